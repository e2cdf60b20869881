"""File formats by name."""

from __future__ import annotations

import os


class UnsupportedFormat(ValueError):
    """The extension is not one that can be read or written."""


# Extension -> format.
EXTENSIONS = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xml": "xml",
    ".nt": "nt", ".xlsx": "xlsx", ".xls": "xlsx", ".txt": "txt", ".parquet": "parquet",
}


def inner_extension(path: str) -> str:
    """Extension below one ``.gz``."""
    name = os.path.basename(path.rstrip("/")).lower()
    if name.endswith(".gz"):
        name = name[:-3]
    return os.path.splitext(name)[1]


def detect_format(path: str) -> str:
    ext = inner_extension(path)
    if ext not in EXTENSIONS:
        raise UnsupportedFormat(f"unsupported format '{ext}', supported: {', '.join(sorted(EXTENSIONS))}")
    return EXTENSIONS[ext]
