"""Byte-level BPE ids for many texts.

A byte-level pre-tokenizer never lets a token run over the place before a space that a non-space follows: what
precedes ends there and the space belongs to the next word. Very long texts are encoded in stretches cut at such
places, so memory is bounded.

Ids come from the tokenizer file's own library. Where the file's merges are in the order of their ids, a rank encoder
made from the same file gives the same ids several times faster; it takes the stretches in Latin letters, on which
both agree about what a letter is. A stretch on which the rank encoder gives up, as with a million white-space
characters in a row, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import groupby

import numpy as np

CUT = re.compile(r"(?= \S)")
NOT_LATIN = re.compile(r"[^\x00-\u024f]")
MOST_CHARS = 262_144


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rank_encoder(path: str):
    """A rank encoder with the file's vocabulary, or None where the file is of another kind."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, steps = file["model"], file.get("pre_tokenizer") or {}
    plain = file.get("normalizer") is None and steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. One per tokenizer file and worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = rank_encoder(path)

    def encode(self, text: str) -> bytes:
        if len(text) <= MOST_CHARS:
            return self._ids(text)
        out, at = [], 0
        while at < len(text):
            place = CUT.search(text, at + MOST_CHARS)
            end = place.start() if place else len(text)
            out.append(self._ids(text[at:end]))
            at = end
        return b"".join(out)

    def _ids(self, text: str) -> bytes:
        if self.ranks is None:
            return self._slow(text)
        if NOT_LATIN.search(text) is None:
            return self._fast(text)
        # runs of words in other letters go to the library, the rest does not
        parts = groupby(CUT.split(text), key=lambda piece: NOT_LATIN.search(piece) is None)
        return b"".join([(self._fast if latin else self._slow)("".join(run)) for latin, run in parts])

    def _fast(self, text: str) -> bytes:
        try:
            ids = self.ranks.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern gives up on about a million white-space characters in a row
            return self._slow(text)
        return ids.astype("<u4", copy=False).tobytes()

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
