"""Wavelet matrix of a sequence of token ids, and its file.

Plane by plane, from the highest bit down, the ids' bits are stored and the ids are parted stably: those with a zero
first. Rank on the planes leads from a place to its id, or from an id to how often it occurs before a place; select
leads back from the occurrences to their places. So one file answers access, counting and lookup.

File: the planes' blocks of ``BLOCK`` bits, each compressed by itself where that makes it smaller; the table of
documents; the directory (where each block begins and how many ones precede it); its length; ``MAGIC``. Answering
reads the directory and the blocks that are met, not the file.
"""

from __future__ import annotations

import io
import json
import struct
from collections import OrderedDict
from typing import BinaryIO

import numpy as np
import pyarrow as pa

MAGIC = b"GSWAVE01"
BLOCK = 1 << 16
BLOCK_BYTES = BLOCK // 8
HELD_BLOCKS = 1024


def planes(ids: np.ndarray, width: int) -> list[np.ndarray]:
    """The bit planes of ``ids``, packed eight to a byte, lowest first."""
    out, now = [], ids
    for level in range(width - 1, -1, -1):
        ones = ((now >> now.dtype.type(level)) & now.dtype.type(1)).astype(bool)
        out.append(np.packbits(ones, bitorder="little"))
        now = np.concatenate([now[~ones], now[ones]])
    return out


def encode(ids: np.ndarray, docs: pa.Table) -> bytes:
    """The file of unsigned ``ids``; ``docs`` has a row per document in order, with its ``n_tokens``."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    small = ids.astype(np.uint16 if width <= 16 else np.uint32)
    codec, out, directory = pa.Codec("zstd", compression_level=1), io.BytesIO(), []
    for plane in planes(small, width):
        begins, ones, total = [], [], 0
        for at in range(0, len(plane), BLOCK_BYTES):
            raw = plane[at:at + BLOCK_BYTES]
            begins.append(out.tell()), ones.append(total)
            pressed = codec.compress(raw, asbytes=True)
            out.write(pressed if len(pressed) < len(raw) else raw.tobytes())
            total += int(np.bitwise_count(raw).sum())
        directory.append({"begins": [*begins, out.tell()], "ones": [*ones, total]})
    table_at = out.tell()
    with pa.ipc.new_stream(out, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(docs)
    head = json.dumps({"tokens": len(ids), "width": width, "docs_at": table_at, "docs_end": out.tell(), "planes": directory}).encode()
    out.write(pa.compress(head, codec="zstd", asbytes=True))
    out.write(struct.pack("<QQ", len(head), out.tell() - json.loads(head)["docs_end"]))
    out.write(MAGIC)
    return out.getvalue()


class WaveletFile:
    """Answers from an open file; arrays of places, ids or ranks are answered together."""

    def __init__(self, file: BinaryIO):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        file.seek(max(0, end - 24))
        tail = file.read(24)
        if len(tail) < 24 or tail[16:] != MAGIC:
            raise ValueError("not a whole wavelet file")
        raw, pressed = struct.unpack("<QQ", tail[:16])
        file.seek(end - 24 - pressed)
        head = json.loads(pa.decompress(file.read(pressed), decompressed_size=raw, codec="zstd", asbytes=True))
        self.tokens, self.width, self._docs = head["tokens"], head["width"], (head["docs_at"], head["docs_end"])
        self.begins = [np.array(p["begins"], np.int64) for p in head["planes"]]
        self.ones = [np.array(p["ones"], np.int64) for p in head["planes"]]
        self.zeros = [self.tokens - int(o[-1]) for o in self.ones]
        self._held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def docs(self) -> pa.Table:
        self.file.seek(self._docs[0])
        return pa.ipc.open_stream(self.file.read(self._docs[1] - self._docs[0])).read_all()

    def _open_block(self, plane: int, block: int) -> np.ndarray:
        a, b = self.begins[plane][block:block + 2]
        self.file.seek(int(a))
        data, size = self.file.read(int(b - a)), min(BLOCK_BYTES, (self.tokens + 7) // 8 - block * BLOCK_BYTES)
        if len(data) < size:
            data = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
        return np.frombuffer(data, np.uint8)

    def block(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._held:
            if len(self._held) >= HELD_BLOCKS:
                self._held.popitem(last=False)
            self._held[key] = self._open_block(plane, block)
        self._held.move_to_end(key)
        return self._held[key]

    def _by_block(self, which: np.ndarray):
        order = np.argsort(which, kind="stable")
        edges = np.flatnonzero(np.diff(which[order])) + 1
        for rows in np.split(order, edges):
            if len(rows):
                yield int(which[rows[0]]), rows

    def rank(self, plane: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place, and the bit there (zero behind the end)."""
        ones, bits = np.empty(len(places), np.int64), np.zeros(len(places), bool)
        for block, rows in self._by_block(places // BLOCK):
            if block * BLOCK >= self.tokens:
                ones[rows] = self.ones[plane][-1]
                continue
            data = self.block(plane, block)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(data), dtype=np.int64)])
            inside = places[rows] % BLOCK
            byte, bit = inside // 8, (inside % 8).astype(np.uint8)
            value = np.append(data, np.uint8(0))[byte]
            ones[rows] = self.ones[plane][block] + before[byte] + np.bitwise_count(value & ((np.uint8(1) << bit) - np.uint8(1)))
            bits[rows] = (value >> bit) & 1
        return ones, bits

    def select(self, plane: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Place of the ``rank``-th (from 0) one or zero of a plane."""
        firsts = self.ones[plane][:-1]
        if not bit:
            firsts = np.arange(len(firsts), dtype=np.int64) * BLOCK - firsts
        out = np.empty(len(ranks), np.int64)
        for block, rows in self._by_block(np.searchsorted(firsts, ranks, side="right") - 1):
            places = np.flatnonzero(np.unpackbits(self.block(plane, block), bitorder="little") == bit)
            out[rows] = block * BLOCK + places[ranks[rows] - firsts[block]]
        return out

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``."""
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.tokens):
            raise IndexError("place outside the sequence")
        for plane in range(self.width):
            ones, bits = self.rank(plane, at)
            out = out << 1 | bits
            at = np.where(bits, self.zeros[plane] + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        at = np.array([start, end], np.int64)
        if token < 0 or token >> self.width:
            return 0, 0
        for plane in range(self.width):
            ones, _ = self.rank(plane, at)
            at = self.zeros[plane] + ones if token >> (self.width - 1 - plane) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` occurs in places ``start`` to ``end``, end exclusive."""
        a, b = self._range(token, start, self.tokens if end is None else end)
        return b - a

    def locate(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """The places of ``token``, ascending."""
        a, b = self._range(token, start, self.tokens if end is None else end)
        at = np.arange(a, b, dtype=np.int64)
        for plane in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - plane) & 1
            at = self.select(plane, bit, at - self.zeros[plane] * bit) if len(at) else at
        return at

    def all(self) -> np.ndarray:
        """The whole sequence: planes from the last to the first put every id back to its place."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.tokens, kind)
        for plane in range(self.width - 1, -1, -1):
            blocks = [self._open_block(plane, b) for b in range(len(self.begins[plane]) - 1)]
            packed = np.concatenate(blocks) if blocks else np.zeros(0, np.uint8)
            ones = np.unpackbits(packed, count=self.tokens, bitorder="little").astype(bool)
            back, zeros = np.empty_like(out), self.zeros[plane]
            back[~ones] = out[:zeros]
            back[ones] = out[zeros:] | kind(1 << (self.width - 1 - plane))
            out = back
        return out.astype("<u4")
