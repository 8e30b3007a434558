"""Byte-level helpers shared by the operators: Arrow buffers as numpy arrays, words, rolling identifiers.

Every helper works on one block of rows at a time (about ``BLOCK`` bytes of text, or one longer
row), so the memory of a task does not depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 1 << 20
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _odd() -> tuple[np.ndarray, np.ndarray]:
    """Random odd factors for bytes and for places in a word, of two kinds; made where used."""
    if "odd" not in _tables:
        rng = np.random.default_rng(20240229)
        _tables["odd"] = tuple(rng.integers(1, 2**63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 1 << 16))
    return _tables["odd"]


def utf8(text: Column | str, end: str = "") -> Column:
    """Text as UTF-8 bytes (null: empty), ``end`` appended."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.coalesce(text.cast("string"), F.lit("")), F.lit(end)).cast("binary")


def total_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, one aggregate; sizes sketches and bucket counts."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary or string Arrow array without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offs.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def row_blocks(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def binary_array(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Binary (or string) Arrow array over consecutive slices of ``data``."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.Array.from_buffers(kind or pa.binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all places of the spans, span after span."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K3
    return x ^ (x >> np.uint64(29))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a pair of identifiers, order kept."""
    x = a * _K1 + (b ^ (b >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(32))


def window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Identifiers of all runs of ``width`` consecutive items, by doubling: a run of 2k items is
    the pair of the runs of k items at its start and k places later."""
    have = 1
    while have * 2 <= width and len(ids) > have:
        ids, have = combine(ids[:-have], ids[have:]), have * 2
    if have < width:
        step = width - have
        ids = combine(ids[:-step], ids[step:]) if len(ids) > step else ids[:0]
    return ids


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block whose rows each end in a line feed."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _SPACE):
        self.data, self.offs = data, offs
        gap = gaps[data]
        self.inside = ~gap
        self.starts = np.flatnonzero(self.inside & np.concatenate([[True], gap[:-1]])) if len(data) else np.zeros(0, np.int64)
        self.ends = np.flatnonzero(gap[1:] & self.inside[:-1]) + 1
        self.lengths = self.ends - self.starts
        self.row = np.searchsorted(offs, self.starts, "right") - 1
        self.per_row = np.bincount(self.row, minlength=len(offs) - 1)

    def ids(self, which: int) -> np.ndarray:
        """One 64-bit identifier per word; two independent kinds."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        before = np.cumsum(self.lengths) - self.lengths
        place = np.arange(int(self.lengths.sum())) - np.repeat(before, self.lengths)
        byte, places = _odd()
        part = byte[which][self.data[self.inside]] * places[which][place & 0xFFFF]
        return mix(np.add.reduceat(part, before) + self.lengths.astype(np.uint64))

    def whole(self, width: int) -> np.ndarray:
        """Which windows of ``width`` words lie in one row."""
        n = max(0, len(self.row) - width + 1)
        return self.row[:n] == self.row[width - 1 :] if n else np.zeros(0, bool)

    def join(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept words of each row with one space between: bytes and row lengths."""
        out, mask = self.data.copy(), np.zeros(len(self.data), bool)
        mask[self.inside] = np.repeat(keep, self.lengths)
        last = np.zeros(len(keep), bool)
        at = np.flatnonzero(keep)
        if len(at):
            last[at[np.concatenate([self.row[at][1:] != self.row[at][:-1], [True]])]] = True
        spaced = self.ends[keep & ~last]
        out[spaced], mask[spaced] = 0x20, True
        sums = np.concatenate([[0], np.cumsum(mask)])
        return out[mask], np.diff(sums[self.offs])


def coverage(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places a window of ``width`` beginning at a start covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
