"""Substring dedup of word windows behind a count-min prefilter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventide.llm import blocks, sketch


def _windows(batch: pa.RecordBatch, width: int, kinds: tuple[int, ...]) -> Iterator[tuple]:
    offs, data = blocks.buffers(batch.column("t"))
    for lo, hi in blocks.row_blocks(offs):
        words = blocks.Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        yield lo, words, words.whole(width), [blocks.mix(blocks.window_ids(words.ids(k), width)) for k in kinds]


def _ids(width: int) -> Callable:
    def ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, whole, (ids,) in _windows(batch, width, (0,)):
            yield ids[whole]

    return ids_of


def _candidates(width: int, bits: int, seen) -> Callable:
    """Windows estimated repeated, counted within the block first, so a hot window leaves a task
    once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sketch.read(seen)
        for batch in batches:
            keys = batch.column("k")
            for lo, words, whole, (a, b) in _windows(batch, width, (0, 1)):
                b = b.astype(np.uint32)
                at = np.flatnonzero(whole)
                at = at[sketch.may_repeat(bitmap, a[at], bits)]
                if not len(at):
                    continue
                at = at[np.lexsort((b[at], a[at]))]
                new = np.concatenate([[True], (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(at)))
                at = at[first]
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(a[at].view(np.int64)), "b": pa.array(b[at].view(np.int32)),
                    "n": pa.array(many, pa.int32()), "k": keys.take(pa.array(words.row[at] + lo)),
                })

    return run


def _cut(width: int, bits: int, seen) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sketch.read(seen)
        for batch in batches:
            keys, lone = batch.column("k"), batch.column("lone")
            for lo, words, whole, (a,) in _windows(batch, width, (0,)):
                at = np.flatnonzero(whole)
                at = at[sketch.may_repeat(bitmap, a[at], bits)]
                single = lone.slice(lo, len(words.offs) - 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                at = at[~np.isin(a[at], single)]
                keep = ~blocks.coverage(at, width, len(words.row))
                text, lengths = words.join(keep)
                kept = np.bincount(words.row[keep], minlength=len(words.offs) - 1)
                yield pa.RecordBatch.from_pydict({
                    "k": keys.slice(lo, len(lengths)), "n_words": pa.array(words.per_row, pa.int64()),
                    "n_removed": pa.array(words.per_row - kept, pa.int64()),
                    "kept_text": blocks.binary_array(text, lengths, pa.string()),
                })

    return run


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """Removes each word covered by a run of ``width`` words that starts more than once in the table.

    Words are ``[^\\x20\\x09-\\x0D]+``, runs stay within a row, and all runs are judged on the input.
    One row per input row: ``key``, n_words, n_removed, kept_text (kept words, one space between).

    1. Every partition makes a count-min sketch of its windows; the merged sketch overestimates.
    2. Windows estimated repeated are counted exactly, under 96 bits, pre-counted per block.
    3. Those counted once were false alarms. They are few, and go back to their rows by key.

    A null text has no words and gives an empty kept_text; null and repeated keys keep their rows
    (a repeated row repeats its windows). An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("k"), blocks.utf8(text, "\n").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    seen, bits = sketch.repeated_bits(rows, _ids(width), blocks.total_bytes(docs, text) // 6)
    found = rows.mapInArrow(_candidates(width, bits, seen), f"a long, b int, n int, k {kind}")
    lone = (
        found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("k").alias("k")).where("n = 1")
        .groupBy("k").agg(F.collect_list("a").alias("lone")).withColumnRenamed("k", "j")
    )
    joined = rows.join(lone, F.col("k").eqNullSafe(F.col("j")), "left").select("k", "t", F.coalesce("lone", F.array().cast("array<bigint>")).alias("lone"))
    out = joined.mapInArrow(_cut(width, bits, seen), f"k {kind}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("k", key)
