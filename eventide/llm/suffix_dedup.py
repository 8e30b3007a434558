"""Suffix-array dedup of byte strings by bucket-pointer refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventide.llm import blocks, sketch

#: Bytes of input per bucket of suffixes; buckets grow in number, not in size.
_BYTES_PER_BUCKET = 4 << 20
#: Bytes of text at a time where only leaders are asked for: nothing is gained by larger blocks there.
_LEADER_BLOCK = 1 << 18
_LAST = np.iinfo(np.int64).max
_PACKED = "bucket int, lens binary, text binary, lead binary, code binary, key binary, hash binary, start binary"


def _gram_ids(data: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of all q-grams (q of eight or more), from eight bytes on by doubling."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    ids, have = blocks.mix(np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,)).copy()), 8
    while have * 2 <= q:
        ids, have = blocks.combine(ids[:-have], ids[have:]), have * 2
    if have < q:
        ids = blocks.combine(ids[: have - q], ids[q - have :])
    return blocks.mix(ids)


def _least(ids: np.ndarray, span: int) -> np.ndarray:
    """Least identifier of every run of ``span`` places."""
    have = 1
    while have * 2 <= span:
        ids, have = np.minimum(ids[:-have], ids[have:]), have * 2
    return np.minimum(ids[: have - span], ids[span - have :]) if have < span else ids


def _stretches(batch: pa.RecordBatch, width: int, block: int = blocks.BLOCK) -> Iterator[tuple]:
    """Blocks with their stretches: runs of windows with one leading gram, the least of the
    half-width grams in the window. Equal windows have equal leaders, wherever they stand. (Least
    values crowd at the low end, so they are mixed again.)"""
    offs, data = blocks.buffers(batch.column("t"))
    gram = width // 2 + 1
    for lo, hi in blocks.row_blocks(offs, block):
        part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts = blocks.spans(at[:-1], np.maximum(np.diff(at) - width + 1, 0))
        if not len(starts):
            continue
        lead = _least(_gram_ids(part, gram), width - gram + 1)[starts]
        new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(starts))) + width - 1
        row = np.searchsorted(at, starts[first], "right") - 1 + lo
        yield part, starts[first], lengths, blocks.mix(lead[first]), row, starts[first] - (offs[row] - offs[lo])


def _ids(width: int) -> Callable:
    def ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, lead, _, _ in _stretches(batch, width, _LEADER_BLOCK):
            yield lead

    return ids_of


def _same(texts: pa.Array) -> tuple[np.ndarray, int]:
    """A number per distinct byte string, compared whole, and how many there are."""
    coded = texts.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _pack(width: int, bits: int, n_buckets: int, seen) -> Callable:
    """Stretches whose leader may be repeated, each distinct one of a block once with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sketch.read(seen)
        for batch in batches:
            keys = batch.column("k").fill_null(_LAST).to_numpy(zero_copy_only=False)
            hashes = batch.column("h").to_numpy(zero_copy_only=False)
            for data, at, lengths, lead, row, start in _stretches(batch, width):
                hit = sketch.may_repeat(bitmap, lead, bits)
                at, lengths, lead, row, start = (x[hit] for x in (at, lengths, lead, row, start))
                if not len(at):
                    continue
                code, n = _same(blocks.binary_array(data[blocks.spans(at, lengths)], lengths))
                one = np.zeros(n, np.int64)
                one[code[::-1]] = np.arange(len(code))[::-1]
                bucket = (lead[one] % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n)
                one, bucket = one[order], bucket[order]
                occ = np.argsort(rank[code], kind="stable")
                code = rank[code][occ]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(cuts[1:], n)
                out = []
                for lo, hi, a, b in zip(cuts, ends, np.searchsorted(code, cuts), np.searchsorted(code, ends), strict=True):
                    these, places = one[lo:hi], occ[a:b]
                    out.append({
                        "bucket": int(bucket[lo]), "lens": lengths[these].astype(np.uint32).tobytes(),
                        "text": pa.compress(data[blocks.spans(at[these], lengths[these])].tobytes(), "zstd", asbytes=True),
                        "lead": (lead[these] >> np.uint64(32)).astype(np.uint32).tobytes(),
                        "code": (code[a:b] - lo).astype(np.uint32).tobytes(), "key": keys[row[places]].tobytes(),
                        "hash": hashes[row[places]].tobytes(), "start": start[places].astype(np.uint32).tobytes(),
                    })
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("lens", "text", "lead", "code", "key", "hash", "start"))]))

    return run


def refine(text: np.ndarray, width: int) -> np.ndarray:
    """Bucket identifier of the ``width``-byte string at every place (text is padded at its end).

    Suffixes are first bucketed by their first eight bytes. Buckets of one are done. The others are
    refined by sorting on the pair of their own bucket and the bucket of the suffix as many bytes
    later as buckets are deep; the refined identifiers take the place of the old ones, so every
    round reuses the updates of the one before and doubles the depth.
    """
    n = len(text)
    raw = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    eight = np.ndarray((n + width,), np.uint64, raw, strides=(1,))
    _, ids, size = np.unique(eight, return_inverse=True, return_counts=True)
    depth = 8
    while depth < width:
        step = min(depth, width - depth)
        active = np.flatnonzero(size[ids[: n + width - step]] > 1)
        if not len(active):
            break
        top = int(ids.max()) + 1
        pair = ids[active] * top + ids[active + step]
        _, fresh, many = np.unique(pair, return_inverse=True, return_counts=True)
        ids = ids.copy()
        ids[active] = fresh + top
        size = np.concatenate([size, np.zeros(top - len(size), size.dtype), many])
        depth += step
    return ids[:n]


def _resolve(width: int) -> Callable:
    """Places of one bucket whose windows also start under a smaller key."""
    kinds = {"lens": np.uint32, "lead": np.uint32, "code": np.uint32, "key": np.int64, "hash": np.int32, "start": np.uint32}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = {c: [np.frombuffer(x, kind) for x in group[c]] for c, kind in kinds.items()}
        base = np.cumsum([0] + [len(x) for x in parts["lens"]])
        code = np.concatenate([x.astype(np.int64) + b for x, b in zip(parts["code"], base, strict=False)])
        lens, lead, key, hash_, start = (np.concatenate(parts[c]) for c in ("lens", "lead", "key", "hash", "start"))
        lens, start = lens.astype(np.int64), start.astype(np.int64)
        text = np.frombuffer(b"".join(pa.decompress(t, int(n.sum()), "zstd", asbytes=True) for t, n in zip(group["text"], parts["lens"], strict=True)), np.uint8)
        same, n = _same(blocks.binary_array(text, lens, pa.binary()))
        code = same[code]
        least = np.full(n, _LAST)
        np.minimum.at(least, code, key)
        one = np.zeros(n, np.int64)
        one[same] = np.arange(len(same))
        length = lens[one]
        whole = key > least[code]
        found = [(np.flatnonzero(whole), start[whole], start[whole] + length[code[whole]])]

        _, family, many = np.unique(lead[one], return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(many[family] > 1)
        if len(mixed):
            begin = (np.cumsum(lens) - lens)[one[mixed]]
            local = np.cumsum(length[mixed]) - length[mixed]
            ids = refine(text[blocks.spans(begin, length[mixed])], width)
            windows = length[mixed] - width + 1
            places = blocks.spans(local, windows)
            owner = np.repeat(np.arange(len(mixed)), windows)
            _, ids = np.unique(ids[places], return_inverse=True)
            smallest = np.full(int(ids.max()) + 1, _LAST)
            np.minimum.at(smallest, ids, least[mixed][owner])
            gone = np.flatnonzero(least[mixed][owner] > smallest[ids])
            if len(gone):
                new = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (owner[gone][1:] != owner[gone][:-1])])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(gone)) - 1
                who = mixed[owner[gone[head]]]
                a = places[gone[head]] - local[owner[gone[head]]]
                b = places[gone[tail]] - local[owner[gone[head]]] + width
                rest = np.flatnonzero(~whole)
                rest = rest[np.argsort(code[rest], kind="stable")]
                lo, hi = np.searchsorted(code[rest], who), np.searchsorted(code[rest], who, "right")
                occ = rest[blocks.spans(lo, hi - lo)]
                a, b = np.repeat(a, hi - lo), np.repeat(b, hi - lo)
                found.append((occ, start[occ] + a, start[occ] + b))
        occ, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"k": key[occ], "h": hash_[occ], "a": a, "b": b})

    return run


def _with_characters(part: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Bytes that go once every character that lost a byte goes as a whole. Each row begins with a character."""
    if not gone.any():
        return gone
    lead = np.flatnonzero((part & 0xC0) != 0x80)
    return np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(part))))


def _cut(batches: Iterator[pa.RecordBatch], characters: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, data = blocks.buffers(batch.column("t"))
        for lo, hi in blocks.row_blocks(offs):
            at, part = offs[lo : hi + 1] - offs[lo], data[offs[lo] : offs[hi]]
            a, b = (batch.column(c).slice(lo, hi - lo) for c in "ab")
            row = np.repeat(np.arange(hi - lo), np.diff(a.offsets.to_numpy()))
            a, b = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + at[row] for x in (a, b))
            step = np.zeros(len(part) + 1, np.int32)
            np.add.at(step, a, 1)
            np.add.at(step, b, -1)
            gone = np.cumsum(step[:-1]) > 0
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            edges = at[:-1][np.diff(at) > 0]
            head[edges] = gone[edges]
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            removed, lost = sums(gone), _with_characters(part, gone) if characters else gone
            yield pa.RecordBatch.from_pydict({
                "k": batch.column("k").slice(lo, hi - lo), "c": batch.column("c").slice(lo, hi - lo), "n_bytes": pa.array(np.diff(at), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(sums(head), pa.int64()),
                "kept": blocks.binary_array(part[~lost], np.diff(at) - sums(lost)),
            })


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """Removes each byte covered by a ``width``-byte string that also starts under a smaller key.

    Texts are UTF-8 bytes; matches stay within a row, and all are judged on the input. One row per
    input row: ``key``, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary; a cut may
    fall inside a character, unless ``characters`` is set: then kept lacks every character that lost a byte, and is valid UTF-8).

    1. Windows are gathered into stretches with one leading gram. A count-min sketch of the leaders
       drops stretches that cannot be repeated.
    2. The others go to the bucket of their leader: as text, once per block and distinct stretch.
    3. In a bucket, leaders held by one distinct stretch are done. The suffixes of the others are
       sorted by bucket-pointer refinement, whole bytes compared; windows of one final bucket are
       removed from all rows but those of the smallest key.

    A null text is empty. A null key counts as larger than all others. Rows that share a key do not
    remove from each other. An empty table gives no rows. Keys are long. Columns named in ``carry`` go
    along in a struct ``carried``, so no name can clash; others are ignored.
    """
    total = blocks.total_bytes(docs, text)
    with_carried = docs.select(
        F.col(key).cast("long").alias("k"), blocks.utf8(text).alias("t"),
        F.struct(*(F.col(c) for c in carry)).alias("c") if carry else F.struct(F.lit(0).alias("none")).alias("c"),
    ).withColumn("h", F.xxhash64("t").bitwiseAND(0x7FFFFFFF).cast("int"))
    rows = with_carried.drop("c")
    seen, bits = sketch.repeated_bits(rows, _ids(width), total // 12)
    n_buckets = max(64, total // _BYTES_PER_BUCKET)
    packed = rows.mapInArrow(_pack(width, bits, n_buckets, seen), _PACKED)
    gone = packed.groupBy("bucket").applyInPandas(_resolve(width), "k long, h int, a int, b int")
    gone = gone.groupBy(F.col("k").alias("k2"), F.col("h").alias("h2")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    none = F.array().cast("array<int>")
    on = (F.coalesce("k", F.lit(int(_LAST))) == F.col("k2")) & (F.col("h") == F.col("h2"))
    joined = with_carried.join(gone, on, "left").select("k", "t", "c", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    kind = with_carried.schema["c"].dataType.simpleString()
    out = joined.mapInArrow(lambda batches: _cut(batches, characters), f"k long, c {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    out = out.withColumnRenamed("c", "carried") if carry else out.drop("c")
    return out.withColumnRenamed("k", key)
