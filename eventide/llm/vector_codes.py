"""Product codes of integer vectors, nearest entries found exactly by distances to fixed pivots."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventide.session import stage_table

BLOCK_ROWS = 4096
#: Squared distances stay below 2**53 under this size of a component, for parts of up to 32 components.
PLAIN = 1 << 23


def _integers(flat: np.ndarray, plain: bool) -> np.ndarray:
    """floor(256 * x), as Python integers where a component is too large for machine words."""
    if plain:
        return np.floor(flat * 256.0).astype(np.int64)
    exact = [math.floor(x * 256) if abs(x) < 2.0**60 else int(x) * 256 for x in flat.tolist()]
    return np.array(exact, object)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the first entries that lie far apart: the first, then whichever is farthest from those chosen."""
    chosen, far = [0], _squared(entries, entries[0])
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, _squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points to pivots as 32-bit floats, rounded by less than 2**-23 of their size. Python
    integers may exceed floats: their distances count as zero, which prunes nothing."""
    if points.dtype == object:
        return np.zeros((len(points), len(pivots)), np.float32)
    return np.sqrt(np.stack([_squared(points, p).astype(np.float64) for p in pivots], axis=1)).astype(np.float32)


def nearest(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point (ties: the lower) and its squared distance, both exact.

    By the triangle inequality |d(point, pivot) - d(entry, pivot)| never exceeds d(point, entry), so
    the largest such difference over the pivots bounds an entry from below. The entries of the three least
    bounds are measured in that order; then every entry whose bound, less the rounding of its floats, does
    not exceed the best distance is measured as well. ``seen`` gathers the number of exact distances.
    """
    own = pivot_distances(entries, pivots)
    n, m, rows = len(points), len(entries), np.arange(len(points))
    bound = np.zeros((n, m), np.float32)
    for p in range(own.shape[1]):
        gap = to_pivots[:, p, None] - own[None, :, p]
        np.abs(gap, out=gap)
        gap -= (to_pivots[:, p, None] + own[None, :, p]) * np.float32(2.0**-21)
        np.maximum(bound, gap, out=bound)
    best, at = None, None
    for _ in range(min(3, m)):
        e = np.argmin(bound, axis=1)
        d = _squared(points, entries[e])
        bound[rows, e] = np.inf
        if best is None:
            best, at = d, e
        else:
            closer = (d < best) | ((d == best) & (e < at))
            best, at = np.where(closer, d, best), np.where(closer, e, at)
    # The root is rounded up, so that an entry as near as the best is never pruned.
    reach = np.full(n, np.inf, np.float32) if best.dtype == object else np.sqrt(best.astype(np.float64)).astype(np.float32) * np.float32(1 + 2.0**-20)
    r, e = np.nonzero(bound <= reach[:, None])
    if seen is not None:
        seen.append(n * min(3, m) + len(r))
    if len(r):
        d = _squared(points[r], entries[e])
        order = np.lexsort((e, d, r)) if d.dtype != object else np.array(sorted(range(len(r)), key=lambda i: (r[i], d[i], e[i])))
        first = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]
        r, d, e = r[first], d[first], e[first]
        closer = (d < best[r]) | ((d == best[r]) & (e < at[r]))
        best[r[closer]], at[r[closer]] = d[closer], e[closer]
    return at, best


def _small(values: np.ndarray) -> np.ndarray:
    """An integer block in the narrowest machine type that holds it."""
    top = int(np.abs(values).max(initial=0))
    kind = np.int16 if top < 1 << 15 else np.int32
    return values.astype(kind)


def _stored(batch: pa.RecordBatch, width: int, parts: int, pivots: int, plain: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Integer parts and pivot distances of a batch, in blocks of rows."""
    for lo in range(0, batch.num_rows, BLOCK_ROWS):
        rows = slice(lo, min(lo + BLOCK_ROWS, batch.num_rows))
        n = rows.stop - rows.start
        if plain:
            raw = batch["ints"].slice(lo, n).to_pylist()
            ints = np.stack([np.frombuffer(b, np.int16 if len(b) == 2 * width else np.int32) for b in raw]).astype(np.int64)
        else:
            ints = _integers(batch["vector"].slice(lo, n).flatten().to_numpy(zero_copy_only=False), False).reshape(n, width)
        near = np.frombuffer(b"".join(batch["near"].slice(lo, n).to_pylist()), np.float32).reshape(n, parts, pivots)
        yield rows, ints.reshape(n, parts, width // parts), near


def _limbs(total: int) -> list[int]:
    """A whole number as signed digits of base 2**32, so that sums of any size add up as longs."""
    out = []
    while not -(1 << 32) < total < 1 << 32:
        out.append(total & 0xFFFFFFFF)
        total >>= 32
    return [*out, total]


def vector_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64,
    rounds: int = 2, pivots: int = 3,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the final codebooks (one array, entry by component, for each part).

    One row per kept vector: ``key``, codes (array of indexes, by part), error (squared distances
    summed over the parts) and label_error (error summed over equal labels, nulls together). Null
    vectors and those with null or non-finite components are dropped. A component x counts as floor(256 x); vectors are cut
    into ``parts`` equal consecutive parts. A part's codebook starts as that part of the ``entries``
    smallest keys; each round assigns every part to its nearest entry (ties: the lower index) and replaces
    an entry by the floor of its parts' mean; unused entries stay. A last assignment gives the codes.

    The distances of all parts to a few fixed pivots, drawn from the first codebook, are computed once and stored
    beside the narrowed integers. Each round measures its entries against the pivots only; differences
    of these distances order and prune the exact integer evaluations (``nearest``). A round sends one sum per
    partition, entry and component through a shuffle; the driver sees codebooks only, whose size the parameters fix.

    Repeated rows count each; among equal keys the least vector comes first and null keys come last. The
    smallest key's vector sets the width: vectors of another length are dropped, and all of them if the
    width is no positive multiple of ``parts``. Fewer vectors than ``entries`` give shorter codebooks; an empty table gives
    no rows and no codebooks. Components too large for machine words are computed as Python integers, slowly and without pruning;
    an error beyond a long is null, and so is its label's. Other columns are ignored; no limit on a vector's length.
    """
    value = F.col(vector).cast("array<double>")
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), value.alias("vector")).where(F.col("vector").isNotNull() & ~odd)
    schema = f"key {vectors.schema[key].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, codes array<int>, error bigint"
    least = [F.col("key").asc_nulls_last(), F.col("vector").asc(), F.col("label").asc()]
    width = kept.select("key", "vector", "label").orderBy(*least).limit(1).select(F.size("vector").alias("n")).first()
    width = width.n if width else 0
    if not width or width % parts:
        none = kept.limit(0).select("key", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("bigint").alias("error"))
        return _labelled(none, key), []
    kept = kept.where(F.size("vector") == width)
    top = kept.agg(F.max(F.array_max(F.transform("vector", F.abs))).alias("top")).first().top
    plain = top < (PLAIN / 256) and width // parts <= 32
    first = np.array([r.vector for r in kept.orderBy(*least).limit(entries).select("vector").collect()], np.float64)
    books = _integers(first.ravel(), plain).reshape(len(first), parts, width // parts)
    books = [books[:, p].copy() for p in range(parts)]
    fixed = [choose_pivots(b, pivots) for b in books]
    count = len(fixed[0])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                ints = _integers(part["vector"].flatten().to_numpy(zero_copy_only=False), plain).reshape(part.num_rows, width)
                cut = ints.reshape(part.num_rows, parts, -1)
                near = np.stack([pivot_distances(cut[:, p], fixed[p]) for p in range(parts)], axis=1)
                narrow = _small(ints) if plain else None
                rows = [("near", pa.array([r.tobytes() for r in near], pa.binary()))]
                rows.append(("ints", pa.array([r.tobytes() for r in narrow], pa.binary())) if plain else ("vector", part["vector"]))
                yield pa.RecordBatch.from_arrays([part["key"], part["label"], *[c for _, c in rows]], ["key", "label", *[n for n, _ in rows]])

    kept_as = schema.split(", codes")[0] + (", near binary, ints binary" if plain else ", near binary, vector array<double>")
    stored = stage_table(kept.mapInArrow(store, kept_as), "vector-parts")

    def assigned(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple]:
        for rows, ints, near in _stored(batch, width, parts, count, plain):
            found = [nearest(ints[:, p], near[:, p], books[p], fixed[p]) for p in range(parts)]
            yield rows, ints, [f[0] for f in found], [f[1] for f in found]

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(books[p]), width // parts + 1), np.int64 if plain else object) for p in range(parts)]
            for batch in batches:
                for _, ints, codes, _ in assigned(batch, books):
                    for p in range(parts):
                        if plain:
                            weigh = [np.bincount(codes[p], weights=c, minlength=len(books[p])) for c in ints[:, p].T]
                            weigh.append(np.bincount(codes[p], minlength=len(books[p])))
                            total[p] += np.stack(weigh, axis=1).astype(np.int64)
                        else:
                            np.add.at(total[p], codes[p], np.concatenate([ints[:, p], np.ones((len(ints), 1), object)], axis=1))
            digits = [(p, e, c, i, d) for p in range(parts) for e, row in enumerate(total[p].tolist()) if row[-1] for c, s in enumerate(row) for i, d in enumerate([s] if plain else _limbs(s))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in digits], pa.int64()) for i in range(5)], ["part", "entry", "place", "limb", "digit"])

        moved = stored.mapInArrow(sums, "part long, entry long, place long, limb long, digit long")
        moved = moved.groupBy("part", "entry", "place", "limb").agg(F.sum("digit").alias("digit")).collect()
        total: dict = {}
        for r in moved:
            total[r.part, r.entry, r.place] = total.get((r.part, r.entry, r.place), 0) + (r.digit << (32 * r.limb))
        books, size = [b.copy() for b in books], width // parts
        for (p, e, c), s in total.items():
            if c < size:
                books[p][e, c] = s // total[p, e, size]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, codes, far in assigned(batch, books):
                part = batch.slice(rows.start, rows.stop - rows.start)
                flat = pa.array(np.stack(codes, axis=1).astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, parts, dtype=np.int32)), flat)
                error = np.sum(np.stack(far, axis=1), axis=1)
                error = pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part["key"], part["label"], lists, error], ["key", "label", "codes", "error"])

    return _labelled(stored.mapInArrow(coded, schema), key), books


def _labelled(coded: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Adds the error of all rows of a label. Sums are small; a hot label's rows are dealt by salt over ``salts`` copies of them."""
    coded = stage_table(coded.withColumn("salt", F.pmod(F.xxhash64("key", "codes"), F.lit(salts))), "vector-codes")
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    by_label = by_label.select("of", "label_error", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("s"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("s")))
    return joined.select(F.col("key").alias(key), "codes", "error", "label_error")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' decimal components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_text(codes: Column) -> Column:
    """Codes as lowercase hexadecimal, two digits each."""
    return F.concat_ws("", F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
