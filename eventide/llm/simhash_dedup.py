"""SimHash near-dedup with a grid over popcount vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventide.llm import blocks
from eventide.llm.components import components, local_roots
from eventide.session import stage_table

_EVEN = 0x5555555555555555


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for batch in batches:
            offs, data = blocks.buffers(batch.column("t"))
            for lo, hi in blocks.row_blocks(offs):
                part = data[offs[lo] : offs[hi]]
                part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
                words = blocks.Words(part, offs[lo : hi + 1] - offs[lo])
                joined, sizes = words.join(np.ones(len(words.row), bool))
                # Word places in the joined bytes: one space between the words of a row, none between rows.
                fresh = np.concatenate([[True], words.row[1:] != words.row[:-1]]) if len(words.row) else np.zeros(0, bool)
                begin = np.cumsum(words.lengths + ~fresh) - words.lengths
                end = begin + words.lengths
                many = words.per_row
                first = np.cumsum(many) - many
                shingles = np.where(many > 0, np.maximum(many - width + 1, 1), 0)
                at = blocks.spans(first, shingles)
                owner = np.repeat(np.arange(hi - lo), shingles)
                last = np.minimum(at + width - 1, (first + many - 1)[owner])
                text = joined.tobytes()
                hashes = np.array([digest(text[a:b], 42) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)], np.uint64)
                out = np.zeros(hi - lo, np.uint64)
                some = np.flatnonzero(shingles)
                if len(some):
                    starts = (np.cumsum(shingles) - shingles)[some]
                    ones = np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.int32)
                    out[some] = np.packbits(ones * 2 > shingles[some, None], axis=1).view(np.uint64).ravel()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("k", "c")), pa.array(out.view(np.int64))], ["k", "c", "f"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """SimHash of each row as a long: a bit is 1 if it is set in over half of the XXH64 (seed 42) of
    the row's ``width``-word shingles, repeats included. Columns ``k``, ``c`` (those of ``carry``), ``f``."""
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(key).alias("k"), blocks.utf8(text, "\n").alias("t"), carried.alias("c"))
    kind, along = (rows.schema[c].dataType.simpleString() for c in "kc")
    return rows.mapInArrow(_fingerprints(width), f"k {kind}, c {along}, f long")


def _cells(distance: int) -> list[int]:
    """Masks of the grid. A fingerprint is embedded as 32 counts of set bits, one for each two bits;
    the counts are dealt into twice ``distance`` groups. Two vectors within Manhattan distance
    ``distance`` agree in at least ``distance`` whole groups, so each choice of that many groups is a
    grid whose cells hold every such pair at least once."""
    groups = np.array_split(np.arange(32), 2 * distance)
    return [sum(3 << int(2 * s) for g in pick for s in groups[g]) for pick in combinations(range(2 * distance), distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counts(f: Column) -> Column:
    """The 32 counts of a fingerprint, two bits each."""
    a, b = f.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(f, 1).bitwiseAND(F.lit(_EVEN))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _within(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Pairs within ``distance`` bits: first by the Manhattan distance of their counts, a lower bound
    of it, then exactly."""
    even, one = np.uint64(_EVEN), np.uint64(1)
    x = ((a & even) + ((a >> one) & even)) ^ ((b & even) + ((b >> one) & even))
    low, high = x & even, (x >> one) & even
    near = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low) <= distance
    return near & (np.bitwise_count(a ^ b) <= distance)


def _links(distance: int, small: int = 64):
    """Links within the cells, which arrive in order. A cell of more than ``small`` fingerprints gives
    each linked fingerprint's least reachable one instead of all pairs."""

    def pairs(f: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(f)))
        a, b = [], []
        cell = np.repeat(np.arange(len(starts)), sizes)
        few = np.repeat(sizes <= small, sizes)
        for d in range(1, min(small, int(sizes.max(initial=1)))):
            at = np.flatnonzero(few[:-d] & (cell[d:] == cell[:-d]))
            if not len(at):
                break
            at = at[_within(f[at], f[at + d], distance)]
            a.append(f[at])
            b.append(f[at + d])
        for k in np.flatnonzero(sizes > small):
            g = f[starts[k] : starts[k] + sizes[k]]
            root = local_roots(len(g), lambda lo, hi, g=g: _within(g[lo:hi, None], g[None, :], distance))
            at = np.flatnonzero(root != np.arange(len(g)))
            a.append(g[at])
            b.append(g[root[at]])
        if sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last cell, which may go on in the next batch
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("c", "cell", "f")]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            if not len(cols[0]):
                continue
            new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield from pairs(cols[2][:cut].view(np.uint64), new[:cut])
            held = [x[cut:] for x in cols]
        if held and len(held[0]) > 1:
            yield from pairs(held[2].view(np.uint64), np.arange(len(held[2])) == 0)

    return run


def near_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``f`` within ``distance`` bits."""
    v = counts(F.col("f"))
    grid = F.array(*(F.struct(F.lit(n).alias("c"), v.bitwiseAND(F.lit(_signed(m))).alias("cell")) for n, m in enumerate(_cells(distance))))
    cells = distinct.select("f", F.explode(grid).alias("g")).select("g.c", "g.cell", "f")
    return cells.repartition("c", "cell").sortWithinPartitions("c", "cell").mapInArrow(_links(distance), "a long, b long")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups rows whose SimHash fingerprints are linked by chains of at most ``distance`` bits.

    One row per input row: ``key``, fingerprint (16 hex digits), component_id (smallest key that can
    be reached), kept (the row has that key; of repeated rows all are kept).

    Rows with one fingerprint are one node, so copies, however many, cost one row each. Nodes meet in
    grid cells over their popcount vectors; a large cell gives a forest, not its pairs. Labels come
    from star rounds over the links.

    A-Z are lower-cased; a row with fewer words than ``width`` has one shingle of them all; a null,
    empty or blank text has fingerprint zero and is linked like any other. A null key gets the
    component of its group and is never kept unless the whole group's keys are null. An empty table
    gives no rows. Columns named in ``carry`` go along in a struct ``carried``, beside ``group``, which names
    the group even where two groups share their smallest key; others are ignored.
    """
    marks = stage_table(fingerprints(docs, key, text, width, carry), "fingerprints")
    nodes = marks.groupBy("f").agg(F.min("k").alias("low"))
    linked = components(near_links(nodes.select("f"), distance))
    nodes = nodes.join(linked, F.col("f") == F.col("node"), "left").select("f", "low", F.coalesce("component", "f").alias("component"))
    lows = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(lows, "component").select("f", "component", "component_id")
    return marks.join(nodes, "f").select(
        F.col("k").alias(key), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id",
        F.col("k").eqNullSafe(F.col("component_id")).alias("kept"), *([F.col("component").alias("group"), F.col("c").alias("carried")] if carry else []),
    )
