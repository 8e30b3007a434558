"""Connected components by alternating star operations, one stage table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventide.session import stage_table


def local_roots(n: int, neighbours) -> "np.ndarray":  # noqa: F821
    """Least reachable place for each of ``n`` places. ``neighbours(lo, hi)`` gives the links of the
    places lo to hi as a boolean block of hi - lo rows and ``n`` columns."""
    import numpy as np

    root = np.arange(n)
    while True:
        new = root.copy()
        for lo in range(0, n, 512):
            hi = min(n, lo + 512)
            linked = neighbours(lo, hi)
            new[lo:hi] = np.minimum(new[lo:hi], np.where(linked, root[None, :], n).min(axis=1))
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """Nodes (long) with the least node they reach, from links (a, b): columns node, component.

    Large star, then small star: every node points its larger neighbours at the least node it sees.
    All work is joins and minima of edges, so no component and no node's neighbourhood has to fit
    anywhere. Nodes without a link to another node do not appear.
    """
    link = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    link, before = stage_table(link, "links"), None
    while True:
        state = link.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before or not state.n:
            break
        before = state
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        link = stage_table(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
    roots = link.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return link.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
