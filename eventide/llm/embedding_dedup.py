"""Embedding near-dedup with randomised-rotation binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventide.llm.components import components
from eventide.session import stage_table


def _rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Unit centres of a bounded sample by spherical k-means."""
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:k]]
    for _ in range(rounds):
        home = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def _rows(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), kind).reshape(batch.num_rows, -1))


def _encode(centres, turn: np.ndarray, kind: str):
    """Home cell, cosine to its centre, raw vector, sign code of the rotated unit vector, and the
    code's correction factor: the inner product of the vector with its own code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("embedding")).astype(kind)
            x = _unit(raw)
            cos = x.astype(np.float32) @ c.T
            home = np.argmax(cos, axis=1)
            y = x @ turn
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n": batch.column("n"), "home": pa.array(home, pa.int32()),
                "cos": pa.array(cos[np.arange(len(x)), home], pa.float64()), "raw": pa.array([r.tobytes() for r in raw], pa.binary()),
                "code": pa.array([r.tobytes() for r in np.packbits(y > 0, axis=1)], pa.binary()),
                "factor": pa.array(np.abs(y).sum(axis=1) / math.sqrt(y.shape[1])),
            })

    return run


def _visits(centres, low: np.ndarray, threshold: float, kind: str, widths: float):
    """The cells of lower number that may hold a partner. A partner at cosine t with cosine m to its
    own centre gives this row a cosine of t m to that centre, give or take the width of a random
    direction; a cell is visited from its members' low m and ``widths`` such widths on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        spread = np.sqrt(np.maximum(1 - threshold**2, 0) * np.maximum(1 - low**2, 0) / max(c.shape[1] - 1, 1))
        limit = threshold * low - widths * spread
        for batch in batches:
            if not batch.num_rows:
                continue
            home = batch.column("home").to_numpy()
            near = (_rows(batch, kind).astype(np.float32) @ c.T >= limit[None, :]) & (np.arange(len(c))[None, :] < home[:, None])
            row, cell = np.nonzero(near)
            row, cell = np.concatenate([np.arange(len(home)), row]), np.concatenate([home, cell])
            for lo in range(0, len(row), 20_000):
                part = batch.take(pa.array(row[lo : lo + 20_000]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[lo : lo + 20_000], pa.int32())], [*part.schema.names, "cell"])

    return run


def _compare(threshold: float, width: float, kind: str):
    """Links among the rows of one pair of blocks of a cell. The code of one side and the rotated
    vector of the other estimate their inner product without bias; a pair is dropped if it lies under
    the threshold even at the upper bound, and recomputed in double precision otherwise."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        bi, bj = int(group["bi"].iloc[0]), int(group["bj"].iloc[0])
        group = group.sort_values(["block", "id"], kind="stable")
        x = _unit(np.frombuffer(b"".join(group["raw"]), kind).reshape(len(group), -1))
        dim = x.shape[1]
        turned = (x @ _rotation(dim)).astype(np.float32)
        packed = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1)
        factor = group["factor"].to_numpy(np.float32)
        ids, size = group["id"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        at_home, block = group["at_home"].to_numpy(bool), group["block"].to_numpy()
        left, right = (np.flatnonzero(block == b) for b in (bi, bj))
        if not len(left) or not len(right):
            return none
        signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
        found = []
        slack = np.sqrt(1 - np.minimum(factor, 1) ** 2)
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            t = (signs[rows] @ turned[right].T) / np.float32(math.sqrt(dim))
            f, s = factor[rows, None], slack[rows, None]
            sure = f * t + s * np.sqrt(np.maximum(1 - t * t, 0))
            likely = t / f + width * s / f / math.sqrt(max(dim - 1, 1))
            a, b = np.nonzero(np.minimum(sure, likely) >= threshold - 1e-4)
            a, b = rows[a], right[b]
            keep = (at_home[a] | at_home[b]) & ((a < b) if bi == bj else True)
            a, b = a[keep], b[keep]
            exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            found.append((a[exact], b[exact]))
        a, b = (np.concatenate(p) for p in zip(*found, strict=True))
        if not len(a):
            return none
        total = np.zeros(len(group), np.int64)
        np.add.at(total, a, size[b])
        np.add.at(total, b, size[a])
        linked, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        p, q = place[: len(a)], place[len(a) :]
        root = np.arange(len(linked))
        while True:
            new = root.copy()
            np.minimum.at(new, p, root[q])
            np.minimum.at(new, q, root[p])
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"id": ids[linked], "n": total[linked], "root": ids[linked[root]]})

    return run


def embedding_dedup(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
    sample: int = 20_000, block: int = 2048, width: float = 6.0, widths: float = 2.0,
) -> DataFrame:
    """Links all vectors with cosine of ``threshold`` or more and labels their components.

    One row per input row: ``key``, n_links (other vectors linked directly), component_id (least key
    reachable), kept (it is its own component's least).

    Equal vectors are one node with a count. Every node goes to the nearest of about 4 sqrt(n)
    centres, fitted on at most ``sample`` nodes, and visits the lower cells that may hold a partner;
    ``widths`` sets how far it looks (2: about 97 in 100 pairs just at the threshold, nearly all closer
    ones; measured in the tests against brute force). Cells are cut into pairs of blocks of about
    ``block`` nodes. In a pair of blocks, one-bit codes of the randomly rotated vectors with their
    correction factors estimate each inner product. A pair is dropped when the smaller of a certain
    bound and a confidence bound (``width`` standard widths) is under the threshold; otherwise its
    cosine is computed in double precision. Each pair of blocks gives link counts and a forest, never
    its pairs.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
    different lengths neither. Keys are long; of a key that comes several times each row counts, and a
    null key is a row without links to count its own (component null, kept false). An empty table
    gives no rows. Other columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("embedding"))
    fine = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    good = rows.where(fine & F.col("id").isNotNull())
    classes = stage_table(good.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vectors")
    found = []
    for (dim,) in classes.select(F.size("embedding")).distinct().collect():
        found.append(_linked(classes.where(F.size("embedding") == dim), dim, threshold, sample, block, width, widths))
    lone = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not found:
        out = lone
    else:
        nodes = found[0]
        for more in found[1:]:
            nodes = nodes.unionByName(more)
        own = good.join(nodes.withColumnRenamed("id", "node"), "embedding").select("id", F.col("n_links"), F.col("component_id"))
        out = own.unionByName(lone.join(good.select("id").distinct(), "id", "left_anti"))
        odd = rows.where(~fine & F.col("id").isNotNull()).join(good.select("id").distinct(), "id", "left_semi")
        out = out.unionByName(odd.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _linked(classes: DataFrame, dim: int, threshold: float, sample: int, block: int, width: float, widths: float) -> DataFrame:
    """Nodes of one length: embedding, id, n_links (with the node's own copies), component_id."""
    spark = classes.sparkSession
    drawn = classes.orderBy(F.xxhash64("id")).limit(sample).select("embedding").toArrow()
    points = _unit(_matrix(drawn.column(0).combine_chunks()))
    n = classes.count()
    k = int(min(4096, max(1, len(points) // 8), 4 * math.isqrt(n) + 1))
    centres = spark.sparkContext.broadcast(_fit(points.astype(np.float32), k))
    kind = "float32" if classes.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"
    schema = "id long, n long, home int, cos double, raw binary, code binary, factor double"
    coded = stage_table(classes.mapInArrow(_encode(centres, _rotation(dim), kind), schema), "codes")
    low = np.ones(k)
    for r in coded.groupBy("home").agg(F.percentile_approx("cos", 0.05).alias("low")).collect():  # one row per centre
        low[r.home] = r.low
    visits = coded.mapInArrow(_visits(centres, low, threshold, kind, widths), schema + ", cell int")
    visits = stage_table(visits.withColumn("at_home", F.col("home") == F.col("cell")).drop("cos", "home"), "visits")
    many = visits.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = visits.join(many, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("*", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "other")
    links = stage_table(placed.groupBy("cell", "bi", "bj").applyInPandas(_compare(threshold, width, kind), "id long, n long, root long"), "links")
    total = links.groupBy("id").agg(F.sum("n").alias("m"))
    labels = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return (
        classes.join(total, "id", "left").join(labels, F.col("id") == F.col("node"), "left")
        .select("embedding", "id", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
