"""Forecasts of the sector index from all event scores: clamped lines walked forward, and boosted trees.

Both fit one model per sector and horizon. The monotone scores of a sector may only raise its
forecast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.fixed_values import COARSE_FOLD, HORIZONS, MIN_TRAIN, RISING_SCORES, SECTOR_FEATURES, WEIGHT_SCORE
from eventide.functions.linear import clamped_solve, dot
from eventide.operators.walkforward import fill_gaps, fold_starts, sample_weights

RIDGE = 0.01


def feature_labels(
    events: DataFrame,
    curves: DataFrame,
    features: list[str] = SECTOR_FEATURES,
    rising: dict[str, list[str]] = RISING_SCORES,
    weight_score: dict[str, str] = WEIGHT_SCORE,
    horizons: list[int] = HORIZONS,
) -> DataFrame:
    """One row per sector, horizon and event date: all features, which of them may only raise the index, and the index or null.

    ``events`` holds one event per date, so the table is bounded by the calendar.
    """
    sectors = F.array(
        *[
            F.struct(
                F.lit(s).alias("sector"),
                F.coalesce(F.col(weight_score[s]).cast("double"), F.lit(0.0)).alias("score"),
                F.array(*[F.lit(f in rising[s]) for f in features]).alias("rises"),
            )
            for s in rising
        ]
    )
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    series = events.select("date", values.alias("f"), F.explode(sectors).alias("s")).select("date", "f", "s.*")
    points = curves.select("date", F.inline("curve")).where(F.col("index") != 0)
    points = points.select("date", "sector", "h", F.col("index").alias("y"))
    return series.withColumn("h", F.explode(F.lit(horizons))).join(points, ["date", "sector", "h"], "left")


# ------------------------------------------------------------------ clamped lines


def gram_terms(n: int) -> dict[str, Column]:
    """Terms whose weighted sums are the normal equations of a line over ``n`` features."""
    w, y, f = F.col("w"), F.col("y"), [F.get(F.col("f"), F.lit(i)) for i in range(n)]
    terms = {"s_n": F.lit(1.0), "s_w": w, "s_y": w * y}
    terms |= {f"s_{i}": w * f[i] for i in range(n)} | {f"s_{i}y": w * f[i] * y for i in range(n)}
    terms |= {f"s_{i}_{j}": w * f[i] * f[j] for i in range(n) for j in range(i, n)}
    return {name: F.when(F.col("y").isNotNull(), term).otherwise(0.0) for name, term in terms.items()}


def centred(n: int, ridge: float = RIDGE) -> tuple[Column, Column, list[Column]]:
    """Covariance matrix with the ridge on its diagonal, covariances with the label, and means, from the sums."""
    mean = [F.col(f"s_{i}") / F.col("s_w") for i in range(n)]
    label = F.col("s_y") / F.col("s_w")

    def entry(i: int, j: int) -> Column:
        low, high = min(i, j), max(i, j)
        value = F.col(f"s_{low}_{high}") / F.col("s_w") - mean[i] * mean[j]
        return value + ridge if i == j else value

    matrix = F.array(*[F.array(*[entry(i, j) for j in range(n)]) for i in range(n)])
    return matrix, F.array(*[F.col(f"s_{i}y") / F.col("s_w") - mean[i] * label for i in range(n)]), mean


def fold_grams(labels: DataFrame, n: int = len(SECTOR_FEATURES), coarse: int = COARSE_FOLD) -> DataFrame:
    """Labels with the weighted sums over all dates before the fold of each date.

    Sums run along the dates of a (sector, horizon); all windows share that partitioning, so the
    labels are shuffled once and no fold is fitted in a loop.
    """
    series = Window.partitionBy("sector", "h")
    past = series.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    fold = Window.partitionBy("sector", "h", "fold_start").orderBy("i")
    rows = fold_starts(sample_weights(labels), coarse)
    terms = gram_terms(n)
    rows = rows.withColumns({name: F.coalesce(F.sum(term).over(past), F.lit(0.0)) for name, term in terms.items()})
    return rows.withColumn("sums", F.first(F.struct(*terms)).over(fold)).drop(*terms).select("*", "sums.*").drop("sums")


def walk_forward_lines(labels: DataFrame, n: int = len(SECTOR_FEATURES), coarse: int = COARSE_FOLD, min_train: int = MIN_TRAIN, ridge: float = RIDGE) -> DataFrame:
    """Past-only forecasts by weighted least squares over all features, rising ones clamped at zero.

    A small ridge on the slopes keeps short and one-valued histories solvable. One solution per
    fold; its rows only look it up.
    """
    rows = fold_grams(labels, n, coarse)
    matrix, rhs, mean = centred(n, ridge)
    folds = rows.where((F.col("fold_start") >= min_train) & (F.col("s_n") >= min_train))
    folds = folds.dropDuplicates(["sector", "h", "fold_start"]).select(
        "sector", "h", "fold_start", (F.col("s_y") / F.col("s_w")).alias("level"), F.array(*mean).alias("means"),
        clamped_solve(matrix, rhs, F.col("rises"), n).alias("slopes"),
    )
    away = F.zip_with("f", "means", lambda x, m: x - m)
    pred = F.col("level") + dot(F.col("slopes"), away)
    joined = rows.select("sector", "h", "date", "fold_start", "f", "y").join(folds, ["sector", "h", "fold_start"], "left")
    return fill_gaps(joined.withColumn("pred", pred)).select("sector", "date", "h", "fold_start", "y", "pred")


# ------------------------------------------------------------------ boosted trees


LEAF = "sector string, h int, base double, tree int, low array<double>, high array<double>, gives double"


def _cells(labels: DataFrame) -> DataFrame:
    """Usable labels summed per series and distinct feature values.

    Squared error needs only the sums of weights and weighted labels of rows that share their
    features, so events may repeat without cost.
    """
    usable = sample_weights(labels).where(F.col("y").isNotNull())
    return usable.groupBy("sector", "h", "rises", "f").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n")
    )


def _boosted(trees: int, depth: int, rate: float, penalty: float, least_weight: float, min_train: int):
    """Trees of one series from its cells; every level is a few histograms of (node, feature value)."""

    def run(series, cells):
        import numpy as np
        import pandas as pd

        cells = cells.sort_values("f", key=lambda f: f.map(tuple)).reset_index(drop=True)
        names = ["sector", "h", "base", "tree", "low", "high", "gives"]
        if cells["n"].sum() < min_train:
            return pd.DataFrame(columns=names)
        x, w, wy = np.stack(cells["f"]), cells["w"].to_numpy(), cells["wy"].to_numpy()
        rises = np.array(cells["rises"][0], bool)
        base = wy.sum() / w.sum()
        left = wy - w * base  # residual times weight
        noise = 1e-12 * (wy * wy / w).sum() or 1.0  # a series of one value has nothing to gain but rounding
        cuts, bins = zip(*(np.unique(column, return_inverse=True) for column in x.T))
        out = []
        for tree in range(1, trees + 1):
            node, bounds = np.zeros(len(x), np.int64), np.array([[-np.inf, np.inf]])
            most = max((left * left / w).sum(), noise)  # what splitting into single cells would gain
            low, high = np.full((1, len(cuts)), -np.inf), np.full((1, len(cuts)), np.inf)

            def sums(place, size, nodes):
                at = node * size + place
                return (np.bincount(at, v, nodes * size).reshape(nodes, size) for v in (left, w))

            def value(g, h, bounds):
                return np.clip(g / (h + penalty), bounds[:, :1], bounds[:, 1:])

            def score(g, h, v):
                return 2 * g * v - (h + penalty) * v * v

            for _ in range(depth):
                nodes = len(bounds)
                g, h = sums(0, 1, nodes)
                now = score(g, h, value(g, h, bounds))
                gains, middles, places = [], [], []
                for f, (levels, place) in enumerate(zip(cuts, bins)):
                    gl, hl = (s.cumsum(axis=1)[:, :-1] for s in sums(place, len(levels), nodes))
                    vl, vr = value(gl, hl, bounds), value(g - gl, h - hl, bounds)
                    gain = np.round((score(gl, hl, vl) + score(g - gl, h - hl, vr) - now) / most, 9)
                    sound = (hl >= least_weight) & (h - hl >= least_weight) & ((vl <= vr) | ~rises[f])
                    gains.append(np.where(sound, gain, 0.0))
                    middles.append((vl + vr) / 2)
                    places += [(f, k) for k in range(len(levels) - 1)]
                gains, middles = np.concatenate(gains, axis=1), np.concatenate(middles, axis=1)
                if not gains.size or gains.max() <= 0:
                    break
                best = gains.argmax(axis=1)  # the first of equal gains: lowest feature, then lowest threshold
                split = np.flatnonzero(gains.max(axis=1) > 0)
                right = np.full(nodes, -1)
                right[split] = nodes + np.arange(len(split))
                low, high, bounds = (np.concatenate([a, a[split]]) for a in (low, high, bounds))
                moved = node.copy()
                for k in split:
                    f, cut = places[best[k]]
                    high[k, f] = low[right[k], f] = cuts[f][cut]
                    if rises[f]:
                        bounds[k, 1] = bounds[right[k], 0] = middles[k, best[k]]
                    moved[(node == k) & (bins[f] > cut)] = right[k]
                node = moved
            g, h = sums(0, 1, len(bounds))
            gives = value(g, h, bounds)[:, 0] * rate
            left = left - w * gives[node]
            out += [(*series, base, tree, low[k].tolist(), high[k].tolist(), gives[k]) for k in range(len(gives))]
        return pd.DataFrame(out, columns=names)

    return run


def boosted_series(
    labels: DataFrame,
    trees: int = 100,
    depth: int = 5,
    rate: float = 0.05,
    penalty: float = 1.0,
    least_weight: float = 1.0,
    min_train: int = MIN_TRAIN,
) -> DataFrame:
    """Boosted trees of every sector and horizon: one row per leaf, with its series' base.

    A leaf is a box of feature values, above ``low`` and up to ``high``, and what it ``gives``. All series
    grow in one job, a group each. A level sums residuals and weights per node and feature value and weighs every
    threshold; a split must gain, and among gains equal to nine digits of the most that could be gained, the first feature
    and the lowest threshold win.

    Rising features stay monotone: a split on one is taken only if its right side is not lower, and the
    middle of both values then bounds all leaves below it on either side.

    A series needs ``min_train`` usable dates. A group holds the distinct feature values of its series, 11^4 of
    whole-number scores at most and never more than there are dates, however many events there are.
    """
    grow = _boosted(trees, depth, rate, penalty, least_weight, min_train)
    # A series is much work for its size, so the groups are dealt over all tasks and not gathered by their bytes.
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _cells(labels).repartition(tasks, "sector", "h").groupBy("sector", "h").applyInPandas(grow, LEAF)


def leaf_table(leaves: DataFrame, features: list[str] = SECTOR_FEATURES) -> DataFrame:
    """Leaves with the open and closed end of each feature in columns of their own (null: no end)."""

    def end(name: str, i: int) -> Column:
        value = F.get(F.col(name), F.lit(i))
        return F.when(F.abs(value) < float("inf"), value)

    ends = [end(name, i).alias(f"{name}_{f}") for i, f in enumerate(features) for name in ("low", "high")]
    return leaves.select("sector", "h", "tree", *ends, "gives")


def _answers():
    """Forecasts of distinct feature values by the leaves of their series, a tree at a time."""

    def run(series, asked, leaves):
        import numpy as np

        out = asked[["sector", "h", "f"]].copy()
        out["pred"] = np.nan
        if len(leaves) and len(out):
            x, total = np.stack(out["f"]), np.full(len(out), leaves["base"].iloc[0])
            for _, tree in leaves.groupby("tree"):
                low, high = np.stack(tree["low"]), np.stack(tree["high"])
                inside = ((x[:, None] > low) & (x[:, None] <= high)).all(axis=2)
                total = total + inside @ tree["gives"].to_numpy()
            out["pred"] = total
        return out

    return run


def boosted_forecasts(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """Forecast of each label row by the trees of its series; gaps as in the walk.

    Rows of a series with equal features are answered once, so a group is as bounded as its series' cells.
    """
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["sector", "h"]
    asked = labels.select("sector", "h", "f").distinct().repartition(tasks, *keys).groupBy(*keys)
    answers = asked.cogroup(leaves.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(_answers(), "sector string, h int, f array<double>, pred double")
    answers = answers.withColumn("pred", F.nanvl("pred", F.lit(None).cast("double")))
    joined = labels.select("sector", "h", "date", "f", "y").join(answers, ["sector", "h", "f"], "left")
    return fill_gaps(joined).select("sector", "date", "h", "y", "pred")
