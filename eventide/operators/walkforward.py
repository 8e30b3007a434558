"""Walk-forward forecasts of the sector index from running weighted sums.

The learner is a weighted straight line on one score whose slope may not be
negative. For one feature the clamped slope is the least-squares answer under
that constraint, and it follows from six sums. So every fold of the walk is a
lookup in running sums, and no model is fitted in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.fixed_values import COARSE_FOLD, FINAL_EVENTS, HORIZONS, MIN_TRAIN, MONOTONE_SCORE, WEIGHT_SCORE
from eventide.functions.linear import lower_hull

SUMS = {
    "s_n": lambda w, x, y: F.lit(1.0),
    "s_w": lambda w, x, y: w,
    "s_wx": lambda w, x, y: w * x,
    "s_wy": lambda w, x, y: w * y,
    "s_wxx": lambda w, x, y: w * x * x,
    "s_wxy": lambda w, x, y: w * x * y,
}


# With a single score level there is no slope; the sums alone cannot tell, as
# their last bits depend on the order of addition.
RANGE = {"x_low": F.min, "x_high": F.max}


def label_table(
    events: DataFrame,
    curves: DataFrame,
    weight_score: dict[str, str] = WEIGHT_SCORE,
    monotone_score: dict[str, str] = MONOTONE_SCORE,
    horizons: list[int] = HORIZONS,
) -> DataFrame:
    """One row per sector, horizon and event date, with the index or null.

    ``events`` holds one event per date, so the table is bounded by the
    calendar: dates x sectors x horizons, however many events there are.
    """
    sectors = F.array(
        *[
            F.struct(
                F.lit(s).alias("sector"),
                F.col(weight_score[s]).cast("double").alias("score"),
                F.col(monotone_score[s]).cast("double").alias("x"),
            )
            for s in weight_score
        ]
    )
    series = events.select("date", F.explode(sectors).alias("s")).select("date", "s.*")
    rows = series.withColumn("h", F.explode(F.lit(horizons)))
    points = curves.select("date", F.inline("curve")).where(F.col("index") != 0)
    points = points.select("date", "sector", "h", F.col("index").alias("y"))
    return rows.join(points, ["date", "sector", "h"], "left")


def _series() -> Window:
    return Window.partitionBy("sector", "h")


def sample_weights(labels: DataFrame) -> DataFrame:
    """Weight of a row: (1 + score^2) x (1 + days since the first usable date / 100)."""
    first = F.min(F.when(F.col("y").isNotNull(), F.col("date"))).over(_series())
    recency = 1.0 + F.datediff("date", first) / 100.0
    return labels.withColumn("w", (1.0 + F.col("score") * F.col("score")) * recency)


def fold_starts(labels: DataFrame, coarse: int = COARSE_FOLD) -> DataFrame:
    """Rank of each date and the rank at which its fold starts.

    While more than ``coarse`` dates remain, folds hold ``coarse`` dates; the
    last ones are single.
    """
    ordered = _series().orderBy("date")
    out = labels.withColumns(
        {"i": F.row_number().over(ordered) - 1, "n_dates": F.count(F.lit(1)).over(_series())}
    )
    coarse_folds = F.greatest(F.ceil((F.col("n_dates") - coarse) / coarse), F.lit(0))
    start = F.when(F.col("i") < coarse_folds * coarse, (F.floor(F.col("i") / coarse) * coarse)).otherwise(F.col("i"))
    return out.withColumn("fold_start", start.cast("int"))


def fold_report(folds: DataFrame) -> DataFrame:
    """Train and test sizes of each fold; ``folds`` is one series of ranked dates."""
    return folds.groupBy("fold_start").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("test_size")
    ).select("fold_start", "first_date", "last_date", "test_size", F.col("fold_start").alias("train_size"))


def _terms() -> dict[str, Column]:
    usable = F.col("y").isNotNull()
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    terms = {name: F.when(usable, term(w, x, y)).otherwise(0.0) for name, term in SUMS.items()}
    return terms | {name: F.when(usable, x) for name in RANGE}


def _totals(terms: dict[str, Column], window) -> dict[str, Column]:
    """The six sums and the range of the score over a window."""
    sums = {name: F.coalesce(F.sum(terms[name]).over(window), F.lit(0.0)) for name in SUMS}
    return sums | {name: pick(terms[name]).over(window) for name, pick in RANGE.items()}


def line_forecast(x: Column, min_train: int = MIN_TRAIN, prefix: str = "") -> Column:
    """Forecast of the clamped weighted line from the six sums; null below ``min_train`` rows."""
    n, sw, swx, swy, swxx, swxy = [F.col(prefix + name) for name in SUMS]
    has_range = F.col(f"{prefix}x_low") < F.col(f"{prefix}x_high")
    free_slope = F.when(has_range, (sw * swxy - swx * swy) / (sw * swxx - swx * swx))
    slope = F.greatest(F.coalesce(free_slope, F.lit(0.0)), F.lit(0.0))
    level = (swy - slope * swx) / sw
    return F.when(n >= min_train, level + slope * x)


def fill_gaps(forecasts: DataFrame, pred: str = "pred") -> DataFrame:
    """A missing horizon repeats the one before it; the first falls back to 100."""
    along = Window.partitionBy("sector", "date").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return forecasts.withColumn(pred, F.coalesce(F.last(pred, ignorenulls=True).over(along), F.lit(100.0)))


def walk_forward(labels: DataFrame, coarse: int = COARSE_FOLD, min_train: int = MIN_TRAIN) -> DataFrame:
    """Forecasts that use only dates before the fold of each date.

    All windows share the (sector, h) partitioning: the labels are shuffled
    once, and a series is as long as the calendar.
    """
    return fill_gaps(_walked(labels, coarse, min_train))


def _walked(labels: DataFrame, coarse: int = COARSE_FOLD, min_train: int = MIN_TRAIN, final: bool = False) -> DataFrame:
    """Forecasts before gaps are filled; with ``final``, those of the fit on all dates beside them."""
    rows = fold_starts(sample_weights(labels), coarse)
    past = _series().orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    fold = Window.partitionBy("sector", "h", "fold_start").orderBy("i")
    whole = {f"all_{name}": total for name, total in _totals(_terms(), _series()).items()} if final else {}
    rows = rows.withColumns(_totals(_terms(), past) | whole)
    rows = rows.withColumns({name: F.first(name).over(fold) for name in [*SUMS, *RANGE]})
    can_train = F.col("fold_start") >= min_train
    redone = [line_forecast(F.col("x"), min_train, "all_").alias("final_pred")] if final else []
    pred = F.when(can_train, line_forecast(F.col("x"), min_train)).alias("pred")
    return rows.select("sector", "date", "h", "i", "n_dates", "fold_start", "y", pred, *redone)


def walk_forward_purged(labels: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """Forecasts that use a row only once its label date has passed.

    A row counts from the day after the later of its own date and its label
    date. Rows enter the running sums at that day, questions are put at the
    event date, and the frame takes days strictly before.
    """
    weighted = sample_weights(labels)
    known_on = F.greatest(F.unix_date("date"), F.unix_date(F.date_add("date", F.col("h"))))
    facts = weighted.where(F.col("y").isNotNull()).select(
        "sector", "h", known_on.alias("at"), F.lit(False).alias("asked"),
        *[term.alias(name) for name, term in _terms().items()],
        F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
    )
    questions = weighted.select(
        "sector", "h", F.unix_date("date").alias("at"), F.lit(True).alias("asked"),
        *[F.lit(0.0).alias(name) for name in SUMS], *[F.lit(None).cast("double").alias(name) for name in RANGE],
        "date", "x", "y",
    )
    before = _series().orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    stored = {name: F.col(name) for name in [*SUMS, *RANGE]}
    summed = facts.unionByName(questions).withColumns(_totals(stored, before))
    forecasts = summed.where("asked").withColumn("pred", line_forecast(F.col("x"), min_train))
    return fill_gaps(forecasts.select("sector", "date", "h", "y", "pred"))


def final_overwrite(labels: DataFrame, recent: int = FINAL_EVENTS) -> DataFrame:
    """Walk-forward forecasts with the latest dates redone by one line per sector and horizon, fitted on all dates.

    Those rows are in-sample and say so in ``source``; honest scoring must
    leave them out. Both forecasts come from one pass over one partitioning.
    """
    rows = fill_gaps(_walked(labels, final=True))
    is_recent = F.col("i") >= F.col("n_dates") - recent
    return rows.select(
        "sector", "date", "h", "y",
        F.when(is_recent, F.coalesce("final_pred", F.lit(100.0))).otherwise(F.col("pred")).alias("pred"),
        F.when(is_recent, "final").otherwise("honest").alias("source"),
    )


def live_forecasts(labels: DataFrame) -> DataFrame:
    """Forecasts of the final lines, fitted on all dates; null where a series has too few, as nothing is filled."""
    return _walked(labels, final=True).select("sector", "date", "h", F.col("final_pred").alias("pred"))


def trajectory_arrays(forecasts: DataFrame) -> DataFrame:
    """One row per sector and date with the forecasts as an array in horizon order."""
    points = F.sort_array(F.collect_list(F.struct("h", "pred")))
    return forecasts.groupBy("sector", "date").agg(points.alias("p")).select(
        "sector", "date", F.col("p.pred").alias("predicted_trajectory"), F.col("p.h").alias("horizons")
    )


def isotonic_levels(labels: DataFrame) -> DataFrame:
    """Non-decreasing effect of the score on the index, per sector and horizon.

    Rows are first reduced to weighted means per score level. Levels whose means fall are pooled: the
    fitted means are the slopes of the lower hull of the running sums, built by one fold over the
    levels of a series with a stack, so a series of n levels takes n log n steps.
    """
    weighted = sample_weights(labels).where(F.col("y").isNotNull())
    levels = weighted.groupBy("sector", "h", "x").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")
    )
    upto = Window.partitionBy("sector", "h").orderBy("x")
    levels = levels.withColumns({"k": F.row_number().over(upto), "sw": F.sum("w").over(upto), "swy": F.sum("wy").over(upto)})
    point = F.struct("k", F.col("sw").alias("x"), F.col("swy").alias("y"), F.col("x").alias("score"), "w", "wy")
    packed = levels.groupBy("sector", "h").agg(F.sort_array(F.collect_list(point)).alias("levels"))
    origin = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("w"), F.lit(0.0).alias("wy"))
    packed = packed.withColumn("hull", lower_hull(F.concat(F.array(origin), "levels")))
    ends = packed.select("sector", "h", "levels", F.explode(F.arrays_zip(F.slice("hull", F.lit(1), F.size("hull") - 1).alias("a"), F.slice("hull", F.lit(2), F.size("hull") - 1).alias("b"))).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    pooled = F.slice("levels", a["k"] + 1, b["k"] - a["k"])
    blocks = ends.select("sector", "h", ((b["y"] - a["y"]) / (b["x"] - a["x"])).alias("isotonic_index"), F.explode(pooled).alias("level"))
    return blocks.select(
        "sector", "h", F.col("level.score").alias("score"), F.col("level.w").alias("weight"),
        (F.col("level.wy") / F.col("level.w")).alias("mean_index"), "isotonic_index",
    )
