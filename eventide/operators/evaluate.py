"""Forecast quality, forecast display frames, stage counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.fixed_values import UP_INDEX


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def directional_accuracy(forecasts: DataFrame, events_per_date: DataFrame, threshold: float = UP_INDEX) -> DataFrame:
    """Hit rate, recall and precision of "the index rises above the threshold".

    Every event counts, also several on one date; since they share forecast
    and outcome, each date is weighted by its number of events ``n_events``.
    """
    pairs = forecasts.where((F.col("y") > 0) & F.col("pred").isNotNull()).join(events_per_date, "date")
    n = F.col("n_events")
    actual, predicted = F.col("y") > threshold, F.col("pred") > threshold

    def count(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, n).otherwise(0)), F.lit(0)).alias(name)

    sums = pairs.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"),
        count(actual == predicted, "hits"),
        count(actual, "actual_ups"),
        count(predicted, "pred_ups"),
        count(actual & predicted, "true_ups"),
    )
    return sums.select(
        "*",
        _share(F.col("hits"), F.col("total")).alias("accuracy"),
        _share(F.col("true_ups"), F.col("actual_ups")).alias("recall"),
        _share(F.col("true_ups"), F.col("pred_ups")).alias("precision"),
    )


def directional_by_date(forecasts: DataFrame, threshold: float = UP_INDEX) -> DataFrame:
    """The same verdict once per date."""
    actual, predicted = F.col("y") > threshold, F.col("pred") > threshold
    return forecasts.where((F.col("y") > 0) & F.col("pred").isNotNull()).select(
        "date", "y", "pred", actual.alias("actual_up"), predicted.alias("pred_up"), (actual == predicted).alias("hit")
    )


def error_metrics(pairs: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """Root mean square error and mean absolute error."""
    gap = F.col(predicted) - F.col(actual)
    return pairs.where(gap.isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.count(F.lit(1)).alias("n")
    )


def horizon_errors(forecasts: DataFrame) -> DataFrame:
    """Errors per sector and horizon, with the mean of the sector's values.

    The window runs over one row per horizon.
    """
    sector = Window.partitionBy("sector")
    return error_metrics(forecasts, ["sector", "h"], "y", "pred").withColumn("avg_rmse", F.avg("rmse").over(sector))


def forecast_choice(
    events: DataFrame, stored: DataFrame, actuals: DataFrame, margin_days: int = 5, live: DataFrame | None = None, digits: int | None = None
) -> DataFrame:
    """Display frame of each event: forecast and outcome by horizon.

    The stored forecast is shown with its ``source``; a horizon without one
    stays absent, and so does a missing outcome. Events of one date share its
    forecast. The frame starts a few days before the announcement. ``is_high``
    marks events whose forecast exceeds 100, to six digits, at some horizon of
    the sector; it is found once per date, before the events join. Values are rounded to ``digits`` there too, if
    given, and not once per event. Each event meets one row, the points of its date, and opens it.

    Sectors and dates without a stored forecast take that of the ``live`` model, if given: such an event
    is not in the history yet. Horizons without a model stay absent.
    """
    predicted = stored.where(F.col("pred").isNotNull()).select(
        "sector", "date", "h", F.col("pred").alias("value"), "source", F.lit("predicted").alias("kind")
    )
    if live is not None:
        known = stored.select("sector", "date").distinct()
        fresh = live.where(F.col("pred").isNotNull()).join(known, ["sector", "date"], "left_anti")
        predicted = predicted.unionByName(
            fresh.select("sector", "date", "h", F.col("pred").alias("value"), F.lit("live").alias("source"), F.lit("predicted").alias("kind"))
        )
    actual = actuals.where(F.col("y") != 0).select(
        "sector", "date", "h", F.col("y").alias("value"), F.lit("market").alias("source"), F.lit("actual").alias("kind")
    )
    series = Window.partitionBy("date", "sector")
    is_high = F.max((F.col("kind") == "predicted") & (F.round("value", 6) > 100.0)).over(series)
    value = F.col("value") if digits is None else F.round("value", digits)
    point = F.struct("sector", "h", "kind", "source", value.alias("value"), "is_high")
    frames = predicted.unionByName(actual).withColumn("is_high", is_high).groupBy("date").agg(F.collect_list(point).alias("frame"))
    return (
        events.select("event_id", "date", "lead_time_days")
        .join(frames, "date")
        .select("event_id", "date", "lead_time_days", F.inline("frame"))
        .where(F.col("h") >= -(F.col("lead_time_days") + margin_days))
        .select("event_id", "date", "sector", "h", "kind", "source", "value", "is_high")
    )


def stage_funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows kept at each stage, and their share of the first stage in percent."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "n")
        for k, (name, df) in enumerate(stages, start=1)
    ]
    table = reduce(DataFrame.unionByName, counts)
    first = F.first("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return table.withColumn("pct_of_first", F.try_divide(F.col("n") * 100.0, first))
