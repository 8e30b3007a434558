"""Event study: sector index, its curve around every date, and event trajectories."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.fixed_values import HORIZONS, SECTOR_BASKETS
from eventide.operators.bars import dense_grid
from eventide.operators.calendar import event_lead_time


def basket_of(item: Column, baskets: dict[str, list[str]]) -> Column:
    """Sectors of an item, from the basket lists."""
    pairs: dict[str, list[str]] = {}
    for sector, items in baskets.items():
        for name in items:
            pairs.setdefault(name, []).append(sector)
    mapping = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in pairs.items()))
    return F.try_element_at(mapping, item)


def sector_index(
    prices: DataFrame, baskets: dict[str, list[str]] = SECTOR_BASKETS, backfill: bool = True
) -> DataFrame:
    """Mean price of each basket on each day of the dense calendar.

    Only basket items are densified. A basket whose prices sum to zero has no
    index that day.
    """
    items = sorted({name for names in baskets.values() for name in names})
    grid = dense_grid(prices, backfill=backfill, items=items)
    return (
        grid.withColumn("sector", F.explode(basket_of(F.col("item"), baskets)))
        .groupBy("sector", F.col("day").alias("date"))
        .agg(F.avg("price").alias("price"))
        .where(F.col("price") > 0)
    )


def date_curves(
    index: DataFrame, horizons: list[int] = HORIZONS, digits: int | None = None, dates: DataFrame | None = None
) -> DataFrame:
    """Index at each horizon around each date, with the date itself at 100.

    One row per date, holding an array of (sector, h, index, return_pct): at
    most sectors x horizons elements. The size depends on the calendar alone,
    so anything done to every point, like rounding, is done here and not once
    per event. Only the given ``dates`` get a curve, if any are given.
    """
    bases = index if dates is None else index.join(dates, "date", "left_semi")
    targets = bases.select(
        "sector", "date", F.col("price").alias("base"), F.explode(F.lit(horizons)).alias("h")
    ).withColumn("target", F.date_add("date", F.col("h")))
    at_target = index.select("sector", F.col("date").alias("target"), F.col("price").alias("then"))
    value = F.col("then") / F.col("base") * 100.0
    change = value - 100.0
    if digits is not None:
        value, change = F.round(value, digits), F.round(change, digits)
    points = targets.join(at_target, ["sector", "target"])
    point = F.struct("sector", "h", value.alias("index"), change.alias("return_pct"))
    return points.groupBy("date").agg(F.collect_list(point).alias("curve"))


def event_trajectory(events: DataFrame, curves: DataFrame) -> DataFrame:
    """Long form: one row per event, sector and horizon with a known index.

    Events meet one small row per date, so they are neither ranked nor
    multiplied before the final explode.
    """
    return events.join(curves, "date").select("event_id", "date", F.inline("curve"))


def trajectory_column(sector: str, h: int) -> str:
    return f"Actual_{sector}_T{h}"


def date_wide(curves: DataFrame, sectors: list[str], horizons: list[int] = HORIZONS) -> DataFrame:
    """Wide curves: one column per sector and horizon, 0.0 for missing, one decimal."""
    keys = [f"{s}:{h}" for s in sectors for h in horizons]
    points = curves.select("date", F.inline("curve")).select("date", F.concat_ws(":", "sector", "h").alias("key"), "index")
    wide = points.groupBy("date").pivot("key", keys).agg(F.first("index"))
    values = [
        F.coalesce(F.bround(F.col(f"`{s}:{h}`"), 1), F.lit(0.0)).alias(trajectory_column(s, h))
        for s in sectors
        for h in horizons
    ]
    return wide.select("date", *values)


def trajectory_wide(events: DataFrame, wide: DataFrame) -> DataFrame:
    """Events with the wide curve of their date; a date without one shows zeros."""
    joined = event_lead_time(events).select("event_id", "date", "lead_time_days").join(wide, "date", "left")
    filled = {name: F.coalesce(F.col(f"`{name}`"), F.lit(0.0)) for name in wide.columns if name != "date"}
    legacy = {f"Actual_{s}_Return": filled.get(trajectory_column(s, 7)) for s in ("Honing", "Gem")}
    columns = [c.alias(name) for name, c in (filled | legacy).items() if c is not None]
    return joined.select("event_id", "date", "lead_time_days", *columns)
