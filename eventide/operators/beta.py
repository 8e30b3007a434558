"""How items react to strong events, and what to pick now."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.fixed_values import BETA_ITEMS, SPIKE_FACTOR, SPIKE_KEPT_SHARE, STRONG_SCORE, TIER_MAPPING, WIN_RETURN_PCT


def strong_dates(events: DataFrame, score: str = "honing_mat_demand", threshold: int = STRONG_SCORE) -> DataFrame:
    """Dates of strong events with their number.

    Events of one date see the same prices, so a date stands for all of them
    and carries their count as a weight.
    """
    return events.where(F.col(score) >= threshold).groupBy("date").agg(F.count(F.lit(1)).alias("n_events"))


def listed_items(prices: DataFrame, items: list[str] = BETA_ITEMS) -> DataFrame:
    """Prices of the items on the hand-kept list; the filter goes before any window, and to the scan where it can.
    Listed items without prices simply do not appear."""
    return prices.where(F.col("item").isin(items))


def price_windows(prices: DataFrame, days_ahead: int = 14) -> DataFrame:
    """Base price and forward window of every (item, date) that can have a base.

    The base is the price a day earlier, else the same day. So the only
    candidate dates are bar days and the days right after them: each bar emits
    those, and one range frame per item looks ahead. No range join, no
    expansion over the window.
    """
    by_item = Window.partitionBy("item").orderBy("day")
    steps = prices.select(
        "item",
        "day",
        "price",
        F.lag("day").over(by_item).alias("prev_day"),
        F.lag("price").over(by_item).alias("prev_price"),
        F.lead("day").over(by_item).alias("next_day"),
    )
    has_yesterday = F.coalesce(F.datediff("day", "prev_day") == 1, F.lit(False))
    has_tomorrow = F.coalesce(F.datediff("next_day", "day") == 1, F.lit(False))
    same_day = F.struct(
        F.col("day").alias("date"),
        F.when(has_yesterday, F.col("prev_price")).otherwise(F.col("price")).alias("base_price"),
        F.when(has_yesterday, "T-1").otherwise("T0").alias("base_source"),
        F.col("price").alias("price"),
    )
    next_date = F.struct(
        F.date_add("day", 1).alias("date"),
        F.col("price").alias("base_price"),
        F.lit("T-1").alias("base_source"),
        F.lit(None).cast("double").alias("price"),
    )
    marks = F.array_compact(F.array(same_day, F.when(~has_tomorrow, next_date)))
    ahead = Window.partitionBy("item").orderBy(F.unix_date("date")).rangeBetween(1, days_ahead)
    return (
        steps.select("item", F.explode(marks).alias("mark"))
        .select("item", "mark.*")
        .select(
            "item",
            "date",
            "base_price",
            "base_source",
            F.max("price").over(ahead).alias("max_price"),
            F.avg("price").over(ahead).alias("mean_price"),
            F.count("price").over(ahead).alias("days_seen"),
        )
    )


def event_returns(windows: DataFrame, dates: DataFrame) -> DataFrame:
    """Best return after each strong date, without flash spikes.

    A jump beyond the spike factor counts only when the window's mean kept a
    share of it.
    """
    base, top, mean = F.col("base_price"), F.col("max_price"), F.col("mean_price")
    is_flash = (top > base * SPIKE_FACTOR) & (mean < base + (top - base) * SPIKE_KEPT_SHARE)
    return (
        windows.join(dates, "date")
        .where((F.col("days_seen") > 0) & ~is_flash & (base > 0))
        .withColumn("return_pct", (top - base) / base * 100.0)
    )


def item_betas(returns: DataFrame, win_pct: float = WIN_RETURN_PCT) -> DataFrame:
    """Mean best return, share of wins in percent, and number of events, per item."""
    n = F.col("n_events")
    won = F.when(F.col("return_pct") > win_pct, n).otherwise(0)
    return returns.groupBy("item").agg(
        (F.sum(F.col("return_pct") * n) / F.sum(n)).alias("avg_return"),
        (F.sum(won) * 100.0 / F.sum(n)).alias("win_rate"),
        F.sum(n).alias("sample_size"),
    )


def tier_mapping_table(spark: SparkSession, mapping: dict[str, str | None] = TIER_MAPPING) -> DataFrame:
    """The hand-kept mapping as a two-column table of literals."""
    pairs = chain.from_iterable((F.lit(old), F.lit(new).cast("string")) for old, new in mapping.items())
    return spark.range(1).select(F.explode(F.create_map(*pairs)).alias("item", "mapped"))


def tier_picks(betas: DataFrame, mapping: DataFrame, top: int = 7) -> DataFrame:
    """Best current items: old items count for their successor, items without one drop out.

    The mapping is a hand-kept list; it is told apart from "not listed" by a
    flag, since a listed item may map to nothing.
    """
    listed = mapping.withColumn("listed", F.lit(True))
    current = F.when(F.col("listed"), F.col("mapped")).otherwise(F.col("item"))
    return (
        betas.join(listed, "item", "left")
        .withColumn("current_pick", current)
        .where(F.col("current_pick").isNotNull())
        .groupBy("current_pick")
        .agg(
            F.max("avg_return").alias("avg_return"),
            F.avg("win_rate").alias("win_rate"),
            F.min_by("item", F.struct(-F.col("avg_return"), F.col("item"))).alias("source_item"),
        )
        .orderBy(F.desc("avg_return"), "current_pick")
        .limit(top)
    )
