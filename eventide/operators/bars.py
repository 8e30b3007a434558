"""Tick cleaning, daily bars, the dense calendar grid and the volume merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.columns import contains_any, parse_mixed_timestamp


def normalize_ticks(raw: DataFrame, time_col: str = "date") -> DataFrame:
    """Parse mixed time notations, drop what does not parse, keep the time of day."""
    ts = parse_mixed_timestamp(time_col)
    return raw.withColumn("ts", ts).where(F.col("ts").isNotNull()).withColumn("day", F.to_date("ts")).drop(time_col)


def daily_bars(ticks: DataFrame) -> DataFrame:
    """One bar per item and day.

    Partial aggregates run before the only shuffle, so an item with a third of
    all ticks sends one row per task and day, not its ticks.
    """
    return ticks.groupBy("item", "day").agg(
        F.avg("price").alias("price_mean"),
        F.stddev_samp("price").alias("price_std"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.count("price").alias("tick_count"),
    )


def daily_prices(ticks: DataFrame) -> DataFrame:
    """Mean price per item and day, with the tick count as a proxy for activity."""
    return ticks.groupBy("item", "day").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("trade_count"))


def family_daily(ticks: DataFrame, substring: str) -> DataFrame:
    """Daily mean price of the items whose family name contains a substring."""
    return (
        ticks.where(contains_any(F.col("family"), [substring]))
        .groupBy("family", "item", "day")
        .agg(F.avg("price").alias("avg_price"))
    )


def dense_grid(prices: DataFrame, backfill: bool = True, items: list[str] | None = None) -> DataFrame:
    """Every item on every day from the first to the last day of the whole table.

    A price holds until the item's next one, so each bar is expanded over the
    days it covers: one window per item and no join with a calendar. With
    ``backfill`` the first price also covers the days before it.
    """
    first_day = prices.agg(F.min("day")).scalar()
    last_day = prices.agg(F.max("day")).scalar()
    if items is not None:
        prices = prices.where(F.col("item").isin(items))
    by_item = Window.partitionBy("item").orderBy("day")
    covered_to = F.coalesce(F.date_sub(F.lead("day").over(by_item), 1), last_day)
    is_first = F.row_number().over(by_item) == 1
    covered_from = F.when(is_first, first_day).otherwise(F.col("day")) if backfill else F.col("day")
    spans = prices.select(
        "item", "price", F.col("day").alias("seen"), covered_from.alias("lo"), covered_to.alias("hi")
    )
    return spans.select(
        "item", F.explode(F.sequence("lo", "hi")).alias("day"), "price", "seen"
    ).select("item", "day", "price", (F.col("day") == F.col("seen")).alias("is_observed"))


def forward_return(prices: DataFrame, rows_ahead: int = 7, price_col: str = "price") -> DataFrame:
    """Return to the price ``rows_ahead`` rows later; the tail without one is dropped."""
    by_item = Window.partitionBy("item").orderBy("day")
    price, future = F.col(price_col), F.col("future_price_7d")
    return (
        prices.withColumn("future_price_7d", F.lead(price_col, rows_ahead).over(by_item))
        .withColumn("target_return_7d", F.try_divide(future - price, price))
        .where(F.col("target_return_7d").isNotNull())
    )


def dedup_volume(volume: DataFrame, order_col: str) -> DataFrame:
    """One row per item and day; the record fetched last wins.

    The history is appended whole at every fetch, so copies are expected.
    """
    latest = F.max(F.struct(order_col, "avg_price", "trade_count"))
    return volume.groupBy("item", "day").agg(latest.alias("v")).select("item", "day", "v.avg_price", "v.trade_count")


def volume_enrich(bars: DataFrame, volume: DataFrame) -> DataFrame:
    """Trade counts on existing bars; days without volume count 0."""
    counts = volume.select("item", "day", "trade_count")
    return bars.join(counts, ["item", "day"], "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0)))


def volume_backfill(bars: DataFrame, volume: DataFrame) -> DataFrame:
    """Bars with trade counts, plus bars made of volume rows on days without ticks.

    One full outer join does both the enrichment and the append of the missing
    keys: both inputs hold at most one row per item and day. A bar that comes
    from volume alone has min = max = mean and no spread.
    """
    both = bars.withColumn("from_bars", F.lit(True)).join(volume, ["item", "day"], "full")
    missing = F.col("from_bars").isNull()

    def bar(name: str, from_volume):
        return F.when(missing, from_volume).otherwise(F.col(name)).alias(name)

    return both.select(
        "item",
        "day",
        bar("price_mean", F.col("avg_price")),
        bar("price_std", F.lit(0.0)),
        bar("price_min", F.col("avg_price")),
        bar("price_max", F.col("avg_price")),
        F.coalesce("tick_count", F.lit(0)).alias("tick_count"),
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
        missing.alias("is_appended"),
    )


def price_volume(volume: DataFrame) -> DataFrame:
    """Price and volume moves per item, newest first.

    A rise on growing volume is real, a rise on shrinking volume is fake.
    """
    by_item = Window.partitionBy("item").orderBy("day")
    price_step = F.col("avg_price") - F.lag("avg_price").over(by_item)
    count_step = F.col("trade_count") - F.lag("trade_count").over(by_item)
    move = (
        F.when((F.col("price_step") > 0) & (F.col("count_step") > 0), "real_rise")
        .when((F.col("price_step") > 0) & (F.col("count_step") < 0), "fake_rise")
        .when(F.col("price_step") < 0, "fall")
        .otherwise("flat")
    )
    return (
        volume.withColumns({"price_step": price_step, "count_step": count_step})
        .withColumn("move", move)
        .orderBy("item", F.desc("day"))
    )


def preview(df: DataFrame, order: list, rows: int) -> DataFrame:
    """First rows in a total order; sorted per task, so only ``rows`` rows travel."""
    return df.orderBy(*order).limit(rows)
