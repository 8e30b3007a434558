"""Weekday seasonality, excess return over it, and hour-of-day timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.fixed_values import EXCESS_HIGH, EXCESS_LOW, ITEM_CLASSES, SELL_FEE
from eventide.functions.columns import classify

WEEKDAY_COLUMNS = [f"day_{k}" for k in range(7)]


def seasonality(bars: DataFrame, price: str = "price_mean") -> DataFrame:
    """Weekday mean over global mean, global mean and spread, per item.

    Seven conditional means in one aggregate: the same result as a pivot, with
    one shuffle. An item with mean zero has null factors.
    """
    weekday = F.weekday("day")
    means = [F.avg(F.when(weekday == k, F.col(price))).alias(f"mean_{k}") for k in range(7)]
    totals = bars.groupBy("item").agg(
        *means, F.avg(price).alias("global_mean"), F.stddev_samp(price).alias("global_std")
    )
    factors = [F.try_divide(F.col(f"mean_{k}"), F.col("global_mean")).alias(f"day_{k}") for k in range(7)]
    cv = F.try_divide(F.col("global_std"), F.col("global_mean")).alias("volatility_cv")
    return totals.select("item", *factors, "global_mean", "global_std", cv)


def excess_return(frame: DataFrame, factors: DataFrame, price: str = "price_mean") -> DataFrame:
    """Relative distance of a price to its item's weekday baseline, outliers trimmed."""
    long = factors.unpivot(["item", "global_mean"], WEEKDAY_COLUMNS, "day_name", "factor").select(
        "item",
        F.substring("day_name", 5, 1).cast("int").alias("weekday"),
        (F.col("global_mean") * F.col("factor")).alias("baseline_price"),
    )
    frame = frame if "weekday" in frame.columns else frame.withColumn("weekday", F.weekday("day"))
    baseline = F.col("baseline_price")
    return (
        frame.join(long, ["item", "weekday"])
        .withColumn("excess_return", F.try_divide(F.col(price) - baseline, baseline))
        .where((F.col("excess_return") > EXCESS_LOW) & (F.col("excess_return") < EXCESS_HIGH))
    )


def category_onehot(df: DataFrame, name_col: str, classes: list[tuple[str, list[str]]] = ITEM_CLASSES) -> DataFrame:
    """Item class and its indicator columns."""
    labels = [label for label, _ in classes] + ["other"]
    out = df.withColumn("category", classify(F.col(name_col), classes))
    return out.withColumns({f"is_{label}": (F.col("category") == label).cast("int") for label in labels})


def hourly_deviation(ticks: DataFrame) -> DataFrame:
    """Mean distance of a tick to its item's daily mean, in percent, per hour of day.

    Ticks are first summed per (item, day, hour); the daily mean then comes
    from at most 24 such rows, and the mean over ticks is recovered from sums
    and counts. No tick takes part in a window.
    """
    by_hour = ticks.groupBy("item", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.sum("price").alias("price_sum"), F.count(F.lit(1)).alias("n")
    )
    by_day = by_hour.groupBy("item", "day").agg(
        (F.sum("price_sum") / F.sum("n")).alias("day_mean"),
        F.collect_list(F.struct("hour", "price_sum", "n")).alias("hours"),
    )
    parts = by_day.where(F.col("day_mean") != 0).select("day_mean", F.explode("hours").alias("part"))
    excess = F.col("part.price_sum") / F.col("day_mean") - F.col("part.n")
    return parts.groupBy(F.col("part.hour").alias("hour")).agg(
        (F.sum(excess) * 100.0 / F.sum("part.n")).alias("avg_deviation_pct")
    )


def hour_sides(hours: DataFrame) -> DataFrame:
    """Which side each hour favours."""
    return hours.withColumn("side", F.when(F.col("avg_deviation_pct") > 0, "sell").otherwise("buy"))


def best_hours(hours: DataFrame, fee: float = SELL_FEE) -> DataFrame:
    """Cheapest and dearest hour, and the round trip between them after the sell fee."""
    dev = F.col("avg_deviation_pct")
    best = hours.agg(
        F.min_by("hour", F.struct(dev, F.col("hour"))).alias("buy_hour"),
        F.min("avg_deviation_pct").alias("buy_dev"),
        F.min_by("hour", F.struct(-dev, F.col("hour"))).alias("sell_hour"),
        F.max("avg_deviation_pct").alias("sell_dev"),
    )
    buy, sell = 100.0 + F.col("buy_dev"), 100.0 + F.col("sell_dev")
    net = best.withColumn("net_margin_pct", (sell * (1.0 - fee) - buy) / buy * 100.0)
    return net.withColumn("verdict", F.when(F.col("net_margin_pct") > 0, "trade").otherwise("hold"))
