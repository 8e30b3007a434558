"""Event calendar: rollups, lead time, joins of event features to prices."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.fixed_values import DECISION_RULES, DEFAULT_LEAD_DAYS, SECTOR_FEATURES
from eventide.functions.columns import relabel, truthy, weekday_features


def daily_events(events: DataFrame, scores: list[str] = SECTOR_FEATURES) -> DataFrame:
    """One row per event day: number of titles and the highest scores."""
    tops = [F.max(s).alias(s) for s in scores]
    return events.groupBy("date").agg(F.count("title").alias("event_count"), *tops, F.lit(1).alias("is_event_day"))


def event_lead_time(events: DataFrame, default: int = DEFAULT_LEAD_DAYS) -> DataFrame:
    """Whole days from announcement to event; unknown announcements count as a week."""
    return events.withColumn(
        "lead_time_days", F.coalesce(F.datediff("date", "announcement_date"), F.lit(default))
    )


def event_dedup(events: DataFrame, score: str = "honing_mat_demand", id_col: str = "event_id") -> DataFrame:
    """The strongest event of each date; the lower id wins a tie.

    An aggregate, not a ranking window: a date with a third of all events is
    reduced to one row per task before the shuffle. Score and id are ranked as
    one decimal, exact for every int score and long id. The aggregate is
    hash-based while only fixed-width columns are used, and unused columns are
    pruned one by one; with text columns it sorts each task's rows.
    """
    step = F.lit(Decimal(1 << 64))
    rank = F.coalesce(F.col(score), F.lit(0)).cast("decimal(10, 0)") * step - F.col(id_col).cast("decimal(19, 0)")
    rest = [c for c in events.columns if c != "date"]
    return events.groupBy("date").agg(*[F.max_by(c, rank).alias(c) for c in rest])


def event_search(
    events: DataFrame, pattern: str, hidden_type: str | None = None, labels: dict[str, str] | None = None
) -> DataFrame:
    """Title search without regard to case, newest first, with shown names."""
    found = events.where(F.col("title").rlike(f"(?i){pattern}"))
    if hidden_type is not None:
        found = found.where(F.col("event_type") != hidden_type)
    shown = relabel(F.col("event_type"), labels or {})
    return found.select(
        "event_id",
        "date",
        shown.alias("event_type"),
        "title",
        F.when(truthy("is_pre_announced"), "Yes").otherwise("No").alias("pre_announced"),
        F.format_string("[%s] %s - %s", F.date_format("date", "yyyy-MM-dd"), shown, F.col("title")).alias("display_title"),
    ).orderBy(F.desc("date"), "event_id")


def summary_merge(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base rows plus the extra rows whose (date, title) the base lacks."""
    keys = base.select("date", "title").distinct()
    fresh = extra.join(keys, ["date", "title"], "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def _rule_conditions() -> list[Column]:
    c = F.col
    no_score = reduce(lambda a, b: a & b, [c(s) == 0 for s in SECTOR_FEATURES])
    return [
        (c("honing_mat_demand") > 7) & ~c("is_pre_announced"),
        (c("gem_demand") > 8) & (c("content_difficulty") > 6),
        (c("gold_inflation") > 7) & (c("gold_sink") < 3),
        no_score & (F.weekday("date") >= 5),
    ]


def decision_rules(events: DataFrame) -> DataFrame:
    """One row per event and matching rule."""
    hits = [
        F.when(condition, F.struct(F.lit(n).alias("rule"), F.lit(outcome).alias("outcome"), F.lit(sure).alias("confidence")))
        for n, (condition, (_, outcome, sure)) in enumerate(zip(_rule_conditions(), DECISION_RULES), start=1)
    ]
    return events.select("event_id", "date", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(
        "event_id", "date", "hit.*"
    )


def daily_event_features(events: DataFrame, flags: list[str]) -> DataFrame:
    """Event features per day: any flag, strongest impact, worst sentiment, first type."""
    return events.groupBy("date").agg(
        F.count(F.lit(1)).alias("event_count"),
        *[F.max(f).alias(f) for f in flags],
        F.max("impact_score").alias("impact_score"),
        F.min("sentiment_score").alias("sentiment_score"),
        F.min_by("event_type", "event_id").alias("event_type"),
    )


def event_feature_join(ticks: DataFrame, day_features: DataFrame, flags: list[str]) -> DataFrame:
    """Ticks with the features of their day; days without events get neutral values.

    The day table has one row per calendar day. Joining it, not the events,
    keeps the tick count: a day with many events does not multiply its ticks.
    """
    numbers = [*flags, "impact_score", "sentiment_score", "event_count"]
    joined = ticks.join(day_features.withColumnRenamed("date", "day"), "day", "left")
    return joined.fillna(0, subset=numbers).fillna({"event_type": "None"})


def daily_features(prices: DataFrame, day_features: DataFrame, flags: list[str]) -> DataFrame:
    """Daily mean price per item with the features of the day and its weekday.

    A mean over ticks that were repeated once per event equals the plain mean,
    so prices and events are both reduced to days before they meet.
    """
    joined = event_feature_join(prices, day_features, flags)
    return joined.withColumn("day_of_week", F.weekday("day"))


def training_frame(bars: DataFrame, day_events: DataFrame, scores: list[str] = SECTOR_FEATURES) -> DataFrame:
    """Bars with the event scores of the day and calendar features."""
    joined = bars.join(day_events.withColumnRenamed("date", "day"), "day", "left")
    zero = {name: 0 for name in [*scores, "event_count", "is_event_day"]}
    return joined.fillna(zero).withColumns(weekday_features(F.col("day")))
