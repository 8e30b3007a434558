"""Keyed merges: incremental append, upserts, deduplication, history flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.fixed_values import ITEM_GRADES


def incremental_append(incoming: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key the target does not hold yet.

    Target keys are made distinct first, so a key the target repeats many
    times is sent once per task.
    """
    return incoming.join(target.select(*key).distinct(), key, "left_anti")


def unprocessed(
    events: DataFrame, target: DataFrame, event_type: str, date_col: str = "broadcast_date"
) -> DataFrame:
    """Events whose date has no row of one given type in the target.

    Only that type blocks: an ordinary event of the same date does not.
    """
    done = (
        target.where((F.col("event_type") == event_type) & F.col("announcement_date").isNotNull())
        .select(F.col("announcement_date").alias(date_col))
        .distinct()
    )
    return events.join(done, date_col, "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in arrival order, as a two-phase aggregate."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("last")).select(*keys, *[F.col(f"last.{c}") for c in rest])


def discover_items(
    records: DataFrame, order: list[Column], grades: list[str] = ITEM_GRADES
) -> DataFrame:
    """Items by id from listing records of the given grades; the last record wins."""
    return latest_per_key(records.where(F.col("grade").isin(grades)), ["item_id"], order)


def notice_upsert(current: DataFrame, batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Stored notices merged with a batch, by link, with the kind of change.

    The stored side holds one row per link. A batch may repeat a link: the
    last row in ``order`` counts, or the greatest row when no order is given.
    A changed title replaces the stored row; an unchanged one keeps it; stored
    links absent from the batch stay.
    """
    rest = [c for c in current.columns if c != "link"]
    last = F.max_by(F.struct(*rest), F.struct(*(order or rest)))
    old = current.select("link", F.struct(*rest).alias("old"))
    new = batch.groupBy("link").agg(last.alias("new"))
    status = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "new")
        .when(~F.col("old.title").eqNullSafe(F.col("new.title")), "title_changed")
        .otherwise("unchanged")
    )
    merged = old.join(new, "link", "full").withColumn("status", status)
    takes_new = F.col("status").isin("new", "title_changed")
    row = F.when(takes_new, F.col("new")).otherwise(F.col("old"))
    return merged.select("link", row.alias("row"), "status").select("link", "row.*", "status")


def replace_by_key(history: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """History without the keys of the new records, plus those records."""
    kept = history.join(records.select(key).distinct(), key, "left_anti")
    return kept.unionByName(records, allowMissingColumns=True)


def post_dedup(existing: DataFrame, fresh: DataFrame, key: str = "link", order: list[Column] | None = None) -> DataFrame:
    """Union by link where the stored copy wins.

    Among copies of one side the first in ``order`` is kept (the best score, say), and among equals
    the least row.
    """
    both = existing.withColumn("origin", F.lit(0)).unionByName(
        fresh.withColumn("origin", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c != key]
    values = [c for c in rest if c != "origin"]
    ranks = [rank.alias(f"rank_{n}") for n, rank in enumerate(order or [])]
    first = F.min(F.struct("origin", *ranks, F.struct(*values).alias("row")))
    return both.groupBy(key).agg(first.alias("r")).select(key, *[F.col(f"r.row.{c}") for c in values])


HISTORY_SCHEMA = "array<struct<Name: string, Stats: array<struct<Date: string, AvgPrice: double, TradeCount: bigint>>>>"


def history_flatten(responses: DataFrame, json_col: str = "response") -> DataFrame:
    """Item history responses to one row per item and day.

    Each response is a list whose first element carries the item's statistics;
    an empty list gives no rows.
    """
    first = F.try_element_at(F.from_json(F.col(json_col), HISTORY_SCHEMA), F.lit(1))
    return (
        responses.select(first.alias("item"))
        .select(F.col("item.Name").alias("item"), F.explode("item.Stats").alias("s"))
        .select(
            "item",
            F.col("s.Date").try_cast("date").alias("day"),
            F.col("s.AvgPrice").alias("avg_price"),
            F.col("s.TradeCount").alias("trade_count"),
        )
    )
