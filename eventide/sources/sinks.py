"""Sinks: sorted CSV, appended Parquet, nested trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.walkforward import trajectory_arrays


def write_sorted_csv(df: DataFrame, path: str, order: list) -> None:
    """Overwrite a CSV folder whose part files follow the order.

    The sort is range-partitioned over all tasks; nothing is gathered.
    """
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_new(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def write_ticks_by_month(ticks: DataFrame, path: str) -> None:
    """Parquet ticks partitioned by month, so that date filters prune folders.

    Rebalancing gathers a month in few files and splits a month that is too
    large for one task.
    """
    monthly = ticks.withColumn("month", F.date_format("day", "yyyy-MM")).hint("rebalance", "month")
    monthly.write.mode("overwrite").partitionBy("month").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, order: list[str] = ()) -> DataFrame:
    """A table of Parquet files dealt into ``buckets`` by ``key``, and read back as such.

    Two tables with the same buckets of a key join and group by it without an exchange. Rows are first
    dealt by the key, so each bucket is one file and not one per task; its rows lie in the order of key and ``order``.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(table)
    return spark.table(table)


def write_trajectories(forecasts: DataFrame, path: str) -> None:
    """Trajectories as JSON lines, one folder per sector."""
    trajectory_arrays(forecasts).write.mode("overwrite").partitionBy("sector").json(path)
