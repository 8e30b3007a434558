"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventide.session import stage_table


def shard_by_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Cuts all rows, in order of their key, into ``shards`` runs of nearly equal bytes.

    One row per input row: ``key``, size (UTF-8 bytes of the text plus 1), text_crc32, shard (int),
    slot (its place in the shard, from 0).

    Rows go to key ranges, sizes alone, not texts. Each range sums its sizes and rows; the running
    total of these sums (one row per range) tells every range where it begins; a running sum inside
    the range does the rest. A row's shard is where its first byte falls among equal targets, so a
    shard differs from its target by less than one row at either end.

    A null text has no bytes and counts 1. Null keys come first; rows of one key are ordered by
    CRC-32 and then as read, and may be parted by a cut. An empty table gives no rows; fewer rows than shards leave
    shards empty. Other columns are ignored. DataFrame functions only.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(key).alias("k"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("pos"),
    )
    order = ["k", "text_crc32", "pos"]
    rows = stage_table(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("total"),
    )
    own = Window.partitionBy("part").orderBy(*order)
    placed = rows.join(totals, "part").select(
        "k", "size", "text_crc32",
        (F.col("bytes_before") + F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first_byte"),
        (F.col("rows_before") + F.row_number().over(own) - 1).alias("place"), "total",
    )
    placed = placed.withColumn("shard", F.expr(f"cast(first_byte * {shards} div total as int)"))
    starts = stage_table(placed.groupBy("shard").agg(F.min("place").alias("start")), "shards")
    return placed.join(starts, "shard").select(
        F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("place") - F.col("start")).cast("long").alias("slot")
    )
