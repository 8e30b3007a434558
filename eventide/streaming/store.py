"""Log-structured store of notices: a base in buckets of the link, changes by batch, and compaction.

A batch reads only the buckets its links fall into, of one base version and of the changes after it.
Nothing is rewritten in place: a change is a row under its batch number, and compaction writes a new base
version beside the old one. Versions and changes that a newer base covers are read by nobody; let the folder expire them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.ingest import notice_upsert

FIRST = -1


def numbers_below(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``prefix=<number>`` of a path, ascending; none if the path is missing."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    found = [int(n.removeprefix(f"{prefix}=")) for n in names if n.startswith(f"{prefix}=")]
    return sorted(k for k in found if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}={k}/_SUCCESS")))


class NoticeStore:
    """Notices by link under ``folder``; ``buckets`` is fixed when the store is made.

    ``columns`` are those of the stored notices, link among them.
    """

    def __init__(self, base: DataFrame, folder: str, buckets: int = 64, compact_after: int = 20):
        self.spark, self.folder, self.buckets, self.compact_after = base.sparkSession, folder, buckets, compact_after
        self.columns = base.columns
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
        self.schema = f"{kinds}, status string, batch int, bucket int"
        if not numbers_below(self.spark, f"{folder}/base", "upto"):
            self._save(base.withColumns({"status": F.lit("kept"), "batch": F.lit(FIRST)}), f"base/upto={FIRST}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("link"), F.lit(self.buckets)).cast("int")

    def _save(self, rows: DataFrame, place: str) -> None:
        """Rows by bucket. Rebalancing splits a bucket that is too large for one task."""
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{place}")

    def _scan(self, before: int | None, buckets: list[int] | None) -> DataFrame:
        """Base and changes of the batches below ``before``, in the given buckets only, if any."""
        versions = [k for k in numbers_below(self.spark, f"{self.folder}/base", "upto") if before is None or k < before]
        upto = versions[-1]
        batches = [k for k in numbers_below(self.spark, f"{self.folder}/changes", "batch") if k > upto and (before is None or k < before)]
        places = [f"base/upto={upto}", *[f"changes/batch={k}" for k in batches]]
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/{p}") for p in places]
        parts = [p.where(F.col("bucket").isin(buckets)) if buckets is not None else p for p in parts]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c != "link"]
        newest = rows.groupBy("link").agg(F.max_by(F.struct(*rest, "status", "batch"), "batch").alias("v"))
        return newest.select("link", "v.*")

    def notices(self) -> DataFrame:
        """All notices with their last kind of change."""
        return self._latest(self._scan(None, None)).select(*self.columns, "status")

    def current(self, batch: DataFrame, number: int) -> DataFrame:
        """Stored notices of the batch's links, as of before it. The driver sees bucket numbers only."""
        links = batch.select("link").distinct()
        wanted = sorted(r.bucket for r in links.select(self.bucket().alias("bucket")).distinct().collect())
        return self._latest(self._scan(number, wanted).join(links, "link", "left_semi")).select(*self.columns)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Writes the batch's new and changed notices under its number, so a repeated batch overwrites itself."""
        changed = F.col("status").isin("new", "title_changed")
        merged = notice_upsert(self.current(batch, number), batch.select(*self.columns)).where(changed)
        self._save(merged.select(*self.columns, "status").withColumn("batch", F.lit(number)), f"changes/batch={number}")
        versions = numbers_below(self.spark, f"{self.folder}/base", "upto")
        if number - versions[-1] >= self.compact_after:
            self.compact(number)

    def compact(self, upto: int) -> None:
        """A new base version that holds everything up to a batch."""
        self._save(self._latest(self._scan(upto + 1, None)), f"base/upto={upto}")
