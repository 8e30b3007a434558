"""Structured Streaming forms of the polling jobs.

Every job takes its checkpoint and its output from one folder, so a restarted
query goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.fixed_values import ALERT_SCORE, HORIZONS
from eventide.operators import study
from eventide.session import stage_table
from eventide.streaming.store import NoticeStore


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the Parquet files of a folder, or of a path pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(stream: DataFrame, folder: str, mode: str):
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    )


def _wall_clock(c) -> Column:
    """The session's wall clock as an instant in UTC.

    Windows align to UTC; on this scale their hours and days are the ones that
    people in the session's zone read. Watermarks accept it, unlike times
    without a zone.
    """
    return F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())


def _plain_time(c) -> Column:
    """Back from the wall-clock scale to a time without a zone."""
    return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")


def hourly_bars(ticks: DataFrame, folder: str, lateness: str = "1 hour") -> DataFrame:
    """Hourly bars per item; a bar is written once its hour can receive no more ticks.

    ``ticks`` is a stream with ``ts``; state is one row per item and open hour.
    """
    bars = (
        ticks.withColumn("ts", _wall_clock("ts"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour"), "item")
        .agg(
            F.avg("price").alias("price_mean"), F.min("price").alias("price_min"),
            F.max("price").alias("price_max"), F.count(F.lit(1)).alias("tick_count"),
        )
        .select(F.col("window.start").alias("hour_start"), "item", "price_mean", "price_min", "price_max", "tick_count")
    )
    _start(bars, folder, "append").format("parquet").start(f"{folder}/bars").awaitTermination()
    out = bars.sparkSession.read.schema(bars.schema).parquet(f"{folder}/bars")
    return out.withColumn("hour_start", _plain_time("hour_start"))


def daily_state(ticks: DataFrame, folder: str, lateness: str = "1 hour") -> DataFrame:
    """Running count, sum, min and max per item and day.

    Each micro-batch writes only the days it changed, under its batch number,
    so a repeated batch overwrites itself; readers take the latest version.
    """
    spark = ticks.sparkSession
    state = (
        ticks.withColumn("ts", _wall_clock("ts"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "item")
        .agg(
            F.count(F.lit(1)).alias("tick_count"), F.sum("price").alias("price_sum"),
            F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        )
        .select(F.to_date(_plain_time("window.start")).alias("day"), "item", "tick_count", "price_sum", "price_min", "price_max")
    )

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    _start(state, folder, "update").foreachBatch(save).start().awaitTermination()
    versions = spark.read.parquet(f"{folder}/state")
    values = ["tick_count", "price_sum", "price_min", "price_max"]
    latest = versions.groupBy("day", "item").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select("day", "item", "v.*")


def alert_stream(notices: DataFrame, folder: str, window: str = "1 hour", lateness: str = "1 day") -> StreamingQuery:
    """Keeps the first sighting of each notice in each ``window``.

    State is one row per notice and window that copies may still reach, however long the stream runs: the
    watermark drops the others, and copies later than ``lateness``. A micro-batch writes the sightings it touched under its number.
    """
    sightings = (
        notices.withColumn("at", _wall_clock("ts"))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", window), "notice_id")
        .agg(F.min(F.struct("ts", "score")).alias("first"))
        .select("notice_id", "first")
    )

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/sightings/batch={number}")

    return _start(sightings, folder, "update").foreachBatch(save).start()


def alerts(notices: DataFrame, folder: str, threshold: int = ALERT_SCORE, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Notices that are important at first sight; each is judged by its earliest copy.

    ``notices`` is a stream with ``notice_id``, ``ts`` and ``score``. The earliest of the windows' first
    sightings decides, so the order of rows and of files does not matter within ``lateness``, and a
    notice alerts once whenever its copies come.
    """
    query = alert_stream(notices, folder, window, lateness)
    query.awaitTermination()
    seen = notices.sparkSession.read.parquet(f"{folder}/sightings")
    first = seen.groupBy("notice_id").agg(F.min("first").alias("first"))
    return first.select("notice_id", "first.*").where(F.col("score") >= threshold)


def upsert_notices(batches: DataFrame, base: DataFrame, folder: str, buckets: int = 64, compact_after: int = 20) -> DataFrame:
    """Notice upsert per micro-batch into a log-structured store (``store.NoticeStore``).

    The base is copied into the store once. A batch reads only the buckets of its own links and writes its new and changed
    notices; every ``compact_after`` batches the changes are folded into a new base.
    """
    store = NoticeStore(base, f"{folder}/store", buckets, compact_after)
    _start(batches, folder, "append").foreachBatch(store.merge).start().awaitTermination()
    return store.notices()


def _save_versions(events: DataFrame, curves: DataFrame, folder: str, number: int) -> None:
    """A batch's version of its events: one row of event_id and date each, and the curves of those dates once.

    Events whose date has no curve are left out. A repeated batch overwrites itself.
    """
    spark = curves.sparkSession
    rows = events.select("event_id", "date").join(curves.select("date"), "date", "left_semi")
    rows.write.mode("overwrite").parquet(f"{folder}/trajectories/batch={number}")
    dates = spark.read.parquet(f"{folder}/trajectories/batch={number}").select("date").distinct()
    curves.join(dates, "date", "left_semi").dropDuplicates(["date"]).write.mode("overwrite").parquet(f"{folder}/curves/batch={number}")


def _latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Points of every event's latest version. Events are ranked by their own narrow rows; a curve meets them after that."""
    versions = spark.read.parquet(f"{folder}/trajectories")
    latest = versions.groupBy("event_id").agg(F.max_by(F.struct("date", "batch"), "batch").alias("v"))
    curves = spark.read.parquet(f"{folder}/curves")
    return latest.select("event_id", "v.*").join(curves, ["date", "batch"]).select("event_id", "date", F.inline("curve"))


def refresh_trajectories(events: DataFrame, curves: DataFrame, folder: str) -> DataFrame:
    """Trajectories of the events of each micro-batch, and of no others.

    ``curves`` is the stored date table, read per batch. The store keeps one
    row per event, and per batch the curves of its dates, so a later batch
    replaces an event by one row; points are opened when they are read.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        _save_versions(batch, curves, folder, number)

    _start(events, folder, "append").foreachBatch(refresh).start().awaitTermination()
    return _latest_versions(curves.sparkSession, folder)


def price_log(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Daily mean prices from the sums that the batches have written; those below ``before`` only, if given."""
    sums = spark.read.parquet(f"{folder}/prices")
    sums = sums if before is None else sums.where(F.col("batch") < before)
    total = sums.groupBy("item", "day").agg(F.sum("price_sum").alias("s"), F.sum("tick_count").alias("n"))
    return total.select("item", "day", (F.col("s") / F.col("n")).alias("price"))


def touched_dates(changed: DataFrame, prices: DataFrame, span: DataFrame, horizons: list[int]) -> DataFrame:
    """Dates whose curve a change of daily prices can move.

    A price covers the days up to its item's next one, the first price also those before it. Days that the
    table did not reach before (``span`` has its former first and last day, or none) are new for every
    item. A curve reads the days its horizons away, so each changed day leads back to those dates.
    Days are merged into a set before they spread: all of it is bounded by the calendar.
    """
    by_item = Window.partitionBy("item").orderBy("day")
    ends = prices.select(F.struct(F.min("day").alias("first"), F.max("day").alias("last"))).scalar()
    before = span.select(F.struct("first", "last")).scalar()
    covers = prices.select("item", "day", F.lead("day").over(by_item).alias("next"), (F.row_number().over(by_item) == 1).alias("is_first"))
    covers = covers.join(changed, ["item", "day"], "left_semi")
    low = F.when(F.col("is_first"), ends["first"]).otherwise(F.col("day"))
    days = covers.select(F.explode(F.sequence(low, F.coalesce(F.date_sub("next", 1), ends["last"]))).alias("day")).distinct()
    fresh = span.select(F.explode(F.sequence(ends["first"], ends["last"])).alias("day"))
    fresh = fresh.where(before["first"].isNull() | (F.col("day") < before["first"]) | (F.col("day") > before["last"]))
    away = F.transform(F.lit(horizons), lambda h: F.date_sub("day", h))
    return days.unionByName(fresh).distinct().select(F.explode(away).alias("date")).distinct()


def refresh_prices(ticks: DataFrame, events: DataFrame, folder: str, baskets: dict[str, list[str]], horizons: list[int] = HORIZONS, digits: int | None = None) -> DataFrame:
    """Trajectories of stored events, kept up to date as ticks arrive, late ones too.

    A micro-batch adds its daily sums to the price log, finds the dates whose curves they can move and
    rewrites the events of those dates only. ``events`` is the stored table of event_id and date. The log and the
    curves are of calendar size; an event's version is its id and date, and each batch writes the curve of a touched date once. A batch writes under its number, so a
    repeated one overwrites itself; readers take an event's latest version.
    """
    spark = events.sparkSession
    items = sorted({i for names in baskets.values() for i in names})

    def refresh(batch: DataFrame, number: int) -> None:
        daily = batch.groupBy("item", "day").agg(F.sum("price").alias("price_sum"), F.count("price").alias("tick_count"))
        daily.where("tick_count > 0").write.mode("overwrite").parquet(f"{folder}/prices/batch={number}")
        changed = spark.read.parquet(f"{folder}/prices/batch={number}").select("item", "day")
        old = spark.read.parquet(f"{folder}/prices").where(F.col("batch") < number)
        span = old.agg(F.min("day").alias("first"), F.max("day").alias("last"))
        prices = stage_table(price_log(spark, folder, number + 1), "price-log")
        inside = prices.where(F.col("item").isin(items))
        whole = prices.agg(F.min("day").alias("day"), F.max("day").alias("last"))
        # The calendar's ends come from all items, the covers from those of the baskets.
        edges = whole.select(F.explode(F.array("day", "last")).alias("day")).withColumns({"item": F.lit(""), "price": F.lit(None).cast("double")})
        dates = touched_dates(changed.where(F.col("item").isin(items)), inside.unionByName(edges.select("item", "day", "price")), span, horizons)
        dates = stage_table(dates, "touched-dates")
        curves = study.date_curves(study.sector_index(prices, baskets), horizons, digits, dates)
        _save_versions(events, stage_table(curves, "touched-curves"), folder, number)

    _start(ticks, folder, "append").foreachBatch(refresh).start().awaitTermination()
    return _latest_versions(spark, folder)
