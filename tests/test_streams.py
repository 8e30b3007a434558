"""Streams over several files, so that state spans micro-batches."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from eventide.operators import study
from eventide.operators.ingest import notice_upsert
from eventide.sources import driver_tables as tables
from eventide.streaming import jobs
from eventide.streaming.store import NoticeStore, numbers_below

T = dt.datetime


def folder():
    return tempfile.mkdtemp(prefix="eventide-test-")


@pytest.fixture
def tick_parts(spark, sf_dir):
    """Intraday ticks in time order, as three files."""
    src = folder()
    ticks = tables.intraday_ticks(spark, sf_dir)
    bounds = [T(2024, 1, 1), T(2024, 1, 10), T(2024, 1, 20), T(2024, 2, 2)]
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = ticks.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
        part.coalesce(1).write.mode("append").parquet(f"{src}/ticks")
    return f"{src}/ticks", ticks


def test_hourly_bars_equal_batch_on_closed_hours(spark, tick_parts, rows):
    path, ticks = tick_parts
    out = jobs.hourly_bars(jobs.file_stream(spark, path, 1), folder())
    last = ticks.agg(F.max("ts")).first()[0]
    batch = ticks.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start"), "item").agg(
        F.avg("price"), F.min("price"), F.max("price"), F.count("*"))
    closed = batch.where(F.col("hour_start") + F.expr("interval 2 hours") <= F.lit(last).cast("timestamp_ntz"))
    assert rows(out) == rows(closed)


def test_daily_state_equals_batch(spark, tick_parts, rows):
    path, ticks = tick_parts
    out = jobs.daily_state(jobs.file_stream(spark, path, 1), folder())
    batch = ticks.groupBy(F.to_date("ts").alias("day"), "item").agg(F.count("*"), F.sum("price"), F.min("price"), F.max("price"))
    assert rows(out) == rows(batch)


def test_alert_is_given_once_across_batches(spark, rows):
    src = folder()
    first = [(1, T(2026, 1, 1, 10), 9), (2, T(2026, 1, 1, 11), 3)]
    second = [(1, T(2026, 1, 1, 12), 9), (2, T(2026, 1, 1, 12), 9), (3, T(2026, 1, 1, 13), 7)]
    for part in (first, second):
        spark.createDataFrame(part, "notice_id INT, ts TIMESTAMP_NTZ, score INT").coalesce(1).write.mode("append").parquet(f"{src}/n")
    out = jobs.alerts(jobs.file_stream(spark, f"{src}/n", 1), folder())
    assert rows(out, "notice_id", "score") == [(1, 9), (3, 7)]


def test_alerts_do_not_depend_on_arrival(spark, rows):
    src = folder()
    later = [(1, T(2026, 1, 1, 12), 9), (2, T(2026, 1, 1, 12), 8), (2, T(2026, 1, 1, 12), 7)]
    earlier = [(1, T(2026, 1, 1, 10), 3), (3, T(2026, 1, 1, 9), 7)]
    for part in (later, earlier):
        spark.createDataFrame(part, "notice_id INT, ts TIMESTAMP_NTZ, score INT").coalesce(1).write.mode("append").parquet(f"{src}/n")
    out = jobs.alerts(jobs.file_stream(spark, f"{src}/n", 1), folder())
    assert rows(out) == [(2, T(2026, 1, 1, 12), 7), (3, T(2026, 1, 1, 9), 7)]


def test_alert_state_shrinks_and_late_copies_change_nothing(spark, rows):
    src, work = folder(), folder()
    for day in range(1, 9):  # 200 notices a day, and a late copy of the first day's each day
        part = [(day * 1000 + k, T(2026, 1, day, 1 + k % 20), 8) for k in range(200)] + [(1000 + day, T(2026, 1, day, 23), 1)]
        spark.createDataFrame(part, "notice_id INT, ts TIMESTAMP_NTZ, score INT").coalesce(1).write.mode("append").parquet(f"{src}/n")
    query = jobs.alert_stream(jobs.file_stream(spark, f"{src}/n", 1), work)
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) < 700 and held[-1] < max(held)
    seen = spark.read.parquet(f"{work}/sightings").groupBy("notice_id").agg(F.min("first").alias("f"))
    assert seen.count() == 8 * 200 and seen.where("f.score < 7").count() == 0


def test_store_reads_only_the_buckets_of_a_batch(spark, rows):
    base = spark.createDataFrame([(f"/n/{k}", f"t{k}") for k in range(500)], "link STRING, title STRING")
    store = NoticeStore(base, folder(), buckets=16, compact_after=3)
    batch = spark.createDataFrame([("/n/7", "new title")], "link STRING, title STRING")
    here = batch.select(store.bucket().alias("b")).first().b
    store.merge(batch, 0)
    for read in (store._scan(1, [here]), store.current(batch, 1)):
        text = read._sc._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
        assert text.count("PartitionFilters: [") == 2 and text.count(f"(bucket") >= 2 and f" = {here})" in text
    assert rows(store.current(batch, 1)) == [("/n/7", "new title")]
    assert store.notices().count() == 500


def test_compaction_folds_changes_and_a_repeated_batch_changes_nothing(spark, rows):
    schema = "link STRING, title STRING"
    base = spark.createDataFrame([("a", "A"), ("b", "B")], schema)
    place = folder()
    store = NoticeStore(base, place, buckets=4, compact_after=2)
    parts = [[("a", "A1")], [("c", "C")], [("a", "A2"), ("d", "D")], [("c", "C3")], [("b", "B4")]]
    for number, part in enumerate(parts):
        for _ in range(2):  # each batch twice, as after a crash
            store.merge(spark.createDataFrame(part, schema), number)
    assert numbers_below(spark, f"{place}/base", "upto")[-1] >= 2
    again = NoticeStore(base, place, buckets=4)
    expected = [("a", "A2"), ("b", "B4"), ("c", "C3"), ("d", "D")]
    assert rows(store.notices(), "link", "title") == rows(again.notices(), "link", "title") == expected
    assert not any("upto=-1/" in f or "batch=0/" in f for f in again.notices().inputFiles())


def test_upsert_sees_earlier_batches(spark, rows):
    src = folder()
    base = spark.createDataFrame([("a", "A"), ("b", "B")], "link STRING, title STRING")
    batches = [[("b", "B2"), ("c", "C")], [("c", "C2"), ("b", "B2"), ("d", "D")]]
    for part in batches:
        spark.createDataFrame(part, "link STRING, title STRING").coalesce(1).write.mode("append").parquet(f"{src}/n")
    out = jobs.upsert_notices(jobs.file_stream(spark, f"{src}/n", 1), base, folder())
    current = base
    for part in batches:
        current = notice_upsert(current, spark.createDataFrame(part, "link STRING, title STRING")).drop("status")
    assert rows(out, "link", "title") == rows(current)


def test_restart_goes_on_where_it_stopped(spark, rows):
    src, work = folder(), folder()
    base = spark.createDataFrame([("a", "A")], "link STRING, title STRING")

    def land(part):
        spark.createDataFrame(part, "link STRING, title STRING").coalesce(1).write.mode("append").parquet(f"{src}/n")

    def run():
        return jobs.upsert_notices(jobs.file_stream(spark, f"{src}/n"), base, work)

    land([("b", "B")])
    assert rows(run(), "link", "title") == [("a", "A"), ("b", "B")]
    land([("a", "A2")])
    assert rows(run(), "link", "title") == [("a", "A2"), ("b", "B")]
    assert rows(run(), "link", "title") == [("a", "A2"), ("b", "B")]


def test_refresh_touches_only_arriving_events(spark, rows):
    src = folder()
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=k) for k in range(10)]
    index = spark.createDataFrame([("S", d, 100.0 + k) for k, d in enumerate(days)], "sector STRING, date DATE, price DOUBLE")
    curves = study.date_curves(index, [-1, 0, 3])
    for part in ([(1, days[0])], [(2, days[4])]):
        spark.createDataFrame(part, "event_id BIGINT, date DATE").coalesce(1).write.mode("append").parquet(f"{src}/e")
    out = jobs.refresh_trajectories(jobs.file_stream(spark, f"{src}/e", 1), curves, folder())
    assert rows(out, "event_id", "h") == [(1, 0), (1, 3), (2, -1), (2, 0), (2, 3)]


def late_ticks(spark, first, late, work):
    """Runs the price refresh over two landings; the trajectories, and the dates that the second one rewrote."""
    src = folder()
    schema = "item STRING, day DATE, price DOUBLE"
    events = spark.createDataFrame([(k, dt.date(2026, 1, 1) + dt.timedelta(days=k)) for k in range(60)], "event_id BIGINT, date DATE")
    for part in (first, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{src}/t")
        out = jobs.refresh_prices(jobs.file_stream(spark, f"{src}/t"), events, work, {"S": ["x", "y"]}, [-2, 0, 3])
    ticks = spark.createDataFrame(first + late, schema)
    prices = ticks.groupBy("item", "day").agg((F.sum("price") / F.count("price")).alias("price"))
    whole = study.event_trajectory(events, study.date_curves(study.sector_index(prices, {"S": ["x", "y"]}), [-2, 0, 3]))
    again = spark.read.parquet(f"{work}/trajectories").where("batch = 1").select("date").distinct()
    return out, whole, sorted(r.date.timetuple().tm_yday for r in again.collect())


def test_a_late_tick_rewrites_just_its_dates(spark, rows):
    day = lambda k: dt.date(2026, 1, 1) + dt.timedelta(days=k - 1)  # noqa: E731  day of the year
    first = [("x", day(k), 10.0 + k) for k in range(1, 51) if k not in (21, 22)] + [("y", day(k), 5.0) for k in (1, 50)]
    out, whole, rewritten = late_ticks(spark, first, [("x", day(21), 99.0), ("z", day(30), 1.0)], folder())
    assert rows(out) == rows(whole)
    # Day 21's price also holds on day 22: dates that read them 2 days before, on the day, or 3 days ahead.
    assert rewritten == sorted({d - h for d in (21, 22) for h in (-2, 0, 3)})


def test_new_first_and_last_days_reach_every_item(spark, rows):
    day = lambda k: dt.date(2026, 1, 1) + dt.timedelta(days=k - 1)
    first = [("x", day(k), 10.0 + k) for k in range(10, 40)] + [("y", day(20), 5.0)]
    out, whole, rewritten = late_ticks(spark, first, [("z", day(45), 1.0), ("x", day(8), 3.0), ("y", day(12), 7.0)], folder())
    assert rows(out) == rows(whole)
    assert {8, 9, 45, 44} <= set(rewritten) and 30 not in rewritten


def test_days_follow_the_session_zone(spark, rows):
    """Half-hour zones too: a day is a wall-clock day."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        src = folder()
        ticks = [("x", T(2026, 1, 1, 0, 10), 1.0), ("x", T(2026, 1, 1, 23, 50), 2.0), ("x", T(2026, 1, 2, 0, 5), 4.0)]
        spark.createDataFrame(ticks, "item STRING, ts TIMESTAMP_NTZ, price DOUBLE").write.parquet(f"{src}/t")
        out = jobs.daily_state(jobs.file_stream(spark, f"{src}/t"), folder())
        assert rows(out, "day", "tick_count", "price_sum") == [(dt.date(2026, 1, 1), 2, 3.0), (dt.date(2026, 1, 2), 1, 4.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_date_curve_is_written_once_per_batch(spark, rows):
    """Events of one date share its stored curve, and an event shows the curve of its own latest batch."""
    src, work = folder(), folder()
    day = lambda k: dt.date(2026, 1, k)
    events = spark.createDataFrame([(k, day(1 + k % 3)) for k in range(30)] + [(99, day(20))], "event_id BIGINT, date DATE")
    for part in ([("x", day(k), 10.0 * k) for k in range(1, 9)], [("x", day(2), 50.0)]):
        spark.createDataFrame(part, "item STRING, day DATE, price DOUBLE").coalesce(1).write.mode("append").parquet(f"{src}/t")
        out = jobs.refresh_prices(jobs.file_stream(spark, f"{src}/t"), events, work, {"S": ["x"]}, [0, 1])
    assert set(spark.read.parquet(f"{work}/trajectories").columns) == {"event_id", "date", "batch"}
    assert rows(spark.read.parquet(f"{work}/curves").where("batch = 0"), "date") == [(day(k),) for k in (1, 2, 3)]
    index = {1: 35.0 / 10.0 * 100, 2: 30.0 / 35.0 * 100, 3: 40.0 / 30.0 * 100}
    expected = [(k, day(1 + k % 3), h, round(100.0 if h == 0 else index[1 + k % 3], 6)) for k in range(30) for h in (0, 1)]
    assert sorted(rows(out.select("event_id", "date", "h", F.round("index", 6)))) == sorted(expected)


def test_refreshed_events_keep_the_curve_of_their_batch(spark, rows):
    src, work = folder(), folder()
    day = lambda k: dt.date(2026, 1, k)
    for part, price in ([(1, day(1)), (2, day(2)), (3, day(1))], 10.0), ([(2, day(1)), (4, day(2))], 30.0):
        index = spark.createDataFrame([("S", day(1), 10.0), ("S", day(2), price)], "sector STRING, date DATE, price DOUBLE")
        spark.createDataFrame(part, "event_id BIGINT, date DATE").coalesce(1).write.mode("append").parquet(f"{src}/e")
        out = jobs.refresh_trajectories(jobs.file_stream(spark, f"{src}/e"), study.date_curves(index, [0, 1]), work)
    assert rows(out, "event_id", "h", "index") == [(1, 0, 100.0), (1, 1, 100.0), (2, 0, 100.0), (2, 1, 300.0), (3, 0, 100.0), (3, 1, 100.0), (4, 0, 100.0)]
    assert set(spark.read.parquet(f"{work}/trajectories").columns) == {"event_id", "date", "batch"}
