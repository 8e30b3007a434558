"""One key with a third of all rows: results stay whole."""

import datetime as dt

from pyspark.sql import functions as F

from eventide.operators import bars, calendar, enrich, ingest, season

DAY = "date_add(date'2026-01-01', cast(pmod(hash(id), 40) as int))"


def ticks(spark, n=60_000):
    item = "case when id % 3 = 0 then 'hot' else concat('i', id % 500) end"
    return spark.sql(f"select id, {item} item, {DAY} day, cast(id % 97 as double) price from range({n})")


def test_hot_item_keeps_all_ticks(spark):
    out = bars.daily_bars(ticks(spark))
    assert out.agg(F.sum("tick_count")).first()[0] == 60_000
    total = out.agg(F.sum(F.col("price_mean") * F.col("tick_count"))).first()[0]
    assert abs(total - sum(k % 97 for k in range(60_000))) < 1e-3


def test_hot_day_does_not_multiply_ticks(spark):
    events = spark.sql(
        "select id event_id, case when id % 3 = 0 then date'2026-01-05' else date_add(date'2026-01-01', cast(id % 40 as int)) end date,"
        " cast(id % 2 as int) is_new_raid, cast(id % 11 as double) impact_score, cast(id % 3 as int) - 1 sentiment_score, 'Update' event_type from range(30000)")
    days = calendar.daily_event_features(events, ["is_new_raid"])
    joined = calendar.event_feature_join(ticks(spark), days, ["is_new_raid"])
    assert joined.count() == 60_000
    assert joined.where("event_count = 0").count() == 0


def test_hot_link_is_deduplicated_once(spark):
    old = spark.range(10).select(F.lit("hot").alias("link"), F.lit("old").alias("v"))
    new = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("link"), F.lit("new").alias("v"))
    out = ingest.post_dedup(old, new)
    assert out.count() == 20_001
    assert out.where("link = 'hot'").first().v == "old"


def test_hot_hour_deviation_matches_tick_level_mean(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [("hot" if k % 3 == 0 else f"i{k % 7}", base + dt.timedelta(minutes=(k * 37) % 4320), float(50 + k % 31)) for k in range(3000)]
    got = {r.hour: r.avg_deviation_pct for r in season.hourly_deviation(spark.createDataFrame(rows, "item STRING, ts TIMESTAMP_NTZ, price DOUBLE")).collect()}
    sums = {}
    for item, ts, p in rows:
        s = sums.setdefault((item, ts.date()), [0.0, 0])
        s[0] += p
        s[1] += 1
    hours = {}
    for item, ts, p in rows:
        mean = sums[item, ts.date()][0] / sums[item, ts.date()][1]
        hours.setdefault(ts.hour, []).append((p - mean) / mean * 100)
    assert got.keys() == hours.keys()
    assert all(abs(got[h] - sum(v) / len(v)) < 1e-9 for h, v in hours.items())


def test_hot_target_item_joins_once_per_place(spark):
    events = spark.range(5000).select("id", F.concat_ws(",", F.lit("hot"), F.col("id").cast("string"), F.lit(" hot ")).alias("target_items"))
    known = spark.createDataFrame([("hot",), ("hot",), ("7",)], "item STRING")
    out = enrich.target_item_filter(events, known, "id", forbidden=["zzz"])
    assert out.where("target_items = 'hot, hot'").count() == 4999
    assert out.where("id = 7").first().target_items == "hot, 7, hot"
