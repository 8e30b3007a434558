import json
import tempfile

import pytest
from pyspark.sql import functions as F

from eventide import schemas
from eventide.operators import calendar
from eventide.session import shared_dir, stage_table
from eventide.sources import readers, sinks


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="eventide-test-")


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_csv_with_mark_quotes_and_line_breaks(spark, folder):
    path = write(f"{folder}/n.csv", 'date,category,title,link\n2026-01-07,공지,"a, ""b""\nc",/1\n', "utf-8-sig")
    rows = readers.read_csv(spark, path, schemas.NOTICES).collect()
    assert [tuple(r) for r in rows] == [("2026-01-07", "공지", 'a, "b"\nc', "/1")]


def test_csv_columns_are_found_by_name(spark, folder):
    path = write(f"{folder}/v.csv", "trade_count,date,item_name,extra\n5,2026-01-01,x,1\nbad,2026-01-02,y,2\n")
    rows = readers.read_csv(spark, path, schemas.VOLUME).collect()
    assert [tuple(r) for r in rows] == [("x", "2026-01-01", None, 5), ("y", "2026-01-02", None, None)]


def test_headerless_csv_takes_given_names(spark, folder):
    path = write(f"{folder}/o.csv", "2026-01-07,Update,공지,title,/1\n")
    row = readers.read_csv(spark, path, schemas.NOTICES_HEADERLESS, header=False).first()
    assert (row.event_type, row.event_name) == ("Update", "title")


def test_json_documents(spark, folder):
    record = {"date": "2025-05-20 18:00", "post_link": "/1", "analysis": {"target_items": ["a", "b"], "confidence_score": 9}}
    path = write(f"{folder}/a.json", json.dumps([record], indent=2))
    row = readers.read_json_documents(spark, path, schemas.POST_ANALYSES).first()
    assert row.analysis.target_items == ["a", "b"] and row.analysis.market_sentiment is None
    assert row.event_name is None


def test_json_map_list_and_metrics(spark, folder):
    mapping = write(f"{folder}/m.json", json.dumps({"old": "new", "gone": None}, indent=2))
    assert sorted(map(tuple, readers.read_string_map(spark, mapping, "item", "mapped").collect())) == [("gone", None), ("old", "new")]
    names = write(f"{folder}/l.json", json.dumps(["가", "나"], indent=2))
    assert [tuple(r) for r in readers.read_string_list(spark, names, "item").collect()] == [(0, "가"), (1, "나")]
    metrics = write(f"{folder}/t.json", json.dumps({"T+1": {"rmse": 0.5, "mae": 0.25}, "avg_rmse": 0.5}, indent=2))
    assert [tuple(r) for r in readers.read_horizon_metrics(spark, metrics).collect()] == [("T+1", 0.5, 0.25)]


def test_stored_trajectories_and_lookup(spark, folder):
    doc = {"honing": [{"date": "2026-01-07", "predicted_trajectory": [99.0, None, 104.5], "horizons": [-1, 0, 7]},
                      {"date": "2026-01-08", "predicted_trajectory": [99.0], "horizons": [0]}]}
    stored = readers.read_predictions(spark, write(f"{folder}/p.json", json.dumps(doc)))
    at7 = {r.date: r.pred for r in readers.prediction_at(stored, 7).collect()}
    at0 = {r.date: r.pred for r in readers.prediction_at(stored, 0).collect()}
    assert at7 == {"2026-01-07": 104.5, "2026-01-08": None}
    assert at0 == {"2026-01-07": None, "2026-01-08": 99.0}


def test_newest_snapshot_and_fallback(spark, folder):
    for name in ("ticks_20260101.csv", "ticks_20260310.csv", "other_20270101.csv"):
        write(f"{folder}/{name}", "x\n")
    spark.range(3).write.csv(f"{folder}/ticks_20260209.csv")
    assert readers.latest_snapshot(spark, folder, "ticks_", ".csv").endswith("ticks_20260310.csv")
    spark.range(3).write.csv(f"{folder}/ticks_20260401.csv")
    assert readers.latest_snapshot(spark, folder, "ticks_", ".csv") == f"{folder}/ticks_20260401.csv"
    assert readers.latest_snapshot(spark, folder, "none_", ".csv", fallback="all.csv") == "all.csv"
    with pytest.raises(FileNotFoundError):
        readers.latest_snapshot(spark, folder, "none_", ".csv")


def test_cascade_prefers_richer_source(spark, folder):
    schema = schemas.EVENTS_V2
    cascade = [
        ("v2.csv", "v2", lambda p: readers.read_csv(spark, p, schemas.EVENTS_V2)),
        ("v1.csv", "v1", lambda p: readers.read_csv(spark, p, schemas.EVENTS_V1)),
    ]
    assert readers.source_cascade(spark, folder, cascade, schema).count() == 0
    write(f"{folder}/v1.csv", "date,event_type,title,link,market_impact\n2026-01-07,Update,t,/1,Raid\n")
    row = readers.source_cascade(spark, folder, cascade, schema, {"impact_score": 0.0, "sentiment": "neutral"}).first()
    assert (row.source, row.impact_score, row.sentiment, row.keywords) == ("v1", 0.0, "neutral", None)
    write(f"{folder}/v2.csv", "date,event_type,title,link,keywords,impact_score,sentiment,reasoning\n2026-01-07,Update,t,/1,Gem,bad,positive,r\n")
    row = readers.source_cascade(spark, folder, cascade, schema, {"impact_score": 0.0}).first()
    assert (row.source, row.impact_score, row.keywords) == ("v2", 0.0, "Gem")


def test_sinks(spark, folder):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "k STRING, v INT")
    sinks.write_sorted_csv(df, f"{folder}/csv", [F.desc("v")])
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 3
    sinks.append_new(df, f"{folder}/pq")
    sinks.append_new(df, f"{folder}/pq")
    assert spark.read.parquet(f"{folder}/pq").count() == 6
    f = spark.createDataFrame([("S", "2026-01-01", 7, 1.5), ("S", "2026-01-01", 0, 100.0)], "sector STRING, date STRING, h INT, pred DOUBLE")
    sinks.write_trajectories(f, f"{folder}/traj")
    row = spark.read.json(f"{folder}/traj").first()
    assert (row.sector, row.horizons, row.predicted_trajectory) == ("S", [0, 7], [100.0, 1.5])


def test_month_partitions_prune(spark, folder):
    ticks = spark.sql("select 'x' item, date_add(date'2026-01-01', cast(id as int)) day, 1.0D price from range(90)")
    sinks.write_ticks_by_month(ticks, f"{folder}/ticks")
    back = spark.read.parquet(f"{folder}/ticks").where("month = '2026-02'")
    assert back.count() == 28
    assert len(back.inputFiles()) >= 1


def test_stage_table_lives_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    out = stage_table(df, "numbers")
    assert out.count() == 10
    assert shared_dir(spark).split(":")[-1] in out.inputFiles()[0]


def test_summaries_merge_by_date_and_title(spark):
    base = spark.createDataFrame([("2026-01-01", "t", 1)], "date STRING, title STRING, impact INT")
    extra = spark.createDataFrame([("2026-01-01", "t"), ("2026-01-02", "t")], "date STRING, title STRING")
    out = calendar.summary_merge(base, extra)
    assert sorted((r.date, r.impact) for r in out.collect()) == [("2026-01-01", 1), ("2026-01-02", None)]
