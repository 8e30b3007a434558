"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from eventide.plans.catalogue import QUERIES

NO_SESSION_PLAN = {"gbt_scores", "gbt_importance", "scenario_model_scores"} | {n for n in QUERIES if n.startswith("stream_")}


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SESSION_PLAN))
def test_no_pair_products_and_no_python_rows(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for banned in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]:
        assert banned not in text


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    text = plan(QUERIES["scan_prune"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text
    assert "GreaterThanOrEqual(l_shipdate" in text and "Not(EqualTo(l_returnflag,R))" in text


def test_dedup_reads_only_what_is_used(spark, sf_dir):
    text = plan(QUERIES["event_dedup"](spark, sf_dir).select("date", "honing_mat_demand"))
    assert "o_orderstatus" not in text and "SortAggregate" not in text


def test_big_side_is_not_shuffled_for_small_tables(spark, sf_dir):
    """Joins with calendar-bounded stage tables broadcast by measured size."""
    for name in ["event_trajectory", "event_feature_join", "trajectory_wide", "nearest_summary"]:
        text = plan(QUERIES[name](spark, sf_dir))
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_stage_table_above_the_threshold_is_shuffled(spark, sf_dir):
    """Beyond the broadcast threshold the same query falls back to a sort-merge join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = QUERIES["event_trajectory"](spark, sf_dir)
    expected = small.agg(F.count("*"), F.round(F.sum("index"), 2)).first()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = QUERIES["event_trajectory"](spark, sf_dir)
        assert "SortMergeJoin" in plan(wide)
        assert wide.agg(F.count("*"), F.round(F.sum("index"), 2)).first() == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_ticks_join_and_sum_without_an_exchange(spark, sf_dir):
    text = plan(QUERIES["tick_store"](spark, sf_dir))
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert text.count("Bucketed: true") == 2


def test_months_prune_folders(spark, sf_dir):
    text = plan(QUERIES["tick_months"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(month" in text and "1996-01" in text


def test_tick_store_has_more_buckets_for_more_ticks(spark, sf_dir, monkeypatch):
    """A bucket is one task's: its rows stay the same as the table grows."""
    from eventide.sources import driver_tables as dt

    few = QUERIES["tick_store"](spark, sf_dir)
    monkeypatch.setattr(dt, "TICKS_PER_BUCKET", 200)
    buckets = -(-dt.table(spark, sf_dir, "lineitem").count() // 200)
    many = QUERIES["tick_store"](spark, sf_dir)
    text = plan(many)
    assert buckets > 16 and text.count(f"SelectedBucketsCount: {buckets} out of {buckets}") == 2 and "Exchange" not in text
    assert sorted(many.collect()) == sorted(few.collect())


def test_forecast_values_are_rounded_once_per_date(spark):
    """An event meets one row, its date's frame; whether it is high is judged before the rounding."""
    from eventide.operators import evaluate

    points = "sector STRING, date STRING, h INT, y DOUBLE, pred DOUBLE, source STRING"
    stored = spark.createDataFrame([("S", "d1", 1, 90.12345, 100.0004, "honest"), ("S", "d1", -9, None, 100.0, "honest"), ("T", "d2", 1, 0.0, 99.9996, "honest")], points)
    events = spark.createDataFrame([(1, "d1", 2), (2, "d1", 9), (2, "d1", 9), (3, "d2", None), (4, "d2", 0), (5, None, 0)], "event_id INT, date STRING, lead_time_days INT")
    out = evaluate.forecast_choice(events, stored, stored, digits=3)
    text = plan(out)
    assert 0 < text.index("Generate") < text.index("Join")
    frame = [("S", 1, "predicted", 100.0, True), ("S", 1, "actual", 90.123, True)]
    wide = [*frame, ("S", -9, "predicted", 100.0, True)]
    expected = [(1, *x) for x in frame] + [(2, *x) for x in wide] * 2 + [(4, "T", 1, "predicted", 100.0, False)]
    assert sorted(tuple(r) for r in out.select("event_id", "sector", "h", "kind", "value", "is_high").collect()) == sorted(expected)
