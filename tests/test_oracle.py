"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from eventide.plans.catalogue import QUERIES
from eventide.plans.oracle import ORACLE_SQL

ROWS_ONLY = {"gbt_scores", "gbt_importance", "scenario_model_scores", "sector_trees"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_only_models_lack_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == []


def test_boosted_trees_score_every_label(spark, sf_dir):
    scores = QUERIES["gbt_scores"](spark, sf_dir)
    assert scores.count() == QUERIES["walk_forward"](spark, sf_dir).count()
    assert scores.where("pred is null").count() == 0


def test_importance_covers_all_features(spark, sf_dir):
    table = QUERIES["gbt_importance"](spark, sf_dir).collect()
    assert len(table) == 12
    assert abs(sum(r.importance for r in table) - 1.0) < 1e-6


def test_model_ranking_gives_ten_items_per_day(spark, sf_dir):
    out = QUERIES["scenario_model_scores"](spark, sf_dir)
    per_day = [r["count"] for r in out.groupBy("date").count().collect()]
    assert per_day and set(per_day) == {10}
