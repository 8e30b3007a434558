"""Solvers, pooled levels and boosted trees against plain numpy."""

import datetime as dt
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.fixed_values import HORIZONS, RISING_SCORES, SECTOR_FEATURES
from eventide.functions.linear import clamped_solve, lower_hull, solve
from eventide.operators import models, sector_models
from eventide.operators import walkforward as wf
from eventide.plans import catalogue
from eventide.plans.catalogue import QUERIES
from eventide.session import stage_table


def test_solve_equals_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in (1, 2, 4, 12):
        for _ in range(5):
            a = rng.normal(size=(n + 3, n))
            rows.append(((a.T @ a + 0.01 * np.eye(n)).tolist(), rng.normal(size=n).tolist()))
    table = spark.createDataFrame(rows, "m array<array<double>>, b array<double>")
    for r in table.withColumn("x", solve(F.col("m"), F.col("b"))).collect():
        assert np.allclose(np.array(r.m) @ r.x, r.b, atol=1e-8)


def test_clamped_slopes_are_the_constrained_optimum(spark):
    """No feasible change lowers the error: free slopes have gradient zero, slopes held at zero a gradient that points up."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        a = rng.normal(size=(8, 4))
        rows.append(((a.T @ a + 0.01 * np.eye(4)).tolist(), (rng.normal(size=4) * 3).tolist(), [bool(x) for x in rng.integers(0, 2, 4)]))
    table = spark.createDataFrame(rows, "m array<array<double>>, b array<double>, c array<boolean>")
    held = 0
    for r in table.withColumn("x", clamped_solve(F.col("m"), F.col("b"), F.col("c"), 4)).collect():
        gradient = np.array(r.m) @ r.x - np.array(r.b)
        for x, g, clamped in zip(r.x, gradient, r.c):
            if clamped and x == 0:
                held += 1
                assert g >= -1e-9
            else:
                assert abs(g) < 1e-8 and (x > 0 or not clamped)
    assert held > 100


def pooled(values, weights):
    """Pool adjacent violators, in place on lists."""
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, n in blocks for _ in range(n)]


def level_table(spark, values):
    days = dt.date(2000, 1, 1)
    rows = [("S", 0, days, float(k), 0.0, float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "sector string, h int, date date, x double, score double, y double")


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "flat"])
def test_pooled_levels(spark, shape):
    rng = np.random.default_rng(2)
    values = {"noise": rng.normal(size=300) + np.arange(300) / 60, "rising": np.arange(300.0), "falling": -np.arange(300.0), "flat": np.ones(300)}[shape]
    got = wf.isotonic_levels(level_table(spark, values)).orderBy("score").collect()
    assert len(got) == 300
    assert np.allclose([r.isotonic_index for r in got], pooled(values, np.ones(300)), atol=1e-9)
    assert np.allclose([r.mean_index for r in got], values)


def test_ten_thousand_levels_take_seconds(spark):
    rng = np.random.default_rng(3)
    values = np.arange(10_000.0) + rng.normal(size=10_000) * 5
    start = time.perf_counter()
    got = wf.isotonic_levels(level_table(spark, values)).orderBy("score").collect()
    assert time.perf_counter() - start < 30
    assert np.allclose([r.isotonic_index for r in got], pooled(values, np.ones(len(values))), atol=1e-6)


def test_hull_of_few_points(spark):
    table = spark.sql("SELECT array(named_struct('k', 0, 'x', 0D, 'y', 0D)) AS p")
    assert [p.k for p in table.select(lower_hull(F.col("p")).alias("h")).first().h] == [0]


# ------------------------------------------------------------------------- trees


class Booster:
    """Squared-error trees by trying every threshold, monotone by bounds."""

    def __init__(self, x, y, w, rises, trees, depth=5, rate=0.05, penalty=1.0, least_weight=1.0):
        self.rises, self.depth, self.rate, self.penalty, self.least = rises, depth, rate, penalty, least_weight
        self.base = (w * y).sum() / w.sum()
        self.cuts = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
        pred, self.trees = np.full(len(y), self.base), []
        same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
        for _ in range(trees):
            g, h = np.bincount(same, w * (y - pred)), np.bincount(same, w)
            self.most = max((g * g / h).sum(), 1e-12 * (np.bincount(same, w * y) ** 2 / h).sum())
            self.trees.append(self.grow(x, w * (y - pred), w, 0, -np.inf, np.inf))
            pred += np.array([self.walk(self.trees[-1], row) for row in x])

    def value(self, g, h, low, high):
        return min(max(g / (h + self.penalty), low), high)

    def score(self, g, h, v):
        return 2 * g * v - (h + self.penalty) * v * v

    def grow(self, x, g, w, depth, low, high):
        whole, heavy = g.sum(), w.sum()
        v = self.value(whole, heavy, low, high)
        best = None
        for f, t in ((f, t) for f in range(x.shape[1]) for t in self.cuts[f]) if depth < self.depth else ():
            side = x[:, f] <= t
            gl, hl = g[side].sum(), w[side].sum()
            gr, hr = whole - gl, heavy - hl
            if hl < self.least or hr < self.least:
                continue
            vl, vr = self.value(gl, hl, low, high), self.value(gr, hr, low, high)
            if self.rises[f] and vl > vr:
                continue
            gain = round((self.score(gl, hl, vl) + self.score(gr, hr, vr) - self.score(whole, heavy, v)) / self.most, 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, t, (vl + vr) / 2)
        if best is None:
            return v * self.rate
        _, f, t, middle = best
        side = x[:, f] <= t
        bounds = ((low, middle), (middle, high)) if self.rises[f] else ((low, high), (low, high))
        return f, t, *(self.grow(x[s], g[s], w[s], depth + 1, *b) for s, b in zip((side, ~side), bounds))

    def walk(self, node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def predict(self, row):
        return self.base + sum(self.walk(t, row) for t in self.trees)


def label_rows(n=90, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 4)).astype(float)
    y = 100 + 2 * x[:, 0] - 3 * x[:, 1] + x[:, 2] * x[:, 3] / 3 + rng.normal(size=n)
    day = dt.date(2020, 1, 1)
    rows = [("S", h, day + dt.timedelta(days=int(k)), [float(v) for v in x[k]], [True, True, False, False], float(x[k][0]), float(y[k] + h) if k % 11 else None) for h in (0, 7) for k in range(n)]
    return rows, "sector string, h int, date date, f array<double>, rises array<boolean>, score double, y double"


def test_trees_equal_brute_force(spark):
    rows, schema = label_rows()
    labels = spark.createDataFrame(rows, schema)
    series = sector_models.boosted_series(labels, trees=8)
    got = {(r.h, r.date): r.pred for r in sector_models.boosted_forecasts(series, labels).collect()}
    for h in (0, 7):
        own = [r for r in rows if r[1] == h]
        usable = [r for r in own if r[6] is not None]
        first = min(r[2] for r in usable)
        w = np.array([(1 + r[5] ** 2) * (1 + (r[2] - first).days / 100) for r in usable])
        model = Booster(np.array([r[3] for r in usable]), np.array([r[6] for r in usable]), w, [True, True, False, False], 8)
        assert all(abs(got[h, r[2]] - model.predict(r[3])) < 1e-6 for r in own)


def test_forecasts_never_fall_in_a_rising_score(spark):
    rows, schema = label_rows()
    labels = spark.createDataFrame(rows, schema)
    series = sector_models.boosted_series(labels, trees=30)
    grid = [("S", 0, dt.date(2020, 1, 1) + dt.timedelta(days=k), [float(v) for v in f], [True, True, False, False], 0.0, None) for k, f in enumerate(itertools.product(range(6), repeat=4))]
    pred = np.array([r.pred for r in sector_models.boosted_forecasts(series, spark.createDataFrame(grid, schema)).orderBy("date").collect()]).reshape(6, 6, 6, 6)
    assert (np.diff(pred, axis=0) >= -1e-9).all() and (np.diff(pred, axis=1) >= -1e-9).all()
    assert pred.std() > 1 and (np.diff(pred, axis=2) < -1e-9).any()


def test_every_sector_and_horizon_has_its_model(spark, sf_dir):
    labels = catalogue._feature_labels(spark, sf_dir)
    series = sector_models.boosted_series(labels, trees=3).collect()
    assert {(r.sector, r.h, r.tree) for r in series} == {(s, h, t) for s in RISING_SCORES for h in HORIZONS for t in (1, 2, 3)}


def test_final_trees_score_every_label(spark, sf_dir):
    out = stage_table(QUERIES["sector_trees"](spark, sf_dir), "test-trees")
    assert out.count() == QUERIES["walk_forward"](spark, sf_dir).count()
    assert out.where("pred is null").count() == 0
    weighted = wf.sample_weights(catalogue._feature_labels(spark, sf_dir)).where("y is not null").select("sector", "h", "date", "w")
    errors = out.join(weighted, ["sector", "h", "date"]).groupBy("sector", "h").agg(
        F.sum(F.col("w") * (F.col("pred") - F.col("y")) ** 2).alias("trees"),
        (F.sum(F.col("w") * F.col("y") ** 2) - F.sum(F.col("w") * F.col("y")) ** 2 / F.sum("w")).alias("mean"))
    assert errors.where("mean > 1e-6 and trees >= mean").count() == 0


def test_too_few_dates_give_no_model_and_repeat_the_horizon_before(spark):
    rows, schema = label_rows(6)
    rows = [r if r[1] == 0 else (*r[:6], None) for r in rows]
    labels = spark.createDataFrame(rows, schema)
    series = sector_models.boosted_series(labels, trees=2)
    assert {r.h for r in series.collect()} == {0}
    got = {(r.h, r.date): r.pred for r in sector_models.boosted_forecasts(series, labels).collect()}
    assert all(got[7, d] == got[0, d] for h, d in got if h == 7)
    lines = sector_models.walk_forward_lines(labels).where("h = 7 and fold_start >= 3").collect()
    assert lines and all(r.pred is not None for r in lines)


# ---------------------------------------------------------------------- backtest


def frame_rows():
    rng = np.random.default_rng(9)
    day = dt.date(2024, 1, 1)
    rows = [(f"i{c}{k}", day + dt.timedelta(days=d), c, float(rng.integers(0, 10)), float(d % 2), 1 if d == 39 else int(d % 7 == 0), 0.0)
            for d in range(40) for c in "ab" for k in range(2)]
    rows = [(*r[:6], 0.01 * r[3] - 0.02 * r[4] + (0.1 if r[2] == "a" else 0.0) + float(rng.normal() * 1e-3)) for r in rows]
    return rows + [("new", day + dt.timedelta(days=39), "c", 5.0, 1.0, 1, 0.03)]


FRAME = "item string, day date, category string, honing_mat_demand double, is_weekend double, is_event_day int, excess_return double"


def test_an_unseen_class_is_scored(spark):
    table = spark.createDataFrame(frame_rows(), FRAME).withColumns({f"is_{c}": (F.col("category") == c).cast("int") for c in "abc"})
    last = models.last_event_day(table)
    rows = {r["item"]: r for r in models.backtest_rows(table, last).collect()}
    assert len(rows) == 5 and rows["new"].predicted_excess is not None and rows["new"].train_rows == 156
    out = {r["item"]: r for r in models.backtest_features(table, last, ["honing_mat_demand", "is_weekend", "is_a", "is_b", "is_c"]).collect()}
    assert len(out) == 5 and all(abs(r.error) < 0.02 for k, r in out.items() if k != "new") and out["new"].predicted_excess is not None


def test_the_split_stands_before_the_trim(spark):
    whole = spark.createDataFrame(frame_rows(), FRAME)
    trimmed = whole.where(F.col("day") < dt.date(2024, 2, 9))
    assert models.backtest_rows(trimmed, models.last_event_day(whole)).count() == 0


def test_ridge_line_equals_numpy(spark):
    table = spark.createDataFrame(frame_rows(), FRAME)
    features = ["honing_mat_demand", "is_weekend"]
    train = models.recency_weights(table)
    r = models.ridge_line(train, features, "excess_return").first()
    pdf = train.toPandas()
    x, y, w = pdf[features].to_numpy(), pdf["excess_return"].to_numpy(), pdf["w"].to_numpy()
    m, level = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    slopes = np.linalg.solve(((x - m).T * w) @ (x - m) / w.sum() + 1e-3 * np.eye(2), ((x - m).T * w) @ (y - level) / w.sum())
    assert np.allclose(r.slopes, slopes) and abs(r.level - level) < 1e-12
