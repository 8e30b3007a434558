"""Walk-forward protocol against a plain refit at every fold."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import evaluate, walkforward as wf

D = dt.date
HORIZONS = [-3, 0, 7]
SECTORS = ["Honing", "Gem"]


def make_labels(n, seed=3):
    rng = random.Random(seed)
    day, out = D(2024, 1, 1), []
    for _ in range(n):
        day += dt.timedelta(days=rng.randint(1, 5))
        for s in SECTORS:
            score, x = float(rng.randint(0, 10)), float(rng.randint(0, 10))
            for h in HORIZONS:
                y = None if rng.random() < 0.1 else 100 + rng.uniform(-1, 2) * x + rng.gauss(0, 1)
                out.append((s, h, day, score, x, y))
    return out


def line(train, x):
    if len(train) < 3:
        return None
    first = min(t[0] for t in train)
    w = np.array([(1 + t[1] ** 2) * (1 + (t[0] - first).days / 100) for t in train])
    xs, ys = np.array([t[2] for t in train]), np.array([t[3] for t in train])
    mx, my = (w * xs).sum() / w.sum(), (w * ys).sum() / w.sum()
    spread = (w * (xs - mx) ** 2).sum()
    slope = max((w * (xs - mx) * (ys - my)).sum() / spread, 0.0) if np.ptp(xs) > 0 else 0.0
    return my + slope * (x - mx)


def fold_of(i, n, coarse):
    start = 0
    while True:
        size = coarse if n - start > coarse else 1
        if start <= i < start + size:
            return start
        start += size


def expected(labels, usable):
    """``usable(row, question, ranks)`` says whether a row may train."""
    dates = sorted({r[2] for r in labels})
    rank = {d: k for k, d in enumerate(dates)}
    out = {}
    for s in SECTORS:
        for d in dates:
            last = None
            for h in HORIZONS:
                series = [r for r in labels if r[0] == s and r[1] == h]
                question = next(r for r in series if r[2] == d)
                train = [(r[2], r[3], r[4], r[5]) for r in series if r[5] is not None and usable(r, question, rank)]
                last = guess if (guess := line(train, question[4])) is not None else (100.0 if last is None else last)
                out[s, d, h] = last
    return out


def frame(spark, labels):
    return spark.createDataFrame(labels, "sector STRING, h INT, date DATE, score DOUBLE, x DOUBLE, y DOUBLE")


def check(got, want):
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def as_dict(df):
    return {(r.sector, r.date, r.h): r.pred for r in df.collect()}


@pytest.mark.parametrize("n", [2, 9, 23, 40])
def test_walk_forward_equals_refits(spark, n):
    labels, coarse = make_labels(n), 8
    want = expected(
        labels,
        lambda r, q, rank: fold_of(rank[q[2]], n, coarse) >= 3 and rank[r[2]] < fold_of(rank[q[2]], n, coarse),
    )
    check(as_dict(wf.walk_forward(frame(spark, labels), coarse)), want)


def test_purged_counts_only_labels_already_known(spark):
    labels = make_labels(30, seed=5)
    want = expected(labels, lambda r, q, rank: max(r[2], r[2] + dt.timedelta(days=r[1])) < q[2])
    check(as_dict(wf.walk_forward_purged(frame(spark, labels))), want)


def test_later_events_do_not_change_purged_forecasts(spark):
    labels = make_labels(25)
    cut = sorted({r[2] for r in labels})[15]
    early = as_dict(wf.walk_forward_purged(frame(spark, [r for r in labels if r[2] <= cut])))
    full = as_dict(wf.walk_forward_purged(frame(spark, labels)))
    assert all(abs(full[k] - v) < 1e-9 for k, v in early.items())


def test_final_overwrite_looks_ahead_and_says_so(spark):
    labels = make_labels(25)
    out = wf.final_overwrite(frame(spark, labels), recent=4)
    dates = sorted({r[2] for r in labels})
    marked = {r.date for r in out.where("source = 'final'").select("date").distinct().collect()}
    assert marked == set(dates[-4:])
    last = {(r.sector, r.h): r.pred for r in out.where(F.col("date") == dates[-1]).collect()}
    series = [(r[2], r[3], r[4], r[5]) for r in labels if r[0] == "Gem" and r[1] == 7 and r[5] is not None]
    x = next(r[4] for r in labels if r[0] == "Gem" and r[1] == 7 and r[2] == dates[-1])
    assert abs(last["Gem", 7] - line(series, x)) < 1e-6


def test_fold_report(spark):
    labels = make_labels(120)
    one = frame(spark, labels).where("sector = 'Gem' and h = 0")
    report = [(r.fold_start, r.test_size) for r in wf.fold_report(wf.fold_starts(one)).orderBy("fold_start").collect()]
    assert report == [(0, 50), (50, 50)] + [(k, 1) for k in range(100, 120)]
    exact = frame(spark, make_labels(100)).where("sector = 'Gem' and h = 0")
    report = [(r.fold_start, r.test_size) for r in wf.fold_report(wf.fold_starts(exact)).orderBy("fold_start").collect()]
    assert report == [(0, 50)] + [(k, 1) for k in range(50, 100)]


def pool(values):
    """Pool adjacent violators over (weight, mean) pairs."""
    blocks = []
    for w, m in values:
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return [m for _, m, n in blocks for _ in range(n)]


def test_isotonic_levels_match_pooling(spark):
    out = wf.isotonic_levels(frame(spark, make_labels(80))).orderBy("sector", "h", "score").collect()
    for key in {(r.sector, r.h) for r in out}:
        series = [r for r in out if (r.sector, r.h) == key]
        want = pool([(r.weight, r.mean_index) for r in series])
        assert max(abs(r.isotonic_index - w) for r, w in zip(series, want)) < 1e-9


def test_trajectory_arrays_keep_horizon_order(spark):
    df = spark.createDataFrame([("S", D(2026, 1, 1), h, float(h)) for h in (7, -3, 0)], "sector STRING, date DATE, h INT, pred DOUBLE")
    row = wf.trajectory_arrays(df).first()
    assert row.horizons == [-3, 0, 7] and row.predicted_trajectory == [-3.0, 0.0, 7.0]


def test_accuracy_counts_every_event_and_keeps_its_identities(spark):
    f = spark.createDataFrame(
        [(D(2026, 1, 1), 102.0, 101.5), (D(2026, 1, 2), 101.0, 103.0), (D(2026, 1, 3), 99.0, 100.0), (D(2026, 1, 4), 150.0, 90.0),
         (D(2026, 1, 5), None, 90.0)], "date DATE, y DOUBLE, pred DOUBLE")
    n = spark.createDataFrame([(D(2026, 1, k), k) for k in range(1, 6)], "date DATE, n_events BIGINT")
    r = evaluate.directional_accuracy(f, n).first()
    assert (r.total, r.hits, r.actual_ups, r.pred_ups, r.true_ups) == (10, 4, 5, 3, 1)
    assert r.accuracy == 40.0 and r.recall == 20.0
    assert abs(r.precision * r.pred_ups - r.recall * r.actual_ups) < 1e-9
    assert abs(r.precision * r.pred_ups / 100 - r.true_ups) < 1e-9
