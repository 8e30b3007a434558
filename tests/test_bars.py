import datetime as dt
import statistics

from pyspark.sql import functions as F

from eventide.operators import bars, beta, season, study

D = dt.date


def day(n):
    return D(2026, 1, 1) + dt.timedelta(days=n)


def test_mixed_times_parse_and_bad_ones_drop(spark):
    raw = spark.createDataFrame(
        [("2026-01-07",), ("2026-01-07 10:05:00",), ("2026-01-07 10:05:00.000000000",), ("2026-01-07T10:05:00",),
         ("2026/01/07 10:05:00",), ("2026.01.07",), ("nonsense",), (None,), ("2026-13-40",)], "date STRING")
    out = bars.normalize_ticks(raw)
    assert out.count() == 6
    assert {r.day for r in out.collect()} == {D(2026, 1, 7)}


def test_daily_bars_match_plain_statistics(spark):
    data = [("a", day(0), p) for p in (1.0, 2.0, 6.0)] + [("b", day(0), 5.0)]
    out = {r.item: r for r in bars.daily_bars(spark.createDataFrame(data, "item STRING, day DATE, price DOUBLE")).collect()}
    assert out["a"].price_mean == 3.0 and out["a"].tick_count == 3
    assert abs(out["a"].price_std - statistics.stdev([1.0, 2.0, 6.0])) < 1e-12
    assert out["b"].price_std is None


def prices(spark, data):
    return spark.createDataFrame([(i, day(n), float(p)) for i, n, p in data], "item STRING, day DATE, price DOUBLE")


def test_grid_fills_forward_then_back(spark, rows):
    table = prices(spark, [("a", 0, 10), ("a", 3, 40), ("b", 2, 7), ("c", 5, 1)])
    grid = {(i, d): p for i, d, p in rows(bars.dense_grid(table), "item", "day", "price")}
    assert len(grid) == 3 * 6
    assert [grid["a", day(n)] for n in range(6)] == [10, 10, 10, 40, 40, 40]
    assert [grid["b", day(n)] for n in range(6)] == [7] * 6
    strict = bars.dense_grid(table, backfill=False)
    assert strict.where("item = 'b'").count() == 4
    assert strict.where("item = 'c'").count() == 1


def test_forward_return_counts_rows_not_days(spark, rows):
    table = prices(spark, [("a", n * 3, 100 + n) for n in range(9)])
    out = rows(bars.forward_return(table), "day", "future_price_7d", "target_return_7d")
    assert out == [(day(0), 107.0, 0.07), (day(3), 108.0, (108.0 - 101.0) / 101.0)]


def test_volume_backfill_equals_left_join_plus_missing_keys(spark, rows):
    b = spark.createDataFrame(
        [("a", day(0), 5.0, 1.0, 4.0, 6.0, 3)],
        "item STRING, day DATE, price_mean DOUBLE, price_std DOUBLE, price_min DOUBLE, price_max DOUBLE, tick_count BIGINT")
    v = spark.createDataFrame([("a", day(0), 9.0, 11), ("a", day(1), 8.0, 12)], "item STRING, day DATE, avg_price DOUBLE, trade_count BIGINT")
    assert rows(bars.volume_backfill(b, v)) == [
        ("a", day(0), 5.0, 1.0, 4.0, 6.0, 3, 11, False), ("a", day(1), 8.0, 0.0, 8.0, 8.0, 0, 12, True)]


def test_index_is_100_on_the_date_itself(spark):
    table = prices(spark, [("x", 0, 10), ("x", 40, 20), ("y", 5, 30)])
    index = study.sector_index(table, {"S": ["x", "y"], "T": ["y"]})
    points = study.date_curves(index).select("date", F.inline("curve"))
    assert points.where("h = 0").select("index").distinct().collect() == [(100.0,)]
    at = {(r.sector, r.date, r.h): r["index"] for r in points.collect()}
    assert at["S", day(10), 30] == 125.0
    assert ("S", day(20), 21) not in at
    assert at["T", day(0), 30] == 100.0


def test_zero_priced_basket_has_no_index(spark):
    table = prices(spark, [("x", 0, 0), ("x", 2, 5)])
    index = study.sector_index(table, {"S": ["x"]})
    assert index.count() == 1


def test_item_in_two_baskets_counts_in_both(spark):
    index = study.sector_index(prices(spark, [("x", 0, 4)]), {"S": ["x"], "T": ["x"]})
    assert index.count() == 2


def brute_windows(data):
    by_item = {}
    for item, n, p in data:
        by_item.setdefault(item, {})[n] = float(p)
    out = {}
    for item, series in by_item.items():
        for d in range(min(series), max(series) + 2):
            base = series.get(d - 1, series.get(d))
            if base is None:
                continue
            ahead = [series[k] for k in range(d + 1, d + 15) if k in series]
            out[item, day(d)] = (base, max(ahead) if ahead else None, len(ahead))
    return out


def test_price_windows_match_brute_force(spark, rows):
    data = [("a", n, 10 + (n * 7) % 13) for n in (0, 1, 4, 5, 9, 30, 31, 33)] + [("b", n, n + 1) for n in range(20)]
    got = {(i, d): (b, m, c) for i, d, b, m, c in rows(
        beta.price_windows(prices(spark, data)), "item", "date", "base_price", "max_price", "days_seen")}
    assert got == brute_windows(data)


def test_flash_spike_is_dropped_and_lasting_jump_kept(spark, rows):
    flash = [("f", 0, 2), *[("f", n, 8 if n == 2 else 2.1) for n in range(1, 15)]]
    jump = [("j", 0, 2), *[("j", n, 8) for n in range(1, 15)]]
    windows = beta.price_windows(prices(spark, flash + jump))
    dates = spark.createDataFrame([(day(0), 2)], "date DATE, n_events BIGINT")
    out = rows(beta.item_betas(beta.event_returns(windows, dates)))
    assert out == [("j", 300.0, 100.0, 2)]


def test_tier_picks_drop_items_mapped_to_nothing(spark, rows):
    betas = spark.createDataFrame(
        [("old1", 10.0, 50.0, 4), ("old2", 30.0, 100.0, 4), ("gone", 99.0, 100.0, 1), ("same", 20.0, 70.0, 2)],
        "item STRING, avg_return DOUBLE, win_rate DOUBLE, sample_size BIGINT")
    mapping = beta.tier_mapping_table(spark, {"old1": "new", "old2": "new", "gone": None})
    out = [tuple(r) for r in beta.tier_picks(betas, mapping).collect()]
    assert out == [("new", 30.0, 75.0, "old2"), ("same", 20.0, 70.0, "same")]


def test_seasonality_of_zero_mean_item_is_null(spark):
    table = prices(spark, [("z", n, 0) for n in range(7)] + [("a", n, n + 1) for n in range(14)])
    out = {r.item: r for r in season.seasonality(table, "price").collect()}
    assert out["z"].day_0 is None and out["z"].volatility_cv is None
    weighted = sum(out["a"][f"day_{k}"] for k in range(7)) / 7
    assert abs(weighted - 1.0) < 1e-12


def test_stored_trends_give_the_published_round_trip(spark):
    hours = spark.createDataFrame([(12, -2.0), (23, 1.0), (5, 0.5)], "hour INT, avg_deviation_pct DOUBLE")
    best = season.best_hours(hours).first()
    assert (best.buy_hour, best.sell_hour, best.verdict) == (12, 23, "hold")
    assert abs(best.net_margin_pct - ((101 * 0.95 - 98) / 98 * 100)) < 1e-9


def test_item_classes_first_match_wins(spark, rows):
    table = spark.createDataFrame([("파괴석 주머니",), ("10레벨 멸화의 보석",), ("원한 각인서",), ("골드 상자",), ("물약",)], "name STRING")
    out = dict(rows(season.category_onehot(table, "name"), "name", "category"))
    assert out == {"파괴석 주머니": "honing_mat", "10레벨 멸화의 보석": "gem", "원한 각인서": "engraving", "골드 상자": "consumable", "물약": "other"}
