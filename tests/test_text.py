import datetime as dt
import random

from pyspark.sql import functions as F

from eventide import fixed_values as fixed
from eventide.functions import columns
from eventide.operators import calendar, enrich, extract, ingest

T = dt.datetime
D = dt.date


def times(spark, cases):
    df = spark.createDataFrame([(t, D.fromisoformat(a)) for t, a in cases], "text STRING, anchor DATE")
    return [r.starts_at for r in extract.broadcast_times(df, "text", "anchor").collect()]


def test_broadcast_time_notations(spark):
    cases = [
        ("특별 방송 2026.1.2(금) 18:30 시작", "2025-12-20"),
        ("2026년 1월 2일(금) 오후 6시", "2025-12-20"),
        ("1월 2일(금) 오후\n6시", "2025-12-20"),
        ("12월 30일 오전 12시", "2026-01-03"),
        ("7월 5일 18시", "2025-07-01"),
        ("안내 1/3 20:00", "2025-12-28"),
        ("12/31 09:05", "2026-01-02"),
        ("시간 미정", "2026-01-02"),
        ("2026.13.45 10:00 그리고 1/3 20:00", "2026-01-01"),
    ]
    assert times(spark, cases) == [
        T(2026, 1, 2, 18, 30), T(2026, 1, 2, 18), T(2026, 1, 2, 18), T(2025, 12, 30, 0), T(2025, 7, 5, 18),
        T(2026, 1, 3, 20), T(2025, 12, 31, 9, 5), None, None,
    ]


def test_title_score(spark):
    titles = ["로아온 요약 on air", "방송 정리", "로아온 라이브", "요약 모음", "PREVIEW 내용", None]
    df = spark.createDataFrame([(t,) for t in titles], "title STRING")
    assert [r[0] for r in df.select(enrich.title_score(F.lower("title"))).collect()] == [200, 100, 0, 0, 100, 0]


def test_priority_author_passes_and_outranks(spark, rows):
    posts = spark.createDataFrame(
        [(1, "방송 요약", "x" * 100, "u", 4), (2, "잡담", "short", "vip", 0), (3, "방송 요약", "x" * 99, "u", 50)],
        "link BIGINT, title STRING, content STRING, author STRING, reco INT")
    out = rows(enrich.post_score(posts, "vip"), "link", "title_score", "score", "is_candidate")
    assert out == [(1, 130, 132.0, True), (2, 100, 10099.0, True), (3, 130, 155.0, False)]


def test_best_post_in_reach_matches_brute_force(spark):
    rng = random.Random(11)
    posts = [(rng.randint(-40, 200), link, float(rng.randint(0, 9))) for link in range(80)]
    asked = sorted({rng.randint(-60, 220) for _ in range(120)})
    for window in (0, 3, 17):
        want = {}
        for m in asked:
            near = [(-score, link) for at, link, score in posts if abs(at - m) <= window]
            if near:
                score, link = min(near)
                want[m] = (link, -score)
        got = enrich.best_post_by_minute(
            spark.createDataFrame(posts, "minute BIGINT, link BIGINT, score DOUBLE"),
            spark.createDataFrame([(m,) for m in asked], "minute BIGINT"), window)
        assert {r.minute: (r.link, r.score) for r in got.collect()} == want


def test_window_edges_and_manual_link(spark, rows):
    shows = spark.createDataFrame([(1, T(2026, 1, 2, 18)), (2, T(2026, 1, 9, 18)), (3, T(2026, 3, 1, 18))], "event_id INT, ts TIMESTAMP_NTZ")
    posts = spark.createDataFrame(
        [(T(2026, 1, 1, 18), 5, 130.0), (T(2026, 1, 3, 18), 6, 130.0), (T(2026, 1, 3, 18, 1), 7, 999.0), (T(2026, 1, 9, 18), 8, 100.0)],
        "ts TIMESTAMP_NTZ, link BIGINT, score DOUBLE")
    manual = spark.createDataFrame([(D(2026, 1, 9), 77)], "target_date DATE, manual_link BIGINT")
    assert rows(enrich.best_post(shows, posts, manual), "event_id", "link", "score", "origin") == [
        (1, 5, 130.0, "board"), (2, 77, 9999.0, "manual")]


def test_best_post_counts_seconds(spark, rows):
    shows = spark.createDataFrame([(1, T(2026, 1, 2, 18, 0, 30))], "event_id INT, ts TIMESTAMP_NTZ")
    posts = spark.createDataFrame(
        [(T(2026, 1, 1, 18, 0, 29), 1, 999.0), (T(2026, 1, 1, 18, 0, 30), 2, 100.0), (T(2026, 1, 2, 9), 3, 90.0), (T(2026, 1, 3, 18, 0, 31), 4, 999.0)],
        "ts TIMESTAMP_NTZ, link BIGINT, score DOUBLE")
    assert rows(enrich.best_post(shows, posts), "event_id", "link", "score") == [(1, 2, 100.0)]
    later = posts.where("link <> 2").unionByName(posts.where("link = 2").withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS")))
    assert rows(enrich.best_post(shows, later), "event_id", "link", "score") == [(1, 2, 100.0)]


def brute_context(posts, day, look_back=60, top=3):
    until = T(day.year, day.month, day.day)
    near = [p for p in posts if until - dt.timedelta(days=look_back) <= p[0] <= until]
    near.sort(key=lambda p: (-(p[0] - T(1970, 1, 1)).total_seconds(), p[1]))
    return "\n".join(f"- [{p[0]:%Y-%m-%d}] {p[2]} (Score: {p[3]})" for p in near[:top])


def test_recent_context_matches_brute_force(spark):
    rng = random.Random(4)
    posts = []
    for link in range(60):
        at = T(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 150))
        at += dt.timedelta(hours=rng.choice([0, 0, 9, 20]))
        posts.append((at, link, f"t{link}", float(rng.randint(100, 120))))
    days = [D(2026, 1, 1) + dt.timedelta(days=k) for k in range(0, 240, 3)]
    out = enrich.recent_context(
        spark.createDataFrame([(d,) for d in days], "date DATE"),
        spark.createDataFrame(posts, "ts TIMESTAMP_NTZ, link BIGINT, title STRING, score DOUBLE"))
    want = {d: text for d in days if (text := brute_context(posts, d))}
    assert {r.date: r.context for r in out.collect()} == want


def test_nearest_summary_prefers_the_exact_day(spark):
    s = spark.createDataFrame([(1, D(2026, 1, 2)), (2, D(2026, 1, 3)), (3, D(2026, 1, 3)), (4, D(2026, 1, 9))], "summary_id INT, date DATE")
    got = {r.date.day: (r.summary_id, r.diff_days) for r in enrich.nearest_by_date(s).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (2, 0), 4: (2, -1), 8: (4, 1), 9: (4, 0), 10: (4, -1)}


def test_event_flags_ignore_case_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, "gold nerf, NEW RAID", "negative"), (2, None, "odd"), (3, "gem PACKAGE tier 4", "positive")], "id INT, k STRING, s STRING")
    out = rows(enrich.event_flags(df, "k", "s"), "id", *fixed.EVENT_FLAGS, "sentiment_score")
    assert out == [(1, 1, 1, 0, 0, 0, -1), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 1, 1, 1, 1)]


def test_keyword_override_searches_the_whole_text(spark, rows):
    late = "가" * 5000 + "보상"
    df = spark.createDataFrame(
        [(1, late, 0, 9, "m"), (2, "랭킹 조치", 6, None, None), (3, "조용", 1, 1, "m"), (4, "보상 회수", 5, 4, "m")],
        "id INT, content STRING, honing_mat_supply INT, honing_mat_demand INT, mechanisms_applied STRING")
    out = rows(enrich.keyword_override(df), "id", "honing_mat_supply", "honing_mat_demand", "mechanisms_applied")
    assert out == [
        (1, 8, 9, "m" + fixed.SUPPLY_TAG), (2, 6, 8, fixed.DEMAND_TAG), (3, 1, 1, "m"), (4, 5, 8, "m" + fixed.DEMAND_TAG)]


def test_target_items(spark, rows):
    events = spark.createDataFrame([(1, " 파괴강석, 세상 카드 ,수호강석"), (2, "None"), (3, None), (4, "없는것")], "id INT, target_items STRING")
    known = spark.createDataFrame([("파괴강석",), ("수호강석",), ("세상 카드",)], "item STRING")
    assert rows(enrich.target_item_filter(events, known, "id"), "id", "target_items") == [
        (1, "파괴강석, 수호강석"), (2, "None"), (3, "None"), (4, "None")]


def test_json_landing_shapes(spark, rows):
    raw = [
        (1, '```json\n{"honing_mat_supply": 7, "target_items": "A, B", "is_pre_announced": true}\n```'),
        (2, 'Sure! {"honing_mat_demand": "9"} done'), (3, "{broken"), (4, ""), (5, '{"honing_mat_supply": '), (6, '{"a": {"b": 1}'),
        (7, '{"honing_mat_supply": 7 "x"}')]
    out = enrich.json_landing(spark.createDataFrame(raw, "id INT, raw STRING"))
    got = rows(out, "id", "honing_mat_supply", "honing_mat_demand", "target_items", "mechanisms_applied", "is_pre_announced", "parse_error")
    assert got == [
        (1, 7, 0, "A, B", "None", "true", False), (2, 0, 9, "None", "None", "false", False),
        *[(k, 0, 0, "None", "Error", "false", True) for k in (3, 4, 5, 6, 7)]]


def test_roadmap_list_and_single_object(spark, rows):
    raw = [
        ("l1", "t1", D(2026, 1, 2), '[{"event_type": "Stream Summary", "event_label": "Now", "gem_demand": 3},'
         ' {"event_type": "Roadmap Item", "event_label": "Raid", "estimated_date": "2026-02-04"}]'),
        ("l2", "t2", D(2026, 1, 3), '```json {"estimated_date": "soon"} ```'), ("l3", "t3", D(2026, 1, 4), "no json")]
    df = spark.createDataFrame(raw, "link STRING, title STRING, announced DATE, raw STRING")
    out = rows(enrich.roadmap_explode(df), "link", "date", "event_type", "title", "is_pre_announced", "gem_demand")
    assert out == [
        ("l1", D(2026, 1, 2), "Stream Summary", "[Stream Summary] Now", False, 3),
        ("l1", D(2026, 2, 4), "Roadmap Item", "[Roadmap Item] Raid", True, 0),
        ("l2", D(2026, 1, 3), "Stream Summary", "[Event] t2", False, 0)]


def test_page_text_placeholders_and_lines(spark):
    pages = spark.createDataFrame(
        [(1, "<title> A <b>b</b>\n c</title><article><p>one &amp; two</p>\n<p> </p><p>three&lt;</p></article>"), (2, "<html></html>")],
        "page_id INT, html STRING")
    out = [tuple(r) for r in extract.page_text(pages).orderBy("page_id").collect()]
    assert out == [(1, "A b c", "one & two\nthree<"), (2, "Unknown Title", fixed.MISSING_CONTENT)]


def test_board_years_cross_new_year_in_small_blocks(spark, rows):
    dates = [D(2026, 1, 20) - dt.timedelta(days=9 * k) for k in range(150)]
    data = [("b", k, f"{d:%m-%d}", d.year) for k, d in enumerate(dates)]
    listing = spark.createDataFrame(data, "board STRING, pos BIGINT, month_day STRING, truth INT")
    for block in (1, 7, 1000):
        out = extract.board_years(listing, F.lit(2026), block)
        assert out.where("year <> truth").count() == 0 and out.count() == 150


def test_board_years_of_a_hot_board_with_sparse_places(spark):
    """One board holds most rows, at places with wide gaps; the rows are dealt by range."""
    hot = [("hot", k * k * 1000 + 5, D(2026, 1, 20) - dt.timedelta(days=k // 7)) for k in range(9000)]
    rest = [(f"b{k % 40}", 10**12 - k, D(2026, 3, 1) - dt.timedelta(days=(2000 - k) // 40 * 9)) for k in range(2000)]
    data = [(b, p, f"{d:%m-%d}", d.year) for b, p, d in hot + rest]
    listing = spark.createDataFrame(data, "board STRING, pos BIGINT, month_day STRING, truth INT").repartition(6)
    out = extract.board_years(listing, F.lit(2026))
    assert out.count() == len(data) and out.where("year <> truth").count() == 0


def test_board_years_pass_over_other_notations(spark):
    shown = ["13:45", "09:15", "12-30", "12-29", "2023-11-02", "11-01", "01-05", "14:00", "12-31"]
    truth = [2025, 2025, 2025, 2025, 2025, 2025, 2025, 2025, 2024]
    listing = spark.createDataFrame([("b", k, s, y) for k, (s, y) in enumerate(zip(shown, truth))], "board STRING, pos BIGINT, month_day STRING, truth INT")
    for block in (1, 3, 1000):
        assert extract.board_years(listing, F.lit(2025), block).where("year <> truth").count() == 0
    assert extract.board_years(listing, F.lit(2025)).where("year <> truth").count() == 0


def test_post_dates(spark):
    df = spark.createDataFrame([("15:23",), ("01-22",), ("2024-05-06",), ("02-30",), ("?",)], "s STRING")
    crawled = F.to_timestamp_ntz(F.lit("2026-01-24 16:00:00"))
    got = [r[0] for r in df.select(extract.post_date(F.col("s"), F.lit(2026), crawled)).collect()]
    assert got == [D(2026, 1, 24), D(2026, 1, 22), D(2024, 5, 6), None, None]


def test_content_and_broadcast_filters(spark):
    df = spark.createDataFrame(
        [("Update", "x" * 50, "로아온 방송 안내"), ("Update", "x" * 49, "방송 당첨자"), ("Cash", "x" * 90, "점검"), ("Event", fixed.MISSING_CONTENT * 9, "쇼케이스")],
        "event_type STRING, content STRING, title STRING")
    assert enrich.content_filter(df).count() == 2
    assert {r.title for r in enrich.broadcast_filter(df).collect()} == {"로아온 방송 안내", "쇼케이스"}


def test_helpers(spark):
    df = spark.createDataFrame([("1.5", "TRUE ", "None"), ("x", "no", "a"), (None, None, None)], "n STRING, b STRING, t STRING")
    got = [tuple(r) for r in df.select(columns.number_or("n"), columns.truthy("b"), columns.null_if_none_text("t")).collect()]
    assert got == [(1.5, True, None), (0.0, False, "a"), (0.0, False, None)]


def test_lead_time_and_dedup(spark, rows):
    events = spark.createDataFrame(
        [(1, D(2026, 1, 7), D(2026, 1, 2), 5), (2, D(2026, 1, 7), None, 9), (3, D(2026, 1, 7), None, 9), (4, D(2026, 1, 8), D(2026, 1, 9), None)],
        "event_id BIGINT, date DATE, announcement_date DATE, honing_mat_demand INT")
    assert rows(calendar.event_lead_time(events), "event_id", "lead_time_days") == [(1, 5), (2, 7), (3, 7), (4, -1)]
    assert rows(calendar.event_dedup(events), "event_id") == [(2,), (4,)]


def test_event_dedup_takes_ids_of_any_size(spark, rows):
    top = (1 << 63) - 1
    data = [(top, D(2026, 1, 1), 8), (top - 1, D(2026, 1, 1), 8), (5, D(2026, 1, 1), 7), (-top, D(2026, 1, 2), 0), (top, D(2026, 1, 2), None)]
    events = spark.createDataFrame(data, "event_id BIGINT, date DATE, honing_mat_demand INT")
    assert rows(calendar.event_dedup(events), "event_id") == [(-top,), (top - 1,)]


def test_notice_upsert_is_idempotent(spark, rows):
    old = spark.createDataFrame([("a", "A"), ("b", "B")], "link STRING, title STRING")
    batch = spark.createDataFrame([("b", "B2"), ("c", "C"), ], "link STRING, title STRING")
    once = ingest.notice_upsert(old, batch)
    assert rows(once) == [("a", "A", "kept"), ("b", "B2", "title_changed"), ("c", "C", "new")]
    twice = ingest.notice_upsert(once.drop("status"), batch)
    assert rows(twice.drop("status")) == rows(once.drop("status"))
    assert twice.where("status in ('new', 'title_changed')").count() == 0


def test_repeated_link_in_a_batch_counts_once(spark, rows):
    old = spark.createDataFrame([("a", "A")], "link STRING, title STRING")
    batch = spark.createDataFrame([("a", "Z", 1), ("a", "B", 2)], "link STRING, title STRING, seen INT")
    assert rows(ingest.notice_upsert(old, batch, [F.col("seen")])) == [("a", "B", "title_changed")]


def test_stored_copy_wins(spark, rows):
    a = spark.createDataFrame([(1, "old")], "link INT, title STRING")
    b = spark.createDataFrame([(1, "new"), (2, "new")], "link INT, title STRING")
    assert rows(ingest.post_dedup(a, b)) == [(1, "old"), (2, "new")]


def test_best_copy_of_a_new_link_wins(spark, rows):
    a = spark.createDataFrame([(1, 10)], "link INT, points INT")
    b = spark.createDataFrame([(1, 99), (2, 120), (2, 150)], "link INT, points INT")
    assert rows(ingest.post_dedup(a, b, order=[-F.col("points")])) == [(1, 10), (2, 150)]


def test_history_flatten_skips_empty_answers(spark, rows):
    docs = ['[{"Name": "x", "Stats": [{"Date": "2026-01-01", "AvgPrice": 1.5, "TradeCount": 7}, {"Date": "bad", "AvgPrice": 2, "TradeCount": 1}]}]', "[]", "oops"]
    out = ingest.history_flatten(spark.createDataFrame([(d,) for d in docs], "response STRING"))
    assert rows(out) == [("x", None, 2.0, 1), ("x", D(2026, 1, 1), 1.5, 7)]
