"""Equivalent SQL for every registered query that SQL can express.

Written independently of the operators: ranges and folds are joined directly,
fills use calendar tables, and texts are rebuilt from the columns they came
from instead of being parsed.
"""

from __future__ import annotations

from eventide.fixed_values import DECISION_RULES, FRAME_FEATURES, HORIZONS, RISING_SCORES, SECTOR_FEATURES, TYPE_LABELS
from eventide.sources import driver_tables as dt


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


def _case(column: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


def _classes(column: str, classes) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, words)} THEN '{label}'" for label, words in classes) + " ELSE 'other' END"


_CLASS_LABELS = [label for label, _ in dt.CLASSES] + ["other"]
_BASKETS = ", ".join(f"('{s}', '{i}')" for s, items in dt.SECTORS.items() for i in items)
_EVENT_TYPE = _case("o_orderpriority", dt.EVENT_TYPES, "NULL")

VIEWS = {
    "ticks": """SELECT p_brand AS item, p_type AS family, CAST(l_shipdate AS DATE) AS day,
        floor(l_extendedprice / l_quantity * CAST(100 AS DOUBLE) + 0.5) AS price, l_returnflag AS feed
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "prices": "SELECT item, day, avg(price) AS price, count(*) AS trade_count FROM ticks GROUP BY ALL",
    "feed_bars": """SELECT item, day, avg(price) AS price_mean, stddev_samp(price) AS price_std, min(price) AS price_min,
        max(price) AS price_max, count(*) AS tick_count FROM ticks WHERE feed <> 'R' GROUP BY item, day""",
    "volume": "SELECT item, day, avg(price) AS avg_price, count(*) AS trade_count FROM ticks WHERE feed <> 'A' GROUP BY item, day",
    "merged": """SELECT b.item, b.day, b.price_mean, b.price_std, b.price_min, b.price_max, b.tick_count,
        coalesce(v.trade_count, 0) AS trade_count, false AS is_appended
        FROM feed_bars b LEFT JOIN volume v ON b.item = v.item AND b.day = v.day
        UNION ALL
        SELECT v.item, v.day, v.avg_price, CAST(0 AS DOUBLE), v.avg_price, v.avg_price, CAST(0 AS BIGINT), v.trade_count, true
        FROM volume v WHERE NOT EXISTS (SELECT 1 FROM feed_bars b WHERE b.item = v.item AND b.day = v.day)""",
    "calendar": f"""SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, {_EVENT_TYPE} AS event_type,
        {_EVENT_TYPE} || ' ' || CAST(o_orderkey AS VARCHAR) AS title, '/notice/' || CAST(o_orderkey AS VARCHAR) AS link,
        o_orderpriority = '2-HIGH' AS is_pre_announced,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) - CAST(o_custkey % 30 AS INTEGER) END AS announcement_date,
        CAST(o_orderkey * 7 % 11 AS INTEGER) AS honing_mat_demand, CAST(o_custkey * 3 % 11 AS INTEGER) AS gem_demand,
        CAST(o_orderkey % 11 AS INTEGER) AS gold_inflation, CAST(o_custkey * 5 % 11 AS INTEGER) AS gold_sink,
        CAST(o_custkey % 11 AS INTEGER) AS content_difficulty FROM orders""",
    "days": "SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM prices",
    "grid": """SELECT item, day, coalesce(
        last_value(price IGNORE NULLS) OVER (PARTITION BY item ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(price IGNORE NULLS) OVER (PARTITION BY item ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price,
        price IS NOT NULL AS is_observed
        FROM (SELECT DISTINCT item FROM prices) CROSS JOIN days LEFT JOIN prices USING (item, day)""",
    "baskets": f"SELECT * FROM (VALUES {_BASKETS}) AS b(sector, item)",
    "sidx": "SELECT sector, day AS date, avg(price) AS price FROM grid JOIN baskets USING (item) GROUP BY ALL",
    "horizons": f"SELECT unnest({HORIZONS}) AS h",
    "curves": """SELECT a.sector, a.date, h, b.price / a.price * 100.0 AS idx FROM sidx a CROSS JOIN horizons
        JOIN sidx b ON b.sector = a.sector AND b.date = a.date + h""",
    "event_days": """SELECT date, count(title) AS event_count, max(honing_mat_demand) AS honing_mat_demand,
        max(gem_demand) AS gem_demand, max(gold_inflation) AS gold_inflation, max(content_difficulty) AS content_difficulty,
        1 AS is_event_day FROM calendar GROUP BY date""",
    "day_features": """SELECT date, count(*) AS event_count, max(CASE WHEN gold_inflation >= 9 THEN 1 ELSE 0 END) AS is_gold_nerf,
        max(CASE WHEN content_difficulty >= 8 THEN 1 ELSE 0 END) AS is_new_raid, max(CASE WHEN gold_sink >= 8 THEN 1 ELSE 0 END) AS is_t4,
        max(CASE WHEN gem_demand >= 9 THEN 1 ELSE 0 END) AS is_gem, max(CASE WHEN event_type = 'Roadmap Item' THEN 1 ELSE 0 END) AS is_package,
        CAST(max(gold_inflation) AS DOUBLE) AS impact_score,
        min(CASE WHEN gem_demand > 7 THEN 1 WHEN gem_demand < 3 THEN -1 ELSE 0 END) AS sentiment_score,
        arg_min(event_type, event_id) AS event_type FROM calendar GROUP BY date""",
    "chosen": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY date
        ORDER BY honing_mat_demand DESC, event_id) AS rn FROM calendar) WHERE rn = 1""",
    "frame": """SELECT m.*, coalesce(e.event_count, 0) AS event_count, coalesce(e.honing_mat_demand, 0) AS honing_mat_demand,
        coalesce(e.gem_demand, 0) AS gem_demand, coalesce(e.gold_inflation, 0) AS gold_inflation,
        coalesce(e.content_difficulty, 0) AS content_difficulty, coalesce(e.is_event_day, 0) AS is_event_day,
        CAST(isodow(m.day) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(m.day) >= 6 THEN 1 ELSE 0 END AS is_weekend,
        CASE WHEN isodow(m.day) = 3 THEN 1 ELSE 0 END AS is_wednesday
        FROM merged m LEFT JOIN event_days e ON e.date = m.day""",
    "labels": """SELECT s.sector, horizons.h, c.date, row_number() OVER (PARTITION BY s.sector, horizons.h ORDER BY c.date) - 1 AS i,
        count(*) OVER (PARTITION BY s.sector, horizons.h) AS n_dates,
        CAST(CASE s.sector WHEN 'Gem' THEN gem_demand ELSE honing_mat_demand END AS DOUBLE) AS score,
        CAST(CASE s.sector WHEN 'Honing' THEN honing_mat_demand ELSE gem_demand END AS DOUBLE) AS x, k.idx AS y
        FROM chosen c CROSS JOIN (SELECT DISTINCT sector FROM baskets) s CROSS JOIN horizons
        LEFT JOIN curves k ON k.sector = s.sector AND k.h = horizons.h AND k.date = c.date""",
    "weighted": """SELECT *, (1.0 + score * score) * (1.0 + CAST(date - min(date) FILTER (WHERE y IS NOT NULL)
        OVER (PARTITION BY sector, h) AS DOUBLE) / 100.0) AS w,
        CASE WHEN i < 50 * greatest(ceil((n_dates - 50) / 50), 0) THEN i // 50 * 50 ELSE i END AS fold_start FROM labels""",
    "fold_sums": """SELECT f.sector, f.h, f.fold_start, count(*) AS n, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy,
        sum(w * x * x) AS swxx, sum(w * x * y) AS swxy, min(x) AS lo, max(x) AS hi
        FROM (SELECT DISTINCT sector, h, fold_start FROM weighted) f
        JOIN (SELECT sector, h, i, w, x, y FROM weighted WHERE y IS NOT NULL) t
        ON t.sector = f.sector AND t.h = f.h AND t.i < f.fold_start GROUP BY ALL""",
    "fold_lines": """SELECT *, (swy - slope * swx) / sw AS level FROM (SELECT *, greatest(CASE WHEN lo = hi
        THEN 0 ELSE (sw * swxy - swx * swy) / (sw * swxx - swx * swx) END, 0) AS slope FROM fold_sums)""",
    "honest": """SELECT sector, date, h, i, n_dates, fold_start, y, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY sector, date
        ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 100.0) AS pred
        FROM (SELECT q.*, CASE WHEN q.fold_start >= 3 AND n >= 3 THEN level + slope * x END AS raw
        FROM weighted q LEFT JOIN fold_lines l ON l.sector = q.sector AND l.h = q.h AND l.fold_start = q.fold_start)""",
    "final_lines": """SELECT *, (swy - slope * swx) / sw AS level FROM (SELECT *, greatest(CASE WHEN lo = hi
        THEN 0 ELSE (sw * swxy - swx * swy) / (sw * swxx - swx * swx) END, 0) AS slope
        FROM (SELECT sector, h, count(*) AS n, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * x) AS swxx,
        sum(w * x * y) AS swxy, min(x) AS lo, max(x) AS hi FROM weighted WHERE y IS NOT NULL GROUP BY ALL))""",
    "live": """SELECT q.sector, q.date, q.h, q.y, CASE WHEN n >= 3 THEN level + slope * x END AS pred
        FROM weighted q LEFT JOIN final_lines l ON l.sector = q.sector AND l.h = q.h""",
    "stored": """SELECT a.sector, a.date, a.h, a.y, CASE WHEN a.i >= n_dates - 10 THEN coalesce(b.pred, 100.0) ELSE a.pred END AS pred,
        CASE WHEN a.i >= n_dates - 10 THEN 'final' ELSE 'honest' END AS source
        FROM honest a JOIN live b ON b.sector = a.sector AND b.date = a.date AND b.h = a.h""",
    "windows": """SELECT d.date, i.item, coalesce(y.price, t.price) AS base_price, CASE WHEN y.price IS NOT NULL THEN 'T-1' ELSE 'T0' END AS base_source,
        max(f.price) AS max_price, list_sum(list(f.price ORDER BY f.day)) / count(f.price) AS mean_price, count(f.price) AS days_seen
        FROM (SELECT DISTINCT date FROM calendar) d CROSS JOIN (SELECT DISTINCT item FROM prices) i
        LEFT JOIN prices y ON y.item = i.item AND y.day = d.date - 1
        LEFT JOIN prices t ON t.item = i.item AND t.day = d.date
        LEFT JOIN prices f ON f.item = i.item AND f.day > d.date AND f.day <= d.date + 14
        WHERE coalesce(y.price, t.price) IS NOT NULL GROUP BY ALL""",
    "returns": """SELECT item, (max_price - base_price) / base_price * 100.0 AS ret FROM calendar c JOIN windows w ON w.date = c.date
        WHERE honing_mat_demand >= 7 AND days_seen > 0 AND base_price > 0
        AND NOT (max_price > base_price * 1.5 AND mean_price < base_price + (max_price - base_price) * 0.25)""",
    "betas": """SELECT item, avg(ret) AS avg_return, avg(CASE WHEN ret > 3 THEN 100.0 ELSE 0.0 END) AS win_rate, count(*) AS sample_size
        FROM returns GROUP BY item""",
    "hours": """SELECT hour, avg((price - m) / m * 100.0) AS dev FROM (SELECT hour(ts) AS hour, price,
        avg(price) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS m
        FROM (SELECT event_type, ts, floor(value * CAST(100 AS DOUBLE) + 0.5) AS price FROM events)) GROUP BY hour""",
    "scored": f"""SELECT f.*, {_classes('f.item', dt.CLASSES)} AS category, (price_mean - base) / base AS excess_return
        FROM (SELECT f.*, gm * (wm / gm) AS base FROM (SELECT *, avg(price_mean) OVER (PARTITION BY item) AS gm,
        avg(price_mean) OVER (PARTITION BY item, weekday) AS wm FROM frame) f) f
        WHERE (price_mean - base) / base > -0.5 AND (price_mean - base) / base < 5.0""",
    "posts": f"""SELECT doc_id AS link, source || '/' || lang AS title, text, source AS author, CAST(doc_id % 40 AS INTEGER) AS reco,
        TIMESTAMP '{dt.EPOCH_OF_POSTS}' + CAST(doc_id * 37 % 43200 AS INTEGER) * INTERVAL 1 MINUTE AS ts FROM documents""",
    "scored_posts": f"""SELECT *, title_score + reco * 0.5::DOUBLE + CASE WHEN author = '{dt.PRIORITY_SOURCE}' THEN 9999 ELSE 0 END AS score,
        title_score >= 100 AND (author = '{dt.PRIORITY_SOURCE}' OR length(text) >= 100) AS is_candidate
        FROM (SELECT *, CASE WHEN author = '{dt.PRIORITY_SOURCE}' THEN greatest(points, 100) ELSE points END AS title_score
        FROM (SELECT *, CASE WHEN {_any('lower(text)', dt.STREAM_WORDS)} AND {_any('lower(text)', dt.TYPE_WORDS)}
        THEN 100 {' '.join(f"+ CASE WHEN contains(lower(text), {_text(w)}) THEN {n} ELSE 0 END" for w, n in dt.BONUS_WORDS.items())}
        ELSE 0 END AS points FROM posts))""",
    "page_titles": "SELECT page_id, url, html, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages",
    "old_notices": "SELECT url AS link, title FROM page_titles WHERE url LIKE 'https:%'",
    "new_notices": """SELECT url AS link, CASE WHEN contains(url, '#') THEN title || ' (updated)' ELSE title END AS title
        FROM page_titles WHERE NOT contains(html, 'lang="de"') OR url NOT LIKE 'https:%'""",
}

_NEEDS = {
    "prices": ["ticks"], "feed_bars": ["ticks"], "volume": ["ticks"], "merged": ["feed_bars", "volume"], "days": ["prices"],
    "grid": ["days", "prices"], "sidx": ["grid", "baskets"], "curves": ["sidx", "horizons"], "event_days": ["calendar"],
    "day_features": ["calendar"], "chosen": ["calendar"], "frame": ["merged", "event_days"],
    "labels": ["chosen", "curves", "baskets", "horizons"], "weighted": ["labels"], "fold_sums": ["weighted"],
    "fold_lines": ["fold_sums"], "honest": ["weighted", "fold_lines"], "final_lines": ["weighted"],
    "live": ["weighted", "final_lines"], "stored": ["honest", "live"], "windows": ["calendar", "prices"],
    "returns": ["calendar", "windows"], "betas": ["returns"], "scored": ["frame"], "scored_posts": ["posts"],
    "old_notices": ["page_titles"], "new_notices": ["page_titles"],
}


def _sql(body: str, *views: str) -> str:
    """Put the needed views in front, each after those it reads."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    heads = ", ".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return f"WITH {heads} {body}" if heads else body


_FRAME_COLUMNS = """item, day, price_mean, round(price_std, 4) AS price_std, price_min, price_max, tick_count, trade_count, is_appended"""

_WIDE = ", ".join(
    f"""coalesce(round_even(max(idx) FILTER (WHERE sector = '{s}' AND h = {h}), 1), 0.0) AS "Actual_{s}_T{h}" """
    for s in dt.SECTORS
    for h in HORIZONS
)

_SHOWN_TYPE = _case("event_type", TYPE_LABELS, "event_type")

_RULES = " UNION ALL ".join(
    f"SELECT event_id, date, {n} AS rule, {_text(DECISION_RULES[n - 1][1])} AS outcome, {_text(DECISION_RULES[n - 1][2])} AS confidence FROM calendar WHERE {where}"
    for n, where in enumerate(
        [
            "honing_mat_demand > 7 AND NOT is_pre_announced",
            "gem_demand > 8 AND content_difficulty > 6",
            "gold_inflation > 7 AND gold_sink < 3",
            "honing_mat_demand = 0 AND gem_demand = 0 AND gold_inflation = 0 AND content_difficulty = 0 AND isodow(date) >= 6",
        ],
        start=1,
    )
)

_FLAG_CASES = ", ".join(
    f"CASE WHEN {_any('lower(text)', words)} THEN 1 ELSE 0 END AS {name}" for name, words in dt.FLAG_WORDS.items()
)

_LINE_SUMS = """sum(w) AS sw, sum(w * honing_mat_demand) AS swx, sum(w * excess_return) AS swy,
   sum(w * honing_mat_demand * honing_mat_demand) AS swxx, sum(w * honing_mat_demand * excess_return) AS swxy,
   min(honing_mat_demand) AS lo, max(honing_mat_demand) AS hi"""
_LINE = """slope, (swy - slope * swx) / sw AS level FROM (SELECT *, CASE WHEN lo = hi THEN 0
   ELSE (sw * swxy - swx * swy) / (sw * swxx - swx * swx) END AS slope FROM"""
_LINES = f"""sums AS (SELECT category, {_LINE_SUMS} FROM train GROUP BY category),
 lines AS (SELECT category, {_LINE} sums)),
 pooled AS (SELECT {_LINE} (SELECT {_LINE_SUMS} FROM train)))"""

_TRAIN = """
 last AS (SELECT max(day) AS d FROM frame WHERE is_event_day = 1),
 train AS (SELECT s.*, 0.5 + 1.5 * (CAST(day - min(day) OVER () AS DOUBLE) / CAST(max(day) OVER () - min(day) OVER () AS DOUBLE)) AS w
   FROM scored s, last WHERE day < d)"""

_BACKTEST = f"""{_TRAIN}, {_LINES},
 tested AS (SELECT item, day, predicted_excess, excess_return, predicted_excess - excess_return AS error FROM (
   SELECT item, day, excess_return, CASE WHEN l.level IS NULL THEN p.level + p.slope * honing_mat_demand
   ELSE l.level + l.slope * honing_mat_demand END AS predicted_excess FROM scored s JOIN last ON day = d CROSS JOIN pooled p LEFT JOIN lines l USING (category)))
"""

_SIZES = """(SELECT count(DISTINCT day) FROM frame WHERE is_event_day = 1) AS event_days, (SELECT count(DISTINCT item) FROM frame) AS items,
        (SELECT count(*) FROM frame) AS frame_rows"""


def _eliminated(source: str, n: int) -> str:
    """Steps that solve ``source``'s system m0_0 .. m(n-1)_(n), one table per unknown; the last one holds the solution in column n."""
    steps = []
    for k in range(n):
        left = ", ".join(
            (f"m{i}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k}") + f" AS m{i}_{j}"
            for i in range(n) for j in range(k + 1, n + 1)
        )
        steps.append(f"{source}_{k + 1} AS (SELECT * EXCLUDE ({', '.join(f'm{i}_{j}' for i in range(n) for j in range(k, n + 1))}), {left} FROM {source if k == 0 else f'{source}_{k}'})")
    return ", ".join(steps)


def _system(values: list[str], label: str, ridge: float) -> str:
    """Covariances of columns over a weighted relation, with their means and the label's."""
    n = len(values)
    means = [f"sum(w * ({v})) / sum(w)" for v in values]
    cells = [f"sum(w * ({values[i]}) * ({values[j]})) / sum(w) - ({means[i]}) * ({means[j]}) {f'+ {ridge}' if i == j else ''} AS m{i}_{j}" for i in range(n) for j in range(n)]
    cells += [f"sum(w * ({values[i]}) * {label}) / sum(w) - ({means[i]}) * (sum(w * {label}) / sum(w)) AS m{i}_{n}" for i in range(n)]
    return ", ".join(cells + [f"{m} AS mean{i}" for i, m in enumerate(means)] + [f"sum(w * {label}) / sum(w) AS level"])


_FRAME_VALUES = [f"CASE WHEN category = '{f[3:]}' THEN 1.0 ELSE 0.0 END" if f.startswith("is_") and f[3:] in _CLASS_LABELS else f"CAST({f} AS DOUBLE)" for f in FRAME_FEATURES]
_SCENARIO_VALUES = [*_FRAME_VALUES, "0.0", "0.0"]
_FEATURE_BACKTEST = f"""{_TRAIN}, system AS (SELECT {_system(_FRAME_VALUES, "excess_return", 0.001)}, count(*) AS train_rows FROM train),
 {_eliminated("system", len(_FRAME_VALUES))},
 tested AS (SELECT item, day, category, predicted_excess, excess_return, predicted_excess - excess_return AS error, train_rows FROM (
   SELECT item, day, category, excess_return, train_rows, level + {" + ".join(f"m{i}_{len(_FRAME_VALUES)} * ({v} - mean{i})" for i, v in enumerate(_FRAME_VALUES))} AS predicted_excess
   FROM scored JOIN last ON day = d CROSS JOIN system_{len(_FRAME_VALUES)}))
"""

# Four event scores: the sums of each fold by a range join, its clamped line, and the first tree level by level.
_SCORES = "f0, f1, f2, f3"
_SCORED_LABELS = f"""scored_labels AS (SELECT k.*, CAST(c.{SECTOR_FEATURES[0]} AS DOUBLE) AS f0, CAST(c.{SECTOR_FEATURES[1]} AS DOUBLE) AS f1,
 CAST(c.{SECTOR_FEATURES[2]} AS DOUBLE) AS f2, CAST(c.{SECTOR_FEATURES[3]} AS DOUBLE) AS f3 FROM weighted k JOIN chosen c ON c.date = k.date)"""
_GRAM_TERMS = {"s_n": "CASE WHEN w IS NOT NULL THEN 1.0 END", "s_w": "w", "s_y": "w * y"} | {f"s_{i}": f"w * f{i}" for i in range(4)} | {f"s_{i}y": f"w * f{i} * y" for i in range(4)} | {
    f"s_{i}_{j}": f"w * f{i} * f{j}" for i in range(4) for j in range(i, 4)
}
_GRAMS = f"""{_SCORED_LABELS}, grams AS (SELECT q.sector, q.h, q.fold_start, {", ".join(f"coalesce(sum(CAST({v} AS DOUBLE)), 0.0) AS {k}" for k, v in _GRAM_TERMS.items())}
 FROM (SELECT DISTINCT sector, h, fold_start FROM weighted) q
 LEFT JOIN (SELECT * FROM scored_labels WHERE y IS NOT NULL) t ON t.sector = q.sector AND t.h = q.h AND t.i < q.fold_start GROUP BY ALL)"""


def _rising(place: int) -> str:
    sectors = ", ".join(_text(s) for s, names in RISING_SCORES.items() if SECTOR_FEATURES[place] in names)
    return f"sector IN ({sectors})" if sectors else "false"


def _held(*places: int) -> str:
    return " OR ".join(f"(mask // {2**i}) % 2 = 1" for i in places)


_MASKED = ", ".join(
    [f"CASE WHEN {_held(i, j)} THEN {float(i == j)} ELSE s_{min(i, j)}_{max(i, j)} / s_w - s_{i} * s_{j} / s_w / s_w {'+ 0.01' if i == j else ''} END AS m{i}_{j}" for i in range(4) for j in range(4)]
    + [f"CASE WHEN {_held(i)} THEN 0.0 ELSE s_{i}y / s_w - s_{i} * s_y / s_w / s_w END AS m{i}_4, s_{i}y / s_w - s_{i} * s_y / s_w / s_w AS b{i}, s_{i} / s_w AS mean{i}" for i in range(4)]
)
_CLAMPED_LINES = f"""{_GRAMS}, masked AS (SELECT sector, h, fold_start, mask, s_y / s_w AS level, {_MASKED}
 FROM grams CROSS JOIN (SELECT unnest(range(16)) AS mask) WHERE fold_start >= 3 AND s_n >= 3 AND {" AND ".join(f"({_rising(i)} OR NOT ({_held(i)}))" for i in range(4))}),
 {_eliminated("masked", 4)},
 best AS (SELECT * FROM masked_4 WHERE {" AND ".join(f"(m{i}_4 >= 0 OR NOT ({_rising(i)}))" for i in range(4))}
 QUALIFY row_number() OVER (PARTITION BY sector, h, fold_start ORDER BY -({" + ".join(f"m{i}_4 * b{i}" for i in range(4))}), mask) = 1),
 raw AS (SELECT q.sector, q.date, q.h, q.fold_start, level + {" + ".join(f"m{i}_4 * (f{i} - mean{i})" for i in range(4))} AS p
 FROM scored_labels q LEFT JOIN best k ON k.sector = q.sector AND k.h = q.h AND k.fold_start = q.fold_start)"""


def _first_trees(depth: int = 5) -> str:
    """Tables of the first tree of each series: best splits by trying every threshold of every node, a level at a time."""
    value = "CASE place " + " ".join(f"WHEN {i} THEN f{i}" for i in range(4)) + " END"
    rises = "CASE place " + " ".join(f"WHEN {i} THEN {_rising(i)}" for i in range(4)) + " END"
    clip = lambda g, h: f"least(greatest({g} / ({h} + 1.0), least_value), most_value)"
    score = lambda g, h, v: f"(2.0 * {g} * {v} - ({h} + 1.0) * {v} * {v})"
    ends = [f"{name}{i}" for i in range(4) for name in ("lo", "hi")]
    out = [
        _SCORED_LABELS,
        f"""usable AS MATERIALIZED (SELECT *, sum(w * y) OVER s / sum(w) OVER s AS base FROM scored_labels WHERE y IS NOT NULL
        WINDOW s AS (PARTITION BY sector, h) QUALIFY count(*) OVER s >= 3)""",
        f"c0 AS MATERIALIZED (SELECT sector, h, CAST(1 AS BIGINT) AS node, {_SCORES}, sum(w) AS w, sum(w * y) AS wy, sum(w * y) - sum(w) * any_value(base) AS r FROM usable GROUP BY sector, h, {_SCORES})",
        "scales AS MATERIALIZED (SELECT sector, h, greatest(sum(r * r / w), 1e-12 * sum(wy * wy / w)) AS most FROM c0 GROUP BY sector, h)",
        "cuts AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT DISTINCT sector, h, {i} AS place, f{i} AS cut FROM c0" for i in range(4)) + ")",
        "n0 AS MATERIALIZED (SELECT DISTINCT sector, h, node, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {e}" for e in ends)
        + ", CAST('-inf' AS DOUBLE) AS least_value, CAST('inf' AS DOUBLE) AS most_value FROM c0)",
    ]
    for d in range(depth):
        moved = lambda name: ", ".join(f"CASE WHEN place = {i} THEN cut ELSE {name}{i} END AS {name}{i}" if name == n else f"{n}{i}" for i in range(4) for n in ("lo", "hi"))
        out += [
            f"""s{d} AS MATERIALIZED (SELECT sector, h, node, place, cut, coalesce(sum(r) FILTER (WHERE {value} <= cut), 0) AS gl,
            coalesce(sum(w) FILTER (WHERE {value} <= cut), 0) AS hl, sum(r) AS g, sum(w) AS hw FROM c{d} JOIN cuts USING (sector, h) GROUP BY ALL)""",
            f"""b{d} AS MATERIALIZED (SELECT *, (vl + vr) / 2 AS middle, round(raw_gain / most, 9) AS gain FROM (SELECT *, {score("gl", "hl", "vl")} + {score("(g - gl)", "(hw - hl)", "vr")} - {score("g", "hw", "v")} AS raw_gain FROM (
            SELECT *, {clip("gl", "hl")} AS vl, {clip("(g - gl)", "(hw - hl)")} AS vr, {clip("g", "hw")} AS v FROM s{d} JOIN n{d} USING (sector, h, node) JOIN scales USING (sector, h)))
            WHERE hl >= 1 AND hw - hl >= 1 AND round(raw_gain / most, 9) > 0 AND (NOT ({rises}) OR vl <= vr)
            QUALIFY row_number() OVER (PARTITION BY sector, h, node ORDER BY round(raw_gain / most, 9) DESC, place, cut) = 1)""",
            f"""n{d + 1} AS MATERIALIZED (SELECT * FROM n{d} WHERE NOT EXISTS (SELECT 1 FROM b{d} b WHERE b.sector = n{d}.sector AND b.h = n{d}.h AND b.node = n{d}.node)
            UNION ALL SELECT sector, h, node * 2, {moved("hi")}, least_value, CASE WHEN {rises} THEN middle ELSE most_value END FROM b{d}
            UNION ALL SELECT sector, h, node * 2 + 1, {moved("lo")}, CASE WHEN {rises} THEN middle ELSE least_value END, most_value FROM b{d})""",
            f"""c{d + 1} AS MATERIALIZED (SELECT c.sector, c.h, CASE WHEN place IS NULL THEN c.node WHEN {value} <= cut THEN c.node * 2 ELSE c.node * 2 + 1 END AS node,
            {_SCORES}, w, r FROM c{d} c LEFT JOIN (SELECT sector, h, node, place, cut FROM b{d}) b ON b.sector = c.sector AND b.h = c.h AND b.node = c.node)""",
        ]
    out.append(f"leaves AS (SELECT n.*, {clip('g', 'hw')} * 0.05 AS gives FROM n{depth} n JOIN (SELECT sector, h, node, sum(r) AS g, sum(w) AS hw FROM c{depth} GROUP BY ALL) USING (sector, h, node))")
    return ", ".join(out)


def _with_more(body: str, more: str, *views: str) -> str:
    base = _sql("", *views).rstrip()
    return f"{base}, {more} {body}"


_HALF = "CASE WHEN o_custkey % 2 = 0 THEN '오전' ELSE '오후' END"
_HOUR = "(o_orderkey % 12 + 1)"
_DAY = "CAST(o_orderdate AS DATE)"
_ANCHOR = "(CAST(o_orderdate AS DATE) - CAST(o_custkey % 20 AS INTEGER))"

ORACLE_SQL: dict[str, str] = {
    "scan_prune": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag <> 'R'""",
    "normalize_ticks": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS price, l_shipdate AS ts,
        CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linenumber <= 6""",
    "daily_bars": _sql(
        """SELECT item, day, avg(price) AS price_mean, round(stddev_samp(price), 4) AS price_std, min(price) AS price_min,
        max(price) AS price_max, count(*) AS tick_count FROM ticks GROUP BY item, day""", "ticks"),
    "tick_store": """SELECT p_partkey AS part, p_brand AS item, CAST(l_shipdate AS DATE) AS day,
        sum(floor(l_extendedprice / l_quantity * CAST(100 AS DOUBLE) + 0.5)) AS price_sum, count(*) AS tick_count
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "tick_months": _sql(
        """SELECT item, day, avg(price) AS price_mean, round(stddev_samp(price), 4) AS price_std, min(price) AS price_min,
        max(price) AS price_max, count(*) AS tick_count FROM ticks WHERE year(day) = 1996 GROUP BY item, day""", "ticks"),
    "price_file": _sql("SELECT item, day, price, trade_count FROM prices", "prices"),
    "family_daily": _sql(
        "SELECT family, item, day, avg(price) AS avg_price FROM ticks WHERE family LIKE '%AR%' GROUP BY family, item, day", "ticks"),
    "dense_grid": _sql("SELECT item, day, price, is_observed FROM grid", "grid"),
    "dense_grid_no_lookahead": _sql(
        """SELECT item, day, price, is_observed FROM (SELECT item, day, last_value(price IGNORE NULLS) OVER (PARTITION BY item ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price, price IS NOT NULL AS is_observed
        FROM (SELECT DISTINCT item FROM prices) CROSS JOIN days LEFT JOIN prices USING (item, day)) WHERE price IS NOT NULL""", "days"),
    "forward_return_7d": _sql(
        """SELECT *, (future_price_7d - price) / price AS target_return_7d FROM (SELECT item, day, price,
        lead(price, 7) OVER (PARTITION BY item ORDER BY day) AS future_price_7d FROM prices) WHERE future_price_7d IS NOT NULL AND price <> 0""",
        "prices"),
    "forward_return_calendar": _sql(
        """SELECT *, (future_price_7d - price) / price AS target_return_7d FROM (SELECT item, day, price,
        lead(price, 7) OVER (PARTITION BY item ORDER BY day) AS future_price_7d FROM grid) WHERE future_price_7d IS NOT NULL AND price <> 0""",
        "grid"),
    "seasonality": _sql(
        "SELECT item, "
        + ", ".join(f"round(avg(price) FILTER (WHERE isodow(day) = {k + 1}) / avg(price), 6) AS day_{k}" for k in range(7))
        + """, round(avg(price), 3) AS global_mean, round(stddev_samp(price), 3) AS global_std,
        round(stddev_samp(price) / avg(price), 6) AS volatility_cv FROM prices GROUP BY item""", "prices"),
    "excess_return": _sql(
        """SELECT item, day, price, weekday, round((price - base) / base, 6) AS excess_return
        FROM (SELECT item, day, price, CAST(isodow(day) - 1 AS INTEGER) AS weekday,
        avg(price) OVER (PARTITION BY item, isodow(day)) AS base FROM prices)
        WHERE (price - base) / base > -0.5 AND (price - base) / base < 5.0""", "prices"),
    "category_onehot": "SELECT *, "
        + ", ".join(f"CASE WHEN category = '{c}' THEN 1 ELSE 0 END AS is_{c}" for c in ["honing_mat", "gem", "engraving", "consumable", "other"])
        + f" FROM (SELECT p_partkey, p_name, {_classes('p_name', dt.PART_CLASSES)} AS category FROM part)",
    "price_volume": _sql(
        """SELECT *, CASE WHEN price_step > 0 AND count_step > 0 THEN 'real_rise' WHEN price_step > 0 AND count_step < 0 THEN 'fake_rise'
        WHEN price_step < 0 THEN 'fall' ELSE 'flat' END AS move FROM (SELECT *, avg_price - lag(avg_price) OVER (PARTITION BY item ORDER BY day) AS price_step,
        trade_count - lag(trade_count) OVER (PARTITION BY item ORDER BY day) AS count_step FROM volume)""", "volume"),
    "preview": _sql("SELECT item, day, price, trade_count FROM prices ORDER BY item, day LIMIT 10000", "prices"),
    "stage_funnel": _sql(
        """SELECT step, stage, n, n * 100.0::DOUBLE / first_value(n) OVER (ORDER BY step) AS pct_of_first FROM (
        SELECT 1 AS step, 'raw ticks' AS stage, count(*) AS n FROM lineitem
        UNION ALL SELECT 2, 'daily bars', count(*) FROM (SELECT DISTINCT item, day FROM ticks)
        UNION ALL SELECT 3, 'events', count(*) FROM orders
        UNION ALL SELECT 4, 'strong events', count(*) FROM calendar WHERE honing_mat_demand >= 7)""", "ticks", "calendar"),
    "volume_dedup": _sql(
        """SELECT item, day, avg_price, trade_count FROM (SELECT *, row_number() OVER (PARTITION BY item, day ORDER BY feed DESC) AS rn
        FROM (SELECT item, day, feed, avg(price) AS avg_price, count(*) AS trade_count FROM ticks WHERE feed <> 'A' GROUP BY ALL)) WHERE rn = 1""",
        "ticks"),
    "volume_enrich": _sql(
        """SELECT item, day, price_mean, round(price_std, 4) AS price_std, price_min, price_max, tick_count,
        coalesce(v.trade_count, 0) AS trade_count FROM feed_bars LEFT JOIN volume v USING (item, day)""", "feed_bars", "volume"),
    "volume_backfill": _sql(f"SELECT {_FRAME_COLUMNS} FROM merged", "merged"),
    "daily_events": _sql("SELECT * FROM event_days", "event_days"),
    "event_lead_time": _sql(
        """SELECT event_id, date, announcement_date, coalesce(CAST(date - announcement_date AS INTEGER), 7) AS lead_time_days
        FROM calendar""", "calendar"),
    "event_dedup": _sql("SELECT * FROM chosen", "chosen"),
    "numeric_coerce": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS balance FROM customer",
    "event_search": _sql(
        f"""SELECT event_id, date, {_SHOWN_TYPE} AS event_type, title, CASE WHEN is_pre_announced THEN 'Yes' ELSE 'No' END AS pre_announced,
        '[' || CAST(date AS VARCHAR) || '] ' || {_SHOWN_TYPE} || ' - ' || title AS display_title FROM calendar
        WHERE regexp_matches(lower(title), 'update|summary|event') AND event_type <> 'Event'""", "calendar"),
    "summary_merge": _sql(
        """SELECT event_id, date, event_type, title, 'impact' AS source FROM calendar WHERE announcement_date IS NOT NULL
        UNION ALL SELECT event_id, date, event_type, title, 'summary' FROM calendar s WHERE event_type = 'Stream Summary'
        AND NOT EXISTS (SELECT 1 FROM calendar b WHERE b.announcement_date IS NOT NULL AND b.date = s.date AND b.title = s.title)""", "calendar"),
    "decision_rules": _sql(_RULES, "calendar"),
    "event_feature_join": _sql(
        """SELECT t.day, item, price, feed, coalesce(f.event_count, 0) AS event_count, coalesce(is_gold_nerf, 0) AS is_gold_nerf,
        coalesce(is_new_raid, 0) AS is_new_raid, coalesce(is_t4, 0) AS is_t4, coalesce(is_gem, 0) AS is_gem, coalesce(is_package, 0) AS is_package,
        coalesce(impact_score, 0) AS impact_score, coalesce(sentiment_score, 0) AS sentiment_score,
        coalesce(event_type, 'None') AS event_type FROM ticks t LEFT JOIN day_features f ON f.date = t.day""", "ticks", "day_features"),
    "daily_features": _sql(
        """SELECT t.day, item, avg(price) AS price, count(DISTINCT event_id) AS event_count, coalesce(max(CASE WHEN gold_inflation >= 9 THEN 1 ELSE 0 END), 0) AS is_gold_nerf,
        coalesce(max(CASE WHEN content_difficulty >= 8 THEN 1 ELSE 0 END), 0) AS is_new_raid, coalesce(max(CASE WHEN gold_sink >= 8 THEN 1 ELSE 0 END), 0) AS is_t4,
        coalesce(max(CASE WHEN gem_demand >= 9 THEN 1 ELSE 0 END), 0) AS is_gem, coalesce(max(CASE WHEN event_type = 'Roadmap Item' THEN 1 ELSE 0 END), 0) AS is_package,
        coalesce(CAST(max(gold_inflation) AS DOUBLE), 0) AS impact_score,
        coalesce(min(CASE WHEN event_id IS NULL THEN NULL WHEN gem_demand > 7 THEN 1 WHEN gem_demand < 3 THEN -1 ELSE 0 END), 0) AS sentiment_score,
        coalesce(arg_min(event_type, event_id), 'None') AS event_type, CAST(isodow(t.day) - 1 AS INTEGER) AS day_of_week
        FROM ticks t LEFT JOIN calendar c ON c.date = t.day GROUP BY t.day, item""", "ticks", "calendar"),
    "training_frame": _sql("SELECT * REPLACE (round(price_std, 4) AS price_std) FROM frame", "frame"),
    "sector_index": _sql("SELECT sector, date, round(price, 4) AS price FROM sidx", "sidx"),
    "event_trajectory": _sql(
        """SELECT event_id, e.date, sector, h, round(idx, 4) AS "index", round(idx - 100.0, 4) AS return_pct
        FROM calendar e JOIN curves c ON c.date = e.date""", "calendar", "curves"),
    "trajectory_wide": _sql(
        f"""SELECT e.event_id, e.date, coalesce(CAST(e.date - announcement_date AS INTEGER), 7) AS lead_time_days, {_WIDE},
        coalesce(round_even(max(idx) FILTER (WHERE sector = 'Honing' AND h = 7), 1), 0.0) AS "Actual_Honing_Return",
        coalesce(round_even(max(idx) FILTER (WHERE sector = 'Gem' AND h = 7), 1), 0.0) AS "Actual_Gem_Return"
        FROM calendar e LEFT JOIN curves c ON c.date = e.date GROUP BY e.event_id, e.date, announcement_date""", "calendar", "curves"),
    "event_base_price": _sql("SELECT item, date, base_price, base_source FROM windows", "windows"),
    "forward_window": _sql(
        "SELECT item, date, max_price, mean_price, days_seen FROM windows WHERE days_seen > 0", "windows"),
    "listed_betas": _sql(
        f"SELECT item, round(avg_return, 4) AS avg_return, round(win_rate, 4) AS win_rate, sample_size FROM betas WHERE item IN ({', '.join(_text(i) for i in dt.LISTED_ITEMS)})",
        "betas"),
    "item_betas": _sql(
        "SELECT item, round(avg_return, 4) AS avg_return, round(win_rate, 4) AS win_rate, sample_size FROM betas", "betas"),
    "tier_picks": _sql(
        """SELECT current_pick, round(max(avg_return), 4) AS avg_return, round(avg(win_rate), 4) AS win_rate, arg_max(item, avg_return) AS source_item
        FROM (SELECT *, CASE item WHEN 'Brand#1' THEN 'Brand#11' WHEN 'Brand#2' THEN 'Brand#11' WHEN 'Brand#3' THEN NULL ELSE item END AS current_pick
        FROM betas) WHERE current_pick IS NOT NULL GROUP BY current_pick ORDER BY max(avg_return) DESC, current_pick LIMIT 7""", "betas"),
    "hourly_deviation": _sql(
        """SELECT CAST(hour AS INTEGER) AS hour, round(dev, 6) AS avg_deviation_pct, CASE WHEN dev > 0 THEN 'sell' ELSE 'buy' END AS side
        FROM hours""", "hours"),
    "best_hours": _sql(
        """SELECT CAST(buy_hour AS INTEGER) AS buy_hour, round(buy_dev, 6) AS buy_dev, CAST(sell_hour AS INTEGER) AS sell_hour, round(sell_dev, 6) AS sell_dev,
        round(net, 6) AS net_margin_pct, CASE WHEN net > 0 THEN 'trade' ELSE 'hold' END AS verdict FROM (SELECT *,
        (100 * (1 + sell_dev / 100) * 0.95 - 100 * (1 + buy_dev / 100)) / (100 * (1 + buy_dev / 100)) * 100 AS net
        FROM (SELECT arg_min(hour, dev) AS buy_hour, min(dev) AS buy_dev, arg_max(hour, dev) AS sell_hour, max(dev) AS sell_dev FROM hours))""", "hours"),
    "sample_weights": _sql("SELECT sector, h, date, score, round(w, 4) AS w FROM weighted", "weighted"),
    "walk_forward_folds": _sql(
        """SELECT CAST(fold_start AS INTEGER) AS fold_start, min(date) AS first_date, max(date) AS last_date, count(*) AS test_size,
        CAST(fold_start AS INTEGER) AS train_size FROM (SELECT date, CASE WHEN i < 50 * greatest(ceil((n - 50) / 50), 0) THEN i // 50 * 50 ELSE i END AS fold_start
        FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM calendar)))
        GROUP BY fold_start""", "calendar"),
    "walk_forward": _sql(
        "SELECT sector, date, h, CAST(fold_start AS INTEGER) AS fold_start, round(pred, 3) AS pred FROM honest", "honest"),
    "walk_forward_grams": _with_more(
        f"SELECT sector, h, CAST(fold_start AS INTEGER) AS fold_start, {', '.join(f'round({k}, {0 if k[-1] == 'y' else 2}) AS {k}' for k in _GRAM_TERMS)} FROM grams", _GRAMS, "weighted", "chosen"),
    "walk_forward_lines": _with_more(
        """SELECT sector, date, h, CAST(fold_start AS INTEGER) AS fold_start, round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY sector, date
        ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 100.0), 3) AS pred FROM raw""", _CLAMPED_LINES, "weighted", "chosen"),
    "sector_first_trees": _with_more(
        f"""SELECT sector, h, 1 AS tree, {", ".join(f"{end}{i} AS {name}_{f}" for i, f in enumerate(SECTOR_FEATURES) for end, name in (("lo", "low"), ("hi", "high")))},
        round(gives, 6) + 0.0 AS gives FROM leaves""", _first_trees(), "weighted", "chosen"),
    "walk_forward_purged": _sql(
        """SELECT sector, date, h, round(coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY sector, date ORDER BY h
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 100.0), 3) AS pred FROM (
        SELECT sector, date, h, CASE WHEN n >= 3 THEN (swy - slope * swx) / sw + slope * x END AS raw FROM (
        SELECT *, greatest(CASE WHEN lo = hi THEN 0 ELSE (sw * swxy - swx * swy) / (sw * swxx - swx * swx) END, 0) AS slope FROM (
        SELECT q.sector, q.h, q.date, q.x, count(t.w) AS n, sum(t.w) AS sw, sum(t.w * t.x) AS swx, sum(t.w * t.y) AS swy,
        sum(t.w * t.x * t.x) AS swxx, sum(t.w * t.x * t.y) AS swxy, min(t.x) AS lo, max(t.x) AS hi FROM weighted q
        LEFT JOIN (SELECT * FROM weighted WHERE y IS NOT NULL) t ON t.sector = q.sector AND t.h = q.h AND t.date < q.date AND t.date + t.h < q.date
        GROUP BY ALL)))""", "weighted"),
    "final_overwrite": _sql("SELECT sector, date, h, round(pred, 3) AS pred, source FROM stored", "stored"),
    "trajectory_arrays": _sql(
        """SELECT sector, date, CAST(row_number() OVER (PARTITION BY sector, date ORDER BY h) - 1 AS INTEGER) AS pos, h, round(pred, 3) AS pred
        FROM honest""", "honest"),
    "forecast_choice": _sql(
        """SELECT event_id, s.date, sector, h, kind, source, round(value, 3) AS value, is_high FROM (
        SELECT *, coalesce(max(CASE WHEN kind = 'predicted' AND round(value, 6) > 100.0 THEN 1 ELSE 0 END) OVER (PARTITION BY date, sector), 0) = 1 AS is_high FROM (
        SELECT sector, date, h, pred AS value, source, 'predicted' AS kind FROM stored
        UNION ALL SELECT sector, date, h, y, 'market', 'actual' FROM stored) WHERE value IS NOT NULL) s
        JOIN (SELECT event_id, date, coalesce(date - announcement_date, 7) AS lead FROM calendar) c ON c.date = s.date
        WHERE h >= -(lead + 5)""", "stored", "calendar"),
    "forecast_live": _sql(
        """SELECT event_id, s.date, sector, h, kind, source, round(value, 3) AS value, is_high FROM (
        SELECT *, coalesce(max(CASE WHEN kind = 'predicted' AND round(value, 6) > 100.0 THEN 1 ELSE 0 END) OVER (PARTITION BY date, sector), 0) = 1 AS is_high FROM (
        SELECT sector, date, h, pred AS value, source, 'predicted' AS kind FROM stored WHERE date < DATE '1998-01-01'
        UNION ALL SELECT sector, date, h, pred, 'live', 'predicted' FROM live WHERE date >= DATE '1998-01-01' OR date NOT IN (SELECT date FROM stored)
        UNION ALL SELECT sector, date, h, y, 'market', 'actual' FROM stored) WHERE value IS NOT NULL) s
        JOIN (SELECT event_id, date, coalesce(date - announcement_date, 7) AS lead FROM calendar) c ON c.date = s.date
        WHERE h >= -(lead + 5)""", "stored", "live", "calendar"),
    "directional_accuracy": _sql(
        """SELECT total, hits, actual_ups, pred_ups, true_ups, round(hits * 100.0 / total, 6) AS accuracy,
        round(true_ups * 100.0 / actual_ups, 6) AS recall, round(CASE WHEN pred_ups = 0 THEN 0 ELSE true_ups * 100.0 / pred_ups END, 6) AS "precision"
        FROM (SELECT count(*) AS total, count(*) FILTER (WHERE (y > 101) = (pred > 101)) AS hits, count(*) FILTER (WHERE y > 101) AS actual_ups,
        count(*) FILTER (WHERE pred > 101) AS pred_ups, count(*) FILTER (WHERE y > 101 AND pred > 101) AS true_ups
        FROM calendar c JOIN stored s ON s.date = c.date AND sector = 'Honing' AND h = 7 WHERE y > 0)""", "calendar", "stored"),
    "directional_by_date": _sql(
        """SELECT date, round(y, 3) AS y, round(pred, 3) AS pred, y > 101 AS actual_up, pred > 101 AS pred_up, (y > 101) = (pred > 101) AS hit
        FROM stored WHERE sector = 'Honing' AND h = 7 AND y > 0""", "stored"),
    "horizon_errors": _sql(
        """SELECT sector, h, round(rmse, 4) AS rmse, round(mae, 4) AS mae, n, round(avg(rmse) OVER (PARTITION BY sector), 4) AS avg_rmse
        FROM (SELECT sector, h, sqrt(avg((pred - y) * (pred - y))) AS rmse, avg(abs(pred - y)) AS mae, count(*) AS n FROM honest WHERE y IS NOT NULL
        GROUP BY sector, h)""", "honest"),
    "isotonic_fit": _with_more(
        """SELECT k.sector, k.h, k.x AS score, round(k.w, 3) AS weight, round(k.wy / k.w, 3) AS mean_index, round(max(lowest), 3) AS isotonic_index
        FROM levels k JOIN (SELECT sector, h, kx, ix, min(mean) AS lowest FROM (
        SELECT k.sector, k.h, k.x AS kx, s.ix, s.mean FROM levels k JOIN spans s ON s.sector = k.sector AND s.h = k.h AND s.ix <= k.x AND s.jx >= k.x)
        GROUP BY ALL) m ON m.sector = k.sector AND m.h = k.h AND m.kx = k.x GROUP BY k.sector, k.h, k.x, k.w, k.wy""",
        """levels AS (SELECT sector, h, x, sum(w) AS w, sum(w * y) AS wy FROM weighted WHERE y IS NOT NULL GROUP BY ALL),
        spans AS (SELECT a.sector, a.h, a.x AS ix, b.x AS jx, sum(m.wy) / sum(m.w) AS mean FROM levels a JOIN levels b ON b.sector = a.sector AND b.h = a.h AND b.x >= a.x
        JOIN levels m ON m.sector = a.sector AND m.h = a.h AND m.x >= a.x AND m.x <= b.x GROUP BY ALL)""", "weighted"),
    "backtest_last_event": _with_more(
        """SELECT day, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, count(*) AS test_rows,
        """ + _SIZES + """ FROM tested GROUP BY day""", _BACKTEST, "scored"),
    "backtest_features": _with_more(
        """SELECT day, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, count(*) AS test_rows,
        """ + _SIZES + """ FROM tested GROUP BY day""", _FEATURE_BACKTEST, "scored"),
    "backtest_feature_rows": _with_more(
        """SELECT item, day, category, round(predicted_excess, 6) AS predicted_excess, round(excess_return, 6) AS excess_return, round(error, 6) AS error
        FROM tested""", _FEATURE_BACKTEST, "scored"),
    "top_movers": _with_more(
        """SELECT kind, CAST(place AS INTEGER) AS place, item, round(predicted_excess, 6) AS predicted_excess, round(excess_return, 6) AS excess_return,
        round(error, 6) AS error FROM (
        SELECT 'predicted' AS kind, row_number() OVER (ORDER BY predicted_excess DESC, item) AS place, * FROM tested
        UNION ALL SELECT 'actual', row_number() OVER (ORDER BY excess_return DESC, item), * FROM tested) WHERE place <= 5""", _BACKTEST, "scored"),
    "scenario_scores": _with_more(
        """SELECT date, item, category, round(p, 6) AS predicted_excess_return, CAST(place AS INTEGER) AS place, round(p * 100.0, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY p DESC, item) AS place FROM (
        SELECT date, item, category, CASE WHEN l.level IS NULL THEN p.level + p.slope * honing_mat_demand ELSE l.level + l.slope * honing_mat_demand END AS p
        FROM event_days CROSS JOIN (SELECT DISTINCT item, category FROM scored) CROSS JOIN pooled p LEFT JOIN lines l USING (category))) WHERE place <= 10""",
        f"""train AS (SELECT *, 0.5 + 1.5 * (CAST(day - min(day) OVER () AS DOUBLE) / CAST(max(day) OVER () - min(day) OVER () AS DOUBLE)) AS w FROM scored),
        {_LINES}""", "scored", "event_days"),
    "scenario_feature_scores": _with_more(
        f"""SELECT date, item, category, p AS predicted_excess_return, CAST(place AS INTEGER) AS place, round(p * 100.0, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY p DESC, item) AS place FROM (
        SELECT date, item, category, round(level + {" + ".join(f"m{i}_{len(_SCENARIO_VALUES)} * ({v} - mean{i})" for i, v in enumerate(_SCENARIO_VALUES))}, 8) AS p
        FROM (SELECT e.*, CASE WHEN isodow(e.date) >= 6 THEN 1 ELSE 0 END AS is_weekend, item, category FROM event_days e CROSS JOIN (SELECT DISTINCT item, category FROM scored))
        CROSS JOIN system_{len(_SCENARIO_VALUES)})) WHERE place <= 10""",
        f"""train AS (SELECT *, 0.5 + 1.5 * (CAST(day - min(day) OVER () AS DOUBLE) / CAST(max(day) OVER () - min(day) OVER () AS DOUBLE)) AS w FROM scored),
        system AS (SELECT {_system(_SCENARIO_VALUES, "excess_return", 0.001)} FROM train), {_eliminated("system", len(_SCENARIO_VALUES))}""", "scored", "event_days"),
    "tick_hours": """SELECT event_id, event_type AS item, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events""",
    "feature_vectors": _sql(
        """SELECT event_id, 0 AS pos, CAST(honing_mat_demand AS DOUBLE) AS feature_value FROM chosen
        UNION ALL SELECT event_id, 1, gem_demand FROM chosen UNION ALL SELECT event_id, 2, gold_inflation FROM chosen
        UNION ALL SELECT event_id, 3, content_difficulty FROM chosen""", "chosen"),
    "event_flags": f"""SELECT doc_id, {_FLAG_CASES}, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN -1 ELSE 0 END AS sentiment_score FROM documents""",
    "content_filter": """SELECT page_id, 'Official Notice' AS event_type, CAST(length(content) AS INTEGER) AS content_length FROM (
        SELECT page_id, url, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', chr(10), 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
        '[ \\t\\r\\n]*\\n[ \\t\\r\\n]*', chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS content FROM pages)
        WHERE url LIKE 'https:%' AND length(content) >= 50""",
    "broadcast_filter": _sql(
        f"""SELECT link, CAST(ts AS DATE) AS date, author FROM posts WHERE {_any('text', dt.BROADCAST_WORDS)}
        AND NOT {_any('text', dt.BROADCAST_EXCLUDED)} AND CAST(ts AS DATE) >= DATE '2024-01-10'""", "posts"),
    "post_score": _sql(
        """SELECT link, author, reco, title_score, CAST(score AS DOUBLE) AS score, round(reco * 0.5::DOUBLE + length(text) * 0.2::DOUBLE, 3) AS legacy_score,
        is_candidate FROM scored_posts""", "scored_posts"),
    "best_post": _sql(
        """SELECT event_id, link, score, origin FROM (
        SELECT event_id, -1 AS link, CAST(9999 AS DOUBLE) AS score, 'manual' AS origin FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-01'
        UNION ALL SELECT event_id, link, score, 'board' FROM (SELECT e.event_id, p.link, CAST(p.score AS DOUBLE) AS score,
        row_number() OVER (PARTITION BY e.event_id ORDER BY p.score DESC, p.link) AS rn FROM events e JOIN scored_posts p
        ON p.is_candidate AND p.ts >= e.ts - INTERVAL 24 HOUR AND p.ts <= e.ts + INTERVAL 24 HOUR
        WHERE CAST(e.ts AS DATE) <> DATE '2024-01-01') WHERE rn = 1)""", "scored_posts"),
    "post_dedup": _sql(
        """SELECT link, author, CASE WHEN link IN (SELECT doc_id FROM labels) THEN reco WHEN link % 3 = 0 THEN reco + 5 ELSE reco + 1 END AS reco FROM posts""", "posts"),
    "recent_context": _sql(
        """SELECT e.event_id, e.date, coalesce(context, 'None') AS context FROM (SELECT event_id, CAST(ts AS DATE) AS date FROM events) e
        LEFT JOIN (SELECT date, string_agg('- [' || strftime(ts, '%Y-%m-%d') || '] ' || title || ' (Score: ' || CAST(CAST(score AS DOUBLE) AS VARCHAR) || ')', chr(10) ORDER BY rn) AS context
        FROM (SELECT d.date, p.*, row_number() OVER (PARTITION BY d.date ORDER BY p.ts DESC, p.link) AS rn
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) d JOIN scored_posts p ON p.is_candidate
        AND p.ts <= CAST(d.date AS TIMESTAMP) AND p.ts >= CAST(d.date - 60 AS TIMESTAMP)) WHERE rn <= 3 GROUP BY date) c ON c.date = e.date""",
        "scored_posts"),
    "nearest_summary": _sql(
        """SELECT event_id, date, summary_id, CAST(diff AS INTEGER) AS diff_days FROM (
        SELECT n.event_id, n.date, s.summary_id, s.d - n.date AS diff, row_number() OVER (PARTITION BY n.event_id
        ORDER BY abs(s.d - n.date), s.d - n.date, s.summary_id) AS rn
        FROM (SELECT event_id, date FROM calendar WHERE event_type = 'Official Notice') n
        LEFT JOIN (SELECT event_id AS summary_id, coalesce(announcement_date, date) AS d FROM calendar WHERE event_type = 'Stream Summary') s
        ON s.d >= n.date - 1 AND s.d <= n.date + 1) WHERE rn = 1""", "calendar"),
    "keyword_override": f"""SELECT doc_id, CASE WHEN hs THEN 8 ELSE s END AS honing_mat_supply, CASE WHEN hd THEN 8 ELSE d END AS honing_mat_demand,
        'Analysis' || CASE WHEN hs THEN ' | Python_Keyword_Override_Supply' ELSE '' END || CASE WHEN hd THEN ' | Python_Keyword_Override_Demand' ELSE '' END AS mechanisms_applied
        FROM (SELECT *, s < 5 AND {_any('text', dt.SUPPLY_WORDS)} AS hs, d < 5 AND {_any('text', dt.DEMAND_WORDS)} AS hd
        FROM (SELECT doc_id, text, CAST(doc_id % 11 AS INTEGER) AS s, CAST(doc_id * 3 % 11 AS INTEGER) AS d FROM documents))""",
    "target_item_filter": f"""SELECT d.doc_id, CAST(count(k.item) AS INTEGER) AS n_items, coalesce(string_agg(k.item, ', ' ORDER BY pos), 'None') AS target_items
        FROM (SELECT doc_id, trim(part) AS item, pos FROM (SELECT doc_id, unnest(string_split(text, ',')) AS part,
        unnest(generate_series(1, len(string_split(text, ',')))) AS pos FROM documents)) d
        LEFT JOIN (SELECT DISTINCT trim(unnest(string_split(text, ','))) AS item FROM benchmark) k
        ON k.item = d.item AND d.item <> '' AND NOT {_any('d.item', dt.FORBIDDEN_WORDS)} GROUP BY d.doc_id""",
    "broadcast_time": f"""SELECT o_orderkey AS event_id, {_ANCHOR} AS anchor, CASE o_orderpriority
        WHEN '1-URGENT' THEN {_DAY} + {_HOUR} * INTERVAL 1 HOUR + (o_orderkey % 60) * INTERVAL 1 MINUTE
        WHEN '2-HIGH' THEN {_DAY} + (CASE WHEN {_HALF} = '오후' THEN {_HOUR} % 12 + 12 ELSE {_HOUR} % 12 END) * INTERVAL 1 HOUR
        WHEN '3-MEDIUM' THEN make_timestamp(y, month({_DAY}), day({_DAY}), {_HOUR}, 0, 0)
        WHEN '4-NOT SPECIFIED' THEN make_timestamp(y, month({_DAY}), day({_DAY}), {_HOUR}, o_orderkey % 60, 0) END AS starts_at
        FROM (SELECT *, CASE WHEN month({_ANCHOR}) = 12 AND month({_DAY}) = 1 THEN year({_ANCHOR}) + 1
        WHEN month({_ANCHOR}) = 1 AND month({_DAY}) = 12 THEN year({_ANCHOR}) - 1 ELSE year({_ANCHOR}) END AS y FROM orders)""",
    "board_year": f"""SELECT link, board, page, shown AS month_day, CAST(coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY board ORDER BY age, link
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2001) AS INTEGER) AS year FROM (SELECT *, CASE WHEN length(shown) = 5 AND contains(shown, '-') THEN y END AS known FROM (
        SELECT o_orderkey AS link, o_orderpriority AS board, 12000 - ({_DAY} - DATE '1970-01-01') AS age, CAST((12000 - ({_DAY} - DATE '1970-01-01')) // 7 AS INTEGER) AS page,
        CASE WHEN o_orderkey % 7 = 0 THEN strftime({_DAY}, '%Y-%m-%d') WHEN o_orderkey % 11 = 0 THEN '12:34' ELSE strftime({_DAY}, '%m-%d') END AS shown, year({_DAY}) AS y FROM orders))""",
    "page_spans": f"""SELECT o_orderpriority AS board, CAST((12000 - ({_DAY} - DATE '1970-01-01')) // 7 AS INTEGER) AS page,
        max({_DAY}) AS latest, min({_DAY}) AS oldest, count(*) AS posts FROM orders GROUP BY ALL""",
    "news_alerts": """SELECT notice_id, ts, score FROM (SELECT user_id AS notice_id, ts, CAST(CAST(floor(value) AS BIGINT) % 10 + 1 AS INTEGER) AS score,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, floor(value) % 10) AS rn FROM events) WHERE rn = 1 AND score >= 7""",
    "json_profile": """SELECT 'k' AS key, count(*) AS n, count(k) AS n_numeric, min(k) AS min_value, max(k) AS max_value
        FROM (SELECT CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k FROM events)""",
    "json_landing": """SELECT event_id, CASE WHEN ok THEN k % 11 ELSE 0 END AS honing_mat_demand, CASE WHEN ok THEN k % 11 ELSE 0 END AS gem_demand, 0 AS gold_sink,
        CASE WHEN ok THEN k % 10 ELSE 0 END AS confidence_score, CASE WHEN ok THEN event_type ELSE 'None' END AS target_items,
        'general_update' AS trajectory_pattern, CASE WHEN ok THEN 'None' ELSE 'Error' END AS mechanisms_applied, NOT ok AS parse_error
        FROM (SELECT *, user_id % 5 <= 2 AS ok, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "reaction_landing": """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN quality = 1 END AS is_gold_nerf, CAST(NULL AS BOOLEAN) AS is_new_raid,
        CASE WHEN doc_id % 7 <> 0 THEN 'a|doc ' || CAST(doc_id AS VARCHAR) END AS key_features,
        CASE WHEN doc_id % 7 <> 0 THEN 'Rise' END AS predicted_market_direction, CASE WHEN doc_id % 7 <> 0 THEN toxic END AS confidence_score,
        doc_id % 7 = 0 AS parse_error, CASE WHEN doc_id % 7 = 0 THEN 'no answer for ' || CAST(doc_id AS VARCHAR) END AS raw_response FROM labels""",
    "roadmap_explode": """SELECT event_id AS link, 0 AS pos, CAST(ts AS DATE) AS date, 'Stream Summary' AS event_type, '[Stream Summary] Hype ' || event_type AS title,
        false AS is_pre_announced, CAST(ts AS DATE) AS announcement_date, CAST(user_id % 11 AS INTEGER) AS gem_demand, 0 AS gold_sink,
        CAST(user_id % 10 AS INTEGER) AS confidence_score, 'None' AS package_category, 'general_update' AS trajectory_pattern, event_type AS target_items, 'Analysis' AS mechanisms_applied
        FROM events WHERE event_type <> 'error'
        UNION ALL SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, DATE '2024-03-01' + CAST(user_id % 9 AS INTEGER), 'Roadmap Item',
        '[Roadmap Item] Next ' || CAST(user_id AS VARCHAR), true, CAST(ts AS DATE), 0, 0, 0, 'None', 'general_update', 'None', 'Analysis' FROM events""",
    "history_flatten": _sql("SELECT * FROM volume", "volume"),
    "dim_dedup": """SELECT item_id, grade, seller FROM (SELECT l_partkey AS item_id, l_returnflag AS grade, l_suppkey AS seller,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_returnflag DESC) AS rn
        FROM lineitem WHERE l_returnflag IN ('A', 'N')) WHERE rn = 1""",
    "analysis_upsert": """SELECT doc_id AS post_link, lang AS verdict, source AS tags FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT doc_id, 'q' || CAST(quality AS VARCHAR), 'new' FROM labels""",
    "notice_extract": """SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, regexp_extract(li, 'href="([^"]*)"', 1) AS href, regexp_extract(li, '>([^<]*)</a>', 1) AS label
        FROM (SELECT page_id, unnest(l) AS li, unnest(generate_series(1, len(l))) AS pos
        FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages))""",
    "notice_rows": _sql(
        """SELECT page_id, 1 AS pos, CAST(page_id AS VARCHAR) AS notice_id, trim(title) AS title, '공지' AS category,
        strftime(DATE '2024-01-01' + CAST(page_id % 28 AS INTEGER), '%Y-%m-%d') AS date, true AS is_pinned FROM page_titles
        UNION ALL SELECT page_id, 2, '9' || CAST(page_id AS VARCHAR), 'Unknown Title', 'General', 'Unknown Date', false FROM page_titles""",
        "page_titles"),
    "latest_notice": _sql("SELECT page_id, CAST(page_id AS VARCHAR) AS notice_id, trim(title) AS title FROM page_titles", "page_titles"),
    "page_text": """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
        regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', chr(10), 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
        '[ \\t\\r\\n]*\\n[ \\t\\r\\n]*', chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS content FROM pages""",
    "notice_upsert": _sql(
        """SELECT link, title, 'new' AS status FROM new_notices WHERE link NOT IN (SELECT link FROM old_notices)
        UNION ALL SELECT o.link, CASE WHEN n.link IS NOT NULL THEN n.title ELSE o.title END, CASE WHEN n.link IS NULL THEN 'kept'
        WHEN n.title <> o.title THEN 'title_changed' ELSE 'unchanged' END FROM old_notices o LEFT JOIN new_notices n ON n.link = o.link""",
        "old_notices", "new_notices"),
    "incremental_append": _sql(
        "SELECT link, title FROM new_notices WHERE link NOT IN (SELECT link FROM old_notices)", "old_notices", "new_notices"),
    "processed_dates": _sql(
        """SELECT date AS broadcast_date, event_id FROM calendar WHERE event_type = 'Official Notice' AND date NOT IN
        (SELECT announcement_date FROM calendar WHERE event_type = 'Stream Summary' AND announcement_date IS NOT NULL)""", "calendar"),
    "source_cascade": _sql("SELECT * REPLACE (0 AS gold_sink), 'Raw' AS source FROM calendar", "calendar"),
    "latest_snapshot": "SELECT * FROM part",
    "stream_hourly_bars": """SELECT date_trunc('hour', ts) AS hour_start, event_type AS item, avg(price) AS price_mean, min(price) AS price_min,
        max(price) AS price_max, count(*) AS tick_count FROM (SELECT *, floor(value * CAST(100 AS DOUBLE) + 0.5) AS price FROM events)
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""",
    "stream_daily_state": """SELECT CAST(ts AS DATE) AS day, event_type AS item, count(*) AS tick_count, sum(price) AS price_sum, min(price) AS price_min,
        max(price) AS price_max FROM (SELECT *, floor(value * CAST(100 AS DOUBLE) + 0.5) AS price FROM events) GROUP BY ALL""",
    "stream_upsert": _sql(
        """SELECT link, title, 'new' AS status FROM new_notices WHERE link NOT IN (SELECT link FROM old_notices)
        UNION ALL SELECT o.link, CASE WHEN n.title <> o.title THEN n.title ELSE o.title END, CASE WHEN n.title <> o.title THEN 'title_changed' ELSE 'kept' END
        FROM old_notices o LEFT JOIN new_notices n ON n.link = o.link""", "old_notices", "new_notices"),
    "stream_refresh": _sql(
        """SELECT event_id, e.date, sector, h, round(idx, 4) AS "index", round(idx - 100.0, 4) AS return_pct
        FROM calendar e JOIN curves c ON c.date = e.date""", "calendar", "curves"),
}
ORACLE_SQL["stream_alerts"] = ORACLE_SQL["news_alerts"]
ORACLE_SQL["stream_prices"] = ORACLE_SQL["event_trajectory"]
