"""SQL of the operators that SQL can express, written from their definitions: every entry measured, every pair joined, every state kept."""

from __future__ import annotations

from eventide.llm.secret_scan import ACCESS, ACCOUNT, ASSIGN, BASE, BLANK, ENDPOINT, HEX, LEAST, ROLE, RUN


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# CRC-32 of a text's UTF-8 bytes, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: CAST('0x' || b AS BIGINT))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7]), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""


# ------------------------------------------------------------------------------- shards

SHARDING = f"""WITH sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents),
 placed AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16
 // sum(size) OVER () AS INTEGER) AS shard FROM sized)
 SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot,
 CAST(NULL AS INTEGER) AS grown_shard FROM placed"""


# ------------------------------------------------------------------ conversation repair

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _way(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state's way carried on by one edit: cost, edits and text."""
    text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND substr(role, 1, 1) = '{initial}' THEN {_way(state, 'extra', 'K', 'line')} END"


def _reroled(state: str, name: str) -> str:
    line = f"'{name}:' || text"
    return f"CASE WHEN NOT gone THEN {_way(state, '1 + extra', 'R', line)} END"


_STEP = f"""SELECT conv, i, e AS e0, s AS s0, {_least(_way("e", "5", "I", "'user:'"), _way("s", "5", "I", "'user:'"), _way("a", "5", "I", "'user:'"), "u")} AS u0, a AS a0 FROM (
 SELECT conv, i, {_way("e0", "2", "D")} AS e,
 {_least(_way("s0", "2", "D"), _kept("e0", "s"))} AS s,
 {_least(_way("u0", "2", "D"), *[w for x in ("e0", "s0", "a0") for w in (_kept(x, "u"), _reroled(x, "user"))])} AS u,
 {_least(_way("a0", "2", "D"), _kept("u0", "a"), _reroled("u0", "assistant"))} AS a FROM (
 SELECT r.conv, d.i, e0, s0, u0, a0, role, text, role || ':' || text AS line, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS extra
 FROM walk r JOIN marked d ON d.conv IS NOT DISTINCT FROM r.conv AND d.i = r.i + 1))"""

CONVERSATION_REPAIR = f"""WITH RECURSIVE
 keyed AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 fated AS (SELECT *, {_CRC.format("k")} % 20 AS fate FROM keyed),
 damaged AS (SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
 CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated WHERE fate <> 0),
 marked AS (SELECT conv, turn, role, text, i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) || substr(role, 1, 1) AS pair,
 CASE WHEN core = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM (
 SELECT *, rtrim(text, {_SPACE}) AS core, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
 row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged)),
 walk AS (SELECT DISTINCT conv_id AS conv, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS e0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s0,
 {{'c': 5, 'a': 'I', 't': 'user:'}} AS u0, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a0 FROM conversations
 UNION ALL SELECT conv, i, e0, s0, u0, {_least("a0", _way("u0", "5", "I", "'assistant:'"))} FROM ({_STEP})),
 counted AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
 count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
 count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv)
 SELECT w.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, CAST({_least("e0", "a0")}.c AS BIGINT) AS cost, {_least("e0", "a0")}.a AS audit, sha256({_least("e0", "a0")}.t) AS repaired_sha256
 FROM walk w LEFT JOIN counted c ON c.conv IS NOT DISTINCT FROM w.conv WHERE w.i = coalesce(c.n, 0)"""


# --------------------------------------------------------------------------- secret scan

_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "account": ACCOUNT, "run": RUN, "endpoint": ENDPOINT, "blank": BLANK}
_SOUND = {
    "assign": f"length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= {LEAST['assign']}", "access": f"length(m) >= {LEAST['access']}", "hex": f"length(m) >= {LEAST['hex']}",
    "run": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')",
}


def _spans(kind: str) -> str:
    pattern = _quoted(_PATTERNS[kind])
    return f"""SELECT doc_id, '{kind}' AS kind, {[*_PATTERNS].index(kind)} AS rank, s, s + length(m) AS t FROM (
 SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS s FROM (
 SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
 SELECT doc_id, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gaps FROM documents WHERE regexp_matches(text, {pattern})))) WHERE {_SOUND.get(kind, "true")}"""


_CERTAIN = ", ".join(f"'{k}'" for k in BASE)
_ROLES = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE.items()) + " END"
_SHOWN = "string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, rank)"

SECRET_SCAN = f"""WITH found AS MATERIALIZED ({" UNION ALL ".join(_spans(k) for k in _PATTERNS)}),
 scoped AS (SELECT f.doc_id, kind, rank, f.s, f.t, {_ROLES} AS role, (SELECT count(*) FROM found b WHERE b.kind = 'blank' AND b.doc_id = f.doc_id AND b.s <= f.s) AS scope
 FROM found f WHERE kind <> 'blank'),
 sure AS (SELECT * FROM scoped WHERE kind IN ({_CERTAIN})),
 weak AS (SELECT * FROM scoped w WHERE kind NOT IN ({_CERTAIN}) AND NOT EXISTS (SELECT 1 FROM sure c WHERE c.doc_id = w.doc_id AND c.s < w.t AND w.s < c.t)),
 met AS (SELECT w.doc_id, w.kind, w.rank, w.s, w.t, w.role, bool_or(o.role = 'secret') AS secret, bool_or(o.role = 'identifier') AS identifier
 FROM weak w JOIN (SELECT * FROM sure UNION ALL SELECT * FROM weak) o ON o.doc_id = w.doc_id AND o.scope = w.scope
 AND ((o.s >= w.t AND o.s - w.t <= 400) OR (w.s >= o.t AND w.s - o.t <= 400)) GROUP BY ALL),
 linked AS (SELECT doc_id, kind, rank, s, t FROM met WHERE CASE role WHEN 'identifier' THEN secret WHEN 'secret' THEN identifier ELSE secret AND identifier END
 UNION ALL SELECT doc_id, kind, rank, s, t FROM sure)
 SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 sha256(coalesce({_SHOWN} FILTER (WHERE kind IN ({_CERTAIN})), '')) AS base_sha256, coalesce({_SHOWN} FILTER (WHERE kind IS NOT NULL), '') AS spans
 FROM documents d LEFT JOIN linked l ON l.doc_id = d.doc_id GROUP BY d.doc_id"""


# -------------------------------------------------------------------------- vector codes


def _assigned(book: str) -> str:
    """Nearest entry of every part: all entries measured, ties to the lower index."""
    return f"""SELECT vec_id, label, p, x, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM (
 SELECT vec_id, label, p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS d FROM parts JOIN {book} USING (p)) GROUP BY vec_id, label, p, x"""


def _moved(book: str, codes: str) -> str:
    return f"""SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM {book} b LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS y FROM (
 SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM {codes}) GROUP BY p, e, i) GROUP BY p, e) m
 ON m.p = b.p AND m.e = b.e"""


VECTOR_CODES = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
 parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS p FROM kept)),
 b0 AS MATERIALIZED (SELECT p, e, x AS y FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),
 c0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_moved("b0", "c0")}), c1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_moved("b1", "c1")}),
 c2 AS MATERIALIZED ({_assigned("b2")}),
 coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM c2 GROUP BY vec_id, label)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(y[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, y, unnest(range(1, len(y) + 1)) AS i FROM b2)) AS codebooks_sha256 FROM coded"""
