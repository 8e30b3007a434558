"""Conversation repair, secret scan and vector codes against brute force, odd rows included."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm.conversation_repair import FOLLOWS, NEXT, START, ASSISTANT, Costs, Repair, repair_conversations, repaired_rows
from eventide.llm.queries import damaged, op11_conversation_repair, op12_secret_scan, op13_vector_codes, span_text
from eventide.llm.secret_scan import ACCOUNT, BLANK, ENDPOINT, RUN, secret_scan
from eventide.llm.vector_codes import choose_pivots, code_text, codebooks_sha256, nearest, pivot_distances, vector_codes

ROLES = ["user", "assistant", "system", "user", "assistant", "tool", ""]


def cheapest(rows, costs=Costs()):
    """Least (cost, audit) over all edits, with whole audits and lines held per state."""

    def close(states):
        changed = True
        while changed:
            changed = False
            for s in list(states):
                to, name = NEXT[s]
                way = (states[s][0] + costs.insert, states[s][1] + "I", states[s][2] + (name + ":",))
                if to not in states or way[:2] < states[to][:2]:
                    states[to], changed = way, True
        return states

    now = close({START: (0, "", ())})
    for role, text, fault in rows:
        new = {}

        def put(s, way):
            if s not in new or way[:2] < new[s][:2]:
                new[s] = way

        extra = costs.truncated if fault == 3 else 0
        for s, (cost, audit, lines) in now.items():
            put(s, (cost + costs.delete, audit + "D", lines))
            if fault in (1, 2):
                continue
            if (s, role[:1]) in FOLLOWS:
                put(FOLLOWS[s, role[:1]], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            to, name = NEXT[s]
            put(to, (cost + costs.rerole + extra, audit + "R", (*lines, f"{name}:{text}")))
        now = close(new)
    cost, audit, lines = min(now[s] for s in (START, ASSISTANT) if s in now)
    return cost, audit, lines


def enumerated(rows, costs):
    """The same by trying every edit string with at most two inserts in a row."""
    found = []

    def go(i, state, cost, audit, inserts):
        if i == len(rows) and state in (START, ASSISTANT):
            found.append((cost, audit))
        if inserts < 2:
            go(i, NEXT[state][0], cost + costs.insert, audit + "I", inserts + 1)
        if i < len(rows):
            role, _, fault = rows[i]
            extra = costs.truncated if fault == 3 else 0
            go(i + 1, state, cost + costs.delete, audit + "D", 0)
            if fault not in (1, 2):
                if (state, role[:1]) in FOLLOWS:
                    go(i + 1, FOLLOWS[state, role[:1]], cost + extra, audit + "K", 0)
                go(i + 1, NEXT[state][0], cost + costs.rerole + extra, audit + "R", 0)

    go(0, START, 0, "", 0)
    return min(found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_repair_equals_brute_force():
    random.seed(11)
    for turn in range(1500):
        costs = Costs() if turn % 2 else Costs(random.randint(0, 4), random.randint(0, 5), random.randint(1, 6), random.randint(0, 5))
        rows = [(random.choice(ROLES), random.choice("xyz"), random.choice([0, 0, 0, 1, 2, 3])) for _ in range(random.randint(0, 14))]
        repair = Repair(costs)
        for row in rows:
            repair.row(*row)
        cost, audit, lines = cheapest(rows, costs)
        assert repair.end() == (cost, audit, sha("\n".join(lines)))
        if len(rows) < 5:
            assert enumerated(rows, costs) == (cost, audit)


def test_edits_of_a_sound_conversation_are_emitted_as_it_streams():
    repair, most = Repair(), 0
    for i in range(3000):
        repair.row(("user", "assistant")[i % 2], "Yes.", 0)
        most = max(most, repair.unresolved())
    assert most < 10 and repair.end()[:2] == (0, "K" * 3000)


def reference_repair(rows):
    """Expected columns per conversation of the damaged table, as in the contract."""
    out, talks = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        talks[conv].extend([(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, faults = set(), [], [0, 0, 0, 0]
        for _, role, text in talk:
            core = text.rstrip(" \t\n\x0b\f\r")
            fault = 1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        out[conv] = (gaps, *faults[1:], illegal, cost, audit, sha("\n".join(lines)))
    return out


TALK = "conv_id long, turn long, role string, text string, conv string, copy int"


@pytest.fixture(scope="module")
def talks(spark):
    random.seed(5)
    words = ["Hello there.", "Why?", "No", " \n", "", "Ä ö!", "... ", "Yes. ", "x" * 20000 + "."]
    rows = [(c, t, random.choice([*ROLES, None]), random.choice([*words, None])) for c in [*range(120), None] for t in range(random.randint(1, 12))]
    rows += [(500, None, r, "No turn.") for r in ("user", "assistant")] + [(501, 7, "user", "Once.")] * 3
    rows += [(502, t, "user" if t % 2 else "assistant", f"Long {t}.") for t in range(1500)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TALK).repartition(6), rows


def test_conversations_equal_brute_force(spark, talks):
    table, rows = talks
    got = repair_conversations(damaged(table), present="present").drop("n_rows").collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == reference_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_given_conversations_equal_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, sf_dir).collect()} == reference_repair(rows)


def test_an_audit_applies_to_rows(spark, talks):
    audits = repair_conversations(talks[0], costs=Costs(insert=1))
    texts = collections.defaultdict(list)
    for r in repaired_rows(talks[0], audits).orderBy("place").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert {r.conv_id: r.repaired_sha256 for r in audits.collect()} == {c: sha("\n".join(texts[c])) for c in {r[0] for r in talks[1]}}
    assert "I" in "".join(r.audit for r in audits.collect())


def test_no_conversations(spark):
    none = spark.createDataFrame([], TALK)
    assert repair_conversations(damaged(none), present="present").count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ORDER = ["assign", "access", "hex", "account", "run", "endpoint"]


def certain_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def all_spans(text, reach=400):
    sure = certain_spans(text)
    breaks = [m.start() for m in re.finditer(BLANK, text)]
    weak = [(m.start(), 3, m.end()) for m in re.finditer(ACCOUNT, text, re.A)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(RUN, text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(ENDPOINT, text, re.A)]
    weak = [w for w in weak if not any(s[0] < w[2] and w[0] < s[2] for s in sure)]
    role = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
    out = list(sure)
    for w in weak:
        scope = sum(b <= w[0] for b in breaks)
        met = {role[o[1]] for o in sure + weak if sum(b <= o[0] for b in breaks) == scope and (0 <= o[0] - w[2] <= reach or 0 <= w[0] - o[2] <= reach)}
        if {"i": {"s"}, "s": {"i"}, "e": {"i", "s"}}[role[w[1]]] <= met:
            out.append(w)
    return sorted(out)


@pytest.fixture(scope="module")
def secrets():
    random.seed(1)
    bits = ["token", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJ1234567890", "deadbeef0123456789abcdef0123", "secret", "api_key", "APIKEY", "passwd", "\n\n",
            "\n \n", "\n", "é", "😀", "user: bob", "login=anna", "http://x.y/z", "aB3" * 8, "host: db.local", "zz", "==", "ſecret=abcdefgh", " w" * 150, "\nuser=x1y2\n"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 40))) for _ in range(400)]
    long = "word " * 30000 + "user: bob password=hunter22 " + "AKIA" + "Z" * 16 + " " + "aB3" * 9 + " and http://h.example/x " + "word " * 1000
    return [*texts, None, "", long, "secret: token = abcdefgh", "token = abcdefgh " * 3000]


def test_secrets_equal_brute_force(spark, secrets):
    table = spark.createDataFrame([(i, t, 1, "clash", "k") for i, t in enumerate(secrets)] + [(0, secrets[0], 1, "c", "k"), (None, secrets[1], 1, "c", "k")], "doc_id long, text string, row int, kind string, key string")
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, tuple(map(tuple, r.base)), tuple(map(tuple, r.spans))) for r in secret_scan(table.repartition(4)).collect())
    expected, weak = collections.Counter(), 0
    for i, t in [*enumerate(secrets), (0, secrets[0]), (None, secrets[1])]:
        base, spans = certain_spans(t or ""), all_spans(t or "")
        weak += len(spans) - len(base)
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        expected[(i, *counts, *(tuple((ORDER[k], s, e) for s, k, e in x) for x in (base, spans)))] += 1
    assert got == expected and weak > 100


def test_given_secrets_equal_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op12_secret_scan(spark, sf_dir).collect():
        base, spans = (",".join(f"{ORDER[k]}:{s}:{e}" for s, k, e in x) for x in (certain_spans(texts[r.doc_id]), all_spans(texts[r.doc_id])))
        assert (r.base_sha256, r.spans) == (sha(base), spans)


def test_no_texts(spark):
    assert secret_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def integer_codes(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks by measuring every entry, in Python integers. Rows in order of their keys."""
    rows = [(k, [int(x) * 256 if abs(x) >= 2.0**60 else math.floor(x * 256) for x in v], g) for k, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(rows[0][1]) // parts
    cut = [[r[1][p * size : (p + 1) * size] for r in rows] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def codes():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p])) for x in cut[p]] for p in range(parts)]

    for _ in range(rounds):
        found = codes()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x for x, c in zip(cut[p], found[p]) if c[1] == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)] if own else books[p][e]
    found, total = codes(), collections.Counter()
    errors = [sum(found[p][i][0] for p in range(parts)) for i in range(len(rows))]
    for (_, _, g), e in zip(rows, errors):
        total[g] += e
    fits = lambda x: x if x < 1 << 63 else None
    whole = {g for g in total if all(e < 1 << 63 for (_, _, h), e in zip(rows, errors) if h == g)}
    out = [(k, "".join(f"{found[p][i][1]:02x}" for p in range(parts)), fits(e), fits(total[g]) if g in whole else None) for i, ((k, _, g), e) in enumerate(zip(rows, errors))]
    return collections.Counter(out), sha(",".join(str(x) for b in books for e in b for x in e))


def coded(spark, rows, kind="float"):
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, label int, key int, codes string").repartition(5)
    out, books = vector_codes(table)
    return collections.Counter(map(tuple, out.select("vec_id", code_text(F.col("codes")), "error", "label_error").collect())), codebooks_sha256(books)


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    narrow = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, narrow(rng.normal(size=64) / 8), int(rng.integers(0, 3)) if i % 7 else None) for i in range(300)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 64, 1), (1002, [None] * 64, 1), (1003, [float("inf")] * 64, 1), (1004, rows[3][1], None), (1005, [0.0] * 64, 1)]
    rows += [(1006, rows[5][1], 2)] * 2 + [(None, rows[6][1], 1)]
    assert coded(spark, rows) == integer_codes(rows)
    ties = [(i, [float(x) for x in np.round(rng.normal(size=16) * 2) / 256], 0) for i in range(200)]
    assert coded(spark, ties) == integer_codes(ties)


def test_vector_codes_of_huge_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16) * 10.0 ** rng.integers(0, 12)], i % 3) for i in range(80)]
    rows += [(100, [1e300] * 16, 3), (101, [1.7e308] * 16, 4), (102, [5e-324] * 16, 4)]
    assert coded(spark, rows, "double") == integer_codes(rows)


def test_vector_codes_of_few_or_odd_vectors(spark):
    assert coded(spark, []) == (collections.Counter(), sha(""))
    assert coded(spark, [(1, [1.0] * 5, 1)]) == (collections.Counter(), sha(""))
    few = [(1, [1.0] * 16, 1), (2, [2.5] * 16, 1)]
    assert coded(spark, [*few, (3, [1.0] * 32, 1), (4, [], 1)]) == integer_codes(few)


def test_given_vectors_equal_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    found = op13_vector_codes(spark, sf_dir).collect()
    expected, digest = integer_codes(rows)
    assert collections.Counter(tuple(r)[:4] for r in found) == expected and {r.codebooks_sha256 for r in found} == {digest}


def test_pivots_prune_and_stay_exact():
    rng = np.random.default_rng(2)
    for spread, size in ((90, 4), (3, 1), (40, 2), (2000, 4)):
        entries, points, seen = rng.integers(-spread, spread, (64, size)), rng.integers(-spread, spread, (3000, size)), []
        pivots = choose_pivots(entries, 3)
        at, best = nearest(points, pivot_distances(points, pivots), entries, pivots, seen)
        every = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (at == every.argmin(1)).all() and (best == every.min(1)).all()
        assert seen[0] < 0.8 * every.size
