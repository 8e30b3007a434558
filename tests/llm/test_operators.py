"""The training-data operators against brute force on small tables with odd rows."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from eventide.llm.blocks import window_ids
from eventide.llm.components import components
from eventide.llm.decontaminate import common_length, decontaminate
from eventide.llm.embedding_dedup import embedding_dedup
from eventide.llm.html_text import extract_main_text, main_text
from eventide.llm.language_id import fit, language_id
from eventide.llm.license_scan import TEMPLATES, license_scan
from eventide.llm.packing import pack
from eventide.llm.sharding import shard_by_bytes
from eventide.llm.simhash_dedup import simhash_dedup
from eventide.llm.substring_dedup import substring_dedup
from eventide.llm.suffix_dedup import refine, suffix_dedup

LAST = 1 << 62
SCHEMA = "doc_id long, text string, lang string, t string, k long, n string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    long = " ".join(f"w{i * i % 977}" for i in range(9000))
    odd = [(9000, None, "en"), (9001, "", None), (9002, " \t\n", "en"), (9003, "x" * 130, None), (9004, "x" * 90 + " tail", "de"),
           (9005, long, "en"), (9006, long, "en"), (9007, "1 2 ### 3", None), (None, "y " * 60, "en"), (9008, "Ä é ñ ß 漢字", None),
           (9009, base[0][1], base[0][2]), (9009, base[0][1], base[0][2]), (9010, "a b", None)]
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in base + odd], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def key(d):
    return LAST if d is None else d


def test_substring_dedup_equals_brute_force(docs, texts):
    words = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    expected = collections.Counter()
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        expected[(d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    got = collections.Counter(tuple(r) for r in substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == expected


def test_suffix_dedup_equals_brute_force(docs, texts):
    first = {}
    for d, t in texts:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], LAST), key(d))
    expected = collections.Counter()
    for d, t in texts:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        expected[(d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))] += 1
    got = suffix_dedup(docs, carry=("t", "k")).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected
    assert {r.carried.t for r in got} == {"clash"}


def test_refined_buckets_are_equal_strings():
    text = np.frombuffer(b"abcabcabd" * 30 + bytes(range(60)) + b"abcabcabd" * 10, np.uint8)
    ids, raw = refine(text, 50), text.tobytes()
    places = range(len(raw) - 49)
    assert all((ids[i] == ids[j]) == (raw[i : i + 50] == raw[j : j + 50]) for i in places for j in places)


def test_window_ids_keep_order():
    ids = np.array([1, 2, 3, 2, 1, 2, 3], np.uint64)
    assert [len(window_ids(ids, w)) for w in (1, 3, 7, 8)] == [7, 5, 1, 0]
    three = window_ids(ids, 3)
    assert three[0] == three[4] and len(set(three.tolist())) == 4


def test_packing_is_an_exact_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = pack(docs, path).collect()
    expected = collections.Counter()
    for d, t in texts:
        expected[(d, tuple([*model.encode(t or "", add_special_tokens=False).ids, 0]))] += 1
    used = collections.Counter()
    for r in rows:
        ids = np.frombuffer(r.ids, np.uint32)
        assert len(ids) == r.length
        used[r.doc_id] += len(ids)
        whole = [w for (d, w) in expected if d == r.doc_id and len(w) == r.doc_tokens]
        assert any(w[r.start : r.start + r.length] == tuple(ids.tolist()) for w in whole)
    for d in {d for d, _ in expected}:
        assert used[d] == sum(len(w) * n for (e, w), n in expected.items() if e == d)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 1024
    assert sum(1024 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)


def test_shards_are_contiguous_and_level(docs, texts):
    rows = shard_by_bytes(docs).collect()
    assert len(rows) == len(texts)
    size = {}
    for d, t in texts:
        size.setdefault(d, set()).add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    assert all((r.size, r.text_crc32) in size[r.doc_id] for r in rows)
    order = [(r.shard, r.slot) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.shard, r.slot))]
    assert order == sorted(order)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(16):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= largest


def test_decontamination_finds_copies_and_paraphrases(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu nu xi omicron."
    near = "alpha BETA gamma delta, epsilon zeta eta eta theta iota kappa lambda mu nu pi omicron"
    loose = "alpha one gamma delta two zeta three theta four kappa. Lambda mu nu xi omicron."
    filler = " ".join(f"filler{i}" for i in range(120))
    others = [(100 + i, filler, "x") for i in range(300)]
    docs = spark.createDataFrame(
        [*others, (1, f"{filler} {item} {filler}", "x"), (2, f"{filler} {near} {filler}", "x"), (3, f"{filler} {loose}", "x"), (4, filler, "x"),
         (5, None, "x"), (6, "", "x"), (7, "omicron xi nu mu lambda kappa iota theta eta zeta", "x"), (None, item, "x")],
        "doc_id long, text string, k string",
    )
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.by_answer for r in decontaminate(docs, benchmark).collect()}
    assert got == {(1, 1): False, (2, 1): False, (3, 1): True, (None, 1): False}
    assert decontaminate(docs, benchmark.limit(0)).count() == 0
    assert decontaminate(docs.limit(0), benchmark).count() == 0


def test_every_verbatim_item_is_found(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    rows, wanted = docs.select("doc_id", "text").collect(), items.collect()
    expected = {(d.doc_id, i.item_id) for d in rows for i in wanted if i.text in d.text}
    assert expected <= {(r.doc_id, r.item_id) for r in decontaminate(docs, items).collect()}


def test_every_verbatim_item_of_a_large_benchmark_is_found(spark):
    """Thousands of items in one block, each standing once among foreign words or words of other items."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(20000)])
    chosen = [words[np.minimum(rng.zipf(1.3, rng.choice([5, 9, 37, 60])) - 1 + rng.integers(0, 9000, 1), 19999)].tolist() for _ in range(3000)]
    rows = []
    for i, item in enumerate(chosen):
        around = words[rng.integers(0, 20000, 80)].tolist()
        k = int(rng.integers(0, 81))
        rows.append((i, " ".join([*around[:k], *item, *around[k:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(chosen)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate(docs, items).collect()}
    assert {(i, i) for i in range(len(chosen))} <= got


def test_pairs_equal_brute_force(spark):
    """Every pair of short rows and items, by the plain table of common subsequences."""
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(900)]
    items = [[words[k] for k in rng.integers(0, 900, int(rng.integers(6, 28)))] for _ in range(60)]
    rows = []
    for i in range(300):
        item = items[int(rng.integers(0, 60))]
        part = [w if rng.random() > (i % 6) / 10 else f"z{int(rng.integers(0, 99))}" for w in item]
        around = [f"u{int(k)}" for k in rng.integers(0, 500, 5)]
        rows.append(around[:2] + part + around[2:])

    def common(a, b):
        above = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(above[j] + 1 if x == y else max(now[j], above[j + 1]))
            above = now
        return above[-1]

    expected = {(i, k): common(t, r) / len(r) for i, t in enumerate(rows) for k, r in enumerate(items)}
    expected = {pair: share for pair, share in expected.items() if share >= 0.8}
    docs = spark.createDataFrame([(i, " ".join(t), 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, t int, k string").repartition(5)
    bench = spark.createDataFrame([(k, " ".join(r), 1) for k, r in enumerate(items)], "item_id long, text string, words int")
    for block in (5000, 13):
        got = {(r.doc_id, r.item_id): r.share for r in decontaminate(docs, bench, items_per_block=block).collect()}
        assert len(expected) > 100 and set(got) <= set(expected) and len(got) >= 0.98 * len(expected)
        assert all(abs(got[pair] - expected[pair]) < 1e-12 for pair in got)


def test_short_repeated_and_long_items(spark):
    filler = " ".join(f"filler{i}" for i in range(200))
    long = " ".join(f"long{i * 7919 % 5003}" for i in range(3000))
    docs = spark.createDataFrame([(1, f"{filler} Too, short here"), (2, f"{filler} {long} {filler * 200}"), (3, "too here short"), (4, f"{filler} yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "too short"), (2, "too short"), (3, long), (4, "!!!"), (None, "Yes.")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.share) for r in decontaminate(docs, bench).collect())
    assert got == [(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (4, 0, 1.0)]


def test_common_length():
    masks = {1: 0b1001, 2: 0b0010, 3: 0b0100}
    assert common_length(masks, 0b1111, [1, 9, 2, 3, 1]) == 4
    assert common_length(masks, 0b1111, [3, 2, 1]) == 2
    assert common_length(masks, 0b1111, []) == 0


def test_licences_are_matched_and_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = "plain words of no licence at all\n" * 3
    files = spark.createDataFrame(
        [(1, "r/LICENSE", mit), (2, "r/a/b/x.txt", filler), (3, "r/a/COPYING", filler + gpl), (4, "r/c/y.txt", filler), (5, "r/a/b/z.txt", mit),
         (6, "q/x.txt", filler), (7, None, mit), (8, "r/n.txt", None), (9, "top.txt", ""), (8, "r/n.txt", None)],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in license_scan(files).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[2] == (None, "GPL-3.0", "r/a") and got[3] == ("GPL-3.0", "GPL-3.0", None)
    assert got[4] == (None, "MIT", "r") and got[5] == ("MIT", "MIT", None) and got[6] == (None, None, None)
    assert got[7] == ("MIT", "MIT", None) and got[8] == (None, "MIT", "r") and got[9] == (None, None, None)
    assert license_scan(files).count() == 10
    assert license_scan(files.limit(0)).count() == 0


def test_licence_lines_equal_brute_force(spark):
    """Common words beside a header, and headers whose every word is common, score as TF-IDF over all files says."""
    import math

    rng = np.random.default_rng(2)
    lines = ["Licensed under CC BY 4.0. copyright", "All rights reserved.", "Copyright all rights reserved here", "Licensed under CC BY 4.0.", "rights of all"]
    texts = [lines[int(rng.integers(0, 5))] + "\ncopyright holder" * int(rng.integers(0, 2)) + f"\nword{i}" for i in range(400)]
    split = [[re.findall("[a-z0-9]+", x.lower()) for x in t.split("\n")] for t in texts]
    df = collections.Counter(w for t in split for w in {w for x in t for w in x})

    def vector(ws):
        x = {w: n * math.log((len(texts) + 2) / (df[w] + 1)) for w, n in collections.Counter(ws).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / size for w, v in x.items()}

    templates = [(n, vector(re.findall("[a-z0-9]+", t.lower()))) for n, t in TEMPLATES]
    files = spark.createDataFrame([(i, f"d/{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_license, r.score) for r in license_scan(files).collect()}
    for i, t in enumerate(split):
        scores = [(-sum(v * y.get(w, 0) for w, v in vector(x).items()), n) for x in t if x for n, y in templates]
        best = min(scores)
        assert got[i][0] == (best[1] if -best[0] >= 0.6 else None)
        assert best[0] > -0.6 or abs(got[i][1] + best[0]) < 1e-6


def test_language_of_held_out_documents(spark, docs, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(real.where(~held))
    got = language_id(real.where(held), model).join(real, "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs, model).collect()}
    assert all(odd[d] == ("und", 0.0) for d in (9000, 9001, 9002, 9007)) and odd[9008][0] != "und"
    assert all(0 <= s <= 1 for _, s in odd.values())
    assert {r.lang_pred for r in language_id(docs, fit(docs.limit(0))).collect()} == {"und"}
    assert language_id(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(real)
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "É", "漢", "  hello world", "hello world  ", "1", "\U00100000", "\U0003fffe", "ñ 1"])], "doc_id long, text string")
    rows = real.select("doc_id", "text").unionByName(odd)
    one, many = (sorted(map(tuple, language_id(rows.repartition(n), model).collect())) for n in (1, 50))
    assert one == many
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(odd, model).collect()}
    assert all(got[k][0] != "und" for k in (0, 1, 2, 8)) and all(got[k] == ("und", 0.0) for k in (5, 6, 7))
    assert got[3] == got[4]


def test_profiles_equal_brute_force(spark, sf_dir):
    """Bound and bundled n-gram vectors of a few texts, letter by letter."""
    from eventide.llm.language_id import _alphabet, _bundles, _letters

    letters, number = _letters(256), _alphabet()
    texts = ["a", "Hello, wörld!", "  x  y ", "", "...", "ñandú 12 漢字"]
    out, count = _bundles(texts, 3, letters)
    for text, vector, n in zip(texts, out, count):
        symbols = [0]
        for c in text:
            symbol = int(number[ord(c)])
            if symbol or symbols[-1]:
                symbols.append(symbol)
        symbols += [0] if symbols[-1] else []
        expected = np.zeros(256)
        for i in range(len(symbols) - 2):
            gram = symbols[i : i + 3]
            expected += np.prod([np.roll(letters[s], 2 - k) for k, s in enumerate(gram)], axis=0)
        assert (vector == expected).all() and n == sum(s > 0 for s in symbols)


def _reach(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    near = np.repeat(base[:20], 6, axis=0) + 0.25 * rng.normal(size=(120, 32))
    x = np.concatenate([base, near, np.repeat(base[:1], 40, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, [1.0, 2.0]), (905, [])]
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = unit @ unit.T
    linked = [(i, j) for i in range(len(x)) for j in range(i) if cos[i, j] >= 0.9]
    exact = sum(1 for i, j in linked) * 2
    assert 0.9 * exact <= sum(got[i].n_links for i in range(len(x))) <= exact
    assert all(got[i].n_links <= (cos[i] >= 0.9).sum() - 1 for i in range(len(x)))
    roots = _reach(len(x), linked)
    assert sum(got[i].component_id == roots[i] for i in range(len(x))) >= 0.95 * len(x)
    assert all((got[d].n_links, got[d].component_id, got[d].kept) == (0, d, True) for d, _ in odd)


def test_main_text():
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies on this site for you.</div><article><h1>Head &amp; line</h1><p><b>First &lt;one&gt;.<br><p>Second\n  line.</p>'
        '<p>Ok.</p><div class="comments"><p>A reader wrote this long comment here.</p></div></article><aside>Side text</aside><footer>&copy; site and more</footer>'
    )
    assert main_text(page) == "Head & line\nFirst <one>.\nSecond line.\nOk."
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    plain = '<body><ul><li><a href="/a">one</a><li><a href="/b">two</a></ul><p>A long paragraph of text.</p><p>More.</p></body>'
    assert main_text(plain) == "A long paragraph of text.\nMore."


def test_linked_blocks_of_an_article_stay():
    page = '<article><h1><a href="/x">Linked head</a></h1><p>A long paragraph of text.</p><p><a href="/y">A linked paragraph.</a></p><p>More of the text.</p></article>'
    assert main_text(page) == "Linked head\nA long paragraph of text.\nA linked paragraph.\nMore of the text."


def test_short_blocks_of_plain_divs_go():
    prose = "A long sentence of the story that goes on for quite some words, as stories do. " * 3
    teasers = "".join(f"<div><div><span>Teaser {k}</span></div></div>" for k in range(8))
    page = f"<body><div>{teasers}</div><div><div>{prose}</div><div>{prose}</div><div>{prose}</div></div><div>{teasers}</div></body>"
    got = main_text(page)
    assert got.count("A long sentence") == 9 and got.count("Teaser") <= 2


PROSE = "A long sentence of the story that goes on for quite some words, as stories do. " * 3


def test_the_ratio_chooses_among_articles():
    cards = "".join(f'<article><h3><a href="/{k}">Card {k}</a></h3><p><a href="/{k}"><b><i>more</i></b></a></p></article>' for k in range(5))
    page = f"<body>{cards}<article><h1>Head</h1><p>{PROSE}</p><p>Ok.</p><p>{PROSE}</p></article>{cards}</body>"
    story = " ".join(PROSE.split())
    assert main_text(page) == f"Head\n{story}\nOk.\n{story}"
    assert "Card" in main_text(f"<body>{cards}</body>") or main_text(f"<body>{cards}</body>") == ""


def test_the_ratio_chooses_regions_without_an_article():
    side = "".join(f"<p><b><i><span>Tip {k}</span></i></b></p>" for k in range(9))
    page = f"<body><div><p>{side}</p></div><div><h2>Head of it</h2><div>{PROSE}</div><div>{PROSE}</div><div>Ok then.</div><div>{PROSE}</div></div><div>{side}</div></body>"
    got = main_text(page).split("\n")
    assert got[0] == "Head of it" and got.count(" ".join(PROSE.split())) == 3 and "Ok then." in got and sum("Tip" in x for x in got) <= 2


def test_paragraphs_of_an_article_stay_whatever_their_class():
    page = (
        f'<article><p class="social-history">{PROSE}</p><section id="related-work"><p>Related work stays.</p></section><p class="notice">A notice to airmen.</p>'
        '<div class="ad-slot">Buy this.</div><div id="comments-list"><p>Nice!</p></div><div class="site-notice">We use cookies.</div></article>'
    )
    assert main_text(page).split("\n")[1:] == ["Related work stays.", "A notice to airmen."]


def test_no_page_stops_the_job(spark):
    import random

    random.seed(4)
    bits = ["<![foo[x", "<![ ", "<![foo x]>", "<![CDATA[a]]>", "<!", "<!-", "<!--", "-->", "<!DOCTYPE [", "]>", "<?x", "<p>", "</p", "<a href='", "&#x;", "&#99999999999;", "&amp", "<div class=>", "</", "<", ">", "\0",
            "text ", "<article>", "</article>", "<script>", "</script>", "<textarea>", "é", "\ud83d"[:0], "<b/>", "<svg", "=\"", "]]>", "<title>", "<plaintext>", "<li>", "<td>"]
    pages = ["".join(random.choice(bits) for _ in range(random.randint(1, 30))) for _ in range(4000)]
    for page in pages:
        main_text(page)
    deep = "<div><b>x " * 20000 + "</p>" * 20000 + "</i>" * 20000
    table = spark.createDataFrame([(k, "u", p) for k, p in enumerate([*pages[:200], "<![foo x]>", "fine <p>text", deep])], "page_id long, url string, html string")
    assert extract_main_text(table).count() == 203 and extract_main_text(table.limit(0)).count() == 0


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>abc</p>", "x"), (1, "u", "<p>abc", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract_main_text(pages).collect()) == [(0, "abc"), (1, ""), (1, "abc")]


def test_simhash_equals_brute_force(docs, texts):
    prints = []
    for _, t in texts:
        b = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", b)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    f = np.array(prints, np.uint64)
    linked = [(i, j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3).tolist() if j < i]
    roots = _reach(len(f), linked)
    least = {}
    for (d, _), r in zip(texts, roots):
        least[r] = min(least.get(r, LAST), key(d))
    expected = collections.Counter((d, f"{p:016x}", None if least[r] == LAST else least[r]) for (d, _), p, r in zip(texts, prints, roots))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()) == expected


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 7), (1, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in (5, 7, *range(200, 260))} == {5} and 1 not in got


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup, shard_by_bytes, simhash_dedup, lambda d: pack(d, public_tokenizers.path("byte_bpe_50k.json"))])
def test_empty_table_gives_no_rows(op, docs):
    assert op(docs.limit(0)).count() == 0


def test_sketch_memory_of_a_task_is_bounded():
    """Counters of one flush and one row at a time, and the same bits as a plain count."""
    import tracemalloc

    import pyarrow as pa

    from eventide.llm import sketch

    rng, bits = np.random.default_rng(5), 24
    parts = [rng.integers(0, 1 << 63, 1 << 17, dtype=np.uint64) * np.uint64(2) for _ in range(24)]
    parts[-1][:1000] = parts[0][:1000]
    tracemalloc.start()
    most = sum(b.num_rows for b in sketch._partition_sketches(lambda ids: [ids], bits)(iter(parts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most > 0 and peak < 64 << 20
    rows = [r for b in sketch._partition_sketches(lambda ids: [ids], bits)(iter(parts)) for r in b.to_pylist()]
    rows.sort(key=lambda r: r["slot"])
    merged = {r["slot"]: r["bits"] for b in sketch._merge(bits)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()}
    ids = np.concatenate(parts)
    for row, places in enumerate(sketch.counters(ids, bits)):
        count = np.bincount(places, minlength=1 << bits)
        for k in range(2):
            want = np.packbits(count[k << 23 : (k + 1) << 23] >= 2, bitorder="little").tobytes()
            assert merged[(row << 1) + k] == want
