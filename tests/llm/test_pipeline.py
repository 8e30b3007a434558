"""The corpus pipeline, stage by stage, against what each stage must keep."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    from eventide.session import stage_table

    out = [spark.read.parquet(f"{sf_dir}/documents.parquet").select(corpus_pipeline.COLUMNS)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage_table(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_stages_keep_the_columns_of_documents(steps):
    assert all(s.columns == corpus_pipeline.COLUMNS for s in steps[:-1])


def test_one_document_of_each_near_duplicate_group_stays(spark, steps):
    from eventide.llm.simhash_dedup import simhash_dedup

    marks = simhash_dedup(steps[1]).collect()
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({r.component_id for r in marks})


def whole_characters(text, gone):
    """Characters of which no byte is gone."""
    out, at = [], 0
    for c in text:
        size = len(c.encode())
        if not any(gone[at : at + size]):
            out.append(c)
        at += size
    return "".join(out)


def test_repeated_passages_go_and_the_rest_stays(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[2:4])
    first = {}
    for d in sorted(before):
        b = before[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        assert after.get(d, "") == whole_characters(before[d], gone)


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_only_characters_at_cuts_are_trimmed(spark, sf_dir):
    shared = "é" * 40
    rows = [(1, f"first {shared} end"), (2, f"own \ufffd text ê{shared}è more \ufffd"), (3, "\ufffd" * 3)]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, documents(spark, rows), sf_dir).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2].startswith("own \ufffd text ") and got[2].endswith(" more \ufffd")


def test_rows_that_share_an_id_are_judged_each_by_its_text(spark, sf_dir):
    real = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(corpus_pipeline.COLUMNS).collect() if r.lang]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = next(r for r in real if r.lang == "en" and 300 < len(r.text) < 2000)
    table = spark.createDataFrame([*real, (777777, clean.text, "en", "x", 1), (777777, "1 2 3 ###", None, "x", 1), (None, clean.text, "en", "x", 1), (None, None, None, "x", 1)], schema)
    kept = corpus_pipeline.language(spark, table, sf_dir).collect()
    assert [r.text for r in kept if r.doc_id in (777777, None)] == [clean.text, clean.text]
    rows = [(5, f"{clean.text} {item}"), (5, clean.text), (None, f"{item} {clean.text}"), (None, clean.text)]
    left = corpus_pipeline.benchmark_leaks(spark, documents(spark, rows), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, clean.text), (5, clean.text)]


def test_one_row_of_rows_that_share_an_id_stays(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(3, text), (3, text), (3, text + " more"), (4, text), (9, "other " * 9), (9, "else " * 30), (None, "x y z"), (None, "x y z")]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept) == [(0, "x y z"), (3, text[:5]), (9, "else "), (9, "other")]


@pytest.mark.parametrize("number", range(5))
def test_empty_tables_pass_every_stage(spark, sf_dir, number):
    assert corpus_pipeline.STAGES[number][1](spark, documents(spark, []), sf_dir).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_odd_rows_pass_every_stage(spark, sf_dir, number):
    long = " ".join(f"wort{i * i % 9973}" for i in range(60000))
    rows = [(None, None), (None, ""), (1, None), (1, " \n"), (2, long), (2, long), (3, "a"), (4, "Ω 漢字"), (5, "plain words here")]
    table = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 2, "de"))
    out = corpus_pipeline.STAGES[number][1](spark, table, sf_dir).collect()
    assert out and (number == 4 or set(out[0].asDict()) == set(corpus_pipeline.COLUMNS))


def test_leaks_go_and_clean_documents_stay(spark, steps, sf_dir):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[3:5])
    assert not any(i in t for i in items for t in after.values())
    assert len(after) >= 0.9 * len(before)


def test_every_document_is_packed(steps):
    assert {r.doc_id for r in steps[4].collect()} == {r.doc_id for r in steps[5].collect()}


def test_foreign_and_gibberish_documents_go(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select(corpus_pipeline.COLUMNS)
    foreign = "Jokainen ihminen syntyy vapaana ja tasavertaisena arvoltaan ja oikeuksiltaan sekä hänelle on annettu järki ja omatunto " * 3
    odd = [(900001, foreign), (900002, "qxzv wkjq zzxq vbnq kqxj xwvq jjkz qpxw zvkq xqjw " * 8), (900003, "123 ### 456")]
    added = spark.createDataFrame([(d, t, None, "x", len(t)) for d, t in odd], real.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, real.unionByName(added), sf_dir).collect()}
    assert kept.isdisjoint({900001, 900002, 900003})
    clean = {r.doc_id for r in real.collect() if r.lang and sum(c.isalpha() for c in r.text or "") > 40}
    assert len(kept & clean) >= 0.97 * len(clean)
