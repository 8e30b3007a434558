"""From raw documents to packed token sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventide.llm.decontaminate import decontaminate
from eventide.llm.language_id import fit, known_language
from eventide.llm.packing import pack
from eventide.llm.simhash_dedup import simhash_dedup
from eventide.llm.suffix_dedup import suffix_dedup
from eventide.session import stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _named(docs: DataFrame) -> DataFrame:
    """Documents with a name of the row: id and hash of the text, so that rows that share an id are told apart."""
    return docs.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("h")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Named documents but those whose name is in ``gone``; null ids are compared like others."""
    gone = gone.select(F.col("row.doc_id").alias("gone_id"), F.col("row.h").alias("gone_h")).distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row.h") == F.col("gone_h"))
    return docs.join(gone, same, "left_anti").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. One goes if it has no letter, or its n-grams are not those of the
    language it resembles most. Learned and calibrated on all labelled documents.

    A null, empty or letterless text goes, whatever shares its id; repeated rows stay or go together; an
    empty table, or one without labels, keeps nothing."""
    docs = _named(docs)
    found = known_language(docs, fit(docs), key="row")
    return _without(docs, found.where(~F.col("known")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group; of repeated rows one.

    Null texts are empty ones, which are near duplicates of each other. Rows that share the smallest id are told
    apart by their text's hash, and the least stays. An empty table stays empty."""
    docs = _named(docs)
    kept = simhash_dedup(docs, carry=("row",)).where("kept")
    kept = kept.groupBy("group").agg(F.min("carried.row").alias("stays")).select("stays.doc_id", "stays.h")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row.h") == F.col("kept_h"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["row"]).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds. A character cut in two goes whole; a
    document of which nothing is left goes.

    A null or empty text stays as it is. Rows that share an id, null or not, do not cut each other; a null id
    counts as the last. An empty table stays empty."""
    out = suffix_dedup(docs, carry=("lang", "source", "text"), characters=True)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("carried.text")))
    out = out.where("n_removed = 0 or length(text) > 0")
    return out.select("doc_id", "text", "carried.lang", "carried.source", F.char_length("text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Rows that share an id, null or not, are judged each by its own text; repeated rows
    stay or go together. An empty table stays empty."""
    docs = _named(docs)
    pairs = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    return _without(docs, pairs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens. A null or empty text gives its end token alone; null
    and repeated ids keep their pieces; an empty table gives no rows."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: Models, fingerprints and tokens have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
