"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventide.llm import sql
from eventide.llm.conversation_repair import repair_conversations
from eventide.llm.decontaminate import decontaminate
from eventide.llm.embedding_dedup import embedding_dedup
from eventide.llm.html_text import extract_main_text
from eventide.llm.language_id import fit, held_out, language_id
from eventide.llm.license_scan import license_scan
from eventide.llm.packing import pack
from eventide.llm.secret_scan import secret_scan
from eventide.llm.sharding import shard_by_bytes
from eventide.llm.simhash_dedup import simhash_dedup
from eventide.llm.substring_dedup import substring_dedup
from eventide.llm.suffix_dedup import suffix_dedup
from eventide.llm.vector_codes import code_text, codebooks_sha256, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def license_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder per source, thousand and hundred of ids; every tenth is a licence file."""
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = [F.concat(F.lit(c), F.expr(f"doc_id div {n}").cast("string")) for c, n in (("k", 1000), ("c", 100))]
    return docs.select("doc_id", "text", F.concat_ws("/", "source", *folder, name).alias("path"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(license_files(_table(spark, sf_dir, "documents")))
    return out.withColumn("score", F.round("score", 6))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id(docs, fit(docs.where(~held_out("doc_id"))))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by the checksum of key and turn; rows that it drops stay with ``present`` false."""
    words = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.pmod(F.crc32(F.concat_ws(":", words["conv_id"], words["turn"]).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", words["role"].alias("role"), words["text"].alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damaged(_table(spark, sf_dir, "conversations")), present="present")
    return out.drop("n_rows")


def span_text(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(_table(spark, sf_dir, "documents"))
    digest = F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", digest, span_text("spans").alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    digest = F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    return out.select("vec_id", code_text(F.col("codes")).alias("code"), "error", "label_error", digest)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_suffix_array_dedup, op3_packing, op4_sharding, op5_decontamination, op6_license_scan, op7_language_id,
        op8_embedding_dedup, op9_html_extraction, op10_simhash_dedup, op11_conversation_repair, op12_secret_scan, op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": sql.SHARDING,
    "op11_conversation_repair": sql.CONVERSATION_REPAIR,
    "op12_secret_scan": sql.SECRET_SCAN,
    "op13_vector_codes": sql.VECTOR_CODES,
}
