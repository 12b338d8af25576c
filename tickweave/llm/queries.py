"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.exact_dedup import exact_duplicates
from tickweave.llm.fingerprint import fingerprint_neighbours
from tickweave.llm.html_extract import extract_pages
from tickweave.llm.lm import score_documents
from tickweave.llm.minhash import near_duplicates
from tickweave.llm.mixing import mix_documents
from tickweave.llm.quotes import link_quotes
from tickweave.llm.sharding import shard_documents
from tickweave.llm.spencode import encode_documents
from tickweave.llm.toxicity import fit_toxicity, score_toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents"), n_shards=40)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(_read(spark, sf_dir, "documents"))


def digest_of_encoding(docs: DataFrame) -> DataFrame:
    """Ids of a text, decoded again: both texts' digests are equal if nothing is lost. A null text counts as empty."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode_documents(docs, decoded="decoded").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("text_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_of_encoding(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_read(spark, sf_dir, "conversations"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_sharding": op1_sharding,
        "op2_fingerprints": op2_fingerprints,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_mixing": op4_mixing,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_quotation_linking": op6_quotation_linking,
        "op7_html_extraction": op7_html_extraction,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_toxicity": op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
            g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                         row_number() OVER (PARTITION BY t ORDER BY doc_id) AS place FROM n)
            SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
        """,
    }
