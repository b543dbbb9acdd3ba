"""The operators' queries over the given tables and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, media, mixing, oracles, packing, quality, resampling, secrets, simhash, substrings, token_counts, token_files, vector_codes
from tidemark.llm.common import documents, prepare

#: The vocabulary files that the queries use.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the unigram model of the byte-level vocabulary."""
    return token_counts.token_counts(documents(spark, sf_dir), RANKS)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: contract columns plus the number of spans that the entropy detector adds."""
    found = secrets.scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"), F.size("added").cast("long").alias("n_added"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_files.read_documents(token_files.write_shards(docs, WORD_BPE), dict(docs.dtypes)["doc_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(documents(spark, sf_dir), with_text=False).drop("spans", "k1")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).drop("rejected_by")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, range-sorted by training position (documents that it leaves out last)."""
    plan = mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), F.round("again_position", 9).alias("again_position"))
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.classify(docs, known, keep=("doc_id",))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_BPE)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's texts."""
    found = resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(documents(spark, sf_dir))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


OPERATORS = (op1_token_counts, op2_secret_scan, op3_simhash, op4_media_columns, op5_token_files, op6_substring_dedup, op7_quality_rules, op8_mixing, op9_language_id, op10_packing, op11_importance_resampling, op12_jaccard_join, op13_vector_codes)


def queries(*more: Callable[[SparkSession, str], DataFrame]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries and those given (the pipeline), each with Python workers made ready first."""

    def ready(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return query(spark, sf_dir)

        return run

    return {f.__name__: ready(f) for f in (*OPERATORS, *more)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
