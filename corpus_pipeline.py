"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Each stage works on all that the one before it kept. The first four return the columns of
``documents``, so any stage can be left out; the last returns the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import catalog, language, mixing, near_copies, packing, secrets, simhash
from tidemark.llm.common import documents, intermediates, prepare, remove, written_at

#: No stage of the whole can be expressed in SQL (compression, XXH64 votes, byte-pair encoding).
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is clear; ``lang`` becomes the predicted one."""
    prepare(spark)
    known = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.classify(docs, known)
    return found.filter("accepted").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by op 3's fingerprints, and by five-word shingles of similarity 0.8 or more."""
    prepare(spark)
    # the tables of sets, larger than the texts, go as soon as it is known which documents are first
    with intermediates(spark) as keep:
        heads, path = written_at(near_copies.heads_of_both(docs), "heads")
        keep.append(path)
    return simhash.of_heads(docs, heads)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their secrets replaced."""
    prepare(spark)
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, by training position."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence."""
    prepare(spark)
    return packing.pack(docs, catalog.BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table; what the stages before it wrote is deleted as soon as it has been read."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with intermediates(spark) as keep:
            docs, path = written_at(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(path)
        if before:
            remove(spark, before)
        before = path
    return docs
