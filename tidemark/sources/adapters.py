"""The engine's tables over the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: ord, id, type, ts, scope, text, tags, priority, source_path, supersedes."""
    types = ["rule", "decision", "note", "incident", "pointer", "excerpt", "constraint"]
    signals = ["security", "ops", "decision", "risk", "style"]
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    d = F.col("doc_id")
    id_of = lambda x: F.concat(pick(types, x % 7), F.lit(":"), x.cast("string"))
    band = F.floor(d / 20) % 5
    # edges to the earlier or later node of the same source, to nobody, or to another scope
    targets = F.array(
        F.when(band.isin(2, 3) | ((band == 4) & (d % 8 == 0)), d - 20),
        F.when((band == 2) & (d % 4 == 0), d + 20),
        F.when(band == 0, d + 1_000_000_000),
        F.when(band == 1, d - 1),
    )
    return table(spark, sf_dir, "documents").select(
        d.alias("ord"),
        id_of(d).alias("id"),
        pick(types, d % 7).alias("type"),
        F.format_string("2024-%02d-%02dT00:00:00Z", (F.floor(d / 28) % 12 + 1).cast("int"), (d % 28 + 1).cast("int")).alias("ts"),
        F.when(F.col("source") == "src0", F.lit("global")).otherwise(F.col("source")).alias("scope"),
        "text",
        F.array(F.col("lang"), pick(signals, d % 5)).alias("tags"),
        (d * 7 % 100).alias("priority"),
        F.when(d % 5 != 0, F.concat(F.lit("doc://"), d.cast("string"))).alias("source_path"),
        F.transform(F.filter(targets, lambda x: x >= 0), id_of).alias("supersedes"),
        F.format_string('{"note": "m%d"}', d % 13).alias("meta_json"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as rules, the shortest with the highest priority: ord, id, type, scope, text, tags, priority."""
    text = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    signals = F.array(*map(F.lit, ["security", "ops", "core", "risk"]))
    return text.select("ord", F.concat(F.lit("rule:"), F.col("ord").cast("string")).alias("id"), F.lit("rule").alias("type"), F.lit("global").alias("scope"), "text", F.array(F.element_at(signals, (F.col("ord") % 4 + 1).cast("int"))).alias("tags"), (F.lit(2000) - F.length("text")).cast("long").alias("priority"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session logs: session, ord, role, text, ts (the turn as minutes of a day)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("ord"), "role", "text",
        F.format_string("2024-01-01T%02d:%02d:00Z", F.floor(F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int")).alias("ts"),
    )


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed: ord, op, node_id, text, ts. Sign-ups add, errors delete, all else updates."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("node_id"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors: node_id, chunk_id, project_id, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("node_id"), F.lit("c000").alias("chunk_id"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("project_id"), "embedding")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval queries: query_id, query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
