"""Retrieval quality: reciprocal rank, recall, latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: How far from its fraction a place is looked for; more than a sketch's error, a ten-thousandth.
NEAR = 0.001


def reciprocal_ranks(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rr): 1 / the rank of the first hit whose text is the expected one, 0 if none is.

    hits: query_id, rank, text; truth: query_id, expected_text.
    """
    right = hits.withColumnRenamed("query_id", "_q").join(truth, (F.col("_q") == F.col("query_id")) & (F.col("text") == F.col("expected_text")))
    best = right.groupBy("query_id").agg(F.min("rank").alias("_rank"))
    return truth.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("_rank"), F.lit(0.0)).alias("rr"))


def retrieval_metrics(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, mrr, recall."""
    rr = reciprocal_ranks(hits, truth)
    return rr.agg(F.count("*").cast("long").alias("queries"), F.avg("rr").alias("mrr"), F.avg((F.col("rr") > 0).cast("double")).alias("recall"))


def nearest_rank(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """One row ``value``: of all values in order, the one at the rounded place (halves to even); no row if there is none.

    A sketch tells between which two values the place lies; those below are counted, and only the distinct ones between
    stand in one order. Where the sketch is wrong, all do.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    ends = [F.lit(max(0.0, fraction - NEAR)), F.lit(min(1.0, fraction + NEAR))]
    low, high, total = values.agg(*[F.percentile_approx("value", p, F.lit(10_000)) for p in ends], F.count("*")).first()
    place = round((total - 1) * fraction)
    below, among = values.agg(F.count_if(F.col("value") < F.lit(low)), F.count_if(F.col("value").between(F.lit(low), F.lit(high)))).first()
    known = below <= place < below + among
    near = values.filter(F.col("value").between(F.lit(low), F.lit(high))) if known else values
    counts = near.groupBy("value").agg(F.count("*").alias("_n"))
    placed = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("value")) + (below if known else 0))
    return placed.filter((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)).select("value")
