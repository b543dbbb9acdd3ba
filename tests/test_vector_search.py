"""Vector searches for many rows, and the recall of the approximate one where cells are left out."""

import random

from pyspark.sql import functions as F

from tidemark.operators import recall
from tidemark.plans import queries

SF = "/root/testdata/sf0.001"


def test_ivf_recall_where_cells_are_left_out(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"v{i}", "c000", "p", [rng.gauss(0, 1) for _ in range(16)]) for i in range(5000)]
    chunks = spark.createDataFrame(rows, "node_id string, chunk_id string, project_id string, embedding array<double>").cache()
    asked = chunks.filter(F.substring("node_id", 2, 9).cast("int") % 20 == 0).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    index = recall.IvfIndex(chunks).stored(str(tmp_path / "ivf"))
    assert (tmp_path / "ivf/rows/cell=3").exists() and index.cells == 100 and index.probes == 10
    pairs = lambda df: {(r["query_id"], r["node_id"]) for r in df.select("query_id", "node_id").collect()}
    true = pairs(recall.vector_topk_of_each(chunks, asked, 20))
    before = len(true & pairs(index.search_each(asked, 20))) / len(true)
    after = len(true & pairs(index.tuned(asked, 20).search_each(asked, 20))) / len(true)
    print(f"ivf recall {before:.3f} -> {after:.3f}, probes {index.probes}")
    assert len(true) == 250 * 20 and before < 0.9 <= after and index.probes < index.cells


def test_every_20th_vector_is_searched(spark):
    ids = {r[0] for r in queries.every_20th(spark, SF).select("query_id").collect()}
    for name in ("vector_topk_exact", "vector_topk_scoped", "ann_ivf_topk"):
        assert {r["query_id"] for r in queries.queries()[name](spark, SF).collect()} == ids and len(ids) == 25
