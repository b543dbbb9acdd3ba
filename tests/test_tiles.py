"""Vector searches in tiles against comparing all with all, and what their plans hold."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import cells, lexical, recall, tiles


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plainly(rows, asked, k):
    both = rows.filter("embedding is not null").crossJoin(asked).withColumn("score", V.cosine(F.col("embedding"), F.col("q")))
    return lexical.top(both, k, F.desc("score"), F.asc("node_id"), F.asc("chunk_id"))


def rows_of(df):
    return sorted(repr((r["query_id"], r["rank"], r["node_id"], r["chunk_id"], r["score"])) for r in df.collect())


def test_tiles_give_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROW_NUMBERS", 8 * 40)
    monkeypatch.setattr(tiles, "QUERY_NUMBERS", 8 * 10)
    rng = random.Random(5)
    # many copies, so that ties stand at the cut; zeros, other lengths, nulls within, numbers that are not finite
    some = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    vectors = [some[i % 30] if i % 3 else [rng.gauss(0, 1) for _ in range(8)] for i in range(300)]
    vectors += [[0.0] * 8, None, [1.0], [None, *[1.0] * 7], [float("nan")] * 8, [float("inf"), *[1.0] * 7], [1e-160] * 8]
    rows = spark.createDataFrame([(f"v{i}", f"c{i % 2}", "p", v) for i, v in enumerate(vectors)], "node_id string, chunk_id string, project_id string, embedding array<double>").cache()
    for keep in ("true", "project_id = 'none'"):
        mine = rows.filter(keep)
        regular = rows.filter("cast(substring(node_id, 2, 9) as int) < 301")
        for asked in (regular, rows.filter("embedding is not null")):
            asked = asked.filter("cast(substring(node_id, 2, 9) as int) % 10 < 7").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
            assert rows_of(recall.vector_topk_of_each(mine, asked, 7)) == rows_of(plainly(mine, asked, 7))
    found = recall.vector_topk_of_each(regular, asked.filter("size(q) = 8 and query_id < 'v29'"), 7)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_nearest_of_many_equal_rows_keeps_the_first():
    x = np.ones((10_000, 4))
    q, r, s = tiles.nearest(x, x[:300], 3)
    assert r.tolist() == [0, 1, 2] * 300 and q.tolist() == [i for i in range(300) for _ in range(3)] and set(s) == {1.0}
    assert all(len(a) == 0 for a in tiles.nearest(x[:0], x[:3], 3)) and all(len(a) == 0 for a in tiles.nearest(x, x[:0], 3))


def test_cells_are_split_in_one_pass(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(f"v{i}", "c", "p", [rng.gauss(0, 1) for _ in range(8)]) for i in range(1200)] + [(f"w{i}", "c", "p", [1.0] * 8) for i in range(90)]
    chunks = spark.createDataFrame(rows, "node_id string, chunk_id string, project_id string, embedding array<float>").cache()
    index = cells.VectorCells(spark, str(tmp_path / "cells"), most=50)
    passes, split = [], cells.VectorCells._split
    monkeypatch.setattr(cells.VectorCells, "_split", lambda self, *a: passes.append(a[0]) or split(self, *a))
    index.apply(chunks.filter("cast(substring(node_id, 2, 9) as int) % 3 = 0"))
    state = index.apply(chunks.filter("cast(substring(node_id, 2, 9) as int) % 3 > 0"))
    assert len(passes) <= 2 and isinstance(passes[-1], list) and len(passes[-1]) > 5 and index.rows(state["cells"]).count() == len(rows)
    asked = chunks.filter("node_id like 'v%7' or node_id = 'w1'").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    found = index.search(asked, 5, probes=10_000)
    assert rows_of(found) == rows_of(plainly(chunks, asked, 5)) and "NestedLoop" not in plan_of(found)
    some = {tuple(r) for r in index.search(asked, 5, probes=len(state["cells"]) // 2).select("query_id", "node_id").collect()}
    assert len(some & {(r["query_id"], r["node_id"]) for r in found.collect()}) >= 0.8 * 5 * asked.count()
