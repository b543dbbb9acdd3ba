"""The stored vector index: exact where all cells are probed, recall after deltas, untouched cells left alone, cells split."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, recall

SCHEMA = "node_id string, chunk_id string, project_id string, embedding array<float>"


def vectors(rng, ids, dim=12):
    out = []
    for i in ids:
        centre = random.Random(i % 12)
        out.append((f"v{i}", "c000", f"p{i % 3}", [centre.gauss(0, 1) + 0.5 * rng.gauss(0, 1) for _ in range(dim)]))
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["node_id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """An index after an addition, an update with deletions and one more addition; with the rows that should be there."""
    rng = random.Random(2)
    at = cells.VectorCells(spark, str(tmp_path_factory.mktemp("cells")), most=120, probes=6)
    live = {r[0]: r for r in vectors(rng, range(600))}
    at.apply(spark.createDataFrame(list(live.values()), SCHEMA))
    first = at.state
    # changes within one cluster only
    few = [i for i in range(600) if i % 12 == 5]
    changed = {r[0]: r for r in vectors(rng, few[:10])}
    gone = [f"v{i}" for i in few[10:20]]
    at.apply(spark.createDataFrame(list(changed.values()), SCHEMA), spark.createDataFrame([(g,) for g in gone], "node_id string"))
    second = at.state
    live |= changed
    for g in gone:
        del live[g]
    more = {r[0]: r for r in vectors(rng, range(1000, 1400))}
    live |= more
    at.apply(spark.createDataFrame([*more.values(), ("none", "c000", "p0", None)], SCHEMA))
    return at, first, second, spark.createDataFrame(list(live.values()), SCHEMA), live


def test_only_cells_concerned_are_written(index):
    _, first, second, _, _ = index
    same = [c for c in first["cells"] if second["cells"].get(c) == first["cells"][c]]
    assert len(first["cells"]) >= 6 and len(same) >= len(first["cells"]) // 2
    assert sum(x["n"] for x in second["cells"].values()) == 590


def test_rows_after_deltas_and_splits(index):
    at, _, second, _, live = index
    state = at.state
    assert sorted(r["node_id"] for r in at.rows(state["cells"]).collect()) == sorted(live)
    assert state["split"] and max(x["n"] for x in state["cells"].values()) <= 2 * at.most
    # a node of a cell that was split since is still found and taken out
    at.apply(None, at.spark.createDataFrame([("v0",), ("v1",)], "node_id string"))
    assert not {"v0", "v1"} & {r["node_id"] for r in at.rows(at.state["cells"]).collect()}
    at.apply(at.spark.createDataFrame([live["v0"], live["v1"]], SCHEMA))
    assert at.rows(at.state["cells"]).count() == len(live)


def test_exact_and_recall(index, spark):
    at, _, _, chunks, _ = index
    asked = chunks.filter(F.substring("node_id", 2, 9).cast("int") % 20 == 0).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    true = found(recall.vector_topk_of_each(chunks, asked, 10))
    assert found(at.search(asked, 10, probes=10_000)) == true
    assert found(at.search(asked, 10, probes=10_000, scope="p1")) == found(recall.vector_topk_of_each(chunks, asked, 10, "p1"))
    some = {(q, n) for q, _, n, _ in found(at.search(asked, 10))}
    assert len(some & {(q, n) for q, _, n, _ in true}) / len(true) >= 0.9 and len(at.state["cells"]) > at.probes


def test_bounds_leave_little(index, spark):
    at, _, _, chunks, _ = index
    asked = chunks.limit(3).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = at.rows(at.state["cells"]).drop("embedding").crossJoin(asked)
    assert cells.bounded_topk(pairs, 10).count() < 0.1 * pairs.count()


def test_odd_vectors(spark, tmp_path):
    at = cells.VectorCells(spark, str(tmp_path / "odd"))
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "query_id long, q array<double>")
    assert at.apply() == at.state and at.apply(spark.createDataFrame([("a", "c", "p", None)], SCHEMA))["cells"] == {}
    rows = spark.createDataFrame([("a", "c", "p", [0.0, 0.0]), ("b", "c", "p", [1.0, 2.0]), ("b", "d", "p", [1.0, 2.0]), ("e", "c", None, [-1e-12, 3e5])], SCHEMA)
    at.apply(rows)
    assert found(at.search(asked, 3)) == found(recall.vector_topk_of_each(rows, asked, 3))
    at.apply(None, rows.select("node_id"))
    assert at.search(asked, 3).count() == 0
    at.apply(rows)
    assert found(at.search(asked, 3)) == found(recall.vector_topk_of_each(rows, asked, 3))
