"""The stored full-text index: equal to the plain operators after adds, updates, deletes and merges; blocks skipped; merges read their segments only."""

import random

import pytest
from pyspark.sql import functions as F
from test_retrieval import ledger

from tidemark.operators import lexical, segments


def made(spark, rng, ids, ord_start, size=12):
    words = ["alpha", "beta", "gamma", "delta", "token", "index", *[f"rare{i}" for i in range(40)]]
    rows = []
    for n, i in enumerate(ids):
        text = " ".join(rng.choices(words, weights=[30, 20, 10, 5, 5, 5, *[1] * 40], k=rng.randrange(0, size)))
        rows.append({"id": f"note:{i}", "type": "note", "scope": "s", "text": text if i % 9 else None, "tags": [f"tag{i % 3}"], "ord": ord_start + n, "ts": f"2026-01-{1 + i % 28:02d}"})
    return ledger(spark, rows)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "alpha rare1"), (1, "gamma tag1 note"), (2, "beta beta delta rare7"), (3, "nothing here"), (4, "")], "query_id long, query string")


def test_deltas_and_merges(spark, tmp_path, asked):
    rng = random.Random(3)
    index = segments.TextSegments(spark, str(tmp_path / "fts"), fanout=3)
    live = {}
    for step in range(5):
        ids = rng.sample(range(80), 25)
        batch = made(spark, rng, ids, 100 * step)
        gone = [f"note:{i}" for i in rng.sample(range(80), 8) if i not in ids]
        index.apply(batch, spark.createDataFrame([(g,) for g in gone], "node_id string"))
        for g in gone:
            live.pop(g, None)
        live |= {r["id"]: r for r in batch.collect()}
        state = index.merge() if step != 3 else index.state
        nodes = spark.createDataFrame(list(live.values()), batch.schema)
        assert state["docs"] == len(live)
        if step in (3, 4):
            assert rows_of(index.lookup(asked, 5)) == rows_of(lexical.lookup_indexed(lexical.postings(nodes), lexical.node_meta(nodes), asked, 5))
            for all_terms in (False, True):
                assert rows_of(index.bm25(asked, 5, all_terms)) == rows_of(lexical.bm25(nodes, asked, 5, all_terms=all_terms))
    assert max(x["tier"] for x in index.state["segments"].values()) >= 1 and len(index.state["segments"]) < 5


def test_merge_reads_its_segments_only(spark, tmp_path, asked):
    rng = random.Random(4)
    index = segments.TextSegments(spark, str(tmp_path / "fts"), fanout=2)
    for step in range(2):
        index.apply(made(spark, rng, range(20 * step, 20 * step + 20), 100 * step))
    state = index.merge()
    (big,) = state["segments"]
    index.pointer.move({**state, "segments": {big: {**state["segments"][big], "tier": 9}}})
    for step in range(2):
        index.apply(made(spark, rng, range(30 + 20 * step, 50 + 20 * step), 200 + 100 * step))
    before = rows_of(index.bm25(asked, 5))
    hidden = tmp_path / f"fts/docs/segment={big}"
    hidden.rename(tmp_path / "away")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        index.bm25(asked, 5).collect()
    state = index.merge()
    (tmp_path / "away").rename(hidden)
    assert sorted(x["tier"] for x in state["segments"].values()) == [1, 9] and rows_of(index.bm25(asked, 5)) == before


def test_blocks_are_skipped(spark, tmp_path):
    """A frequent token in thousands of nodes: all but its first blocks stay unread."""
    texts = [("common " * (1 + (i % 11 == 0))) + " ".join(f"w{i}x{j}" for j in range(3 + i % 17)) for i in range(3000)]
    nodes = ledger(spark, [{"id": f"n{i}", "type": "note", "scope": "s", "text": t, "ord": i} for i, t in enumerate(texts)])
    index = segments.TextSegments(spark, str(tmp_path / "fts"))
    index.apply(nodes)
    asked = spark.createDataFrame([(0, "common"), (1, "common w5x1")], "query_id long, query string")
    assert rows_of(index.bm25(asked, 10)) == rows_of(lexical.bm25(nodes, asked, 10))
    plan = {(r["query_id"], r["read"]): r["count"] for r in index.planned(asked, 10).groupBy("query_id", "read").count().collect()}
    assert plan[0, True] <= 8 and plan[0, False] >= 16, plan
    one = index.planned(asked, 1).filter("query_id = 1 and read")
    assert {r["token"] for r in one.collect()} == {"w5x1"}


def test_pieces_and_empty(spark, tmp_path, monkeypatch, asked):
    monkeypatch.setattr(segments, "PIECE", 30)
    monkeypatch.setattr(segments, "BLOCK", 4)
    nodes = made(spark, random.Random(5), range(100), 0)
    index = segments.TextSegments(spark, str(tmp_path / "fts"))
    assert index.bm25(asked, 5).collect() == [] and index.lookup(asked, 5).collect() == []
    index.apply(nodes)
    assert index._blocks(index.state["segments"]).agg(F.count_distinct("piece")).first()[0] == 4
    assert rows_of(index.bm25(asked, 5)) == rows_of(lexical.bm25(nodes, asked, 5))
    index.apply(nodes.limit(0), nodes.select(F.col("id").alias("node_id")))
    assert index.state["docs"] == 0 and index.bm25(asked, 5).collect() == []
