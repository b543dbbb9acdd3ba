"""Searches over segments meet their queries in tiles, and each text once."""

from test_retrieval import ledger

from tidemark.operators import lexical, segments


def test_tiles_and_equal_texts(spark, tmp_path):
    texts = ["alpha beta alpha", "beta gamma", "alpha gamma gamma", "delta", None]
    nodes = ledger(spark, [{"id": f"n{i}", "type": "note", "scope": "s", "text": t, "ord": i} for i, t in enumerate(texts)])
    index = segments.TextSegments(spark, str(tmp_path / "fts"))
    index.apply(nodes)
    asked = spark.createDataFrame([(0, "alpha gamma"), (1, "alpha gamma"), (2, "beta beta note")], "query_id long, query string")
    for found, plain in ((index.lookup(asked, 3), lexical.lookup_indexed(lexical.postings(nodes), lexical.node_meta(nodes), asked, 3)), (index.bm25(asked, 3), lexical.bm25(nodes, asked, 3))):
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
