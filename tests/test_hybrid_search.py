"""The lexical half of the hybrid search."""

from tidemark.operators import recall
from tidemark.plans import queries
from tidemark.sources import adapters

SF = "/root/testdata/sf0.001"


def test_boost_goes_to_keyword_hits(spark):
    texts = {f"vec:{r['ord']}": r["text"].lower() for r in adapters.nodes(spark, SF).collect()}
    words = queries.HYBRID_QUERY.split()
    asked = queries.every_20th(spark, SF).drop("query")
    near = {(r["query_id"], r["node_id"]): r["score"] for r in recall.vector_topk_of_each(adapters.chunk_vectors(spark, SF), asked, 20).collect()}
    boosted = 0
    for r in queries.hybrid_rerank_global(spark, SF).collect():
        gain = r["score"] - near.get((r["query_id"], r["node_id"]), 0.0) + (0.2 if int(r["node_id"][4:]) % 4 == 0 else 0.0)
        assert gain < 1e-6 or all(w in texts[r["node_id"]] for w in words)
        boosted += gain > 0.04
    assert boosted > 0
