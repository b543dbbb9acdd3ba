"""Ranks of expected nodes, dealt by rare tokens, against the lookup of all nodes."""

import random

from pyspark.sql import functions as F

from tidemark.operators import lexical, term_tiles
from tidemark.plans import queries

NODES = "ord long, id string, type string, ts string, scope string, text string, tags array<string>"


def ledger(n=300):
    rng = random.Random(7)
    vocabulary = [f"w{i:03d}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 25))) for _ in range(n - 103)]
    texts += [*texts[:100], None, "", "  \t"]
    rows = [(i, f"note:{i}", "note", f"2024-01-{i % 7 + 1:02d}" if i % 11 else None, "s", t, ["x"]) for i, t in enumerate(texts)]
    return rows + [(n, "note:5", "rule", "2025-01-01", "s", "w001 twice", None), (n + 1, None, "rule", None, "s", "w001", None)]


def test_as_the_lookup_of_all(spark, monkeypatch):
    for name, most in (("SHARED", 40), ("NODES", 80), ("QUERIES", 30)):
        monkeypatch.setattr(term_tiles, name, most)
    rows = ledger()
    nodes = spark.createDataFrame(rows, NODES).cache()
    rng, texts = random.Random(8), [r[5] for r in rows]
    # whole texts, texts with words that the expected node lacks, the same text for two nodes, nodes that there are not
    asked = [(q, texts[q * 4], f"note:{q * 4}") for q in range(74)]
    asked += [(100 + q, f"{texts[q * 3] or ''} w00{q % 9} w001 other note", f"note:{q * 3 + q % 2}") for q in range(60)]
    asked += [(200, "w001 w001 w002", "note:1"), (201, "w001 w001 w002", "note:2"), (202, "w001", "none"), (203, "nothing", "note:3"), (204, None, "note:4"), (205, "note", rng.choice(rows[:200])[1])]
    asked = spark.createDataFrame(asked, "query_id long, query string, expected string").cache()
    whole = lexical.lookup_indexed(lexical.postings(nodes), lexical.node_meta(nodes), asked.select("query_id", "query"), 3)
    right = whole.join(asked, "query_id").filter(F.col("node_id") == F.col("expected")).select("query_id", "rank", "node_id")
    told = sorted(tuple(r) for r in right.collect())
    for few, rare in ((lexical.MOST_DEALT, lexical.RARE), (0, 1_000), (lexical.MOST_DEALT, 20), (0, 0)):
        monkeypatch.setattr(lexical, "MOST_DEALT", few)
        monkeypatch.setattr(lexical, "RARE", rare)
        assert sorted(tuple(r) for r in lexical.expected_hits(nodes, asked, 3).collect()) == told
    assert 60 < len(told) < 130
    unique = nodes.filter("ord < 300")
    whole = lexical.lookup_indexed(lexical.postings(unique), lexical.node_meta(unique), asked.select("query_id", "query"), 3)
    right = whole.join(asked, "query_id").filter(F.col("node_id") == F.col("expected")).select("query_id", "rank", "node_id")
    assert sorted(tuple(r) for r in lexical.expected_hits(unique, asked, 3).collect()) == sorted(tuple(r) for r in right.collect())


def test_nodes_are_sent_for_rare_tokens_only(spark, monkeypatch):
    """Twice the nodes and queries: what tiles are sent doubles; by groups of queries and pieces of nodes it was four times."""
    sent, tile = [], term_tiles.met
    monkeypatch.setattr(term_tiles, "QUERIES", 10)
    monkeypatch.setattr(term_tiles, "met", lambda nodes, *rest: (sent.append(nodes.agg(F.sum("_groups")).first()[0]), tile(nodes, *rest))[1])
    monkeypatch.setattr(term_tiles, "tiled", lambda *_: 1 / 0)
    monkeypatch.setattr(queries.adapters, "nodes", lambda spark, sf: spark.createDataFrame([(i, f"note:{i}", "note", "t", "s", f"common words here rare{i}", ["x"]) for i in range(sf)], NODES))
    for n in (400, 800):
        assert tuple(queries.queries()["retrieval_metrics"](spark, n).first()) == (n // 20, 1.0, 1.0)
    assert sent == [20, 40]
