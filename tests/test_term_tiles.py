"""Searches by tokens in tiles against comparing all with all, and what their plans hold."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import lexical, term_tiles


def words(text):
    return re.findall(r"[a-z0-9_\-]{3,}", (text or "").lower())


def test_tiles_give_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(term_tiles, "NODES", 50)
    monkeypatch.setattr(term_tiles, "QUERIES", 10)
    rng = random.Random(3)
    vocabulary = [f"w{i:03d}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 30))) for _ in range(200)]
    texts += texts[:100] + [None, "", "w000"]  # copies, so that ties stand at the cut
    types = ["rule", "note", "decision"]
    data = [(i, f"{types[i % 3]}:{i}", types[i % 3], f"2024-01-{i % 7 + 1:02d}" if i % 11 else None, "s", t, ["x"]) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(data, "ord long, id string, type string, ts string, scope string, text string, tags array<string>").cache()
    asked = [(q, texts[q * 3]) for q in range(60)] + [(1000, "w001 w001 w002"), (1001, "w001 w001 w002"), (1002, ""), (1003, None), (1004, "absent")]
    queries = spark.createDataFrame(asked, "query_id long, query string").cache()
    posted, meta = lexical.postings(nodes), lexical.node_meta(nodes)
    held = {d[1]: set(words(" ".join(filter(None, [d[1], d[2], d[4], d[5], "x"])))) for d in data}
    for found, most, weight, bonus, k in ((lexical.lookup_indexed(posted, meta, queries, 5), None, 1, 0, 5), (lexical.heuristic_indexed(posted, meta, queries, 8), 30, 2, 2, 8)):
        expected = []
        for q, text in asked:
            terms = words(text)[:most]
            hits = []
            for _, i, kind, ts, _, own, _ in data:
                at = [p for p, w in enumerate(terms) if w in held[i]]
                if at:
                    hits.append((-(weight * len(at) + (bonus if kind in lexical.BONUS_TYPES else 0)), [-ord(c) for c in ts or ""] + [1], min(at), i, (own or "").strip()))
            expected += [(q, n + 1, h[3], -h[0]) for n, h in enumerate(sorted(hits)[:k]) if bonus or h[4]]
        assert sorted((r["query_id"], r["rank"], r["node_id"], r["score"]) for r in found.collect()) == sorted(expected)
    bags, n = {d[1]: words(d[5]) for d in data}, len(data)
    mean = sum(map(len, bags.values())) / n
    df = Counter(w for b in bags.values() for w in set(b))
    for all_terms in (False, True):
        expected = []
        for q, text in asked:
            hits = []
            for i, bag in bags.items():
                tf = Counter(bag)
                shared = [w for w in dict.fromkeys(words(text)) if tf[w]]
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(bag) / mean)) for w in shared)
                if shared and (not all_terms or len(shared) == len(set(words(text)))):
                    hits.append((-round(score, 6), i))
            expected += [(q, r + 1, h[1], -h[0]) for r, h in enumerate(sorted(hits)[:6])]
        found = lexical.bm25(nodes, queries, 6, all_terms=all_terms)
        assert sorted((r["query_id"], r["rank"], r["node_id"], r["score"]) for r in found.collect()) == sorted(expected)


def test_no_table_of_queries_and_nodes(spark):
    """Queries meet postings in tiles, and equal texts are searched for once."""
    nodes = spark.createDataFrame([(i, f"note:{i}", "note", "t", "s", "one two three", ["x"]) for i in range(300)], "ord long, id string, type string, ts string, scope string, text string, tags array<string>")
    queries = spark.range(200).select(F.col("id").alias("query_id"), F.lit("two three").alias("query"))
    found = lexical.bm25(nodes, queries, 3)
    texts, same = lexical.once(queries)
    assert texts.count() == 1 and same.count() == 200 and found.count() == 600
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
