"""Behaviour of retrieval: the labelled fixture, scope boundaries, budgets, vectors."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import context, evaluate, lexical, recall
from tidemark.plans.store import LEDGER, MemoryStore

FACTS = [
    ("decision:auth", "decision", "Browser clients use OAuth2 PKCE for authentication"),
    ("decision:cache", "decision", "The cache expires entries after fifteen minutes"),
    ("incident:quota", "incident", "API requests failed after exceeding the hourly quota"),
    ("rule:backup", "rule", "Encrypted backups run every night at midnight"),
    ("note:schema", "note", "Database migrations require a reviewed rollback script"),
    ("decision:logs", "decision", "Application logs redact access tokens before storage"),
    ("note:alerts", "note", "Latency alerts trigger above five hundred milliseconds"),
    ("rule:review", "rule", "Infrastructure changes need peer review before deployment"),
    ("note:queue", "note", "The worker queue retries transient jobs three times"),
    ("decision:region", "decision", "Customer records remain in the selected data region"),
    ("incident:cert", "incident", "Certificate rotation failed because the service account lacked permission"),
    ("rule:tests", "rule", "Release builds require unit and integration tests"),
]
QUERIES = [("OAuth2 PKCE", 0), ("encrypted backups", 3), ("redact access tokens", 5), ("peer review deployment", 7), ("transient jobs retries", 8), ("selected data region", 9), ("service account permission", 10), ("unit integration tests", 11)]


def ledger(spark, rows):
    """Rows of (id, type, scope, text, ...) as dicts over the ledger's columns."""
    names = [f.split()[0] for f in LEDGER.split(", ")]
    return spark.createDataFrame([tuple({"ord": i, "ts": f"2026-01-{i % 28 + 1:02d}T09:00:00Z", "tags": [], "links": [], "supersedes": [], "priority": 0, **r}.get(c) for c in names) for i, r in enumerate(rows)], LEDGER)


@pytest.fixture(scope="module")
def facts(spark):
    return ledger(spark, [{"id": i, "type": t, "scope": "bench", "text": x} for i, t, x in FACTS]).cache()


def test_labelled_queries_rank_first(spark, facts):
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUERIES)], "query_id long, query string")
    truth = spark.createDataFrame([(i, FACTS[j][2]) for i, (_, j) in enumerate(QUERIES)], "query_id long, expected_text string")
    hits = lexical.lookup_indexed(lexical.postings(facts), lexical.node_meta(facts), queries, 3)
    assert evaluate.retrieval_metrics(hits, truth).first()[1:] == (1.0, 1.0)
    for q, j in QUERIES:
        assert lexical.lookup_scan(facts, q, 3).first()["text"] == FACTS[j][2]


def test_percentile_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(float(x),) for x in range(12)], "x double")
    assert evaluate.nearest_rank(df, "x", 0.95).first()[0] == 10.0
    assert evaluate.nearest_rank(df, "x", 0.5).first()[0] == float(round(5.5))
    assert evaluate.nearest_rank(df.limit(0), "x", 0.5).count() == 0


HITS = [("foreign", "beta", None), ("unknown", None, None), ("local", "alpha", "fixture.jsonl"), ("unattributed", "beta", None), ("sourced", None, "fixture.jsonl")]


def test_filter_fails_closed(spark):
    hits = spark.createDataFrame([(*h, None, None) for h in HITS], "node_id string, project_id string, source_path string, session_id string, entity_id string")
    ids = lambda df: sorted(r["node_id"] for r in df.collect())
    assert ids(recall.filtered(hits, "alpha")) == ["local"]
    assert ids(recall.filtered(hits, None, strict_provenance=True)) == ["local", "sourced"]


def test_filter_precedes_cut_and_scopes_do_not_leak(spark):
    rows = [{"id": "rule:a", "type": "rule", "scope": "beta", "text": "MARKER local fact"}, {"id": "note:b", "type": "note", "scope": "alpha", "text": "MARKER local fact"}]
    nodes = ledger(spark, rows)
    assert [r["node_id"] for r in recall.heuristic(nodes, "marker local", "alpha", 1).collect()] == ["note:b"]
    assert {r["node_id"] for r in recall.heuristic(nodes, "marker local", None).collect()} == {"rule:a", "note:b"}


def test_first_route_with_hits_wins(spark):
    nodes = ledger(spark, [{"id": "note:b", "type": "note", "scope": "alpha", "text": "MARKER"}])
    hits = recall.hits_of(lexical.heuristic_scan(nodes, "marker", None), "scan")
    stale = recall.filtered(hits, "alpha", session_id="s1")
    assert [r["method"] for r in recall.cascade([lambda: stale, lambda: hits.withColumn("method", F.lit("second")), lambda: 1 / 0]).collect()] == ["second"]
    assert recall.external(spark).count() == 0
    assert [r["node_id"] for r in recall.external(spark, lambda q, k: [{"node_id": "x", "score": 0.5, "text": "t"}, {"node_id": "y", "score": 0.1}]).collect()] == ["x"]


CASES = {
    "single": ([("old", "a", []), ("new", "a", ["old"])], {"new"}),
    "chain and list": ([("old", "a", []), ("middle", "a", ["old"]), ("new", "a", ["middle"])], {"new"}),
    "foreign": ([("old", "a", []), ("foreign", "b", ["old"]), ("reference", "a", [])], {"old", "foreign", "reference"}),
    "two in a cycle": ([("one", "a", ["two"]), ("two", "a", ["one"])], {"one", "two"}),
    "cycle and outsider": ([("one", "a", ["two"]), ("two", "a", ["one"]), ("new", "a", ["one"])], {"one", "two", "new"}),
    "self": ([("one", "a", ["one"])], {"one"}),
    "dangling": ([("new", "a", ["ghost"])], {"new"}),
    "none": ([("new", "a", [])], {"new"}),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_supersession(spark, case):
    rows, expected = CASES[case]
    nodes = ledger(spark, [{"id": i, "type": "decision", "scope": s, "text": i, "supersedes": t} for i, s, t in rows])
    assert {r["id"] for r in context.active(nodes).collect()} == expected


def test_supersession_of_random_graphs(spark):
    rng = random.Random(5)
    rows, expected = [], set()
    for g in range(40):
        names = [f"n{i}" for i in range(6)]
        edges = {n: [m for m in names if rng.random() < 0.2] for n in names}

        def reach(a, edges=edges):
            seen, todo = set(), list(edges[a])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += edges[x]
            return seen

        loops = {n for n in names if n in reach(n)}
        gone = {m for n in names for m in edges[n]} - loops
        expected |= {(f"g{g}", n) for n in names if n not in gone}
        rows += [{"id": n, "type": "note", "scope": f"g{g}", "text": n, "supersedes": edges[n]} for n in names]
    assert {(r["scope"], r["id"]) for r in context.active(ledger(spark, rows)).collect()} == expected


def test_budget_is_the_longest_prefix(spark):
    rng = random.Random(2)
    rows = [{"id": f"rule:{i:02d}", "type": "rule", "scope": "global", "text": "x" * rng.randint(1, 90), "priority": rng.randint(0, 5), "tags": ["ops"]} for i in range(40)]
    for chars in (0, 60, 400, 900):
        left, used = [], 0
        for r in sorted(rows, key=lambda r: (-r["priority"], r["id"])):
            bullet = f"- ({r['id']}) {r['text']}"
            if used + len(bullet) + 1 > chars:
                break
            used += len(bullet) + 1
            left.append(r["id"])
        assert [r["id"] for r in context.within_budget(ledger(spark, rows), chars).orderBy("rank").collect()] == left
    text = context.policy_document(ledger(spark, rows), 900).first()["text"]
    assert text.startswith("# Policy Core") and len(text) <= 900
    picked = context.triggered_rules(ledger(spark, rows), "restart the gateway", None, 3).collect()
    assert len(picked) == 3
    assert context.context_markdown(ledger(spark, rows[:1])).first()["line"].startswith("- [rule] rule:00: x")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, -0.5],), ([0.0, 0.0, 0.0],)], "v array<float>")
    df = df.select("v", V.quantize(F.col("v")).alias("q"), V.to_int8_blob("v").alias("b"), V.unit(F.col("v")).alias("u"))
    one, zero = df.select("q", "b", "u", V.from_int8_blob("b").alias("back")).collect()
    assert one["q"] == [127, 0, -64] and zero["q"] == [0, 0, 0]
    assert one["b"][4:] == bytes([255, 128, 64]) and all(math.isclose(a, b, abs_tol=0.01) for a, b in zip(one["back"], [1.0, 0.0, -0.5], strict=True))
    assert math.isclose(sum(x * x for x in one["u"]), 1.0) and V.storage_ratio(96) == 100 / 384
    with pytest.raises(ValueError):
        V.embedder("nothing")
    assert V.embedder("hash") is V.hash_embedding


def test_small_and_large_vector_indexes(spark):
    rng = random.Random(1)
    rows = [(f"v{i}", "c000", f"p{i % 3}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "node_id string, chunk_id string, project_id string, embedding array<double>")
    exact = [r["node_id"] for r in recall.vector_topk(chunks, rows[7][3], 10).collect()]
    near = [r["node_id"] for r in recall.IvfIndex(chunks).search(rows[7][3], 10).collect()]
    assert exact[0] == near[0] == "v7" and len(set(exact) & set(near)) >= 9
    assert {r["project_id"] for r in recall.IvfIndex(chunks).search(rows[7][3], 10, "p1").collect()} == {"p1"}
    assert recall.IvfIndex(chunks.limit(50)).cells == 1


def test_time(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-15T09:00:00+09:00",), ("soon",), (None,)], "ts string")
    now = F.to_timestamp(F.lit("2026-01-15T00:00:00+00:00"))
    got = [r[0] for r in df.select(C.temporal_decay(F.lit(1.0), F.col("ts"), now)).collect()]
    assert math.isclose(got[0], 0.5 + 0.5 * math.exp(-0.693)) and got[1:] == [1.0, 1.0, 1.0]
    days = [r[0] for r in df.select(C.recency(F.col("ts"), F.to_date(F.lit("2026-01-11")))).collect()]
    assert days == [4.0, 5.4, 0.0, 0.0]


def test_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "alpha"), "alpha", clock=lambda: "2026-02-01T00:00:00+00:00")
    assert store.jot("token refresh is 15 minutes")["status"] == "write"
    assert store.jot("token refresh is 15 minutes ")["status"] == "SKIP_DUPLICATE_FACT"
    batch = store.jot_batch(["api uses jwt auth", "rate limit is 100/min", "api uses jwt auth"])
    assert [r["status"] for r in batch] == ["write", "write", "SKIP_DUPLICATE_FACT"] and batch[2]["id"] == "jot:alpha-dup"
    assert store.lookup("jwt auth") == ["api uses jwt auth"] == store.lookup("jwt auth", index=False)
    assert [r["text"] for r in store.working_set(2)] == ["rate limit is 100/min", "api uses jwt auth"]
    with pytest.raises(ValueError):
        store.add_node(node_id="decision:x", node_type="decision", text="x", tags=["unheard-of"])
    assert store.add_node(node_id="decision:x", node_type="decision", text="use parquet", tags=["decision"])["status"] == "write"
    assert store.add_node(node_id="decision:x", node_type="note", text="other", tags=["decision"])["status"] == "SKIP_DUPLICATE_ID"
    assert store.add_node(node_id="decision:y", node_type="decision", text=" use parquet ", tags=["decision"])["status"] == "SKIP_DUPLICATE_FACT"
    assert [r["node_id"] for r in store.recall("parquet")][0] == "decision:x"
    assert store.query(scope="alpha", node_type="decision").count() == 1
    assert [r["id"] for r in store.context("2026-02-02")] == ["decision:x"]
    assert "extra" in store.add_tag("extra") and "extra" in MemoryStore(spark, str(tmp_path / "alpha"), "alpha").tags


def test_store_ids_feed_and_indexes(spark, tmp_path):
    at = "2026-02-01T00:00:00+00:00"
    store = MemoryStore(spark, str(tmp_path / "beta"), "beta", clock=lambda: at)
    digest = lambda s: "jot:beta-" + hashlib.sha256(s.encode()).hexdigest()[:8]
    assert store.jot("a note alone")["id"] == digest(f"{at}:a note alone")
    assert store.jot_batch(["in a batch"])[0]["id"] == digest(f"{at}:0:in a batch")
    store.add_node(node_id="decision:p", node_type="decision", text="use parquet for tables", tags=["decision"])
    assert [(r["op"], r["node_id"]) for r in store.feed().collect()] == [("add", "decision:p")]
    store.index()
    store.add_node(node_id="decision:q", node_type="decision", text="use parquet for logs", tags=["decision"])
    again = MemoryStore(spark, str(tmp_path / "beta"), "beta", clock=lambda: at)
    assert sorted(again.lookup("parquet")) == ["use parquet for logs", "use parquet for tables"]
    hit = again.recall("parquet tables")[0]
    assert (hit["node_id"], hit["method"]) == ("decision:p", "hybrid")
    # nothing of the scope in the chunks: the scan answers
    assert again.recall("parquet", scope="gamma") == [] and again.recall("logs")[0]["method"] == "ledger_scan"
    found = again.recall("x", scope=None, search=lambda q, n: [{"file": "out/rule_no_pushing.md", "score": 0.9, "text": "---\nid: x\n---\nbody"}, {"node_id": "low", "score": 0.1}])
    assert [(r["node_id"], r["preview"], r["method"]) for r in found] == [("rule:no-pushing", "body", "external")]
    assert again.recall("parquet", scope=None, search=lambda q, n: 1 / 0)[0]["method"] != "external"
    assert again.routing().filter("kind = 'node'").count() == 4


def test_output_of_a_program_is_read_leniently():
    assert recall.json_after_noise('warn {x\n{"results": [{"score": 1}, 3]} tail') == [{"score": 1}]
    assert recall.json_after_noise("[]") == [] and recall.json_after_noise("nothing") == [] and recall.json_after_noise('x [{"a": 1}]') == [{"a": 1}]
    assert recall.command(["sh", "-c", "echo noise; echo '[{\"node_id\": \"a\", \"score\": 1}]'"])("q", 3) == [{"node_id": "a", "score": 1}]


def test_filter_precedes_the_cut(spark):
    """A hit of the asked scope is found however many of other scopes score higher."""
    rows = [{"id": f"rule:{i}", "type": "rule", "scope": "other", "text": "needle needle"} for i in range(30)] + [{"id": "note:mine", "type": "note", "scope": "mine", "text": "a needle"}]
    assert [r["node_id"] for r in recall.heuristic(ledger(spark, rows), "needle", "mine", 3).collect()] == ["note:mine"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.slug(F.lit("  We decided: Über alles! "))) == "we-decided-ber-alles"
    assert one(X.slug(F.lit("!!"), default="excerpt")) == "excerpt"
    assert one(X.clip(F.lit("a  b\n" + "c" * 20), 10)) == "a b ccc..."
    assert one(X.id_of_filename(F.lit("rule_no_pushing.md"))) == "rule:no-pushing"
    assert one(X.without_front_matter(F.lit("---\nid: x\n---\nbody"))) == "body"
    assert one(X.redact(F.lit('Authorization: Bearer abc.def api_key="zzz" sk-ABCDEFGHIJKLMNOPQRST'))) == 'Authorization: Bearer ***REDACTED*** api_key="***REDACTED***" sk-***REDACTED***'
    assert one(X.phrase_count(F.lit("aaaa"), F.lit("aa"))) == 2 and one(X.phrase_count(F.lit("aaaa"), F.lit(""))) == 0
    assert one(X.tag_list(F.array(F.lit("a, b"), F.lit(""), F.lit("c")))) == ["a", "b", "c"]
    assert one(X.bigrams(X.topic_tokens(F.lit("memory the with quick brown foxes"), ["memory"]))) == ["quick brown", "brown foxes"]
    assert one(C.policy_categories(F.lit("nothing here"))) == ["none"]


def test_percentiles_order_few_values(spark):
    """Only the distinct values near the place stand in one order, of any distribution."""
    rows = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("x"))
    values = sorted(r[0] for r in rows.collect())
    skewed = rows.select(F.when(F.col("x") < 9e8, 1.0).otherwise(F.col("x")).alias("x"))
    for fraction in (0.0, 0.5, 0.95, 1.0):
        place = round(19_999 * fraction)
        found = evaluate.nearest_rank(rows, "x", fraction)
        assert [r[0] for r in found.collect()] == [values[place]]
        assert [r[0] for r in evaluate.nearest_rank(skewed, "x", fraction).collect()] == [1.0 if values[place] < 9e8 else values[place]]
    assert "between" in found._jdf.queryExecution().analyzed().toString() or "<=" in found._jdf.queryExecution().analyzed().toString()
