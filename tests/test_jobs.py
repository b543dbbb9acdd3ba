"""Jobs made of the operators."""

import os
import time

from pyspark.sql import functions as F
from test_retrieval import ledger
from test_sessions_and_ingest import rows_of

from tidemark.functions import vectors as V
from tidemark.operators import sessions
from tidemark.plans import jobs
from tidemark.plans.store import MemoryStore

NODES = [{"id": "rule:a", "type": "rule", "scope": "alpha", "text": "alpha marker", "tags": ["ops"]}, {"id": "note:b", "type": "note", "scope": "beta", "text": "beta marker"}]


def test_indexes_in_full_and_from_the_feed(spark, tmp_path):
    nodes = ledger(spark, NODES)
    paths = jobs.index_full(nodes, str(tmp_path))
    chunks = spark.read.parquet(paths["chunks"])
    assert {r["project_id"] for r in chunks.collect()} == {"alpha", "beta"}
    one = chunks.filter("node_id = 'rule:a'").select("embedding", V.from_int8_blob("embedding_int8").alias("back")).first()
    assert len(one["embedding"]) == 96 and max(abs(a - b) for a, b in zip(one["embedding"], one["back"], strict=True)) < 0.01
    assert spark.read.parquet(paths["postings"]).filter("token = 'marker'").count() == 2
    feed = spark.createDataFrame([(1, "add", "note:c", "fresh", "t"), (2, "delete", "note:b", None, "t"), (3, "add", "rule:a", "", "t")], "ord long, op string, node_id string, text string, ts string")
    after = {r["node_id"]: (r["text"], r["project_id"]) for r in jobs.index_fast(feed, nodes, chunks).collect()}
    assert after == {"note:c": ("fresh", "global"), "rule:a": ("alpha marker", "alpha")}


def test_checkpoint_skips_unchanged_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role":"user","text":"hello"}\n')
    none = spark.createDataFrame([], "path string, size long, modified timestamp")
    made, status = jobs.checkpoint(spark, str(tmp_path), none)
    assert "**user**: hello" in made.first()["text"]
    kept = spark.createDataFrame(status.collect(), status.schema)
    assert jobs.checkpoint(spark, str(tmp_path), kept)[0].count() == 0
    (tmp_path / "a.jsonl").write_text('{"role":"user","text":"hello again"}\n')
    os.utime(tmp_path / "a.jsonl", (time.time() + 5, time.time() + 5))
    assert jobs.checkpoint(spark, str(tmp_path), kept)[0].count() == 1


def test_checkpoints_keep_their_status(spark, tmp_path):
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    for r in roots:
        os.mkdir(r)
    (tmp_path / "a/one.jsonl").write_text('{"role":"user","text":"hello"}\n')
    (tmp_path / "b/two.jsonl").write_text('{"role":"user","text":"there"}\n')
    store = str(tmp_path / "store")
    assert spark.read.parquet(jobs.checkpoint_to(spark, roots, store, "2026-01-01")).count() == 2
    assert spark.read.parquet(jobs.checkpoint_to(spark, roots, store, "2026-01-02")).count() == 0
    (tmp_path / "b/two.jsonl").write_text('{"role":"user","text":"there again"}\n')
    assert spark.read.parquet(jobs.checkpoint_to(spark, roots, store, "2026-01-03")).count() == 1


def test_candidates_are_promoted_once(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "p"), "p", clock=lambda: "2026-01-01T00:00:00+00:00")
    rows = spark.createDataFrame(list(enumerate(["rule: always test", "we decided on X"])), "ord long, line string")
    found = sessions.promotion_candidates(rows, "p")
    assert [r["status"] for r in jobs.promote(store, found)] == ["write", "write"]
    assert [r["status"] for r in jobs.promote(store, found)] == ["SKIP_DUPLICATE_ID"] * 2
    jobs.report(spark, str(tmp_path / "reports"), "promote", {"written": 2}, "now")
    jobs.report(spark, str(tmp_path / "reports"), "promote", {"written": 0}, "later")
    assert spark.read.json(str(tmp_path / "reports")).count() == 2


def test_excerpts_are_written_once(spark):
    window = spark.createDataFrame([("s1", 0, "user", "one"), ("s1", 1, "assistant", "two")], "session string, ord long, role string, text string")
    none = spark.createDataFrame([], "hash string")
    now = F.to_timestamp(F.lit("2026-01-01T00:00:00+00:00"))
    made = jobs.excerpt_nodes(window, none, "alpha", now)
    first = made.first()
    assert first["id"] == "excerpt:s1" and first["expires_at"].startswith("2026-01-31") and first["text"] == "### user\n\none\n\n---\n\n### assistant\n\ntwo"
    assert jobs.excerpt_nodes(window, made.select("hash"), "alpha", now).count() == 0
    assert jobs.excerpt_nodes(window, none, "alpha", now, pinned=True).first()["expires_at"] is None


def test_documents(spark):
    rows = spark.createDataFrame(list(enumerate(["rule: always test", "we decided on X"])), "ord long, line string")
    text = jobs.proposal(sessions.promotion_candidates(rows), "s.md", "now").first()["text"]
    assert text.index("decision:we-decided-on-x") < text.index("rule:rule-always-test")
    assert "Nothing to promote" in jobs.proposal(sessions.promotion_candidates(rows.limit(0)), "s.md", "now").first()["text"]
    doc = jobs.working_set_document(rows_of(spark, ["- Hard rule: be brief"]), rows_of(spark, ["- (rule:a) x"]), rows_of(spark, ["x" * 300]), {"blockers": [{"type": "ci", "detail": "red"}, "plain"]}, "now").first()["text"]
    assert "- be brief" in doc and "- (rule:a) x" in doc and "- (ci) red" in doc and "- plain" in doc and "x" * 200 + "…" in doc
    snippets = spark.createDataFrame([("s", "ops", 2, "b"), ("s", "ops", 1, "a")], "session string, topic string, n long, snippet string")
    assert jobs.topic_nodes(snippets, "alpha", "20260101").first()[:4] == ("excerpt:alpha-ops-s-20260101", "excerpt", "alpha", "a\nb")
    known = spark.createDataFrame([("auto_a", "a", 9)], "bucket string, keyword string, hits long")
    new = spark.createDataFrame([("auto_a", "a", 1), ("auto_b", "b", 7)], "bucket string, keyword string, hits long")
    assert sorted(r[:] for r in jobs.merged_buckets(known, new).collect()) == [("auto_a", "a", 9), ("auto_b", "b", 7)]
