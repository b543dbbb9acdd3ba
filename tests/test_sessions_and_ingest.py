"""Behaviour of readers, session pipelines, chunkers, the change feed and its stream."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import ingest, sessions
from tidemark.plans import queries
from tidemark.sources import files
from tidemark.streaming import wal as wal_stream


def rows_of(spark, lines, file="s"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(lines)], "file string, ord long, line string")


def test_ledger_skips_what_is_no_object(spark, tmp_path):
    path = tmp_path / "nodes.jsonl"
    path.write_bytes(b'{"id":"a","type":"rule","ts":"t","tags":["x"],"meta":{"supersedes":"old","session":"s1","path":"p","priority":"7"}}\n\n{bad\n["list"]\n12\n{"id":"b","text":null,"meta":{"supersedes":["c","d"],"pinned":true}}\n{"type":"note"}\n\xff\n')
    got = {r["ord"]: r for r in files.read_ledger(spark, str(path)).collect()}
    assert sorted(got) == [0, 5, 6]
    assert (got[0]["scope"], got[0]["supersedes"], got[0]["session_id"], got[0]["source_path"], got[0]["priority"]) == ("global", ["old"], "s1", "p", 7)
    assert (got[5]["supersedes"], got[5]["text"], got[5]["pinned"]) == (["c", "d"], None, True)


def test_wal_lines(spark):
    got = files.parse_wal(rows_of(spark, ['{"op":"add","node_id":"a"}', '{"op":"add"}', '{"node_id":"b"}', "[]"])).collect()
    assert [(r["op"], r["node_id"]) for r in got] == [("add", "a")]


def test_session_dialects(spark):
    nested = rows_of(spark, ['{"type":"message","id":"1","timestamp":"t1","message":{"role":"user","content":[{"type":"text","text":"hi"},{"type":"image"},{"type":"text","text":"there"}]}}', '{"type":"other"}', '{"type":"message","message":{"role":"toolResult","content":[{"type":"text","text":"out"}]}}', '{"type":"message","message":{"role":"user","content":[]}}'])
    got = files.parse_nested_sessions(nested).collect()
    assert [(r["ord"], r["role"], r["text"]) for r in got] == [(0, "user", "hi\nthere"), (2, "toolResult", "out")]
    assert files.parse_nested_sessions(nested, tool_results=False).count() == 1
    flat = rows_of(spark, ['{"role":"user","text":"one","time":1700000000000}', '{"type":"assistant","message":["a","b"],"ts":"t2"}', '{"type":"tool_call","result":"r"}', '{"error":"boom"}', '{"x":1}', "no json"])
    got = files.parse_flat_sessions(flat).orderBy("ord").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("message", "one"), ("message", "a b"), ("tool", "r"), ("error", "boom"), ("other", None)]
    assert got[0]["ts"] == "2023-11-14T22:13:20" and got[1]["ts"] == "t2"
    counts = sessions.summary_counts(files.parse_flat_sessions(flat), 1).first()
    assert (counts["lines"], counts["messages"], counts["omitted"], counts["tools"], counts["errors"], counts["last_ts"]) == (5, 2, 1, 1, 1, "t2")
    text = sessions.summary_markdown(files.parse_flat_sessions(flat), 1).first()["text"]
    assert "messages_omitted: 1" in text and "**assistant**: a b" in text and "one" not in text


def test_markdown_scans(spark, tmp_path):
    rows = rows_of(spark, ["- (rule:a) text", "- Hard rule: be brief", "- other", "", "- (note:b) x", "tail"])
    assert [r[0] for r in files.rule_ids(rows).collect()] == ["rule:a"]
    assert [r["rule"] for r in files.hard_rules(rows).collect()] == ["be brief"]
    assert files.bullets(rows, 2).count() == 2 and sorted(r["line"] for r in files.tail(rows, 2).collect()) == ["- (note:b) x", "tail"]
    assert files.read_registry(spark, str(tmp_path / "none"), {"topics": {}}) == {"topics": {}}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("{}")
    assert files.newest_session(spark, [str(tmp_path / "absent"), str(tmp_path / "logs")]).first()["path"].endswith("a.jsonl")
    assert files.newest_session(spark, [str(tmp_path / "absent")]).count() == 0


def pack(pieces, joint, most):
    out, buf = [], ""
    for p in pieces:
        if buf and len(buf) + len(joint) + len(p) <= most:
            buf += joint + p
        else:
            out += [buf] if buf else []
            buf = p
    return out + ([buf] if buf else [])


def test_logs_are_files_of_one_folder_in_order(spark, tmp_path):
    rows = [(f"{n % 40}.txt", n, f"line {n} \u00e4") for n in range(1000)]
    files.write_logs(spark.createDataFrame(rows, "name string, ord long, line string").repartition(7), str(tmp_path / "logs"))
    assert sorted(p.name for p in (tmp_path / "logs").iterdir()) == sorted(f"{n}.txt" for n in range(40))
    for n in range(40):
        assert (tmp_path / "logs" / f"{n}.txt").read_text() == "".join(f"line {k} \u00e4\n" for k in range(n, 1000, 40))


def test_newest_log_makes_no_folder_a_session(spark, tmp_path):
    shared = Path(queries.shared(spark).removeprefix("file:"))
    before = set(shared.glob("logs-*"))
    rows = [(c, t, "user" if t else "system", f"text {c} {t}") for c in range(60) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.source_newest_log(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in got) == ["text 59 0", "text 59 1", "text 59 2"]
    (root,) = set(shared.glob("logs-*")) - before
    assert len(list(root.rglob("*.txt"))) == 60 and not [p for p in root.iterdir() if p.is_dir()]


def test_chunkers(spark):
    rng = random.Random(4)
    texts = ["", "  ", "short", "x" * 50, "a b " + "y" * 40, "p1\n\np2\n\n" + "z " * 30] + ["\n\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r for r in df.select("i", X.chunks("t", 30).alias("c"), X.chunks_cutting("t", 30).alias("d")).collect()}
    for i, t in enumerate(texts):
        paragraphs = [p.strip() for p in t.strip().split("\n\n") if p.strip()]
        whole = [c for piece in pack(paragraphs, "\n\n", 30) for c in ([piece] if len(piece) <= 30 else pack(piece.replace("\n", " ").split(), " ", 30))]
        assert got[i]["c"] == whole, t
        assert got[i]["d"] == ([] if not t.strip() else [t.strip()] if len(t.strip()) <= 30 else pack([p[:30] for p in paragraphs], "\n\n", 30)), t


WAL = [(1, "add", "a", "one", "t1"), (2, "update", "a", "two", "t2"), (3, "delete", "a", None, "t3"), (4, "update", "b", "bee", "t4"), (5, "add", "c", "", "t5"), (6, None, "d", "x", "t6"), (7, "add", None, "x", "t7")]


def test_wal_fold(spark):
    wal = spark.createDataFrame(WAL, wal_stream.FEED.replace("ord long", "ord long"))
    ledger = spark.createDataFrame([(1, "b", "from the ledger"), (2, "b", "later"), (3, "c", "sea")], "ord long, id string, text string")
    state = lambda **o: {r["node_id"]: (r["text"], r["ts"]) for r in ingest.wal_state(wal, ledger, **o).collect()}
    assert state() == {"b": ("from the ledger", "t4"), "c": ("sea", "t5")}
    assert state(prefer_wal_text=True) == {"b": ("bee", "t4"), "c": ("sea", "t5")}
    assert ingest.wal_stats(wal).first().asDict() == {"added": 3, "deleted": 1, "updated": 2, "skipped": 2} or ingest.wal_stats(wal).first()["skipped"] == 2


def test_stream_folds_in_any_batches_and_replays(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "state")
    for part in (WAL[3:5], WAL[:2]):
        spark.createDataFrame(part, wal_stream.FEED).coalesce(1).write.mode("append").parquet(feed)
    fold = wal_stream.merge_stream(spark, feed, root, files_per_batch=1)
    assert {r["node_id"] for r in fold.live(spark).collect()} == {"a", "b", "c"}
    spark.createDataFrame(WAL[2:3], wal_stream.FEED).coalesce(1).write.mode("append").parquet(feed)
    fold = wal_stream.merge_stream(spark, feed, root)
    assert {r["node_id"] for r in fold.live(spark).collect()} == {"b", "c"}
    fold(spark.createDataFrame(WAL[:2], wal_stream.FEED), 99)  # a late replay
    assert {r["node_id"] for r in fold.live(spark).collect()} == {"b", "c"}


def widest(lengths, signal, at, start, most, chars):
    """The excerpt by its definition: widen while it pays, drop the longer end while it is too long."""

    def shrunk(width):
        left, right = width, width
        while True:
            inside = range(max(0, at - left), min(len(lengths), at + right + 1))
            if left + right == 0 or sum(lengths[i] for i in inside) <= chars:
                return (left, right), inside
            left, right = (left - 1, right) if left >= right else (left, right - 1)

    chosen, failed = shrunk(start), 0
    for w in range(start + 1, most + 1):
        other = shrunk(w)
        if other[0] == chosen[0] or failed > 1:
            break
        pays = any(signal[i] for i in other[1]) and (not any(signal[i] for i in chosen[1]) or sum(lengths[i] for i in other[1]) >= sum(lengths[i] for i in chosen[1]))
        chosen, failed = (other, 0) if pays else (chosen, failed + 1)
    return chosen[1][0], chosen[1][-1], len(chosen[1])


def test_excerpt_windows(spark):
    rng, rows, expected = random.Random(6), [], {}
    for s in range(120):
        n = rng.randrange(1, 26)
        texts = ["x" * rng.choice([0, 5, 30, 200]) + (" zeta" if rng.random() < 0.2 else "") for _ in range(n)]
        at = rng.randrange(n)
        texts[at] = "ab zz. " * 3 + "x" * rng.choice([0, 400])  # the phrase stands here only, and no word of it is a token
        rows += [(f"s{s}", i, "user", t, "") for i, t in enumerate(texts)]
        expected[f"s{s}"] = (texts, at)
    df = spark.createDataFrame(rows, "session string, ord long, role string, text string, ts string")
    for query, start, most, chars in (("ab zz.", 1, 4, 300), ("ab zz.", 3, 10, 900), ("zeta", 2, 6, 500), ("ab zz.", 3, 10, 10), ("zeta", 0, 3, 10_000)):
        anchors = {r["session"]: r["anchor_ord"] for r in sessions.anchors(df, query).collect()}
        found = {r["session"]: (r["first_ord"], r["last_ord"], r["n"]) for r in sessions.excerpt_adaptive(df, query, start, most, chars).collect()}
        assert set(found) == set(anchors)
        for s, at in anchors.items():
            texts = expected[s][0]
            signal = ["zeta" in t for t in texts] if query == "zeta" else [False] * len(texts)
            assert found[s] == widest(list(map(len, texts)), signal, at, start, most, chars), (query, start, s)


def test_excerpt_text_is_cut_and_stops(spark):
    rows = spark.createDataFrame([("s", i, "x" * 10) for i in range(4)], "session string, ord long, text string")
    got = [r["text"] for r in sessions.excerpt_text(rows, 25).orderBy("ord").collect()]
    assert len(got) == 3 and got[2] == "xxxxx" + sessions.CUT_MARK


def test_lines_of_a_file_cut_into_blocks(spark, tmp_path):
    rng = random.Random(2)
    expected = [f"{i} " + "x" * rng.randrange(300) for i in range(6000)]
    (tmp_path / "log.txt").write_bytes("\n".join(expected).encode() + b"\nbad \xff byte\r")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 16))
    try:
        rows = files.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = [r["line"] for r in rows.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [*expected, "bad \ufffd byte\r"]


def test_documents_are_files(spark, tmp_path):
    df = spark.createDataFrame([(f"rule_{i}.md", f"# {i}\n") for i in range(20)], "filename string, markdown string")
    files.write_documents(df, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"rule_{i}.md": f"# {i}\n" for i in range(20)}


def test_scopes_of_many_tags_are_counted_only(spark):
    rows = spark.createDataFrame([("a", "big", [f"t{i}" for i in range(30)]), ("b", "small", ["y", "x"]), ("c", "none", [])], "id string, scope string, tags array<string>")
    got = {r["scope"]: (r["n_nodes"], r["tags"]) for r in ingest.routing_summary(rows, most_tags=20).collect()}
    assert got == {"big": (1, None), "small": (1, "x,y"), "none": (1, "")}


def test_promotion(spark):
    rows = spark.createDataFrame(list(enumerate(["# Session Summary x", "You've hit your limit", "rule: always test", "we decided on X", "must do", "never do", "plain", "{json: must}", "must do", "ralph: new rule"])), "ord long, line string")
    got = [(r["type"], r["text"], r["scope"]) for r in sessions.promotion_candidates(rows).collect()]
    assert got == [("incident", "You've hit your limit", "global"), ("decision", "must do", "global"), ("decision", "we decided on X", "global"), ("rule", "never do", "global"), ("rule", "ralph: new rule", "agentoffice"), ("rule", "rule: always test", "global")]


def test_auto_buckets_prefer_pairs(spark):
    rows = spark.createDataFrame([("s", i, "user", "quick brown things", "t") for i in range(3)], "session string, ord long, role string, text string, ts string")
    assert [r["bucket"] for r in sessions.auto_buckets(rows, least=3).collect()] == ["auto_brown_things", "auto_quick_brown"]
    assert {r["keyword"] for r in sessions.auto_buckets(rows, least=3, known=("auto_brown_things", "auto_quick_brown")).collect()} == {"brown", "quick", "things"}


def test_chunk_table_and_cache(spark):
    nodes = spark.createDataFrame([(1, "a", "note", "t", None, "one two", None), (2, "b", "note", "t", "x", " ", "p")], "ord long, id string, type string, ts string, scope string, text string, source_path string")
    chunks = ingest.chunk_rows(nodes)
    assert [(r["node_id"], r["chunk_id"], r["source_path"], r["project_id"]) for r in chunks.collect()] == [("a", "c000", "nodes.jsonl#a", "global")]
    newer = chunks.withColumn("text", F.lit("new"))
    assert [r["text"] for r in ingest.upsert_chunks(chunks, newer).collect()] == ["new"] and ingest.delete_chunks(chunks, newer).count() == 0
    texts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "key long, text string")
    cache = spark.createDataFrame([("x", [1.0])], "text string, vector array<double>").select(F.sha2("text", 256).alias("text_sha256"), "vector")
    got = {r["key"]: r["vector"] for r in ingest.cached_embeddings(texts, cache, lambda c: F.array(F.length(c).cast("double") + 1)).collect()}
    assert got == {1: [1.0], 2: [2.0], 3: [2.0]}


def test_rendering(spark):
    nodes = spark.createDataFrame([(1, "rule:x-y", "rule", "t", "global", "body", ["a"], 3, "p"), (2, "rule:x_y", "rule", "", "s", "", [], 0, None)], "ord long, id string, type string, ts string, scope string, text string, tags array<string>, priority int, source_path string")
    got = {r["filename"]: r["markdown"] for r in ingest.rendered(nodes).collect()}
    assert got["rule_x-y.md"] == "---\nid: rule:x-y\ntype: rule\nscope: global\nts: t\ntags: [a]\npriority: 3\nsource: p\n---\n\n# Rule: X Y\n\nbody\n"
    assert got["rule_x_y.md"] == "---\nid: rule:x_y\ntype: rule\nscope: s\n---\n\n# Rule: X_y\n"
    assert ingest.ledger_view(nodes).count() == 2


@pytest.mark.parametrize("known", [None, "projects/own.md"])
def test_routing_keeps_dossiers(spark, known):
    nodes = spark.createDataFrame([("a", "s", ["x"]), ("a", "s", ["y"]), ("b", None, [])], "id string, scope string, tags array<string>")
    dossiers = None if known is None else spark.createDataFrame([("s", known)], "scope string, dossier string")
    got = {r["scope"]: (r["n_nodes"], r["tags"], r["dossier"]) for r in ingest.routing_summary(nodes, dossiers).collect()}
    assert got == {"s": (1, "x,y", known or "projects/s.md"), "global": (1, "", "projects/global.md")}
