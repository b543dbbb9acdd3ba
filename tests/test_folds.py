"""Buckets folded batch by batch, against doing all at once; any batching, and batches that run again."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_retrieval import ledger

from tidemark.operators import ingest, sessions
from tidemark.streaming import folds

COLUMNS = "ord long, id string, type string, scope string, text string"


def one_by_one(rows):
    ids, facts, out = set(), set(), {}
    for ord_, i, kind, scope, text in sorted(rows):
        fact = (kind, scope or "global", (text or "").strip()) if (text or "").strip() else None
        out[ord_] = "SKIP_DUPLICATE_ID" if i in ids else "SKIP_DUPLICATE_FACT" if fact in facts else "write"
        if out[ord_] == "write":
            ids |= {i} - {None}
            facts |= {fact} - {None}
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_writes_are_deduplicated_in_order(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = [(n, f"n{rng.randrange(25)}" if n % 13 else None, rng.choice(["note", "rule"]), rng.choice([None, "global", "s"]), rng.choice([" fact one", "fact one", "two", "three", "", None, *[f"x{k}" for k in range(15)]])) for n in range(80)]
    keys = folds.WriteKeys(spark, str(tmp_path / "keys"))
    size = -(-len(rows) // batches)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in range(batches):
        spark.createDataFrame(rows[b * size : (b + 1) * size], COLUMNS).coalesce(1).write.mode("append").parquet(source)
        keys.stream(spark.readStream.schema(COLUMNS).parquet(source), out, str(tmp_path / "offsets"))
    told = lambda: {r["ord"]: r["status"] for r in spark.read.parquet(out).collect()}
    assert told() == one_by_one(rows)
    # a batch that runs again tells the same and adds nothing
    again = keys.status(spark.createDataFrame(rows[-size:], COLUMNS))
    assert {r["ord"]: r["status"] for r in again.collect()} == {o: s for o, s in told().items() if o >= rows[-size][0]}
    before = keys.keys.read().count()
    keys.add(spark.createDataFrame(rows[:1], COLUMNS), batches - 1)
    assert keys.keys.read().count() == before


def test_routing_entries_follow_the_nodes(spark, tmp_path):
    rng = random.Random(2)
    routing, live = folds.RoutingEntries(spark, str(tmp_path / "routing")), {}
    for step in range(3):
        batch = ledger(spark, [{"id": f"n{i}", "type": "note", "scope": rng.choice(["a", "b", None]), "text": "t", "tags": rng.sample(["x", "y", "z", "w"], rng.randrange(4)), "ord": 100 * step + i} for i in rng.sample(range(30), 12)])
        gone = [f"n{i}" for i in range(30) if rng.random() < 0.2 and f"n{i}" not in {r["id"] for r in batch.collect()}]
        for _ in range(2):  # the second time changes nothing
            routing.apply(batch, spark.createDataFrame([(g,) for g in gone], "node_id string"), step)
        live |= {r["id"]: r for r in batch.collect()}
        for g in gone:
            live.pop(g, None)
    expected = ingest.routing_index(spark.createDataFrame(list(live.values()), batch.schema))
    assert sorted(map(tuple, routing.entries().collect())) == sorted(map(tuple, expected.collect()))
    routing.apply(batch.limit(0), spark.createDataFrame([(g,) for g in live], "node_id string"))
    assert routing.entries().count() == 0


def test_summaries_of_sessions_that_grow(spark, tmp_path):
    rng = random.Random(3)
    events = [(f"s{s}", n, f"t{n}" if n % 3 else "", rng.choice(["message"] * 4 + ["tool", "error"]), rng.choice(["user", "assistant"]), rng.choice(["hello", "there  you", "", None])) for s in range(6) for n in range(rng.randrange(1, 14))]
    schema = "session string, ord long, ts string, kind string, role string, text string"
    kept = folds.SessionSummaries(spark, str(tmp_path / "state"), limit=4)
    source = str(tmp_path / "in")
    first = [e for e in events if e[1] < 5 or e[0] == "s0"]
    for part in (first, [e for e in events if e not in first]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        kept.stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "offsets"))
    whole = sessions.summary_markdown(spark.createDataFrame(events, schema), 4)
    assert sorted(map(tuple, kept.documents().collect())) == sorted(map(tuple, whole.collect()))
    grown = {e[0] for e in events if e not in first}
    assert {r["session"] for r in kept.documents(since=0).collect()} == grown and "s0" not in grown
    assert spark.read.parquet(source).groupBy("session").agg(F.count("*")).count() == 6


def test_texts_are_shuffled_once_at_most_to_be_told_their_status(spark, tmp_path):
    """The rounds are over keys; the texts went through each round's windows."""

    def shuffled():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    texts = [random.Random(i).randbytes(5000).hex() for i in range(300)]
    rows = spark.createDataFrame([(i, f"id{i % 250}", "note", "global", x) for i, x in enumerate(texts)], COLUMNS)
    keys, before = folds.WriteKeys(spark, str(tmp_path / "keys")), shuffled()
    told = keys.status(rows).collect()
    time.sleep(1)  # for the listener of finished stages
    assert sum(r["status"] == "write" for r in told) == 250 and {r["text"] for r in told} == set(texts)
    assert shuffled() - before < 1.5 * sum(map(len, texts)) / 2  # a hexadecimal digit is compressed to half a byte
