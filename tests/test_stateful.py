"""Stateful streams against the batch operators, whatever the batches are."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, sessions
from tidemark.streaming import stateful


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, out, offsets):
    stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/at={n}")).outputMode("update").option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


def test_last_messages_of_growing_sessions(rocks, tmp_path):
    rng = random.Random(1)
    schema = "session string, ord long, role string, text string"
    rows = [(f"s{rng.randrange(5)}", n, rng.choice(["user", "assistant"]), rng.choice(["one", "two  words", " ", None, "x" * 300])) for n in range(60)]
    source = str(tmp_path / "in")
    for part in (rows[:20], rows[20:27], rows[27:]):
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run(stateful.recent_samples(rocks.readStream.schema(schema).parquet(source), 3, 80), str(tmp_path / "out"), str(tmp_path / "offsets"))
    found = rocks.read.parquet(str(tmp_path / "out"))
    newest = found.groupBy("session").agg(F.max("batch").alias("batch"))
    last = found.join(newest, ["session", "batch"]).select("session", "ord", "role", "snippet")
    expected = sessions.last_n(rocks.createDataFrame(rows, schema), 3, 80)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, expected.collect()))


def test_excerpts_expire_as_time_passes(rocks, tmp_path):
    schema = "ord long, id string, pinned boolean, expires_at string, source_path string, seen_at timestamp"
    day = lambda d: f"2026-01-{d:02d}T00:00:00+00:00"
    rows = [(1, "a", False, day(5), "f", 1), (2, "b", False, day(5), None, 1), (3, "c", True, day(5), "f", 1), (4, "d", None, "soon", "f", 1), (5, "e", False, day(20), "f", 1), (6, "f", False, day(4), "f", 1)]
    later = [(7, "f", True, day(4), "f", 2), (8, "e", False, day(8), "f", 2), (9, None, None, None, None, 6)]
    last = [(10, "c", False, day(9), "f", 7), (11, None, None, None, None, 12)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    now = {}
    for step, (part, clock) in enumerate([(rows, 1), (later, 6), (last, 12)]):
        df = rocks.createDataFrame(part, schema.replace("timestamp", "long")).withColumn("seen_at", F.to_timestamp(F.format_string("2026-01-%02dT00:00:00+00:00", "seen_at")))
        df.coalesce(1).write.mode("append").parquet(source)
        run(stateful.expired_excerpts(rocks.readStream.schema(schema).parquet(source)), out, str(tmp_path / "offsets"))
        now |= {r[1]: r for r in part if r[1]}
        # what the batch report counts at this time, of excerpts as they are by then
        table = rocks.createDataFrame([(*r[:5],) for r in now.values()], "ord long, id string, pinned boolean, expires_at string, source_path string").withColumn("type", F.lit("excerpt"))
        report = ingest.gc_report(table, F.to_timestamp(F.lit(day(clock)))).first()
        fates = rocks.read.parquet(out)
        counted = {r["fate"]: r["count"] for r in fates.groupBy("fate").count().collect()}
        assert (counted.get("deleted", 0), counted.get("missing", 0)) == (report["deleted"], report["missing"]), step
    assert {r["id"] for r in fates.collect()} == {"a", "b", "c", "e"}


def test_excerpts_without_a_timer_cost_no_state():
    """A new excerpt has no timers to list, and one without a timer nothing to keep."""
    done = []

    class Row:
        exists = staticmethod(lambda: False)
        update = staticmethod(lambda row: done.append(row))

    class Handle:
        getValueState = staticmethod(lambda *_: Row)
        listTimers = staticmethod(lambda: done.append("listed") or [])
        registerTimer = staticmethod(lambda at: done.append(at))

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 50)

    expiry = stateful._Expiry()
    expiry.init(Handle)
    rows = lambda *r: iter([pd.DataFrame([x], columns=["ord", "has_file", "pinned", "expires_ms"]) for x in r])
    assert not list(expiry.handleInputRows(("a",), rows((1, True, False, 10.0), (2, True, True, 10.0)), Times))
    assert not list(expiry.handleInputRows(("b",), rows((1, True, False, float("nan"))), Times))
    assert done == []
    assert not list(expiry.handleInputRows(("c",), rows((2, False, False, 90.0), (1, True, True, 10.0)), Times))
    assert done == [(False, 90), 91]
