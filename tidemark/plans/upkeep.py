"""Queries over stored indexes, streams and stores that are kept up to date, and their DuckDB twins."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import cells, segments
from tidemark.operators.tables import shared_folder as shared
from tidemark.plans import oracles as O
from tidemark.plans.queries import Query, _events, _excerpts, every_20th
from tidemark.plans.store import MemoryStore
from tidemark.shipping import workers_can_import
from tidemark.sources import adapters
from tidemark.streaming import folds, stateful

REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def ready(spark, sf):
            workers_can_import(spark)
            return f(spark, sf)

        REGISTRY[f.__name__] = ready
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fresh(spark, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


# nodes that are added, updated, deleted and added again


def node_deltas(spark, sf):
    """[(nodes to index, ids to drop)]: two thirds of the ledger; the rest with changed texts of a tenth, a seventh deleted; a third of those again."""
    n = adapters.nodes(spark, sf)
    o = F.col("ord")
    changed = n.withColumn("text", F.when(o % 10 == 0, F.concat(F.lit("updated "), "text")).otherwise(F.col("text")))
    again = n.filter("ord % 21 = 3").withColumn("text", F.concat("type", F.lit(" again "), "scope"))
    return [
        (n.filter("ord % 3 < 2"), None),
        (changed.filter("(ord % 3 = 2 or ord % 10 = 0) and ord % 7 <> 3"), n.filter("ord % 7 = 3").select(F.col("id").alias("node_id"))),
        (again, None),
    ]


#: The ledger after these.
AFTER = O.NODES.replace("nodes AS (", "before AS (", 1) + """, nodes AS (SELECT * REPLACE (CASE WHEN ord % 21 = 3 THEN type || ' again ' || scope WHEN ord % 10 = 0 THEN 'updated ' || text ELSE text END AS text) FROM before WHERE ord % 7 <> 3 OR ord % 21 = 3)"""


def text_index(spark, sf):
    index = segments.TextSegments(spark, fresh(spark, "segments"), fanout=3)
    for nodes, gone in node_deltas(spark, sf):
        index.apply(nodes, gone)
        index.merge()
    return index


@query(f"WITH {O.indexed(O.PROBES, None, 1).replace(O.NODES, AFTER, 1)} {O.LOOKUP} WHERE rank <= 10 AND {O.preview('n.text')} <> ''")
def fts_segments(spark, sf):
    """The batch lookup over segments after additions, updates, deletions and a merge."""
    return text_index(spark, sf).lookup(adapters.probes(spark, sf)).select("query_id", "rank", "node_id", "score", "ts")


@query(O.ORACLES["bm25_topk"].replace(O.NODES, AFTER, 1))
def bm25_stored(spark, sf):
    """BM25 over the stored blocks of the same index."""
    return text_index(spark, sf).bm25(adapters.probes(spark, sf))


# vectors that are added, moved and deleted


def _vector_index(spark, sf):
    """The vectors after three deltas: even ids, then odd ids with a ninth of the even ones deleted, then some of these again, halved."""
    v = adapters.chunk_vectors(spark, sf)
    i = F.substring_index("node_id", ":", -1).cast("long")
    index = cells.VectorCells(spark, fresh(spark, "cells"), most=100)
    index.apply(v.filter(i % 2 == 0))
    index.apply(v.filter(i % 2 == 1), v.filter(i % 18 == 4).select("node_id"))
    index.apply(v.filter(i % 36 == 4).withColumn("embedding", F.transform("embedding", lambda x: (x / 2).cast("float"))))
    return index


def _vectors_after(where: str = "") -> str:
    return O.vector_search(None).replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 18 <> 4 OR vec_id % 36 = 4)", 1)


@query(_vectors_after().replace("rank <= 20", "rank <= 10"))
def vector_cells_exact(spark, sf):
    """Every row whose id is divisible by 20 against all cells: an 8-bit scan with bounds, then full vectors."""
    found = _vector_index(spark, sf).search(every_20th(spark, sf).select("query_id", "q"), 10, probes=1_000_000)
    return found.select("query_id", "node_id", "project_id", F.round("score", 9).alias("score"))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_cells_recall(spark, sf):
    """Of the ten true neighbours after the deltas, whether the probed cells hold nine in ten."""
    index, asked = _vector_index(spark, sf), every_20th(spark, sf).select("query_id", "q")
    n = len(index.state["cells"])
    pairs = lambda df: df.select("query_id", "node_id")
    true, found = pairs(index.search(asked, 10, probes=n)), pairs(index.search(asked, 10, probes=max(10, n * 2 // 3)))
    both = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "node_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


# routing entries that follow the nodes


@query(f"WITH {AFTER} SELECT DISTINCT scope, 'node' AS kind, id AS value FROM nodes UNION SELECT DISTINCT scope, 'tag', unnest(tags) FROM nodes")
def routing_upkeep(spark, sf):
    """The routing entries after the deltas, by counts that are added and taken back."""
    routing = folds.RoutingEntries(spark, fresh(spark, "routing"))
    for number, (nodes, gone) in enumerate(node_deltas(spark, sf)):
        routing.apply(nodes, gone, number)
    return routing.entries()


# streams


def in_batches(spark, df, name: str, parts: list[str], each) -> None:
    """Append the rows of each condition to a folder in turn; ``each`` starts what reads the folder as a stream."""
    path = fresh(spark, name)
    for where in parts:
        df.filter(where).write.mode("append").parquet(path)
        each(spark.readStream.schema(df.schema).parquet(path), f"{path}-offsets")


@query(O.ORACLES["session_summary_text"])
def stream_session_summaries(spark, sf):
    """Summaries of sessions whose events come in three batches, later ones of each session in later batches."""
    kept = folds.SessionSummaries(spark, fresh(spark, "summaries"), 3, 80)
    in_batches(spark, _events(spark, sf), "events", ["ord < 2", "ord between 2 and 4", "ord > 4"], kept.stream)
    return kept.documents()


def _stateful(spark, stream, out: str, offsets: str) -> None:
    """Run a stateful stream over what is there; the rows of each batch go to a folder of its own."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    try:
        sink = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/at={n}")
        stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query(O.ORACLES["session_last_n"])
def stream_recent_messages(spark, sf):
    """The last three messages of each session, held as state while messages come in two batches."""
    out = fresh(spark, "recent")
    run = lambda rows, offsets: _stateful(spark, stateful.recent_samples(rows, 3, 80), out, offsets)
    in_batches(spark, adapters.messages(spark, sf), "messages", ["ord < 3", "ord >= 3"], run)
    found = spark.read.parquet(out)
    newest = found.groupBy("session").agg(F.max("batch").alias("batch"))
    return found.join(newest, ["session", "batch"]).select("session", "ord", "role", "snippet")


@query(f"SELECT deleted, missing FROM ({O.ORACLES['excerpt_gc_report']})")
def stream_expiry(spark, sf):
    """Excerpts that timers have let expire when the stream's time is that of the batch report."""
    rows = _excerpts(spark, sf).filter("type = 'excerpt'").select("ord", "id", "pinned", "expires_at", "source_path", F.to_timestamp(F.lit("2024-01-01T00:00:00+00:00")).alias("seen_at"))
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("boolean").alias("pinned"), F.lit(None).cast("string").alias("expires_at"), F.lit(None).cast("string").alias("source_path"), F.to_timestamp(F.lit("2024-07-01T00:00:00+00:00")).alias("seen_at"))
    out = fresh(spark, "expiry")
    run = lambda stream, offsets: _stateful(spark, stateful.expired_excerpts(stream), out, offsets)
    in_batches(spark, rows.unionByName(tick), "excerpts", ["ord >= 0", "ord < 0"], run)
    fate = lambda x: F.count_if(F.col("fate") == x).cast("long").alias(x)
    return spark.read.parquet(out).agg(fate("deleted"), fate("missing"))


# writes


def _to_write(spark, sf):
    """The ledger as notes of one scope, every eleventh odd one with the first one's id."""
    o = F.col("ord")
    new_id = F.when(o % 2 == 0, F.col("id")).when(o % 11 == 0, F.lit("rule:0")).otherwise(F.concat(F.lit("new:"), o.cast("string")))
    return adapters.nodes(spark, sf).withColumns({"id": new_id, "type": F.lit("note"), "scope": F.lit("global")})


#: As if written one by one: rows of a known id leave no fact behind.
WRITTEN = f"""{O.NODES}, n AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN id WHEN ord % 11 = 0 THEN 'rule:0' ELSE 'new:' || ord END AS id, text, {O.strip('text')} AS fact FROM nodes),
told AS (SELECT ord, id, text, CASE WHEN ord % 2 = 1 AND ord % 11 = 0 THEN 'SKIP_DUPLICATE_ID' WHEN fact <> '' AND row_number() OVER (PARTITION BY fact, ord % 2 = 1 AND ord % 11 = 0 ORDER BY ord) > 1 THEN 'SKIP_DUPLICATE_FACT' ELSE 'write' END AS status FROM n)"""


@query(f"WITH {WRITTEN} SELECT ord, id, status FROM told")
def stream_dedupe_on_write(spark, sf):
    """Rows of a stream, each told whether its id or its fact was written before, by an earlier batch or an earlier row."""
    keys, out = folds.WriteKeys(spark, fresh(spark, "keys")), fresh(spark, "told")
    rows = _to_write(spark, sf).select("ord", "id", "type", "scope", "text")
    third = rows.agg(F.max("ord")).first()[0] // 3
    in_batches(spark, rows, "writes", [f"ord <= {third}", f"ord > {third} and ord <= {2 * third}", f"ord > {2 * third}"], lambda stream, offsets: keys.stream(stream, out, offsets))
    return spark.read.parquet(out).select("ord", "id", "status")


@query(f"WITH {WRITTEN} SELECT 'ledger' AS part, id, sha256(text) AS text_sha256 FROM told WHERE status = 'write' UNION ALL SELECT 'feed', id, sha256(text) FROM told WHERE status = 'write'")
def store_nodes(spark, sf):
    """What the ledger and the feed of a store hold after two tables of nodes were added."""
    store = MemoryStore(spark, fresh(spark, "store"), clock=lambda: "2025-01-01T00:00:00+00:00")
    rows = _to_write(spark, sf)
    half = rows.agg(F.max("ord")).first()[0] // 2
    for where in (f"ord <= {half}", f"ord > {half}"):
        store.add_nodes(rows.filter(where))
    of = lambda name, df, c: df.select(F.lit(name).alias("part"), F.col(c).alias("id"), F.sha2("text", 256).alias("text_sha256"))
    return of("ledger", store.nodes(), "id").union(of("feed", store.feed(), "node_id"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
