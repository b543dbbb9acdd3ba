"""Tables kept in buckets that batches are folded into: keys of what was written, routing entries with counts, session summaries.

A batch reads and writes the buckets of its keys only; a JSON state then names the folder of each bucket and the
last batch, so a batch that runs again changes nothing. All work as batches of a stream (``foreachBatch``) and alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import sessions
from tidemark.operators.tables import Pointer, remove, written_at

BUCKETS = 64


class Buckets:
    """Rows of ``schema``, dealt by a hash of their ``keys``. ``indexed``: a column that gets a Bloom filter in its files."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], indexed: str | None = None, n: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self.indexed, self.n = spark, root.rstrip("/"), schema, keys, indexed, n
        self.pointer = Pointer(spark, f"{self.root}/current")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("string")

    def _state(self) -> dict:
        return self.pointer.read({"buckets": {}, "batch": -1})

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the buckets that rows ``of`` (with the keys) belong to."""
        folders = self._state()["buckets"]
        if of is not None:
            asked = [r[0] for r in of.select(self.bucket()).distinct().collect()]  # at most n
            folders = {b: folders[b] for b in asked if b in folders}
        return self.spark.read.schema(self.schema).parquet(*folders.values()) if folders else self.spark.createDataFrame([], self.schema)

    def done(self, batch: int | None) -> bool:
        return batch is not None and batch <= self._state()["batch"]

    def fold(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> None:
        """Put ``how``(rows of the touched buckets, ``rows``) in place of these buckets, unless ``batch`` was folded before."""
        state = self._state()
        if batch is not None and batch <= state["batch"]:
            return
        touched = [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # at most n
        old = [state["buckets"][b] for b in touched if b in state["buckets"]]
        before = self.spark.read.schema(self.schema).parquet(*old) if old else self.spark.createDataFrame([], self.schema)
        path = f"{self.root}/{uuid.uuid4().hex}"
        writer = how(before, rows).select(*before.columns).withColumn("at", self.bucket()).repartition("at").write.partitionBy("at")
        if self.indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.indexed}", "true")
        writer.parquet(path)
        there = {s.getPath().getName() for s in self.pointer.system.listStatus(self.pointer.jvm.org.apache.hadoop.fs.Path(path))}
        kept = {b: f for b, f in state["buckets"].items() if b not in touched}
        new = {b: f"{path}/at={b}" for b in touched if f"at={b}" in there}
        self.pointer.move({**state, "buckets": kept | new, "batch": state["batch"] if batch is None else batch})
        for folder in old:
            remove(self.spark, folder)


class WriteKeys:
    """Ids and facts (type, scope, stripped text) of all that was written, each with the ``ord`` that wrote it first.

    Deduplication is that of adding rows one by one in their order: a row is skipped if an earlier *written* row
    has its id, else if one has its fact. Within a batch this is settled in rounds: rows that are first with both of their keys are
    written, rows that share a key with these are skipped, the rest goes on. A key is known to a row only from an earlier
    ``ord``, so a batch that runs again gives the same.
    """

    SCHEMA = "key string, ord long"

    def __init__(self, spark: SparkSession, root: str):
        self.keys = Buckets(spark, root, self.SCHEMA, ["key"], indexed="key")
        self.scratch: list[str] = []

    def clean(self) -> None:
        while self.scratch:
            remove(self.keys.spark, self.scratch.pop())

    @staticmethod
    def keyed(rows: DataFrame) -> DataFrame:
        """``rows`` with _id and _fact, digests of both keys; null where there is none."""
        fact = F.concat_ws("\0", F.lit("f"), F.coalesce("type", F.lit("\1")), F.coalesce("scope", F.lit("global")), X.strip("text"))
        return rows.withColumns({"_id": F.when(F.col("id").isNotNull(), F.sha2(F.concat_ws("\0", F.lit("i"), "id"), 256)), "_fact": F.when(X.strip("text") != "", F.sha2(fact, 256))})

    def of_one(self, row: DataFrame) -> str:
        """The status of a single row, against all that was written."""
        keyed = self.keyed(row).select("_id", "_fact")
        mine = keyed.first()
        pairs = keyed.select(F.explode(F.array_compact(F.array("_id", "_fact"))).alias("key"))
        # the files' Bloom filters are asked for both keys
        known = {r["key"] for r in self.keys.read(pairs).filter(F.col("key").isin([k for k in mine if k])).collect()}
        return "SKIP_DUPLICATE_ID" if mine["_id"] in known else "SKIP_DUPLICATE_FACT" if mine["_fact"] in known else "write"

    def status(self, rows: DataFrame) -> DataFrame:
        """``rows`` (ord, id, type, scope, text, ...) with their status, against all earlier rows and one another.

        The rounds are over keys alone; what else is in the rows is shuffled once, to join their status.
        The tables of the rounds are in ``scratch``, to be deleted once the result has been read.
        """
        whole, path = written_at(self.keyed(rows).withColumn("_row", F.monotonically_increasing_id()), "dedupe")
        self.scratch.append(path)
        keyed = whole.select("_row", "ord", "_id", "_fact", F.lit(None).cast("string").alias("status"))
        pairs = keyed.select(F.explode(F.array_compact(F.array("_id", "_fact"))).alias("key")).distinct()
        known = self.keys.read(pairs).join(pairs, "key", "left_semi")
        made = []
        while True:
            seen = lambda c: known.select(F.col("key").alias(c), F.col("ord").alias(f"{c}_ord"))
            told = keyed.filter("status is null").join(seen("_id"), "_id", "left").join(seen("_fact"), "_fact", "left")
            first = lambda c: F.col(c).isNull() | (F.row_number().over(Window.partitionBy(c).orderBy("ord")) == 1)
            left = told.withColumn("status", F.when(F.col("_id_ord") < F.col("ord"), "SKIP_DUPLICATE_ID"))
            # a row whose id an earlier one may still take has to wait, whatever its fact
            status = F.when(F.col("_a") & (F.col("_fact_ord") < F.col("ord")), "SKIP_DUPLICATE_FACT").when(F.col("_a") & F.col("_b"), "write")
            waiting = left.filter("status is null").withColumns({"_a": first("_id"), "_b": first("_fact")}).withColumn("status", status).drop("_a", "_b")
            now, path = written_at(left.filter("status is not null").unionByName(waiting).drop("_id_ord", "_fact_ord"), "dedupe")
            self.scratch.append(path)
            made.append(now.filter("status is not null"))
            if now.filter("status is null").isEmpty():
                break
            new = now.filter("status = 'write'").select(F.explode(F.array_compact(F.array("_id", "_fact"))).alias("key"), "ord")
            known = known.unionByName(new).groupBy("key").agg(F.min("ord").alias("ord"))
            keyed = now
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        return whole.join(out.select("_row", "status"), "_row").select(*rows.columns, "status")

    def add(self, written: DataFrame, batch: int | None = None) -> None:
        """Remember the keys of rows that are written."""
        new = self.keyed(written).select(F.explode(F.array_compact(F.array("_id", "_fact"))).alias("key"), "ord")
        self.keys.fold(new, lambda old, more: old.unionByName(more).groupBy("key").agg(F.min("ord").alias("ord")), batch)

    def stream(self, rows: DataFrame, out: str, offsets: str) -> None:
        """Write the rows of a stream that are new to the table ``out``, with the others' status beside them."""

        def batch(df: DataFrame, number: int) -> None:
            # a folder a batch: one that runs again replaces its own rows
            at = f"{out}/batch={number}"
            self.status(df).write.mode("overwrite").parquet(at)
            self.clean()
            self.add(df.sparkSession.read.parquet(at).filter("status = 'write'"), number)

        rows.writeStream.foreachBatch(batch).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


class RoutingEntries:
    """(scope, kind, value) entries with how many nodes they come from, so that they go when the last of these does."""

    NODES = "node_id string, scope string, tags array<string>"
    COUNTS = "scope string, kind string, value string, n long"

    def __init__(self, spark: SparkSession, root: str):
        self.nodes = Buckets(spark, f"{root}/nodes", self.NODES, ["node_id"])
        self.counts = Buckets(spark, f"{root}/counts", self.COUNTS, ["scope", "kind", "value"])

    @staticmethod
    def _entries(nodes: DataFrame, sign: int) -> DataFrame:
        ids = nodes.select("scope", F.lit("node").alias("kind"), F.col("node_id").alias("value"))
        tags = nodes.select("scope", F.lit("tag").alias("kind"), F.explode(F.array_distinct("tags")).alias("value"))
        return ids.union(tags).groupBy("scope", "kind", "value").agg((F.count("*") * sign).alias("n"))

    def apply(self, nodes: DataFrame, deleted: DataFrame | None = None, batch: int | None = None) -> None:
        """Take in ``nodes`` (of the ledger's columns; the last row of an id counts) in place of what these ids had, and take ``deleted`` (node_id) out."""
        if self.nodes.done(batch):
            return
        last = nodes.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("node_id")).agg(F.max_by(F.struct(F.coalesce("scope", F.lit("global")).alias("scope"), "tags"), "ord").alias("l"))
        new = last.select("node_id", "l.scope", "l.tags")
        gone = new.select("node_id") if deleted is None else new.select("node_id").union(deleted.select("node_id")).distinct()
        old, path = written_at(self.nodes.read(gone).join(gone, "node_id", "left_semi"), "routing")
        delta = self._entries(old, -1).union(self._entries(new, 1)).groupBy("scope", "kind", "value").agg(F.sum("n").alias("n")).filter("n <> 0")
        self.counts.fold(delta, lambda before, more: before.unionByName(more).groupBy("scope", "kind", "value").agg(F.sum("n").alias("n")).filter("n > 0"), batch)
        rows = new.unionByName(gone.join(new.select("node_id"), "node_id", "left_anti"), allowMissingColumns=True)
        self.nodes.fold(rows, lambda before, more: before.join(more.select("node_id"), "node_id", "left_anti").unionByName(more.filter("scope is not null")), batch)
        remove(self.nodes.spark, path)

    def entries(self) -> DataFrame:
        return self.counts.read().select("scope", "kind", "value")


class SessionSummaries:
    """Counts and the last ``limit`` messages of each session, folded from its events as they come; ``documents`` makes the summaries.

    An event's ``ord`` is its place in its session. What a session holds is bounded by ``limit``, and only sessions with new
    events are summarised again.
    """

    SCHEMA = "session string, lines long, messages long, valid long, tools long, errors long, first struct<ord:bigint,ts:string>, last struct<ord:bigint,ts:string>, sample array<struct<ord:bigint,role:string,snippet:string>>, batch long"

    def __init__(self, spark: SparkSession, root: str, limit: int = 120, most_text: int = 220):
        self.state, self.limit, self.most_text = Buckets(spark, root, self.SCHEMA, ["session"]), limit, most_text

    def _partial(self, events: DataFrame, batch: int) -> DataFrame:
        valid = (F.col("kind") == "message") & (X.strip("text") != "")
        n = lambda c: F.count_if(c).cast("long")
        timed = F.when(F.coalesce("ts", F.lit("")) != "", F.struct("ord", "ts"))
        counts = events.groupBy("session").agg(F.count("*").alias("lines"), n(F.col("kind") == "message").alias("messages"), n(valid).alias("valid"), n(F.col("kind") == "tool").alias("tools"), n(F.col("kind") == "error").alias("errors"), F.min(timed).alias("first"), F.max(timed).alias("last"))
        # cut to ``limit`` before they are gathered
        sample = sessions.last_n(events.filter("kind = 'message'"), self.limit, self.most_text).groupBy(F.col("session").alias("_s")).agg(F.collect_list(F.struct("ord", "role", "snippet")).alias("sample"))
        return counts.join(sample, F.col("session").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("batch", F.lit(batch).cast("long"))

    def add(self, events: DataFrame, batch: int) -> None:
        """Fold events (session, ord, ts, kind, role, text)."""

        def how(before: DataFrame, more: DataFrame) -> DataFrame:
            total = [F.sum(c).alias(c) for c in ("lines", "messages", "valid", "tools", "errors")]
            both = before.unionByName(more).groupBy("session").agg(*total, F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_list("sample")).alias("s"), F.max("batch").alias("batch"))
            newest = F.slice(F.reverse(F.array_sort("s")), 1, self.limit)  # the old ones and the new ones, twice the limit at most
            return both.withColumn("sample", F.reverse(newest))

        self.state.fold(self._partial(events, batch), how, batch)

    def documents(self, since: int = -1) -> DataFrame:
        """(session, text) of the sessions that a batch after ``since`` has touched."""
        rows = self.state.read().filter(F.col("batch") > since)
        body = F.array_join(F.transform("sample", lambda m: F.concat(F.lit("- **"), m["role"], F.lit("**: "), m["snippet"])), "\n")
        omitted = F.greatest(F.col("valid") - self.limit, F.lit(0)).cast("long")
        head = F.concat(F.lit("# Session Summary: "), "session", F.lit("\n\n## Metadata\n- lines: "), "lines", F.lit("\n- messages_seen: "), "messages", F.lit("\n- messages_omitted: "), omitted, F.lit("\n- tool_events_seen: "), "tools", F.lit("\n- errors_seen: "), "errors")
        return rows.select("session", F.concat(head, F.lit("\n\n## Messages (most recent sample)\n"), F.when(F.size("sample") <= 0, F.lit("- (none captured)")).otherwise(body), F.lit("\n")).alias("text"))

    def stream(self, events: DataFrame, offsets: str) -> None:
        """Fold a stream of events, whose source keeps count of what was read."""
        events.writeStream.foreachBatch(self.add).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
