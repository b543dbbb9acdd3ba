"""The memory store: one object over a ledger in Parquet, with the verbs that its users know."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import context, ingest, lexical, recall, segments
from tidemark.operators.tables import written_at
from tidemark.plans import jobs
from tidemark.streaming.folds import WriteKeys

LEDGER = "ord long, id string, type string, ts string, scope string, text string, tags array<string>, links array<string>, source_path string, session_id string, entity_id string, priority int, supersedes array<string>"
#: The tags that a project starts with.
BASE_TAGS = ("decision", "constraint", "source", "insight", "risk", "next-step", "contact")
OPTIONAL_TAGS = ("metric", "deadline", "process", "tool", "assumption")


LEDGER_COLUMNS = [x.split()[0] for x in LEDGER.split(", ")]
FEED = "ord long, op string, node_id string, text string, ts string"


class MemoryStore:
    """Appends are new Parquet files under ``root/ledger``; rows are ordered by ``ord``.

    ``ord`` is the time of writing in nanoseconds, and more than that of any row that this object wrote, so writers on several
    hosts need no common counter and an append reads nothing. Ids and facts that are known are kept as keys in
    buckets, of which a write reads those of its own keys. Small things (tags, where the indexes are, other settings) are one JSON
    document, written anew beside the old one; the newest counts.
    """

    def __init__(self, spark: SparkSession, root: str, project: str | None = None, clock=None):
        self.spark, self.root, self.project = spark, root.rstrip("/"), project
        self.clock = clock or (lambda: datetime.now(UTC).isoformat(timespec="seconds"))
        self.settings = self._settings()
        self._keys, self._last = None, 0
        self.tags = {*BASE_TAGS, *OPTIONAL_TAGS, *self.settings.get("tags", [])}

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _settings(self) -> dict:
        newest = self._read("settings", "ord long, value string").orderBy(F.desc("ord")).first()
        return json.loads(newest["value"]) if newest else {}

    def set(self, key: str, value) -> None:
        """Keep a setting."""
        self.settings = {**self._settings(), key: value}
        self.spark.createDataFrame([(time.time_ns(), json.dumps(self.settings))], "ord long, value string").coalesce(1).write.mode("append").parquet(f"{self.root}/settings")

    def nodes(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def feed(self) -> DataFrame:
        """The change feed that ``add_node`` writes."""
        return self._read("feed", FEED)

    def routing(self) -> DataFrame:
        return ingest.routing_index(self.nodes())

    def _next(self, n: int = 1) -> int:
        """The first of ``n`` numbers that this object has not used."""
        start = max(self._last + 1, time.time_ns())
        self._last = start + n - 1
        return start

    @property
    def keys(self) -> WriteKeys:
        """The keys of what was written; made from the ledger where it has none yet."""
        if self._keys is None:
            self._keys = WriteKeys(self.spark, f"{self.root}/keys")
            if not self._keys.keys.pointer.read({"number": 0})["number"]:
                self._keys.add(self.nodes())
        return self._keys

    def _append(self, rows: list[dict]) -> DataFrame:
        start = self._next(len(rows))
        names = self.spark.createDataFrame([], LEDGER).columns
        filled = [tuple({**r, "ord": start + i, "scope": self.project or "global"}.get(c) for c in names) for i, r in enumerate(rows)]
        df = self.spark.createDataFrame(filled, LEDGER)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")
        return df

    def add_nodes(self, nodes: DataFrame) -> DataFrame:
        """Write a table of nodes (the ledger's columns, as far as they are there) in the order of ``ord``, as ``add_node`` would one by one.

        Returns ord, id and status of each. Tags are not validated here (``context.tag_violations``).
        """
        keys, start = self.keys, self._next(1 << 40)
        full = self.spark.createDataFrame([], LEDGER).unionByName(nodes.select([c for c in nodes.columns if c in LEDGER_COLUMNS]), allowMissingColumns=True)
        rows = full.withColumn("ord", F.col("ord") + start).withColumn("scope", F.coalesce("scope", F.lit(self.project or "global"))).withColumn("ts", F.coalesce("ts", F.lit(self.clock())))
        told, path = written_at(keys.status(rows), "told")
        keys.clean()
        new = told.filter("status = 'write'").select(*LEDGER_COLUMNS)
        new.write.mode("append").parquet(f"{self.root}/ledger")
        new.select("ord", F.lit("add").alias("op"), F.col("id").alias("node_id"), "text", "ts").write.mode("append").parquet(f"{self.root}/feed")
        keys.add(new)
        return told.select((F.col("ord") - start).alias("ord"), "id", "status")

    def add_tag(self, *tags: str) -> list[str]:
        self.tags |= set(tags)
        self.set("tags", sorted(self.tags - {*BASE_TAGS, *OPTIONAL_TAGS}))
        return sorted(self.tags)

    def add_node(self, *, node_id: str, node_type: str, text: str = "", tags=None, links=None, supersedes=None, source_path=None, priority=0, ts=None) -> dict:
        """Write a node and tell the feed, unless its id or its fact (type, scope, text) is known; tags must be registered, one of them a base tag."""
        tags = list(tags or [])
        if self.project is not None and (not tags or set(tags) - self.tags or not set(tags) & set(BASE_TAGS)):
            raise ValueError(f"tags must be registered and hold a base tag: {tags}")
        row = {"id": node_id, "type": node_type, "ts": ts or self.clock(), "text": text, "tags": tags, "links": list(links or []), "source_path": source_path, "priority": priority, "supersedes": list(supersedes or [])}
        new = self.spark.createDataFrame([(node_id, node_type, self.project or "global", text)], "id string, type string, scope string, text string")
        status = self.keys.of_one(new)
        if status == "write":
            self.keys.add(self._append([row]))
            self.spark.createDataFrame([(self._next(), "add", node_id, text, row["ts"])], FEED).coalesce(1).write.mode("append").parquet(f"{self.root}/feed")
        return {**row, "status": status}

    def jot(self, text: str, *, tags=None) -> dict:
        """Write a quick note on its own; the feed is not told."""
        return self._jot([text], tags, False)[0]

    def jot_batch(self, texts: list[str], *, tags=None) -> list[dict]:
        """Write quick notes; one result for each text, a known one is skipped."""
        return self._jot(texts, tags, True)

    def _jot(self, texts: list[str], tags, placed: bool) -> list[dict]:
        batch = self.spark.createDataFrame(list(enumerate(texts)), "i long, text string")
        jots = self.nodes().filter(F.array_contains("tags", "jot"))
        ts = self.clock()
        out = [r.asDict() for r in ingest.jot_batch(batch, jots, self.project or "global", ts, placed).orderBy("i").collect()]  # a row for each text given
        new = [{"id": r["id"], "type": "note", "ts": ts, "text": r["text"], "tags": ["jot", *(tags or [])]} for r in out if r["status"] == "write"]
        if new:
            self.keys.add(self._append(new))
        return out

    def index(self) -> dict:
        """Write all indexes of the ledger as it is; lookups and recalls read them. The full-text index only takes in what was written since the last time."""
        nodes = self.nodes()
        upto = nodes.agg(F.max("ord")).first()[0] or 0
        self._index_texts(upto)
        self.set("index", {"ord": upto, "paths": jobs.index_full(nodes.filter(F.col("ord") <= upto), f"{self.root}/indexes")})
        return self.settings["index"]

    def _texts(self) -> segments.TextSegments:
        return segments.TextSegments(self.spark, f"{self.root}/segments")

    def _index_texts(self, upto: int | None = None) -> segments.TextSegments:
        """The full-text index with all nodes up to ``upto``, those that it lacks as one more segment."""
        index, after = self._texts(), self.settings.get("texts", 0)
        new = self.nodes().filter(F.col("ord") > after)
        new = new if upto is None else new.filter(F.col("ord") <= upto)
        last = new.agg(F.max("ord")).first()[0]
        if last is not None:
            index.apply(new.filter(F.col("ord") <= last))
            index.merge()
            self.set("texts", last)
        return index

    def lookup(self, query: str, *, limit: int = 10, index: bool = True) -> list[str]:
        if not index:
            return [r["text"] for r in lexical.lookup_scan(self.nodes(), query, limit).collect()]
        queries = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        if "index" in self.settings:
            found = self._index_texts().lookup(queries, limit)
        else:
            found = lexical.lookup_indexed(lexical.postings(self.nodes()), lexical.node_meta(self.nodes()), queries, limit)
        return [r["text"] for r in found.orderBy("rank").collect()]

    def recall(self, query: str, topk: int = 8, *, search=None, min_score: float = 0.35, hierarchical: bool = False, now: str | None = None, **filters) -> list[dict]:
        """The cascade: hierarchical if asked for, an external search if given, hybrid where chunks are indexed, then the ledger's scan.

        Each route's hits are filtered before they are cut; an external search knows no scope and
        serves recalls over all scopes only.
        """
        scope = filters.pop("scope", self.project)
        scan = lambda: recall.filtered(recall.hits_of(lexical.heuristic_scan(self.nodes(), query, None), "ledger_scan"), scope, **filters)
        routes = []
        if hierarchical:
            at = F.to_timestamp(F.lit(now or self.clock()))
            # without a summary to lead it, the next route is to answer
            routes.append(lambda: recall.hierarchical_search(scan(), topk, now=at).withColumn("_any", F.max((F.col("stage") == "summary").cast("int")).over(Window.partitionBy(F.lit(0)))).filter("_any = 1").drop("_any", "stage"))
        if search is not None:
            routes.append(lambda: recall.filtered(recall.external(self.spark, search, query, topk, min_score), scope, **filters))
        if "index" in self.settings:
            routes.append(lambda: recall.filtered(self._hybrid(query, scope), scope, **filters))
        return [r.asDict() for r in recall.cascade([*routes, scan], topk).collect()]

    def _hybrid(self, query: str, scope: str | None) -> DataFrame:
        chunks = self.spark.read.parquet(self.settings["index"]["paths"]["chunks"])
        chunks = chunks if scope is None else chunks.filter(F.col("scope_part") == jobs.scope_part(F.lit(scope)))
        asked = self.spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("query"), V.hash_embedding(F.lit(query)).alias("q"))
        # only with a full-text hit, as the nearest of hashed vectors says little
        found = recall.hybrid(chunks, asked, 200, 50, 20, scope).filter(F.forall(X.query_tokens(F.lit(query)), lambda t: F.contains(F.lower("text"), t)))
        return recall.hits_of(found.select(F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.col("project_id").alias("scope"), "score", "ts", "text", "source_path"), "hybrid")

    def query(self, **filters) -> DataFrame:
        return recall.structured(self.nodes(), **filters)

    def working_set(self, n: int = 20) -> list[dict]:
        return [r.asDict() for r in ingest.working_set(self.nodes(), n).collect()]

    def context(self, today: str, top: int = 5) -> list[dict]:
        return [r.asDict() for r in context.session_context(self.nodes(), self.project, F.to_date(F.lit(today)), top).collect()]
