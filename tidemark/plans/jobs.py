"""Jobs made of the operators: indexes in full and from the feed, session checkpoints, documents, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import context, ingest, lexical, sessions
from tidemark.sources import files

TTL_DAYS = 30


#: Ranges that stored postings are dealt into by a hash of their token, so a lookup reads those of its tokens only.
TOKEN_PARTS = 64
#: Folders of stored chunks, whatever the number of scopes.
SCOPE_PARTS = 64


def token_part(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(TOKEN_PARTS)).cast("int")


def scope_part(scope: Column) -> Column:
    """Which of SCOPE_PARTS a scope's chunks are stored in; a number, so a filter on a literal scope's part prunes folders."""
    return F.pmod(F.xxhash64(scope), F.lit(SCOPE_PARTS)).cast("int")


def dealt_postings(nodes: DataFrame) -> DataFrame:
    """Postings with their range, each range in one place and by token."""
    posted = lexical.postings(nodes).withColumn("part", token_part(F.col("token")))
    return posted.repartition("part", F.pmod(F.xxhash64("node_id"), F.lit(8))).sortWithinPartitions("part", "token")


def index_full(nodes: DataFrame, root: str, embed: str = "hash", int8: bool = True) -> dict[str, str]:
    """Chunks with vectors, postings, node metadata and the routing index, each a new snapshot; its paths by name."""
    chunks = ingest.chunk_rows(nodes).withColumn("embedding", V.embedder(embed)(F.col("text")).cast("array<float>")).withColumn("embedding_backend", F.lit(embed))
    chunks = chunks.withColumn("embedding_int8", V.to_int8_blob("embedding")) if int8 else chunks
    chunks = chunks.withColumn("scope_part", scope_part(F.col("project_id")))
    parts = {"chunks": (chunks, ("scope_part",)), "postings": (dealt_postings(nodes), ("part",)), "node_meta": (lexical.node_meta(nodes), ()), "routing": (ingest.routing_index(nodes), ("kind",))}
    return {name: files.write_snapshot(df, f"{root.rstrip('/')}/{name}", by) for name, (df, by) in parts.items()}


def stored_lookup(spark: SparkSession, paths: dict[str, str], queries: DataFrame, k: int = 10, newer: DataFrame | None = None) -> DataFrame:
    """``lexical.lookup_indexed`` over what ``index_full`` has written, and over nodes that are ``newer``; ranges without a token asked for are not read.

    At most TOKEN_PARTS numbers are collected; the join that follows is by token.
    """
    asked = lexical.query_terms(queries, None).select(token_part(F.col("token")).alias("part")).distinct().collect()
    posted = spark.read.parquet(paths["postings"]).filter(F.col("part").isin([r["part"] for r in asked])).drop("part")
    meta = spark.read.parquet(paths["node_meta"])
    if newer is not None:
        fresh = lexical.node_meta(newer)
        posted = posted.unionByName(lexical.postings(newer)).distinct()
        meta = meta.join(fresh.select("node_id"), "node_id", "left_anti").unionByName(fresh)
    return lexical.lookup_indexed(posted, meta, queries, k)


def report(spark: SparkSession, path: str, job: str, counts: dict[str, int], now: str) -> None:
    """Append what a job did as one JSON line."""
    spark.createDataFrame([(now, job, counts)], "ts string, job string, counts map<string,bigint>").coalesce(1).write.mode("append").json(path)


def index_fast(wal: DataFrame, ledger: DataFrame, chunks: DataFrame, embed: str = "hash", prefer_wal_text: bool = False) -> DataFrame:
    """The chunk table after the feed: touched nodes are chunked anew, deleted ones dropped; others stay as they are.

    An add whose text gives no chunk leaves the node's chunks in place; an update drops them first.
    """
    live = ingest.wal_state(wal, ledger, prefer_wal_text)
    meta = ledger.groupBy(F.col("id").alias("_id")).agg(F.min_by(F.struct("type", "scope", "source_path"), "ord").alias("m"))
    touched = live.join(meta, F.col("node_id") == F.col("_id"), "left").select(F.col("node_id").alias("id"), F.coalesce("m.type", F.lit("note")).alias("type"), "m.scope", "m.source_path", "text", "ts", "op")
    new = ingest.chunk_rows(touched).withColumn("embedding", V.embedder(embed)(F.col("text")).cast("array<float>"))
    empty_adds = touched.filter((F.col("op") == "add") & (X.strip("text") == "")).select(F.col("id").alias("node_id"))
    gone = ingest.wal_latest(wal).select("node_id").join(empty_adds, "node_id", "left_anti")
    return ingest.delete_chunks(chunks, gone).unionByName(new, allowMissingColumns=True)


def changed_logs(found: DataFrame, status: DataFrame) -> DataFrame:
    """Logs (path, size, modified) that differ from the last checkpoint's; unchanged ones are skipped."""
    return found.join(status.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def list_logs(spark: SparkSession, roots: str | list[str], most: int | None = 50) -> DataFrame:
    """(path, size, modified) of the logs of one or several roots, newest first."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(roots).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    ordered = found.orderBy(F.desc("modified"), "path")
    return ordered if most is None else ordered.limit(most)


def checkpoint(spark: SparkSession, roots: str | list[str], status: DataFrame, limit_messages: int = 160, most_text: int = 280) -> tuple[DataFrame, DataFrame]:
    """Summaries (session, text) of the logs that changed, and the status to keep."""
    found = list_logs(spark, roots)
    changed = changed_logs(found, status)
    paths = [f"{r.rstrip('/')}/*.jsonl" for r in ([roots] if isinstance(roots, str) else roots)]
    events = files.parse_flat_sessions(files.lines(spark, paths)).join(changed.select(F.col("path").alias("session")), "session", "left_semi")
    return sessions.summary_markdown(events, limit_messages, most_text), found


STATUS = "path string, size long, modified timestamp, at string"


def checkpoint_to(spark: SparkSession, roots: str | list[str], store: str, now: str) -> str:
    """``checkpoint`` with its status kept under ``store``: returns where the summaries of what changed are."""
    try:
        kept = spark.read.schema(STATUS).parquet(f"{store}/status")
    except Exception as e:  # the first time there is none
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = spark.createDataFrame([], STATUS)
    last = kept.filter(F.col("at") == (kept.agg(F.max("at")).first()[0] or ""))
    made, found = checkpoint(spark, roots, last)
    path = files.write_snapshot(made, f"{store.rstrip('/')}/summaries")
    # the status moves after the summaries are whole
    found.withColumn("at", F.lit(now)).write.mode("append").parquet(f"{store}/status")
    return path


def promote(store, candidates: DataFrame, tag: str = "decision") -> list[dict]:
    """Write promotion candidates, few by their limit, through the store; known ones are skipped."""
    return [store.add_node(node_id=c["id"], node_type=c["type"], text=c["text"], tags=[tag]) for c in candidates.orderBy("ord").collect()]


def excerpt_hash() -> Column:
    """A digest of an excerpt's session and messages, in this engine's own canonical form."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct("session", "messages")), 256))


def excerpt_nodes(window: DataFrame, existing: DataFrame, scope: str, now: Column, ttl_days: int = TTL_DAYS, pinned: bool = False, chars: int = 20_000) -> DataFrame:
    """A node for each session's excerpt (session, ord, role, text) whose digest no existing node (hash) has.

    Windows are bounded, so a session's excerpt is gathered whole.
    """
    cut = sessions.excerpt_text(window, chars)
    per = cut.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "text"))).alias("messages")).withColumn("hash", excerpt_hash())
    fresh = per.join(existing.select("hash").distinct(), "hash", "left_anti")
    body = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("### "), m["role"], F.lit("\n\n"), m["text"])), "\n\n---\n\n")
    expires = F.lit(None).cast("string") if pinned else F.date_format(now + F.make_dt_interval(F.lit(ttl_days)), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return fresh.select(F.concat(F.lit("excerpt:"), X.slug("session", 60, "excerpt")).alias("id"), F.lit("excerpt").alias("type"), F.lit(scope).alias("scope"), body.alias("text"), "hash", F.lit(pinned).alias("pinned"), expires.alias("expires_at"))


def topic_nodes(snippets: DataFrame, scope: str, day: str) -> DataFrame:
    """A node for each session and topic of ``topic_snippets``, a bounded number of snippets each."""
    per = snippets.groupBy("session", "topic").agg(F.array_sort(F.collect_list(F.struct("n", "snippet"))).alias("s"))
    return per.select(F.concat_ws("-", F.lit(f"excerpt:{scope}"), "topic", X.slug("session", 60, "session"), F.lit(day)).alias("id"), F.lit("excerpt").alias("type"), F.lit(scope).alias("scope"), F.array_join(F.transform("s", lambda x: x["snippet"]), "\n").alias("text"), F.array(F.lit("session"), F.col("topic")).alias("tags"))


def merged_buckets(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry (bucket, keyword, hits) with buckets that it did not have."""
    return registry.unionByName(new.join(registry.select("bucket"), "bucket", "left_anti"))


def proposal(candidates: DataFrame, source: str, now: str) -> DataFrame:
    """Promotion candidates as one text, in rank order; the candidates are few by their limit."""
    rank = F.array_position(F.array(*map(F.lit, sessions.TYPE_ORDER)), F.col("type"))
    line = F.concat(F.lit("- **"), "type", F.lit("** `"), "id", F.lit("` scope=`"), "scope", F.lit("`\n  - "), "text")
    rows = candidates.agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.length("text").alias("l"), "ord", line.alias("line")))).alias("c"))
    body = F.when(F.size("c") == 0, F.lit("Nothing to promote.")).otherwise(F.concat(F.lit("## Facts\n"), F.array_join(F.transform("c", lambda x: x["line"]), "\n")))
    return rows.select(F.concat(F.lit(f"# To be promoted, as of {now}\n\nFrom: `{source}`\n\n"), body, F.lit("\n")).alias("text"))


def working_set_document(memory: DataFrame, core: DataFrame, events: DataFrame, state: dict, now: str) -> DataFrame:
    """The working set as one text, from lines of three files and the state; each part is bounded by its scan."""

    def part(title: str, rows: DataFrame, column: str, prefix: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda x: F.concat(F.lit(prefix), x[column])), "\n")
        return rows.agg(F.concat(F.lit(f"## {title}\n"), F.when(F.count("*") == 0, F.lit("- (none)")).otherwise(text), F.lit("\n")).alias("t"))

    blockers = [f"- ({b.get('type', 'blocker')}) {b.get('detail', '')}".rstrip() if isinstance(b, dict) else f"- {b}" for b in (state.get("blockers") or [])[:5]]
    head = f"<!-- made by a job; changes are lost -->\n# Working set\n\nas of {now}, mode {state.get('mode', 'build')}\n"
    middle = "## Blockers\n" + "\n".join(blockers or ["- (none)"]) + "\n"
    rules = part("Hard rules", files.hard_rules(memory), "rule", "- ").withColumnRenamed("t", "a")
    policy = part("Policy", files.bullets(core), "line", "").withColumnRenamed("t", "b")
    recent = part("Last events", events.select("ord", files.tail_text().alias("line")), "line", "- ").withColumnRenamed("t", "c")
    one = rules.join(F.broadcast(policy), F.lit(True)).join(F.broadcast(recent), F.lit(True))  # one row each
    return one.select(F.concat_ws("\n", F.lit(head), "a", "b", F.lit(middle), "c").alias("text"))


def maintain(nodes: DataFrame, chunks: DataFrame, excerpts: DataFrame, now: Column, roots: tuple[str, ...], chars: int = 900) -> dict[str, DataFrame]:
    """What regular maintenance reports: rendered nodes, the core policy, expired excerpts, chunks in doubt."""
    return {"rendered": ingest.rendered(nodes), "policy": context.policy_document(nodes, chars), "expired": ingest.gc_report(excerpts, now), "audit": ingest.audit(chunks, roots)}
