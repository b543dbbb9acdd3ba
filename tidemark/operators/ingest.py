"""Writing and indexing: dedupe on write, jots, chunks, the change feed, routing, garbage, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as X


def dedupe_on_write(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows to write with status: write, SKIP_DUPLICATE_ID or SKIP_DUPLICATE_FACT (same type, scope and stripped text).

    The id is looked at first. Two anti-joins by key, no comparison of pairs.
    """
    ids = ledger.filter(F.col("id").isNotNull()).select(F.col("id").alias("_id")).distinct()
    fact = lambda prefix: [F.col("type").alias(f"{prefix}t"), F.coalesce("scope", F.lit("global")).alias(f"{prefix}s"), F.sha2(X.strip("text"), 256).alias(f"{prefix}x")]
    facts = ledger.filter(X.strip("text") != "").select(*fact("_l")).distinct()
    rows = new.select("*", *fact("_n"), (X.strip("text") != "").alias("_told"))
    rows = rows.join(ids, F.col("id") == F.col("_id"), "left").join(facts, F.col("_told") & F.col("_nt").eqNullSafe(F.col("_lt")) & (F.col("_ns") == F.col("_ls")) & (F.col("_nx") == F.col("_lx")), "left")
    status = F.when(F.col("_id").isNotNull(), "SKIP_DUPLICATE_ID").when(F.col("_lx").isNotNull(), "SKIP_DUPLICATE_FACT").otherwise("write")
    return rows.withColumn("status", status).select(*new.columns, "status")


def jot_id(project: str, ts: Column, text: Column, position: Column | None = None) -> Column:
    """The id of a quick note: a digest of its time, its position in a batch if it has one, and its text."""
    parts = [ts, text] if position is None else [ts, position.cast("string"), text]
    return F.concat(F.lit(f"jot:{project}-"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8))


def jot_batch(texts: DataFrame, jots: DataFrame, project: str, ts: str, placed: bool = True) -> DataFrame:
    """One row for each of ``texts`` (i, text): id, status. Known texts, or known earlier in the batch, are skipped.

    placed: the place in the batch is part of an id; a note on its own has none.
    """
    key = F.sha2(X.strip("text"), 256)
    known = jots.select(key.alias("_known")).distinct()
    rows = texts.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("i")))
    rows = rows.join(known, F.col("_k") == F.col("_known"), "left")
    dup = F.col("_known").isNotNull() | (F.col("_n") > 1)
    new_id = jot_id(project, F.lit(ts), F.col("text"), F.col("i") if placed else None)
    return rows.select("i", F.when(dup, F.lit(f"jot:{project}-dup")).otherwise(new_id).alias("id"), F.when(dup, "SKIP_DUPLICATE_FACT").otherwise("write").alias("status"), "text")


def working_set(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` quick notes, newest first by place in the ledger."""
    return nodes.filter(F.array_contains("tags", "jot")).orderBy(F.desc("ord")).limit(n).select("id", "ts", "text")


def chunk_rows(nodes: DataFrame, ledger: str = "nodes.jsonl", most: int = 800, separator: str = "\n\n", cutting: bool = False) -> DataFrame:
    """The chunk table: a row for each piece, with provenance; a node without a source points to its ledger line."""
    make = X.chunks_cutting if cutting else X.chunks
    rows = nodes.filter(F.col("id").isNotNull() & (X.strip("text") != "")).withColumn("_c", make("text", most, separator))
    source = F.coalesce(F.nullif("source_path", F.lit("")), F.concat(F.lit(f"{ledger}#"), "id"))
    return rows.select(
        F.col("id").alias("node_id"), F.posexplode("_c").alias("_i", "chunk"), F.coalesce("scope", F.lit("global")).alias("project_id"), F.col("type").alias("node_type"), source.alias("source_path"), "ts",
    ).select("node_id", F.format_string("c%03d", "_i").alias("chunk_id"), "project_id", "node_type", "source_path", "ts", F.col("chunk").alias("text"), F.sha2("chunk", 256).alias("text_sha256"))


def upsert_chunks(current: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in place of all chunks of its nodes."""
    return current.join(new.select("node_id").distinct(), "node_id", "left_anti").unionByName(new, allowMissingColumns=True)


def count_chunks(chunks: DataFrame) -> DataFrame:
    """(project_id, n_nodes, n_chunks)."""
    return chunks.groupBy("project_id").agg(F.count_distinct("node_id").alias("n_nodes"), F.count("*").alias("n_chunks"))


def delete_chunks(current: DataFrame, gone: DataFrame) -> DataFrame:
    return current.join(gone.select("node_id").distinct(), "node_id", "left_anti")


def wal_latest(wal: DataFrame) -> DataFrame:
    """The last operation of each node; rows without an operation or a node are skipped."""
    rows = wal.filter(F.col("op").isNotNull() & F.col("node_id").isNotNull())
    return rows.groupBy("node_id").agg(F.max_by(F.struct("op", "text", "ts", "ord"), "ord").alias("l"), F.count("*").alias("n_ops")).select("node_id", "l.*", "n_ops")


def wal_state(wal: DataFrame, ledger: DataFrame | None = None, prefer_wal_text: bool = False) -> DataFrame:
    """What is left after the feed: node_id, text, ts, op. A ledger text wins over the feed's unless told otherwise; the time is the feed's."""
    live = wal_latest(wal).filter("op <> 'delete'")
    if ledger is None:
        return live.select("node_id", "text", "ts", "op")
    first = ledger.groupBy(F.col("id").alias("_id")).agg(F.min_by("text", "ord").alias("_text"))
    mine, theirs = F.nullif("text", F.lit("")), F.nullif("_text", F.lit(""))
    text = F.coalesce(mine, theirs) if prefer_wal_text else F.coalesce(theirs, mine)
    return live.join(first, F.col("node_id") == F.col("_id"), "left").select("node_id", text.alias("text"), "ts", "op")


def wal_stats(wal: DataFrame) -> DataFrame:
    n = lambda op: F.count_if(F.col("op") == op).cast("long")
    return wal.agg(n("add").alias("added"), n("delete").alias("deleted"), n("update").alias("updated"), F.count_if(F.col("op").isNull() | F.col("node_id").isNull()).cast("long").alias("skipped"))


def routing_index(nodes: DataFrame) -> DataFrame:
    """(scope, kind, value): each scope's distinct node ids and tags, as rows, so a scope may be of any size."""
    scope = F.coalesce("scope", F.lit("global")).alias("scope")
    ids = nodes.filter(F.col("id").isNotNull()).select(scope, F.lit("node").alias("kind"), F.col("id").alias("value"))
    tags = nodes.select(scope, F.lit("tag").alias("kind"), F.explode("tags").alias("value"))
    return ids.union(tags).distinct()


def routing_summary(nodes: DataFrame, dossiers: DataFrame | None = None, most_tags: int = 1000) -> DataFrame:
    """A row a scope: numbers of ids and tags, its tags, and its dossier, kept from (scope, dossier) or the default.

    Tags are listed for scopes with up to ``most_tags`` of them (null beyond; ``routing_index`` has them all as rows).
    """
    index = routing_index(nodes)
    n = lambda kind: F.count_if(F.col("kind") == kind).cast("long")
    counts = index.groupBy("scope").agg(n("node").alias("n_nodes"), n("tag").alias("_tags"))
    few = counts.filter(F.col("_tags") <= most_tags).select(F.col("scope").alias("_s"))
    listed = index.filter("kind = 'tag'").join(few, F.col("scope") == F.col("_s"), "left_semi").groupBy(F.col("scope").alias("_s")).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("tags"))
    out = counts.join(listed, F.col("scope") == F.col("_s"), "left").select("scope", "n_nodes", F.when(F.col("_tags") == 0, F.lit("")).otherwise(F.col("tags")).alias("tags"))
    default = F.concat(F.lit("projects/"), "scope", F.lit(".md"))
    if dossiers is None:
        return out.withColumn("dossier", default)
    return out.join(dossiers.select("scope", F.col("dossier").alias("_d")), "scope", "left").withColumn("dossier", F.coalesce("_d", default)).drop("_d")


def expired(now: Column) -> Column:
    """Excerpts whose time is over and that nobody pinned; one that cannot be read does not expire."""
    return (F.col("type") == "excerpt") & ~F.coalesce("pinned", F.lit(False)) & F.coalesce(C.instant(F.col("expires_at")) < now, F.lit(False))


def gc_report(excerpts: DataFrame, now: Column) -> DataFrame:
    rows = excerpts.filter("type = 'excerpt'").withColumn("_x", expired(now))
    no_file = F.coalesce("source_path", F.lit("")) == ""
    n = lambda c: F.count_if(c).cast("long")
    return rows.agg(n(F.col("_x") & ~no_file).alias("deleted"), n(~F.col("_x")).alias("kept"), n(F.col("_x") & no_file).alias("missing"))


def audit(chunks: DataFrame, roots: tuple[str, ...], recent: int | None = 50) -> DataFrame:
    """The last chunks whose provenance is missing or outside the allowed roots (an #anchor does not count)."""
    rows = chunks if recent is None else chunks.orderBy(F.desc("created_at"), "node_id", "chunk_id").limit(recent)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    path = F.substring_index("source_path", "#", 1)
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.startswith(path, F.lit(root))
    reason = F.when(blank("node_id") | blank("project_id"), "no key").when(blank("source_path") & blank("session_id") & blank("entity_id"), "no provenance").when(~blank("source_path") & ~inside, "outside roots")
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def cache_split(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``texts`` (key, text) with their cached vectors, by digest: hit says whether there is one; only misses are to be computed."""
    rows = texts.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = cache.groupBy(F.col("text_sha256").alias("_sha")).agg(F.min_by("vector", "vector").alias("vector"))
    return rows.join(known, F.col("text_sha256") == F.col("_sha"), "left").withColumn("hit", F.col("_sha").isNotNull()).drop("_sha")


def cached_embeddings(texts: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """Vectors of all texts, each distinct missing text embedded once."""
    split = cache_split(texts, cache)
    missing = split.filter("not hit").groupBy("text_sha256").agg(F.min("text").alias("text")).select(F.col("text_sha256").alias("_sha"), embed(F.col("text")).alias("_new"))
    return split.join(missing, F.col("text_sha256") == F.col("_sha"), "left").withColumn("vector", F.coalesce("vector", "_new")).drop("_sha", "_new")


#: Keys of a node's meta that its document's head has already, or that say how to treat it.
HEAD_KEYS = ("priority", "supersedes", "pinned", "expiresAt", "source_path", "path", "artifact_id")


def extra_meta(meta_json: Column) -> Column:
    """The other keys of a meta as ``- key: value`` lines by key, an array; values that are no text or number are left out."""
    known = F.map_filter(F.from_json(meta_json, "map<string,string>"), lambda k, v: ~k.isin(*HEAD_KEYS) & v.isNotNull())
    return F.transform(F.array_sort(F.map_entries(known)), lambda x: F.concat(F.lit("- "), x["key"], F.lit(": "), x["value"]))


def node_markdown(meta_json: Column | None = None) -> Column:
    """A node as a document of its own, with a section for what else its meta holds."""
    line = lambda label, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c.cast("string")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]")))
    title = F.initcap(F.replace(F.replace("id", F.lit(":"), F.lit(": ")), F.lit("-"), F.lit(" ")))
    head = F.array_compact(F.array(F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("type: "), "type"), F.concat(F.lit("scope: "), F.coalesce("scope", F.lit("global"))), line("ts", F.col("ts")), tags, F.when(F.col("priority") != 0, line("priority", F.col("priority"))), line("source", F.col("source_path")), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit("")))
    body = F.when(F.coalesce("text", F.lit("")) != "", F.array(F.col("text"), F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
    if meta_json is not None:
        lines = F.coalesce(extra_meta(meta_json), F.expr("cast(array() as array<string>)"))
        body = F.concat(body, F.when(F.size(lines) > 0, F.concat(F.array(F.lit("## Metadata")), lines, F.array(F.lit("")))).otherwise(F.expr("cast(array() as array<string>)")))
    return F.array_join(F.concat(head, body), "\n")


def rendered(nodes: DataFrame) -> DataFrame:
    """(filename, markdown): the last of nodes with one file name wins."""
    rows = nodes.filter(F.col("id").isNotNull()).withColumn("filename", F.concat(X.safe_filename("id"), F.lit(".md")))
    return rows.withColumn("markdown", node_markdown(F.col("meta_json") if "meta_json" in nodes.columns else None)).groupBy("filename").agg(F.max_by("markdown", "ord").alias("markdown"))


def ledger_view(nodes: DataFrame) -> DataFrame:
    """(ord, section): each node as a section; ordered newest first, it is the rendered ledger."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("- tags: "), F.array_join("tags", ", "), F.lit("\n"))).otherwise("")
    section = F.concat(F.lit("## "), "id", F.lit("\n- type: `"), "type", F.lit("`\n- scope: `"), F.coalesce("scope", F.lit("")), F.lit("`\n- ts: `"), "ts", F.lit("`\n"), tags, F.lit("\n"), X.strip("text"), F.lit("\n\n---\n"))
    return nodes.select("ord", "ts", section.alias("section")).orderBy(F.desc("ts"), "ord")
