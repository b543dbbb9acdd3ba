"""Readers of ledgers, change feeds, session logs, registries and Markdown, and writers of tables and texts.

Lines keep their order: ``ord`` grows along a file, from where the line's block begins and its place in
what a task reads, so no ordering depends on how Spark deals the blocks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.classify import iso_of_millis

NODE_KEYS = ("id", "type", "ts", "scope", "text")
#: The names under which provenance is found in a node's meta.
ALIASES = {"session_id": ("session_id", "session"), "entity_id": ("entity_id", "desk_id", "agent_id"), "source_path": ("source_path", "path", "artifact_id")}


#: Blocks that Spark cuts files into begin at least so many bytes apart.
LEAST_BLOCK_BITS = 16


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, line): every line of the files; bytes that are no UTF-8 become U+FFFD.

    Files are cut into blocks and read side by side. ``ord`` grows along a file: the number of the
    block's place, then the line's place in its task; a small file read alone has its lines counted from 0.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    block = F.shiftright(F.col("_metadata.file_block_start"), LEAST_BLOCK_BITS)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # without the task's number
    return rows.select(F.col("_metadata.file_path").alias("file"), F.shiftleft(block, 33).bitwiseOR(place).alias("ord"), F.make_valid_utf8("value").alias("line"))


def objects(rows: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, as a variant ``v``; blank lines, bad JSON, lists and scalars are skipped."""
    parsed = rows.filter(F.trim("line") != "").withColumn("v", F.try_parse_json(F.trim("line")))
    return parsed.filter(F.startswith(F.coalesce(F.schema_of_variant("v"), F.lit("")), F.lit("OBJECT")))


def get(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def strings(path: str) -> Column:
    """A list of strings, or one string as a list of itself; null if absent."""
    many, one = get(path, "array<string>"), get(path)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def first_text(*paths: str) -> Column:
    """The first of the paths that is neither absent nor empty."""
    return F.coalesce(*[F.nullif(get(p), F.lit("")) for p in paths])


def parse_nodes(rows: DataFrame) -> DataFrame:
    """Ledger lines (ord, line) as nodes; a missing scope is global; meta stays as JSON text beside what is read from it."""
    provenance = [first_text(*[f"$.meta.{n}" for n in names]).alias(c) for c, names in ALIASES.items()]
    return objects(rows).select(
        "ord", *[get(f"$.{k}").alias(k) for k in NODE_KEYS if k != "scope"], F.coalesce(get("$.scope"), F.lit("global")).alias("scope"), strings("$.tags").alias("tags"), strings("$.links").alias("links"), *provenance,
        F.coalesce(get("$.meta.priority").try_cast("int"), F.lit(0)).alias("priority"), F.coalesce(get("$.meta.pinned", "boolean"), F.lit(False)).alias("pinned"), get("$.meta.expiresAt").alias("expires_at"), F.coalesce(strings("$.meta.supersedes"), F.array().cast("array<string>")).alias("supersedes"), get("$.meta").alias("meta_json"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_nodes(lines(spark, path))


def parse_wal(rows: DataFrame) -> DataFrame:
    """Change-feed lines that name an operation and a node: ord, op, node_id, text, ts."""
    out = objects(rows).select("ord", *[get(f"$.{k}").alias(k) for k in ("op", "node_id", "text", "ts")])
    return out.filter(F.col("op").isNotNull() & F.col("node_id").isNotNull())


def parse_nested_sessions(rows: DataFrame, tool_results: bool = True) -> DataFrame:
    """Messages of logs whose content is a list of parts: session, ord, id, ts, role, text of the text parts."""
    parts = F.from_json(get("$.message.content"), "array<struct<type:string,text:string>>")
    texts = F.filter(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != "")
    out = objects(rows).filter(get("$.type") == "message").select(F.col("file").alias("session"), "ord", get("$.id").alias("id"), F.coalesce(get("$.timestamp"), F.lit("")).alias("ts"), F.coalesce(get("$.message.role"), F.lit("")).alias("role"), F.trim(F.array_join(texts, "\n")).alias("text"))
    out = out.filter(F.coalesce("text", F.lit("")) != "")
    return out if tool_results else out.filter("role <> 'toolResult'")


def parse_flat_sessions(rows: DataFrame) -> DataFrame:
    """Events of logs with loose keys: session, ord, ts, kind (message, tool, error, other), role, text.

    A numeric time is milliseconds since 1970. A line is of the first kind that fits.
    """
    number = F.coalesce(*[F.nullif(get(f"$.{k}", "double"), F.lit(0.0)) for k in ("time", "ts", "createdAt")])
    ts = F.coalesce(*[F.when(F.startswith(F.schema_of_variant(F.variant_get("v", f"$.{k}", "variant")), F.lit("STRING")), F.nullif(get(f"$.{k}"), F.lit(""))) for k in ("time", "ts", "createdAt")], iso_of_millis(number))
    kind, role = get("$.type"), get("$.role")
    body = F.coalesce(*[F.coalesce(F.array_join(get(f"$.{k}", "array<string>"), " "), F.nullif(get(f"$.{k}"), F.lit(""))) for k in ("message", "text", "content")])
    error = F.nullif(get("$.error"), F.lit(""))
    what = (
        F.when(role.isin("user", "assistant") | kind.isin("user", "assistant", "message"), "message")
        .when(F.contains(F.lower(kind), F.lit("tool")), "tool")
        .when(error.isNotNull(), "error")
        .otherwise("other")
    )
    said = F.when(what == "message", body).when(what == "tool", F.coalesce(error, get("$.message"), get("$.result"))).when(what == "error", error)
    return objects(rows).select(F.col("file").alias("session"), "ord", ts.alias("ts"), what.alias("kind"), F.coalesce(role, kind, F.lit("message")).alias("role"), said.alias("text"))


def newest_session(spark: SparkSession, roots: list[str], names: str = "*.jsonl") -> DataFrame:
    """(path, modified) of the newest log under the first root that has any; logs of the sessions' own list do not count."""
    for root in roots:
        found = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true")
        try:
            files = found.load(root).select("path", F.unix_micros("modificationTime").alias("us")).filter(~F.col("path").endswith("sessions.jsonl"))
            newest = files.orderBy(F.desc("us"), "path").limit(1).collect()  # read here, so that the files are looked at once
            if newest:
                return spark.createDataFrame(newest, "path string, us long").select("path", F.timestamp_micros("us").alias("modified"))
        except Exception as e:  # a root that does not exist has no logs
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], "path string, modified timestamp")


def rule_ids(rows: DataFrame) -> DataFrame:
    """Ids that a compiled policy lists as ``- (rule:...)``."""
    return rows.select(F.regexp_extract(F.trim("line"), r"^- \(\s*(rule:[^)]*?)\s*\)", 1).alias("id")).filter("id <> ''").distinct()


def hard_rules(rows: DataFrame, most: int = 8) -> DataFrame:
    """The first lines that state a hard rule."""
    found = rows.select("ord", F.regexp_extract(F.trim("line"), r"(?i)^- hard rule:(.*)$", 1).alias("rule")).filter("rule <> ''")
    return found.orderBy("ord").limit(most).select("ord", F.trim("rule").alias("rule"))


def bullets(rows: DataFrame, most: int = 8) -> DataFrame:
    return rows.select("ord", F.trim("line").alias("line")).filter(F.startswith("line", F.lit("-"))).orderBy("ord").limit(most)


def tail(rows: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` lines that are not blank, each at most 200 characters."""
    return rows.filter(F.trim("line") != "").orderBy(F.desc("ord")).limit(n).select("ord", tail_text().alias("line"))


def tail_text() -> Column:
    return F.when(F.length("line") > 200, F.concat(F.substring("line", 1, 200), F.lit("…"))).otherwise(F.col("line"))


def read_registry(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """A small JSON document (tags, topics, routes), or the default where it is absent or unreadable."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except Exception:  # registries are optional by contract
        return {} if default is None else default


def write_snapshot(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new snapshot beside the old ones and return its path; readers change over when they are told the path."""
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def rename_only(spark: SparkSession, folder: str, path: str) -> None:
    """Give the one part file of a written folder a name of its own."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = [f.getPath() for f in system.listStatus(source) if f.getPath().getName().startswith("part-")]
    if len(part) != 1:
        raise ValueError(f"{folder} has {len(part)} part files, not one")
    system.rename(part[0], target)
    system.delete(source, True)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append nodes as JSON lines; null keys are left out."""
    df.write.mode("append").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """(filename, markdown) as files ``path``/filename, each written by the task that has its row."""
    folder = path.rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    df.select("filename", "markdown").mapInArrow(put, "n long").agg(F.sum("n")).collect()


def write_logs(rows: DataFrame, path: str) -> None:
    """(name, ord, line) as files ``path``/name, a name's lines in the order of ``ord``, each file written by one task as its lines come.

    No file is renamed and nothing is held for a name, so the driver's work does not grow with the number of files.
    """
    folder = path.rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)
        last, out = None, None
        for b in batches:
            for name, some in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), key=itemgetter(0)):
                if name != last:
                    if out:
                        out.close()
                    last, out = name, system.open_output_stream(f"{root}/{name}")
                out.write("".join(f"{line}\n" for _, line in some).encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
        if out:
            out.close()

    rows.repartition("name").sortWithinPartitions("name", "ord").select("name", "line").mapInArrow(put, "n long").agg(F.sum("n")).collect()


MESSAGES = T.StructType([T.StructField(c, T.StringType()) for c in ("session", "id", "ts", "role", "text")])
