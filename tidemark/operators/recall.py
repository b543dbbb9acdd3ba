"""Scoped retrieval: structured queries, vector and hybrid search, hierarchical recall, the cascade.

Hits are node_id, node_type, project_id, score, ts, source_path, session_id, entity_id, preview and method.
"""

from __future__ import annotations

import json
import subprocess
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import lexical, tiles

GLOBAL = "global"


def structured(nodes: DataFrame, scope: str | None = None, node_type: str | None = None, tags: tuple[str, ...] = (), node_id: str | None = None, contains: str | None = None, limit: int | None = 20) -> DataFrame:
    """Nodes that meet all that is asked; all of the tags; the substring in any case; newest first."""
    out = nodes
    for column, value in (("scope", scope), ("type", node_type), ("id", node_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if tags:
        out = out.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    if contains:
        out = out.filter(F.contains(F.lower(F.concat_ws("\n", "id", "type", "scope", "text", lexical.meta_of(nodes))), F.lit(contains.lower())))
    return out if limit is None else out.orderBy(F.coalesce("ts", F.lit("")).desc(), "ord").limit(limit)


def filtered(hits: DataFrame, scope: str | None, node_type: str | None = None, session_id: str | None = None, entity_id: str | None = None, strict_provenance: bool = False) -> DataFrame:
    """Hits within the scope (None: all); an unknown scope is outside any. To be applied before any cut."""
    out = hits
    for column, value in (("project_id", scope), ("node_type", node_type), ("session_id", session_id), ("entity_id", entity_id)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if strict_provenance:
        known = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("source_path", "session_id", "entity_id")]
        out = out.filter(known[0] | known[1] | known[2])
    return out


def hits_of(nodes: DataFrame, method: str) -> DataFrame:
    """Scored nodes as hits."""
    absent = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    return nodes.select(
        F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.col("scope").alias("project_id"), F.col("score").cast("double").alias("score"), "ts",
        absent("source_path").alias("source_path"), absent("session_id").alias("session_id"), absent("entity_id").alias("entity_id"), F.substring(F.coalesce("text", F.lit("")), 1, 180).alias("preview"), F.lit(method).alias("method"),
    )


def heuristic(nodes: DataFrame, query: str, scope: str | None, k: int = 8, **filters) -> DataFrame:
    """Scan hits within the scope, cut after the filter."""
    found = filtered(hits_of(lexical.heuristic_scan(nodes, query, None), "ledger_scan"), scope, **filters)
    return found.orderBy(F.desc("score"), F.coalesce("ts", F.lit("")).desc(), "node_id").limit(k)


def vector_topk(chunks: DataFrame, query: list[float] | Column, k: int = 20, scope: str | None = None) -> DataFrame:
    """The ``k`` chunks whose embedding is closest by cosine; the query is a literal, so rows are only scanned."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    rows = chunks.filter(F.col("embedding").isNotNull())
    rows = rows if scope is None else rows.filter(F.col("project_id") == scope)
    return rows.withColumn("score", V.cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "node_id", "chunk_id").limit(k)


def vector_topk_of_each(chunks: DataFrame, queries: DataFrame, k: int = 20, scope: str | None = None, key: str | None = None) -> DataFrame:
    """``vector_topk`` for each of ``queries`` (query_id, q): among all chunks, or those of the same ``key``; compared in tiles, each of which sends on its best only."""
    rows = chunks.filter(F.col("embedding").isNotNull())
    rows = rows if scope is None else rows.filter(F.col("project_id") == scope)
    return lexical.top(tiles.vector_top(rows, queries, k, key), k, F.desc("score"), F.asc("node_id"), F.asc("chunk_id"))


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 8, lexical_n: int = 50, vector_n: int = 20, scope: str | None = None, missing_penalty: float = 0.20) -> DataFrame:
    """For each of ``queries`` (query_id, query, q): full-text and vector hits among the chunks of the scope, together and ranked anew.

    Full-text hits are the ``lexical_n`` chunks by BM25 that hold all tokens of ``query``, vector hits the ``vector_n``
    closest to ``q``; both are chosen within the scope. A chunk scores its cosine (0 if not among the
    vector hits), 0.05 as a full-text hit, 0.10 if a scope was asked for, less ``missing_penalty`` without provenance.
    """
    keys = ["node_id", "chunk_id"]
    within = chunks if scope is None else chunks.filter(F.col("project_id") == scope)
    texts = within.filter(F.col("text").isNotNull()).select(F.struct(*keys).alias("id"), "text")
    found = lexical.bm25(texts, queries.select("query_id", "query"), lexical_n, all_terms=True).select("query_id", "node_id.*", F.lit(True).alias("_lex"))
    near = vector_topk_of_each(within.select(*keys, "project_id", "embedding"), queries.select("query_id", "q"), vector_n).select("query_id", *keys, F.col("score").alias("_vec"))
    both = found.join(near, ["query_id", *keys], "full_outer")
    known = F.lit(False)
    for c in ("source_path", "session_id", "entity_id"):
        if c in chunks.columns:
            known = known | (F.coalesce(F.col(c), F.lit("")) != "")
    score = F.coalesce("_vec", F.lit(0.0)) + F.when(F.col("_lex"), 0.05).otherwise(0.0) + F.lit(0.10 if scope is not None else 0.0) - F.when(known, 0.0).otherwise(missing_penalty)
    rows = both.join(within.drop("embedding"), keys).withColumn("score", score).drop("_lex", "_vec")
    return lexical.top(rows, k, F.desc("score"), F.desc("project_id"), F.desc("node_id"), F.desc("chunk_id"))


def is_summary() -> Column:
    """Hits that stand for a whole: of that type, or from a folder of summaries."""
    return (F.col("node_type") == "summary") | F.contains(F.coalesce("source_path", F.lit("")), F.lit("summaries"))


def hierarchical_search(hits: DataFrame, k: int = 8, summary_k: int = 5, now: Column | None = None, half_life_days: float = C.HALF_LIFE_DAYS) -> DataFrame:
    """``hierarchical`` with the summaries among ``hits``."""
    return hierarchical(hits.filter(is_summary()), hits, k, summary_k, now, half_life_days)


def decayed(hits: DataFrame, now: Column, half_life_days: float = C.HALF_LIFE_DAYS) -> DataFrame:
    return hits.withColumn("score", C.temporal_decay(F.col("score"), F.col("ts"), now, half_life_days))


def hierarchical(summaries: DataFrame, chunks: DataFrame, k: int = 8, summary_k: int = 5, now: Column | None = None, half_life_days: float = C.HALF_LIFE_DAYS) -> DataFrame:
    """Coarse to fine: the best summaries restrict the chunks to those of their sources; both are merged.

    Summaries come first where both have a node; without any summary the chunks are not restricted.
    """
    coarse = summaries.orderBy(F.desc("score"), "node_id").limit(2 * summary_k)
    prefixes = coarse.filter(F.col("node_id") != "").select(F.substring_index("node_id", ":", 1).alias("_ref")).distinct()
    refs = prefixes.agg(F.collect_list("_ref").alias("_refs"))  # at most 2 * summary_k
    fine = chunks.crossJoin(F.broadcast(refs)).filter((F.size("_refs") == 0) | _of_sources()).drop("_refs").orderBy(F.desc("score"), "node_id").limit(2 * k)
    return _merged(coarse, fine, k, now, half_life_days)


def hierarchical_searches(coarse: Callable[[int], DataFrame], fine: Callable[[int], DataFrame], k: int = 8, summary_k: int = 5, now: Column | None = None, half_life_days: float = C.HALF_LIFE_DAYS) -> DataFrame:
    """Two searches, each called with how many hits it is to give: summaries first, then chunks of the sources of the best ``summary_k`` of these.

    Both are asked for more than is needed, as what is no summary, or of another source, is left out after their cut.
    """
    summaries = coarse(4 * summary_k).filter(is_summary()).orderBy(F.desc("score"), "node_id").limit(2 * summary_k)
    leading = summaries.orderBy(F.desc("score"), "node_id").limit(summary_k).filter(F.col("node_id") != "")
    refs = leading.agg(F.collect_set(F.substring_index("node_id", ":", 1)).alias("_refs"))  # at most summary_k
    chunks = fine(6 * k).crossJoin(F.broadcast(refs)).filter((F.size("_refs") == 0) | _of_sources()).drop("_refs")
    return _merged(summaries, chunks.orderBy(F.desc("score"), "node_id").limit(2 * k), k, now, half_life_days)


def _of_sources() -> Column:
    return F.exists("_refs", lambda r: F.contains(F.col("node_id"), r) | F.contains(r, F.col("node_id")))


def _merged(coarse: DataFrame, fine: DataFrame, k: int, now: Column | None, half_life_days: float) -> DataFrame:
    """Both stages' hits, each node once, a summary before a chunk; the ``k`` best."""
    merged = coarse.withColumn("stage", F.lit("summary")).unionByName(fine.withColumn("stage", F.lit("chunk")), allowMissingColumns=True)
    first = Window.partitionBy("node_id").orderBy(F.when(F.col("stage") == "summary", 0).otherwise(1), F.desc("score"))
    once = merged.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    once = once if now is None else decayed(once, now, half_life_days)
    return once.orderBy(F.desc("score"), F.when(F.col("stage") == "summary", 0).otherwise(1), "node_id").limit(k)


def cascade(routes: list[Callable[[], DataFrame]], k: int = 8) -> DataFrame:
    """The hits of the first route that has any, already filtered; later routes are neither planned nor run.

    Each route is a function that makes its hits. At most ``k`` of them are looked at by the driver.
    """
    for route in routes:
        cut = route().orderBy(F.desc("score"), F.coalesce("ts", F.lit("")).desc(), "node_id").limit(k)
        rows = cut.collect()
        if rows:
            break
    return cut.sparkSession.createDataFrame(rows, cut.schema)


def json_after_noise(text: str) -> list[dict]:
    """The results in what a program printed: the first JSON list, or the ``results`` of the first JSON object, whatever stands before it."""
    decode = json.JSONDecoder().raw_decode
    for at, letter in enumerate(text):
        if letter in "[{":
            try:
                found, _ = decode(text[at:])
            except ValueError:
                continue
            rows = found.get("results") if isinstance(found, dict) else found
            if isinstance(rows, list):
                return [r for r in rows if isinstance(r, dict)]
    return []


def command(argv: list[str], timeout: float = 30.0) -> Callable[[str, int], list[dict]]:
    """A search by a program of the driver's host: called with the query and how many hits, its output read leniently."""

    def search(query: str, n: int) -> list[dict]:
        done = subprocess.run([*argv, query, str(n)], capture_output=True, text=True, timeout=timeout, check=True)
        return json_after_noise(done.stdout)

    return search


def external(spark, search=None, query: str = "", k: int = 8, min_score: float = 0.35) -> DataFrame:
    """Hits of an external search, a callable giving rows with score, text and node_id, or a file name that stands for it; none if absent or failing."""
    schema = "node_id string, file string, score double, text string"
    try:
        rows = [(r.get("node_id"), r.get("file") or r.get("path"), float(r["score"]), r.get("text")) for r in (search(query, 2 * k) if search else [])]
    except Exception as e:  # an external index is best effort by contract, but its failures are told
        warnings.warn(f"external search failed: {e!r}", stacklevel=2)
        rows = []
    found = spark.createDataFrame(rows, schema).filter(F.col("score") >= min_score)
    name = F.element_at(F.split(F.coalesce("file", F.lit("")), "/"), -1)
    node_id = F.coalesce("node_id", F.when(name != "", X.id_of_filename(name)))
    return found.select(node_id.alias("node_id"), F.lit(None).cast("string").alias("node_type"), F.lit("").alias("project_id"), "score", F.lit("").alias("ts"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("entity_id"), F.substring(X.without_front_matter("text"), 1, 180).alias("preview"), F.lit("external").alias("method"))


class IvfIndex:
    """Approximate vector search: k-means cells, the nearest of which are probed.

    Fitted on at most ``sample`` vectors; every vector is assigned to a cell. ``stored`` writes them, a
    folder for each cell, so a search reads its cells only and assigns nothing; ``read`` finds them again.
    Under 100 vectors there is one cell and the search is exact.
    """

    def __init__(self, chunks: DataFrame, sample: int = 20_000, seed: int = 1):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = chunks.count()
        self.cells = 1 if n < 100 else max(4, min(n // 50, 100))
        self.probes = min(10, self.cells)
        rows = chunks.filter(F.col("embedding").isNotNull()).withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
        if self.cells == 1:
            self.centres, self.rows = None, rows.withColumn("cell", F.lit(0)).drop("_v")
            return
        fit = rows.orderBy(F.xxhash64("node_id")).limit(sample)
        model = KMeans(k=self.cells, featuresCol="_v", predictionCol="cell", distanceMeasure="cosine", seed=seed, maxIter=10).fit(fit)
        self.centres = [list(map(float, c)) for c in model.clusterCenters()]
        self.rows = model.transform(rows).drop("_v")

    def stored(self, path: str) -> IvfIndex:
        """This index with its vectors in the table ``path``/rows, by cell, and its centres beside them."""
        spark = self.rows.sparkSession
        centres = [(i, c, self.probes) for i, c in enumerate(self.centres or [None])]
        spark.createDataFrame(centres, "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
        self.rows.repartition("cell", F.pmod(F.xxhash64("node_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
        return self.read(spark, path)

    @classmethod
    def read(cls, spark, path: str) -> IvfIndex:
        index = cls.__new__(cls)
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most 100
        index.cells, index.probes = len(centres), centres[0]["probes"]
        index.centres = [list(r["centre"]) for r in centres] if centres[0]["centre"] is not None else None
        index.rows = spark.read.parquet(f"{path}/rows")
        return index

    def nearest_cells(self, query: list[float]) -> list[int]:
        def cos(a, b):
            na, nb = sum(x * x for x in a) ** 0.5 or 1.0, sum(x * x for x in b) ** 0.5 or 1.0
            return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb)

        if self.centres is None:
            return [0]
        return sorted(range(len(self.centres)), key=lambda i: -cos(self.centres[i], query))[: self.probes]

    def search(self, query: list[float], k: int = 10, scope: str | None = None) -> DataFrame:
        return vector_topk(self.rows.filter(F.col("cell").isin(self.nearest_cells(query))), query, k, scope)

    def _ranked_cells(self, queries: DataFrame) -> DataFrame:
        """(query_id, q, _cell, _nth): all cells of each query, the nearest first."""
        centres = queries.sparkSession.createDataFrame(list(enumerate(self.centres or [[0.0]])), "_cell int, _centre array<double>")
        near = F.lit(0.0) if self.centres is None else V.cosine(F.col("_centre"), F.col("q"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_near"), "_cell"))
        return queries.crossJoin(F.broadcast(centres)).withColumn("_near", near).withColumn("_nth", nth).select("query_id", "q", "_cell", "_nth")

    def tuned(self, queries: DataFrame, k: int = 10, least: float = 0.93, sample: int = 100) -> IvfIndex:
        """This index, with no fewer probes than find ``least`` of the ``k`` true neighbours of ``sample`` queries (query_id, q)."""
        if self.probes >= self.cells:
            return self
        some = queries.orderBy(F.xxhash64("query_id")).limit(sample)
        true = vector_topk_of_each(self.rows, some, k).select("query_id", "cell")
        cells = self._ranked_cells(some).select(F.col("query_id").alias("_q"), "_cell", "_nth")
        nth = true.join(cells, (F.col("query_id") == F.col("_q")) & (F.col("cell") == F.col("_cell"))).groupBy("_nth").count().collect()  # a row a cell
        found, total = 0, sum(r["count"] for r in nth)
        for r in sorted(nth):
            found += r["count"]
            if found >= least * total:
                self.probes = max(self.probes, r["_nth"])
                break
        return self

    def search_each(self, queries: DataFrame, k: int = 10, scope: str | None = None) -> DataFrame:
        """``search`` for each of ``queries`` (query_id, q): query_id, rank, cell and score with the chunks' columns."""
        asked = self._ranked_cells(queries).filter(F.col("_nth") <= self.probes).select("query_id", "q", F.col("_cell").alias("cell"))
        return vector_topk_of_each(self.rows, asked, k, scope, "cell")
