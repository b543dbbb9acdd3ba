"""A stored full-text index in immutable segments, kept up to date by deltas, with exact top-k over its blocks.

A segment holds its nodes (with their terms: the forward index) and, for each token, blocks of up to BLOCK postings,
those of most weight first, each headed by its greatest tf and least length. These bound what any posting of
the block can add to a BM25 score, whatever the corpus's mean length is by then. Segments never change. A delta is one
more segment; the older rows of nodes that it changes or deletes are named in a table of tombstones, and what
they counted for is taken off the document frequencies by rows of negative counts. So statistics are exact at all
times. Once FANOUT segments of a tier are there, they are merged into one of the next, which reads these segments alone, and
their forward index, not texts. A JSON state says which folders count; it moves on when they are whole.

A node's token group is cut into pieces of a hash, so that no task orders more than about PIECE postings of
one token, however many nodes hold it. Rows of nodes are kept in BUCKETS by a hash of their id, and tokens in
PARTS, so a delta or a query reads the folders of its ids or tokens only.

Top-k: a lower bound of a query's k-th score comes from the first blocks of its tokens. The weakest tokens, which together
stay under that, need not be looked at, as whatever reaches it holds another one; of the others a block is skipped
where the most that it and the other tokens can add stays under it. Nodes of the blocks that are left for any of the
queries are scored in full by their forward index, so nothing is estimated. They meet the queries in tiles
(``term_tiles``), so no pair of a query and a node is ever a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import lexical, term_tiles
from tidemark.operators.tables import Pointer, remove

BLOCK, PIECE = 128, 1_000_000
PARTS, BUCKETS = 64, 64
FANOUT = 4
K1, B = 1.2, 0.75
#: Scores are rounded to six places, so bounds are compared with more than that to spare.
SLACK = 1e-5
META = ("type", "scope", "ts", "text_preview", "tags")


def part_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def bucket_of(node_id: Column) -> Column:
    return F.pmod(F.xxhash64(node_id), F.lit(BUCKETS)).cast("int")


def impact(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def with_terms(nodes: DataFrame) -> DataFrame:
    """The last row of each node: node_id, dl, terms (token, tf: its count in the text, 0 where only another field has it) and META."""
    last = nodes.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("_id")).agg(F.max("ord").alias("_ord"))
    rows = nodes.join(last, (F.col("id") == F.col("_id")) & (F.col("ord") == F.col("_ord"))).dropDuplicates(["id"])
    text = X.tokens("text")
    # lengths of runs in the sorted tokens, without a shuffle
    ordered = F.sort_array(text)  # array_sort would compare by a lambda
    n = F.size("_sorted")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("_sorted", i) != F.element_at("_sorted", F.greatest(i - 1, F.lit(1)))))
    runs = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.col("_starts"))
    lengths = F.transform(runs, lambda s, i: F.struct(F.element_at("_sorted", s).alias("token"), (F.coalesce(F.get(runs, i + 1), n + 1) - s).alias("tf")))
    others = F.transform(F.array_except(X.token_set(lexical.node_text(nodes)), F.col("_sorted")), lambda t: F.struct(t.alias("token"), F.lit(0).alias("tf")))
    out = rows.withColumn("_sorted", ordered).withColumn("_starts", F.when(n > 0, starts)).withColumn("terms", F.concat(lengths, others))
    return out.select(F.col("id").alias("node_id"), F.size("_sorted").cast("long").alias("dl"), "terms", "type", "scope", "ts", X.preview("text").alias("text_preview"), "tags")


class TextSegments:
    """The index under ``root``. ``apply`` writes a delta, ``merge`` merges tiers, ``lookup`` and ``bm25`` answer queries."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.pointer = Pointer(spark, f"{self.root}/current")

    @property
    def state(self) -> dict:
        """segments (name -> tier, docs), the names of tables of counts and of tombstones (gone), docs and length of all live nodes."""
        return self.pointer.read({"segments": {}, "counts": [], "gone": [], "docs": 0, "length": 0})

    def _table(self, kind: str, segments, schema: str) -> DataFrame:
        """What the segments have of a kind: root/kind/segment=name/..."""
        paths = [self._path(kind, s) for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _path(self, kind: str, segment: str) -> str:
        return f"{self.root}/{kind}/segment={segment}"

    def _docs(self, segments) -> DataFrame:
        return self._table("docs", segments, "segment string, doc long, node_id string, dl long, terms array<struct<token string, tf int>>, type string, scope string, ts string, text_preview string, tags array<string>, bucket int")

    def _blocks(self, segments) -> DataFrame:
        return self._table("blocks", segments, "segment string, token string, piece int, block int, n int, most_tf int, least_dl long, postings array<struct<doc long, tf int, dl long>>, part int")

    def _dead(self, state: dict) -> DataFrame:
        return self._table("gone", state["gone"], "segment string, old string, doc long, dl long, terms array<struct<token string, tf int>>").select(F.col("old").alias("segment"), "doc")

    def _write(self, name: str, rows: DataFrame, df: bool) -> dict:
        """The segment of ``rows`` (of ``with_terms``); ``df``: with its document frequencies. Its number of nodes and their length."""
        numbered = rows.withColumn("doc", F.monotonically_increasing_id()).withColumn("bucket", bucket_of(F.col("node_id")))
        numbered.write.partitionBy("bucket").parquet(self._path("docs", name))
        # numbers are those written, whatever runs again
        docs = self._docs([name])
        total = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        pieces = 1 + total[0] // PIECE
        posted = docs.select("doc", "dl", F.pmod(F.xxhash64("node_id"), F.lit(pieces)).cast("int").alias("piece"), F.explode("terms").alias("t")).select("doc", "dl", "piece", "t.*")
        weight = impact(F.col("tf"), F.col("dl"), max(1.0, total[1] / max(1, total[0])))
        place = F.row_number().over(Window.partitionBy("token", "piece").orderBy(weight.desc(), "doc"))
        blocks = posted.withColumn("block", F.floor((place - 1) / BLOCK).cast("int")).groupBy("token", "piece", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("most_tf"), F.min(F.when(F.col("tf") > 0, F.col("dl"))).alias("least_dl"), F.collect_list(F.struct("doc", "tf", "dl")).alias("postings"))
        dealt = blocks.withColumn("part", part_of(F.col("token"))).repartition("part", "piece").sortWithinPartitions("part", "token", "block")
        dealt.write.partitionBy("part").parquet(self._path("blocks", name))
        if df:
            counts = self._blocks([name]).select("part", "token", F.size(F.filter("postings", lambda p: p["tf"] > 0)).alias("n")).groupBy("part", "token").agg(F.sum("n").alias("n")).filter("n > 0")
            counts.repartition("part").write.partitionBy("part").parquet(self._path("counts", name))
        return {"docs": total[0], "length": total[1]}

    def apply(self, nodes: DataFrame, deleted: DataFrame | None = None) -> dict:
        """Index ``nodes`` (of the ledger's columns), in place of what was indexed of their ids, and drop those of ``deleted`` (node_id). Returns the state."""
        state, name = self.state, uuid.uuid4().hex
        rows = with_terms(nodes)
        new = self._write(name, rows, True)
        gone = self._docs([name]).select("node_id")
        gone = gone if deleted is None else gone.union(deleted.select("node_id")).distinct()
        state = {**state, "docs": state["docs"] + new["docs"], "length": state["length"] + new["length"], "counts": [*state["counts"], name]}
        if state["segments"]:
            buckets = [r[0] for r in gone.select(bucket_of(F.col("node_id"))).distinct().collect()]  # at most BUCKETS
            old = self._docs(state["segments"]).filter(F.col("bucket").isin(buckets)).join(gone, "node_id", "left_semi").join(self._dead(state), ["segment", "doc"], "left_anti")
            old.select(F.col("segment").alias("old"), "doc", "dl", "terms").write.parquet(self._path("gone", name))
            was = self._table("gone", [name], "old string, doc long, dl long, terms array<struct<token string, tf int>>")
            lost = was.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if lost[0]:
                less = was.select(F.explode("terms").alias("t")).filter("t.tf > 0").groupBy("t.token").agg((-F.count("*")).alias("n"))
                less.withColumn("part", part_of(F.col("token"))).repartition("part").write.partitionBy("part").parquet(self._path("counts", f"{name}-less"))
                state = {**state, "docs": state["docs"] - lost[0], "length": state["length"] - lost[1], "counts": [*state["counts"], f"{name}-less"], "gone": [*state["gone"], name]}
        state["segments"] = state["segments"] | ({name: {"tier": 0, **new}} if new["docs"] else {})
        return self.pointer.move(state)

    def merge(self) -> dict:
        """Merge every tier that has FANOUT segments, the lowest first; returns the state."""
        while True:
            state = self.state
            tiers: dict[int, list[str]] = {}
            for s, x in state["segments"].items():
                tiers.setdefault(x["tier"], []).append(s)
            full = min((t for t, s in tiers.items() if len(s) >= self.fanout), default=None)
            if full is None:
                return state
            own, name = tiers[full], uuid.uuid4().hex
            live = self._docs(own).join(self._dead(state), ["segment", "doc"], "left_anti").drop("segment", "doc", "bucket")
            new = self._write(name, live, False)
            rest = {s: x for s, x in state["segments"].items() if s not in own}
            # tombstones of the segments that stay, and all counts, each in one table
            self._dead(state).filter(~F.col("segment").isin(own)).select(F.col("segment").alias("old"), "doc").write.parquet(self._path("gone", name))
            self._counts(state).repartition("part").write.partitionBy("part").parquet(self._path("counts", name))
            self.pointer.move({**state, "segments": rest | ({name: {"tier": full + 1, **new}} if new["docs"] else {}), "counts": [name], "gone": [name]})
            for kind, old in (("docs", own), ("blocks", own), ("counts", state["counts"]), ("gone", state["gone"])):
                for s in old:
                    remove(self.spark, self._path(kind, s))

    def _counts(self, state: dict) -> DataFrame:
        return self._table("counts", state["counts"], "segment string, token string, n long, part int").groupBy("part", "token").agg(F.sum("n").alias("n")).filter("n > 0")

    def _of_tokens(self, terms: DataFrame, table: DataFrame) -> DataFrame:
        """Rows of a table of parts that hold a token of ``terms``; other parts are not read."""
        parts = [r[0] for r in terms.select(part_of(F.col("token"))).distinct().collect()]  # at most PARTS
        return table.filter(F.col("part").isin(parts)).join(terms.select("token").distinct(), "token", "left_semi")

    def _live(self, hits: DataFrame, state: dict) -> DataFrame:
        return hits.join(self._dead(state), ["segment", "doc"], "left_anti") if state["gone"] else hits

    def lookup(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``lexical.lookup_indexed`` over all live nodes: postings of the queries' tokens, gathered by node, meet the queries in tiles."""
        state = self.state
        texts, same = lexical.once(queries)
        terms = lexical.query_terms(texts, None)
        posted = self._of_tokens(terms, self._blocks(state["segments"])).select("segment", "token", F.explode("postings.doc").alias("doc"))
        held = self._live(posted.groupBy("segment", "doc").agg(F.collect_list("token").alias("tokens")), state)
        told = self._docs(state["segments"]).select("segment", "doc", "node_id", F.coalesce("ts", F.lit("")).alias("ts"))
        # an id with its place, as only one of a node's places is live
        nodes = held.join(told, ["segment", "doc"]).select(F.struct("node_id", "segment", "doc").alias("node_id"), "tokens", "ts", F.lit(0).cast("long").alias("bonus"))
        found = term_tiles.tiled(nodes, lexical.asked_of(terms, "times").withColumnRenamed("times", "points"), term_tiles.counted(k), "score long, first_pos int", state["docs"], texts.count())
        whole = found.select("query_id", "score", "first_pos", "node_id.segment", "node_id.doc").join(self._docs(state["segments"]).select("segment", "doc", "node_id", "ts", "text_preview"), ["segment", "doc"])
        cut = lexical.top(whole, k, F.desc("score"), F.coalesce("ts", F.lit("")).desc(), F.asc("first_pos"), F.asc("node_id"))
        shown = cut.filter(X.strip("text_preview") != "").select("query_id", "rank", "node_id", "score", "ts", F.col("text_preview").alias("text"))
        return lexical.for_all(shown, same).select("query_id", "rank", "node_id", "score", "ts", "text")

    def _idf(self, terms: DataFrame, state: dict) -> DataFrame:
        """(token, idf) of those of the terms' tokens that live nodes hold."""
        idf = F.log(F.lit(1.0) + (F.lit(state["docs"]) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        return self._of_tokens(terms, self._counts(state)).select("token", idf.alias("idf"))

    def planned(self, queries: DataFrame, k: int = 10, all_terms: bool = False) -> DataFrame:
        """For each query the blocks of its tokens: query_id, segment, token, piece, block, idf, bound (the most that one of its postings adds) and read (false: skipped)."""
        state = self.state
        mean = max(1e-9, state["length"] / max(1, state["docs"]))
        terms = lexical.query_terms(queries, None)
        weighed = terms.select("query_id", "token").join(self._idf(terms, state), "token")
        mine = self._of_tokens(terms, self._blocks(state["segments"]).filter("most_tf > 0"))
        heads = mine.drop("postings").withColumn("unit", impact(F.col("most_tf"), F.col("least_dl"), mean))
        first = mine.filter("block = 0").select("segment", "token", F.explode("postings").alias("p")).select("segment", "token", "p.*").filter("tf > 0")
        partial = self._live(weighed.join(first, "token").groupBy("query_id", "segment", "doc").agg(F.sum(F.col("idf") * impact(F.col("tf"), F.col("dl"), mean)).alias("least"), F.count("*").alias("found")), state)
        if all_terms:
            partial = partial.join(terms.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id").filter("found = asked")
        floor = lexical.top(partial, k, F.desc("least")).filter(F.col("rank") == k).select("query_id", F.col("least").alias("floor"))
        blocks = weighed.join(heads, "token").withColumn("bound", F.col("idf") * F.col("unit"))
        tops = blocks.groupBy("query_id", "token").agg(F.max("bound").alias("top"))
        rising = Window.partitionBy("query_id").orderBy("top", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        others = tops.select("query_id", "token", (F.sum("top").over(Window.partitionBy("query_id")) - F.col("top")).alias("others"), F.sum("top").over(rising).alias("weaker"))
        judged = blocks.join(others, ["query_id", "token"]).join(floor, "query_id", "left")
        return judged.select("query_id", "segment", "token", "piece", "block", "idf", "bound", (F.least(F.col("bound") + F.col("others"), F.col("weaker")) >= F.coalesce("floor", F.lit(0.0)) - SLACK).alias("read"))

    def bm25(self, queries: DataFrame, k: int = 10, all_terms: bool = False) -> DataFrame:
        """``lexical.bm25`` over all live nodes: those that a block read for any query names meet the queries in tiles, with the forward index's counts."""
        state = self.state
        mean = max(1e-9, state["length"] / max(1, state["docs"]))
        texts, same = lexical.once(queries)
        plan = self.planned(texts, k, all_terms)
        terms = lexical.query_terms(texts, None)
        mine = self._of_tokens(terms, self._blocks(state["segments"]).filter("most_tf > 0")).select("segment", "token", "piece", "block", "postings")
        place = ["segment", "token", "piece", "block"]
        read = mine.join(plan.filter("read").select(*place).distinct(), place, "left_semi")
        some = self._live(read.select("segment", F.explode(F.filter("postings", lambda p: p["tf"] > 0)["doc"]).alias("doc")).distinct(), state)
        counted = F.filter("terms", lambda t: t["tf"] > 0)
        nodes = self._docs(state["segments"]).select("segment", "doc", "node_id", "dl", counted["token"].alias("tokens"), counted["tf"].alias("times")).join(some, ["segment", "doc"], "left_semi").drop("segment", "doc")
        idf = self._idf(terms, state)
        asked = lexical.asked_of(terms.join(idf, "token", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0))), "idf")
        found = term_tiles.tiled(nodes, asked, term_tiles.weighed(k, K1, B, mean, all_terms), "score double", state["docs"], texts.count())
        cut = lexical.top(found.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.asc("node_id"))
        return lexical.for_all(cut, same).select("query_id", "rank", "node_id", "score")
