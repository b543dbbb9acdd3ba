"""Postings, keyword lookup by index and by scan, and BM25.

Postings are rows (token, node_id), never arrays, so that a token which a third of the nodes share is
just many rows. All lookups take a table of queries; queries meet nodes in tiles (``term_tiles``), equal texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import term_tiles
from tidemark.operators.tables import remove, written_at

#: Types that score higher.
BONUS_TYPES = ("rule", "decision", "incident")


def meta_of(nodes: DataFrame) -> Column:
    """A node's meta as JSON text, empty where the table has none."""
    return F.coalesce(F.col("meta_json"), F.lit("")) if "meta_json" in nodes.columns else F.lit("")


def node_text(nodes: DataFrame) -> Column:
    """What the keyword index covers of a node."""
    return F.concat_ws(" ", "id", "type", "scope", "text", F.concat_ws(" ", "tags"), meta_of(nodes))


#: Repeated ids are broadcast up to so many; beyond, all postings are shuffled.
MOST_REPEATED = 10_000


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node_id), distinct. A row's tokens are distinct without a shuffle, so only those of ids that several rows have are compared; a job over the ids looks for these."""
    rows = nodes.filter(F.col("id").isNotNull())
    posted = lambda some: some.select(F.explode(X.token_set(node_text(some))).alias("token"), F.col("id").alias("node_id"))
    repeated = rows.groupBy(F.col("id").alias("_id")).count().filter("count > 1").select("_id").limit(MOST_REPEATED + 1)
    ids = [(r["_id"],) for r in repeated.collect()]
    if not ids:
        return posted(rows)
    if len(ids) > MOST_REPEATED:
        return posted(rows).distinct()
    known = F.broadcast(nodes.sparkSession.createDataFrame(ids, repeated.schema))
    of = lambda how: posted(rows.join(known, F.col("id") == F.col("_id"), how))
    return of("left_anti").union(of("left_semi").distinct())


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def node_meta(nodes: DataFrame) -> DataFrame:
    """The last row of each id: node_id, type, scope, ts, text_preview, tags."""
    last = F.max_by(F.struct("type", "scope", "ts", X.preview("text").alias("text_preview"), "tags"), "ord")
    return nodes.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("node_id")).agg(last.alias("m")).select("node_id", "m.*")


def query_terms(queries: DataFrame, most: int | None = X.QUERY_TOKENS) -> DataFrame:
    """(query_id, token, pos, times): distinct tokens of each query, their first position and how often they stand there."""
    exploded = queries.select("query_id", F.posexplode(X.query_tokens("query", most)).alias("pos", "token"))
    return exploded.groupBy("query_id", "token").agg(F.min("pos").alias("pos"), F.count("*").alias("times"))


def top(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each query."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct text of ``queries`` (query_id, query) once, by one of its ids; and (query_id, _same): that id for each query."""
    told = queries.groupBy("query").agg(F.min("query_id").alias("_same"))
    return told.select(F.col("_same").alias("query_id"), "query"), queries.join(told, "query").select("query_id", "_same")


def for_all(best: DataFrame, same: DataFrame) -> DataFrame:
    """What was found for each text, for each query of that text."""
    return best.withColumnRenamed("query_id", "_same").join(same, "_same").drop("_same")


def asked_of(terms: DataFrame, weight: str) -> DataFrame:
    """(query_id, tokens, pos, weight): the terms (query_id, token, pos and weight) of each query as lists, in their order."""
    lists = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", weight))).alias("t"))
    return lists.select("query_id", F.col("t.token").alias("tokens"), F.col("t.pos").alias("pos"), F.col(f"t.{weight}").alias(weight))


def indexed_best(posted: DataFrame, meta: DataFrame, queries: DataFrame, k: int, most: int | None, weight: int, bonus: int) -> DataFrame:
    """(query_id, rank, node_id, score, first_pos) and the nodes' metadata: the first ``k`` nodes with at least one token, by score, newest, first place and id; repeated query tokens count again."""
    texts, same = once(queries)
    terms = query_terms(texts, most)
    asked = asked_of(terms.withColumn("points", F.col("times") * weight), "points")
    held = posted.join(terms.select("token").distinct(), "token", "left_semi").groupBy("node_id").agg(F.collect_list("token").alias("tokens"))
    more = F.when(F.col("type").isin(*BONUS_TYPES), F.lit(bonus)).otherwise(0).cast("long")
    told = meta.select("node_id", F.coalesce("ts", F.lit("")).alias("ts"), more.alias("bonus"))
    nodes = held.join(told, "node_id", "left").select("node_id", "tokens", F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce("bonus", F.lit(0).cast("long")).alias("bonus"))
    found = term_tiles.tiled(nodes, asked, term_tiles.counted(k), "score long, first_pos int", meta.count(), texts.count())
    whole = found.join(meta, "node_id", "left")
    return for_all(top(whole, k, F.desc("score"), F.coalesce("ts", F.lit("")).desc(), F.asc("first_pos"), F.asc("node_id")), same)


def lookup_indexed(posted: DataFrame, meta: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Hits by the index: one point a token, then newest; nodes with a blank preview go after the cut."""
    cut = indexed_best(posted, meta, queries, k, None, 1, 0)
    return cut.filter(X.strip("text_preview") != "").select("query_id", "rank", "node_id", "score", "ts", F.col("text_preview").alias("text"))


#: Keys that queries are dealt by are broadcast up to so many; beyond, the nodes' tokens are shuffled.
MOST_DEALT = 1_000_000
#: Nodes of a token that queries are dealt by, or this part of all nodes if more; queries of which all tokens have more are met by all nodes.
RARE, RARE_PART = 1_000, 300
#: Further tokens that a node must hold to be sent to queries that need all of theirs.
ALSO = 8


def expected_hits(nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, node_id): where ``lookup_indexed`` of ``queries`` (query_id, query, expected: a node's id) has the expected node among the first ``k``.

    The rank follows from the nodes that score no less than the expected one. Such a node holds one of any of the query's tokens
    that together count for more than what the expected node lacks; the rarest of these are taken, one token where it lacks nothing,
    and then only nodes that hold the next rarest as well. Queries meet only the nodes of these tokens, so what is shuffled grows with the nodes that hold them, not with
    queries times nodes; queries of common tokens alone, which are few and short, meet all nodes in tiles. The nodes' distinct tokens, the queries and the hits are written as tables in the shared folder; all but the hits are deleted.
    """
    spark = nodes.sparkSession
    named = nodes.filter(F.col("id").isNotNull()).withColumn("_t", X.token_set(node_text(nodes)))
    told = F.struct("ts", (X.strip(X.preview("text")) != "").alias("shown"))
    if named.groupBy("id").count().filter("count > 1").limit(1).count():
        whole = named.groupBy(F.col("id").alias("node_id")).agg(F.max_by(told, "ord").alias("m"), F.array_distinct(F.flatten(F.collect_list("_t"))).alias("tokens"))
    else:
        whole = named.select(F.col("id").alias("node_id"), told.alias("m"), F.col("_t").alias("tokens"))
    whole, path = written_at(whole.select("node_id", "tokens", F.coalesce("m.ts", F.lit("")).alias("ts"), F.lit(0).cast("long").alias("bonus"), "m.shown"), "tokens")
    small = lambda df: F.broadcast(df) if df.count() <= MOST_DEALT else df
    # what the expected node lacks of the query's tokens, repeats counted; a query of which it has none hits nothing
    own = whole.join(small(queries.select(F.col("expected").alias("node_id")).distinct()), "node_id", "left_semi").select(F.col("node_id").alias("expected"), F.col("tokens").alias("_own"))
    lost = queries.withColumn("_t", X.query_tokens("query", None)).join(own, "expected").withColumn("_lost", F.array_except("_t", "_own"))
    lacking = F.when(F.size("_lost") == 0, 0).otherwise(F.size(F.filter("_t", lambda x: F.array_contains("_lost", x))))
    lost = lost.withColumn("lack", lacking).filter(F.col("lack") < F.size("_t")).select("query_id", "query", "lack")
    texts = lost.groupBy("query").agg(F.min("query_id").alias("query_id"), F.max("lack").alias("lack"))
    df = whole.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    terms = query_terms(texts, None).join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    asked = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("df", "token", "pos", "times"))).alias("t")).join(texts, "query_id")
    start, more = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), lambda a, t: F.struct((a["sum"] + t["times"]).alias("sum"), (a["n"] + 1).alias("n"))
    taken = F.aggregate("t", start, lambda a, t: F.when(a["sum"] > F.col("lack"), a).otherwise(more(a, t)))["n"]
    asked = asked.select("query_id", "query", F.col("t.token").alias("tokens"), F.col("t.pos").alias("pos"), F.col("t.times").alias("points"), F.slice("t", F.lit(1), taken).alias("by"), F.when(F.col("lack") == 0, F.slice("t", 2, ALSO)).otherwise(F.slice("t", 1, 0)).alias("also"))
    asked, path_asked = written_at(asked, "asked")
    n = whole.count()
    # the most common of a query's tokens comes last
    common = F.coalesce(F.element_at("by", -1)["df"] > max(RARE, n // RARE_PART), F.lit(False))
    rare, rest = asked.filter(~common), asked.filter(common).select("query_id", "tokens", "pos", "points")
    # about as many nodes as if tokens stood in nodes by chance
    expected = F.aggregate("also", F.col("b.df").cast("double"), lambda a, x: a * x["df"] / n) + 1
    keyed = rare.withColumn("b", F.explode("by")).select("query_id", "tokens", "pos", "points", F.col("b.token").alias("token"), F.col("also.token").alias("also"), expected.alias("n"))
    dealt = term_tiles.dealt(keyed.groupBy("token", "also").agg(F.max("n").alias("n"), F.count("*").alias("m")))
    left = whole.select("node_id", "tokens", "ts", "bonus", F.explode("tokens").alias("token")).join(small(dealt), "token")
    for i in range(ALSO):
        left = left.filter((F.size("also") <= i) | F.array_contains("tokens", F.get("also", F.lit(i))))
    left, right = left.drop("token", "also"), keyed.drop("n").join(dealt, ["token", "also"]).drop("token", "also")
    counted, columns = term_tiles.counted(k), "score long, first_pos int"
    found = term_tiles.met(left, right, counted, columns).dropDuplicates(["query_id", "node_id"])
    if m := rest.count():
        found = found.union(term_tiles.tiled(whole.select("node_id", "tokens", "ts", "bonus"), rest, counted, columns, n, m))
    ranked = top(found.join(whole.select("node_id", "ts", "shown"), "node_id"), k, F.desc("score"), F.desc("ts"), F.asc("first_pos"), F.asc("node_id"))
    same = queries.join(asked.select("query", F.col("query_id").alias("_same")), "query").select("query_id", "_same", "expected")
    hits = for_all(ranked.filter("shown"), same).filter(F.col("node_id") == F.col("expected"))
    out, _ = written_at(hits.select("query_id", "rank", "node_id"), "hits")
    for done in (path, path_asked):
        remove(spark, done)
    return out


def heuristic_indexed(posted: DataFrame, meta: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """Two points a token and two for a bonus type, by the index."""
    cut = indexed_best(posted, meta, queries, k, X.QUERY_TOKENS, 2, 2)
    return cut.select("query_id", "rank", "node_id", "type", "scope", "score", "ts", "text_preview")


def scan_scores(nodes: DataFrame, query: str, most: int | None, weight: int, bonus: int, *columns: str) -> DataFrame:
    """``nodes`` with the score of substring hits of one query, without those that score nothing."""
    haystack = X.searchable(*columns)
    hits = X.substring_hits(haystack, X.query_tokens(F.lit(query), most)) * weight
    return nodes.withColumn("score", (hits + F.when(F.col("type").isin(*BONUS_TYPES), bonus).otherwise(0)).cast("long")).filter("score > 0")


def lookup_scan(nodes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Hits by substring over id, text and tags: one point a token."""
    found = scan_scores(nodes.withColumn("_tags", F.concat_ws(" ", "tags")), query, None, 1, 0, "id", "text", "_tags")
    return found.orderBy(F.desc("score"), F.coalesce("ts", F.lit("")).desc(), "ord").limit(k).select("id", "score", "ts", "text")


def heuristic_scan(nodes: DataFrame, query: str, k: int | None = 8) -> DataFrame:
    """Hits by substring over all of a node: two points a token, two for a bonus type even without a hit."""
    found = scan_scores(nodes.withColumns({"_tags": F.concat_ws(" ", "tags"), "_meta": meta_of(nodes)}), query, X.QUERY_TOKENS, 2, 2, "id", "type", "scope", "text", "_meta", "_tags")
    return found if k is None else found.orderBy(F.desc("score"), F.coalesce("ts", F.lit("")).desc(), "ord").limit(k)


def bm25(nodes: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, all_terms: bool = False) -> DataFrame:
    """(query_id, rank, node_id, score) by BM25 over the nodes' texts; ``all_terms``: only nodes with every token."""
    tokens = nodes.select(F.col("id").alias("node_id"), X.tokens("text").alias("_t"))
    n, mean = tokens.agg(F.count("*"), F.avg(F.size("_t").cast("long"))).first()
    texts, same = once(queries)
    terms = query_terms(texts, None)
    # a node's tokens in one row, once for the frequencies and once for the tiles
    whole = tokens.groupBy("node_id").agg(F.flatten(F.collect_list("_t")).alias("tokens"), F.first(F.size("_t").cast("long")).alias("dl"))
    df = whole.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5))
    asked = asked_of(terms.join(df, "token", "left").withColumn("idf", idf), "idf")
    best = term_tiles.weighed(k, k1, b, mean or 1.0, all_terms)
    found = term_tiles.tiled(whole, asked, best, "score double", n, texts.count())
    cut = top(found.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.asc("node_id"))
    return for_all(cut, same).select("query_id", "rank", "node_id", "score")
