"""The best nodes of many queries by their shared tokens, in tiles: a group of queries against a piece of the nodes.

Both are dealt by hashes, so a tile holds a bounded number of each and no pair of a query and a node is ever a row
of a table. In a tile a query's tokens add to an array of scores, a number for each node; what can be among the ``k``
best leaves the tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes and queries of a tile at most, on average.
NODES, QUERIES = 16_384, 4_096
#: Scores are rounded to six places later.
SLACK = 2e-6


def _lists(column: pa.ChunkedArray) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The elements of a column of lists, and the row of each."""
    column = pa.chunked_array([column.combine_chunks()]) if column.num_chunks != 1 else column
    lists = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _by_id(nodes: pa.Table) -> pa.Table:
    """In the order of node_id, which may be a struct."""
    ids = nodes["node_id"]
    fields = pa.Table.from_struct_array(ids) if pa.types.is_struct(ids.type) else pa.table({"id": ids})
    keys = fields.rename_columns([str(i) for i in range(fields.num_columns)])
    return nodes.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start"))


class _Postings:
    """A piece's nodes by number, in the order of their ids: for each token of the tile's queries the nodes that hold it and how often.

    Nodes list each token as often as they hold it, or with ``times`` once and how often.
    """

    def __init__(self, nodes: pa.Table, queries: pa.Table):
        self.nodes = _by_id(nodes)
        asked, self.query = _lists(queries["tokens"])
        words = pc.unique(asked)
        self.asked = pc.index_in(asked, value_set=words).to_numpy(zero_copy_only=False)
        tokens, node = _lists(self.nodes["tokens"])
        known = pc.index_in(tokens, value_set=words)
        there = pc.is_valid(known).to_numpy(zero_copy_only=False)
        n = max(1, nodes.num_rows)
        pairs = pc.drop_null(known).to_numpy(zero_copy_only=False).astype(np.int64) * n + node[there]
        if "times" in nodes.column_names:
            order = np.argsort(pairs)
            pairs, self.tf = pairs[order], _lists(self.nodes["times"])[0].to_numpy(zero_copy_only=False)[there][order]
        else:
            pairs, self.tf = np.unique(pairs, return_counts=True)
        self.node = (pairs % n).astype(np.int64)
        self.starts = np.searchsorted(pairs // n, np.arange(len(words) + 1))
        self.bounds = np.searchsorted(self.query, np.arange(queries.num_rows + 1))

    def of_query(self, i: int):
        """For each token of a query its place among all queries' tokens, and where its postings begin and end."""
        for at in range(self.bounds[i], self.bounds[i + 1]):
            t = self.asked[at]
            yield at, self.starts[t], self.starts[t + 1]


def counted(k: int):
    """Tiles of nodes (node_id, tokens, ts, bonus) and queries (query_id, tokens, pos, points): query_id, node_id, score and first_pos of each query's first by score, newest, first_pos and id."""

    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        p = _Postings(nodes, queries)
        pos, points = (_lists(queries[c])[0].to_numpy(zero_copy_only=False) for c in ("pos", "points"))
        newest = np.unique(p.nodes["ts"].to_numpy(), return_inverse=True)[1] if len(nodes) else np.empty(0, np.int64)
        bonus, base = p.nodes["bonus"].to_numpy(), int(newest.max(initial=0)) + 1
        out = []
        for i in range(queries.num_rows):
            scores = np.zeros(len(nodes), np.int64)
            for at, a, b in p.of_query(i):
                scores[p.node[a:b]] += points[at]
            held = np.flatnonzero(scores)
            score = scores[held] + bonus[held]
            place = score * base + newest[held]
            if len(held) > k:
                few = place >= np.partition(place, -k)[-k]
                held, score, place = held[few], score[few], place[few]
            first = np.full(len(nodes), np.iinfo(np.int32).max, np.int32)
            for at, a, b in p.of_query(i):
                mine = p.node[a:b]
                first[mine] = np.minimum(first[mine], pos[at])
            order = np.lexsort((held, first[held], -place))[:k]
            out.append((np.full(len(order), i), held[order], score[order], first[held[order]]))
        q, r, s, f = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 4
        return pa.table({"query_id": queries["query_id"].take(pa.array(q)), "node_id": p.nodes["node_id"].take(pa.array(r)), "score": pa.array(s, pa.int64()), "first_pos": pa.array(f, pa.int32())})

    return run


def weighed(k: int, k1: float, b: float, mean: float, all_terms: bool):
    """Tiles of nodes (node_id, tokens, perhaps times, dl) and queries (query_id, tokens, idf): query_id, node_id and score of those that may be among each query's ``k`` best by BM25, rounded and by id."""

    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        p = _Postings(nodes, queries)
        idf = _lists(queries["idf"])[0].to_numpy(zero_copy_only=False)
        dl = p.nodes["dl"].to_numpy()[p.node]
        weight = p.tf * (k1 + 1) / (p.tf + k1 * (1 - b + b * dl / mean))
        out = []
        for i in range(queries.num_rows):
            scores, found = np.zeros(len(nodes)), np.zeros(len(nodes), np.int32)
            for at, lo, hi in p.of_query(i):
                scores[p.node[lo:hi]] += idf[at] * weight[lo:hi]
                found[p.node[lo:hi]] += 1
            held = np.flatnonzero(found == p.bounds[i + 1] - p.bounds[i] if all_terms else found)
            held = held[found[held] > 0]
            if len(held) > k:
                some = scores[held]
                held = held[some >= np.partition(some, -k)[-k] - SLACK]
            # of equal scores the first ids
            held = held[np.lexsort((held, -scores[held]))]
            falling = -scores[held]
            held = held[np.arange(len(held)) - np.searchsorted(falling, falling) < k]
            out.append((np.full(len(held), i), held, scores[held]))
        q, r = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*[o[:2] for o in out], strict=True)) if out else [np.empty(0, np.int64)] * 2
        s = np.concatenate([np.empty(0), *[o[2] for o in out]])
        return pa.table({"query_id": queries["query_id"].take(pa.array(q)), "node_id": p.nodes["node_id"].take(pa.array(r)), "score": pa.array(s)})

    return run


def tiled(nodes: DataFrame, queries: DataFrame, of_tile, columns: str, n: int, m: int) -> DataFrame:
    """``of_tile`` of each tile of ``n`` nodes (node_id, ...) and ``m`` queries (query_id, ...), about: query_id, node_id and ``columns``."""
    ids = [T.StructField(c, df.schema[c].dataType) for c, df in (("query_id", queries), ("node_id", nodes))]
    schema = T.StructType([*ids, *T.StructType.fromDDL(columns).fields])
    pieces = max(1, -(-n // NODES))
    # as many groups as keep all tasks busy, of 16 queries at least
    busy = min(-(-3 * nodes.sparkSession.sparkContext.defaultParallelism // pieces), m // 16)
    groups = max(1, -(-m // QUERIES), busy)
    dealt = lambda c, number: F.pmod(F.xxhash64(c), F.lit(number)).cast("int")
    all_of = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    left = nodes.withColumn("_piece", dealt("node_id", pieces)).withColumn("_group", all_of(groups))
    right = queries.withColumn("_group", dealt("query_id", groups)).withColumn("_piece", all_of(pieces))
    return left.groupBy("_group", "_piece").cogroup(right.groupBy("_group", "_piece")).applyInArrow(of_tile, schema)


#: Nodes of the keys that share a tile, about.
SHARED = 4_096


def dealt(keys: DataFrame) -> DataFrame:
    """Where the nodes and queries of each key meet: ``keys`` (about n nodes, m queries, and others) with _place, which several share, and _groups of their queries, for n and m. A job sums the nodes."""
    names = [c for c in keys.columns if c not in ("n", "m")]
    total, count = keys.agg(F.sum("n"), F.count("*")).first()
    # as many places as keep all tasks busy, of 64 keys at least
    places = max(1, -(-int(total or 0) // SHARED), min(3 * keys.sparkSession.sparkContext.defaultParallelism, count // 64))
    return keys.select(*names, F.pmod(F.xxhash64(*names), F.lit(places)).alias("_place"), F.ceil(F.col("m") / QUERIES).cast("int").alias("_groups"))


def _first_of_each(of_tile):
    """``of_tile`` with each node and query once, where several keys of theirs share the tile."""

    def once(rows: pa.Table, name: str) -> pa.Table:
        firsts = pa.table({"id": rows[name], "at": pa.array(np.arange(rows.num_rows))}).group_by("id").aggregate([("at", "min")])["at_min"]
        return rows if len(firsts) == rows.num_rows else rows.take(firsts)

    return lambda nodes, queries: of_tile(once(nodes, "node_id"), once(queries, "query_id"))


def met(nodes: DataFrame, queries: DataFrame, of_tile, columns: str) -> DataFrame:
    """``of_tile`` of each tile of nodes (node_id, ...) and queries (query_id, ...) that ``dealt`` puts together, a row for each of their keys; pairs that share two may be found twice."""
    ids = [T.StructField(c, df.schema[c].dataType) for c, df in (("query_id", queries), ("node_id", nodes))]
    schema = T.StructType([*ids, *T.StructType.fromDDL(columns).fields])
    left = nodes.withColumn("_at", F.col("_place")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    right = queries.withColumns({"_at": F.col("_place"), "_group": F.pmod(F.xxhash64("query_id"), F.col("_groups")).cast("int")})
    left, right = (df.drop("_place", "_groups").groupBy("_at", "_group") for df in (left, right))
    return left.cogroup(right).applyInArrow(_first_of_each(of_tile), schema)
