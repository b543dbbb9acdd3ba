"""The closest vectors of many queries, in tiles: a group of queries against a piece of the rows, as products of matrices.

Queries and rows are dealt into groups and pieces by hashes, so a tile holds a bounded number of both and tiles
are spread over all tasks; each row is shuffled once for each group of queries. A tile finds the best of each of its
queries, so no pair of a query and a row is ever a row of a table.

Within a tile cosines come from products in 32 bits, whose error is bounded. What the bound cannot exclude is
computed again in doubles, added up in order as ``vectors.cosine`` does, so scores and their order are
the same to the last bit. A search of rows with 8-bit forms (q8, step, length, apart, see ``cells``) takes these
in place of the rounded vectors, and their distance as the bound.

Vectors of another length than most queries', with nulls or numbers that are not finite, or of
a length that doubles cannot square, are compared by ``vectors.cosine`` itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vectors as V

#: Numbers in a tile's rows and queries: 131,072 rows and 16,384 queries of 64.
ROW_NUMBERS, QUERY_NUMBERS = 1 << 23, 1 << 20
#: Queries and rows of one product, pairs compared in doubles at once.
QUERIES, ROWS, PAIRS = 256, 4096, 16_384
#: What stands first among equal scores.
TIES = ("node_id", "chunk_id")
EIGHTH = ("q8", "step", "length", "apart")


def regular(vector: Column, dim: int) -> Column:
    """Whether a vector can go into a matrix of ``dim`` columns; never null."""
    size = V.dot(vector, vector)
    return F.coalesce((F.size(vector) == dim) & ((size == 0) | ((size >= 1e-200) & (size <= 1e200))), F.lit(False))


def vectors_of(column: pa.ChunkedArray, dim: int, kind=np.float64) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.empty(0, kind), *flat]).astype(kind, copy=False).reshape(-1, dim)


def _lengths(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * x[:, d]
    total = np.sqrt(total)
    total[total == 0] = 1.0
    return total


def _cosines(x, y, nx, ny, r, q) -> np.ndarray:
    out = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        a, b = r[at : at + PAIRS], q[at : at + PAIRS]
        products, total = x[a] * y[b], np.zeros(len(a))
        for d in range(x.shape[1]):
            total += products[:, d]
        out[at : at + PAIRS] = total / (nx[a] * ny[b])
    return out


def nearest(x: np.ndarray, y: np.ndarray, k: int, rough: np.ndarray | None = None, off: np.ndarray | None = None, cell: np.ndarray | None = None, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the ``k`` rows of ``x`` closest to each row of ``y``, the first of equals.

    ``rough``: rows of about length 1 that stand for those of ``x``, ``off`` at most from them. ``among``: a row of bits for each
    query, those of the cells that it looks into; ``cell``: each row's.
    """
    nx, ny, slack = _lengths(x), _lengths(y), (x.shape[1] + 16) * 1.2e-7
    fx = (x / nx[:, None]).astype(np.float32) if rough is None else rough
    fy = (y / ny[:, None]).astype(np.float32)
    bound = (np.zeros(len(x)) if off is None else off) + slack
    found = []
    for a in range(0, len(y), QUERIES):
        part = fy[a : a + QUERIES]
        looks = None if among is None else np.unpackbits(among[a : a + QUERIES], axis=1).astype(bool)
        q, r, s, floor = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(part), -np.inf)
        for b in range(0, len(x), ROWS):
            near, off_by = part @ fx[b : b + ROWS].T, bound[b : b + ROWS].astype(np.float32)
            if looks is not None:
                near[~looks[:, cell[b : b + ROWS]]] = -np.inf
            least = floor
            if near.shape[1] > k and np.isneginf(floor).any():
                least = np.maximum(floor, np.partition(near - off_by, -k, axis=1)[:, -k] - slack)
            near += off_by
            hit_q, hit_r = np.nonzero((near >= (least - slack).astype(np.float32)[:, None]) & (near > -np.inf))
            if not len(hit_q):
                continue
            q, r = np.concatenate([q, hit_q]), np.concatenate([r, hit_r + b])
            s = np.concatenate([s, _cosines(x, y, nx, ny, hit_r + b, hit_q + a)])
            order = np.lexsort((r, -s, q))
            q, r, s = q[order], r[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            floor[q[place == k - 1]] = s[place == k - 1]
            q, r, s = q[place < k], r[place < k], s[place < k]
        found.append((q + a, r, s))
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def bits_of(column: pa.ChunkedArray) -> np.ndarray:
    """A column of binaries of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def largest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``y`` whether each row of ``x`` is among the ``k`` closest by cosine, the first of equals; ``k`` of ``x``'s rows at most.

    Only those within the products' error of the k-th are compared in doubles.
    """
    nx, ny, slack = _lengths(x), _lengths(y), (x.shape[1] + 16) * 1.2e-7
    fx, fy = (x / nx[:, None]).astype(np.float32), (y / ny[:, None]).astype(np.float32)
    out = np.zeros((len(y), len(x)), bool)
    for a in range(0, len(y), QUERIES):
        near = fy[a : a + QUERIES] @ fx.T
        last = np.partition(near, len(x) - k, axis=1)[:, len(x) - k, None].astype(np.float64)
        sure = near > last + 3 * slack
        q, r = np.nonzero(~sure & (near >= last - 3 * slack))
        order = np.lexsort((r, -_cosines(x, y, nx, ny, r, q + a), q))
        q, r = q[order], r[order]
        taken = np.arange(len(q)) - np.searchsorted(q, q) < (k - sure.sum(axis=1))[q]
        sure[q[taken], r[taken]] = True
        out[a : a + QUERIES] = sure
    return out


def _of_tile(k: int, dim: int, names: list[str], eighth: bool, among: bool):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows.select(TIES), sort_keys=[(c, "ascending") for c in TIES], null_placement="at_start")
        at = order.to_numpy()
        x, y = vectors_of(rows["embedding"], dim, np.float64)[at], vectors_of(queries["q"], dim, np.float64)
        rough = off = None
        if eighth:
            step, length, apart = (rows[c].to_numpy()[at] for c in EIGHTH[1:])
            rough, off = vectors_of(rows["q8"], dim, np.float32)[at] * (step / length).astype(np.float32)[:, None], apart / length
        cell, bits = (rows["cell"].to_numpy()[at], bits_of(queries["among"])) if among else (None, None)
        q, r, s = nearest(x, y, k, rough, off, cell, bits)
        picked = rows.select(names).take(order.take(pa.array(r)))
        return picked.append_column("query_id", queries["query_id"].take(pa.array(q))).append_column("score", pa.array(s))

    return run


def vector_top(rows: DataFrame, queries: DataFrame, k: int, key: str | None = None) -> DataFrame:
    """For each of ``queries`` (query_id, q and ``key``) candidates that hold its ``k`` closest of ``rows`` by cosine, those of equal ``key`` if one is given.

    rows: node_id, chunk_id, embedding, perhaps the 8-bit form, and others. Where queries have ``among`` (a bit for each cell, the highest of a byte first),
    only rows of these cells (``cell``) count. Returns these others with query_id and score: up to ``k``
    of each tile. Its jobs count rows and queries.
    """
    eighth = set(EIGHTH) <= set(rows.columns)
    others = [c for c in rows.columns if c != "embedding" and c not in EIGHTH]
    among = "among" in queries.columns
    asked = queries.select("query_id", "q", *([key] if key else []), *(["among"] if among else []))
    dim = asked.agg(F.mode(F.size("q"))).first()[0] or 0
    odd = lambda c: F.count_if(~regular(F.col(c), dim))
    n, odd_rows = rows.agg(F.count("*"), odd("embedding")).first()
    m, odd_queries = asked.agg(F.count("*"), odd("q")).first()

    def plainly(some: DataFrame, few: DataFrame) -> DataFrame:
        both = some.join(few, key) if key else some.crossJoin(few)
        if among:
            both = both.filter("shiftright(cast(conv(hex(substring(among, cell div 8 + 1, 1)), 16, 10) as int), 7 - cell % 8) & 1 = 1")
        return both.withColumn("score", V.cosine(F.col("embedding"), F.col("q"))).select(*others, "query_id", "score")

    out = []
    fine_rows = rows if not odd_rows else rows.filter(regular(F.col("embedding"), dim))
    fine_queries = asked if not odd_queries else asked.filter(regular(F.col("q"), dim))
    if odd_rows:
        out.append(plainly(rows.filter(~regular(F.col("embedding"), dim)), asked))
    if odd_queries:
        out.append(plainly(fine_rows, asked.filter(~regular(F.col("q"), dim))))
    if n > odd_rows and m > odd_queries or not out:
        out.append(_tiled(fine_rows, fine_queries, k, key, max(1, dim), n, m, others, eighth, among))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def _tiled(rows, queries, k, key, dim, n, m, others, eighth, among) -> DataFrame:
    most_rows, most_queries = max(1, ROW_NUMBERS // dim), max(1, QUERY_NUMBERS // dim)
    if key is None:
        pieces = max(1, -(-n // most_rows))
        # as many groups as keep all tasks busy, of 64 queries at least
        busy = min(-(-3 * rows.sparkSession.sparkContext.defaultParallelism // pieces), m // 64)
        sizes, pieces, groups = None, F.lit(pieces), F.lit(max(1, -(-m // most_queries), busy))
        on, placed_rows, placed_queries = F.lit(0), rows, queries
    else:
        count = lambda df, most, name: df.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        sizes = count(rows, most_rows, "_pieces").join(count(queries, most_queries, "_groups"), key)
        pieces, groups, on = F.col("_pieces"), F.col("_groups"), F.col(key)
        placed_rows, placed_queries = rows.join(sizes, key), queries.join(sizes, key)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed_rows.withColumns({"_key": on, "_piece": F.pmod(F.xxhash64(*TIES), pieces).cast("int")}).withColumn("_group", all_of(groups))
    right = placed_queries.withColumns({"_key": on, "_group": F.pmod(F.xxhash64("query_id"), groups).cast("int")}).withColumn("_piece", all_of(pieces))
    needed = list(dict.fromkeys([*others, *TIES, "embedding", *(EIGHTH if eighth else ())]))
    left = left.select("_key", "_group", "_piece", *needed)
    right = right.select("_key", "_group", "_piece", "query_id", "q", *(["among"] if among else []))
    types = {f.name: f.dataType for f in [*rows.schema.fields, *queries.schema.fields]}
    schema = T.StructType([T.StructField(c, types[c]) for c in [*others, "query_id"]] + [T.StructField("score", T.DoubleType())])
    by = ("_key", "_group", "_piece")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_of_tile(k, dim, others, eighth, among), schema)
