"""Product-quantisation codes of vectors, with integer codebooks and metric search for the nearest entry.

Components become integers floor(1024 * x). A vector is cut into PARTS equal parts; each part position
has a codebook of up to ENTRIES entries, which starts as that part of the vectors with the smallest ids.
Each of ROUNDS rounds assigns all parts to their nearest entries (squared Euclidean distance, ties to the lower
index) and replaces each entry by the floored mean of its parts.

Search: a vantage-point tree over the entries of a part position. An inner node holds the range of
distances from its vantage entry to the entries of either child; a query skips a child if no distance
within its best so far can lie in that range. Ranges and distances are square roots of whole numbers,
rounded down below and up above by more than a double's error, and a bound met exactly is visited, so that
an equally near entry of lower index is never missed; entries are compared by their whole-number distances
only. Queries go through a tree together: first each down to the leaf that its distances point to, which
gives it a bound, then all through the nodes that their bounds leave.

Assignments never leave their tasks but as sums of each (part, entry): a round is one pass over the vectors
and one aggregation of at most PARTS * ENTRIES rows a task, and the codebooks, PARTS * ENTRIES entries
whatever the input, are all that goes through the driver.

Cases: rows whose vector is null or holds a null, a NaN or an infinity are left out. Shorter vectors
are filled up with zeros to the longest one's length, and that to a multiple of PARTS. A component is
held within 2 ** 27 either way, so that all squared distances are exact (from |x| = 131072 on values are thus
equal); sums over labels that pass a long's range stop at its end. Equal ids are ordered by their vectors, null ids come last;
repeated rows count as often as they stand there. With fewer than ENTRIES vectors the codebooks are shorter; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Components are held within this, so that the squared distance of two vectors of 128 components is below 2 ** 63.
MOST = 1 << 27
#: Entries of a leaf, which are all compared.
LEAF = 16
#: Queries that go through a tree together.
BLOCK = 4096
#: More than a double's relative error of a square root.
SLACK = 2.0**-48
LONG = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as integers within MOST."""
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def squared(queries: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The squared distances of queries from one entry."""
    apart = queries - entry
    return np.einsum("ij,ij->i", apart, apart)


class VantageTree:
    """The entries of one codebook, for ``nearest``. ``compared`` counts the distances that searches took."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.compared = entries, 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray):
        """A leaf (indexes), or (vantage index, bound between near and far, ((least, most), node) of near and far)."""
        if len(own) <= LEAF:
            return own
        # the entry farthest from the first one is a good vantage
        vantage = own[np.argmax(squared(self.entries[own], self.entries[own[0]]))]
        rest = own[own != vantage]
        apart = squared(self.entries[rest], self.entries[vantage])
        order = np.argsort(apart, kind="stable")
        half = len(order) // 2
        sides = [((_below(apart[side].min()), _above(apart[side].max())), self._node(np.sort(rest[side]))) for side in (order[:half], order[half:])]
        return vantage, np.sqrt(float(apart[order[half]])), sides

    def _compare(self, index: int, active: np.ndarray, queries, best, code) -> np.ndarray:
        """Lets the entry count for the active queries; its squared distances from them."""
        apart = squared(queries[active], self.entries[index])
        self.compared += len(active)
        nearer = (apart < best[active]) | (apart == best[active]) & (index < code[active])
        won = active[nearer]
        best[won], code[won] = apart[nearer], index
        return apart

    def _descend(self, node, active, *state) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for i in node:
                self._compare(i, active, *state)
            return
        vantage, bound, (near, far) = node
        apart = np.sqrt(self._compare(vantage, active, *state).astype(np.float64))
        self._descend(near[1], active[apart < bound], *state)
        self._descend(far[1], active[apart >= bound], *state)

    def _visit(self, node, active, queries, best, code) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for i in node:
                self._compare(i, active, queries, best, code)
            return
        vantage, _, sides = node
        apart = self._compare(vantage, active, queries, best, code)
        low, high = _below(apart), _above(apart)
        for (least, most), child in sides:
            within = _above(best[active])
            self._visit(child, active[(low - within <= most) & (high + within >= least)], queries, best, code)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each query and its squared distance."""
        best, code = np.full(len(queries), LONG, dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        for at in range(0, len(queries), BLOCK):
            own = np.arange(at, min(at + BLOCK, len(queries)))
            self._descend(self.root, own, queries, best, code)
            self._visit(self.root, own, queries, best, code)
        return code, best


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v (doubles) of the rows that count."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull()).filter(~odd).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of ``width`` integers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = whole(column.flatten().to_numpy(zero_copy_only=False)), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), dtype=np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _cut(rows: np.ndarray, part: int) -> np.ndarray:
    size = rows.shape[1] // PARTS
    return np.ascontiguousarray(rows[:, part * size : (part + 1) * size])


def _sums(books: list[np.ndarray], width: int):
    """Of a task's vectors: part, entry, how many parts it is nearest to and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in books]
        counts = np.zeros((PARTS, len(books[0])), dtype=np.int64)
        sums = np.zeros((PARTS, len(books[0]), width // PARTS), dtype=np.int64)
        for b in batches:
            rows = matrix(b.column("v"), width)
            for p in range(PARTS):
                own = _cut(rows, p)
                code, _ = trees[p].nearest(own)
                np.add.at(sums[p], code, own)
                counts[p] += np.bincount(code, minlength=len(books[0]))
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def fitted(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after all rounds."""
    # the number of entries bounds what is collected
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = matrix(first.column("v"), width)
    books = [_cut(start, p) for p in range(PARTS)]
    for _ in range(rounds if len(start) else 0):
        partial = rows.select("v").mapInArrow(_sums(books, width), "part long, entry long, n long, sums array<long>")
        wide = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width // PARTS)])
        for r in wide.collect():  # at most PARTS * entries
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width // PARTS)]
    return books


def _coded(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in books]
        for b in batches:
            rows = matrix(b.column("v"), width)
            found = [trees[p].nearest(_cut(rows, p)) for p in range(PARTS)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            error = sum(apart for _, apart in found)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry.tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) and the codebooks. ``entries``: at most 256, the values of two hex digits.

    Labels are summed before their sums meet the rows again, in a join that Spark may split where a label is frequent.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    books = fitted(rows, width, entries, rounds)
    types = dict(rows.dtypes)
    coded = written(rows.mapInArrow(_coded(books, width), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books
