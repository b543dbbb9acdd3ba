"""A stored vector index in cells, kept up to date by deltas, scanned in 8 bits and ranked exactly.

Vectors lie in the cell of the nearest centre by cosine, many cells to a pack (a folder). A delta puts its vectors into their
cells and takes those of changed and deleted nodes out; only the cells that this concerns are written anew, to packs of their own, all
others stay as they are. What a pack holds of cells written since is passed over, by the number of the write (``made``) that rows and cells have;
a pack with no live row is deleted, and the cells of one with less than half of its rows live are written anew. Cells of over ``most`` vectors are split, all in one pass, by k-means on their own rows; the cells that it was
split into are remembered, so a node's place (its cell, kept in BUCKETS by a hash of its id) need not be
rewritten. A JSON state names what counts and moves on when all is whole.

A search reads 8-bit vectors of the probed cells: with the vector's distance from its 8-bit form, the product with a
query is known within that distance times the query's length. Vectors that cannot be among the k best by these bounds
are left out; the full vectors of the rest are ranked exactly, in the same tile (``tiles``), so that candidates never
are a table of their own. So the result is that of comparing all full vectors of the
probed cells, and with all cells probed, of all vectors. Where a search looks into a large part of all cells, a query has a bit for each
cell and meets all rows in tiles; else it is sent to each of its cells.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import vectors as V
from tidemark.operators import lexical, tiles
from tidemark.operators.tables import Pointer, remove

BUCKETS = 64
#: Rows that centres are fitted on.
SAMPLE = 20_000
#: Rows of a pack, about.
PACK = 50_000
#: A query that looks into more than this part of the cells meets all rows.
PART = 8
ROWS = "node_id string, chunk_id string, project_id string, embedding array<float>, q8 array<tinyint>, step double, length double, apart double, cell int"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
#: More than the rounding errors of products in doubles.
SLACK = 1e-9


def eighth(embedding: Column) -> dict[str, Column]:
    """q8 and step (the 8-bit form: q8 * step), length, and apart (the distance from that form)."""
    step = 1.0 / V.int8_scale(embedding)
    q = V.quantize(embedding)
    off = V.with_value(step, lambda s: F.zip_with(embedding, q, lambda x, y: x.cast("double") - y * s))
    return {"q8": q.cast("array<tinyint>"), "step": step, "length": V.norm(embedding), "apart": F.sqrt(V.with_value(off, lambda o: V.dot(o, o)))}


def bounded_topk(pairs: DataFrame, k: int) -> DataFrame:
    """Of rows (query_id, q, q8, step, length, apart, ...) those that may be among a query's k closest by cosine."""
    size = F.sqrt(V.dot(F.col("q"), F.col("q")))
    whole = F.col("length") * V.norm(F.col("q"))
    near, off = V.dot(F.col("q"), F.col("q8")) * F.col("step") / whole, size * F.col("apart") / whole + SLACK
    scored = pairs.withColumns({"_low": near - off, "_high": near + off}).drop("q", "q8", "step", "length", "apart")
    floor = lexical.top(scored.select("query_id", "_low"), k, F.desc("_low")).filter(F.col("rank") == k).select("query_id", F.col("_low").alias("_floor"))
    return scored.join(floor, "query_id", "left").filter(F.col("_high") >= F.coalesce("_floor", F.lit(-2.0))).drop("_low", "_high", "_floor")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the centre with the largest product with each row, in blocks of bounded size."""
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([np.empty(0, np.int64), *[(x[a : a + step] @ centres.T).argmax(axis=1) for a in range(0, len(x), step)]])


def _probed(numbers: list[int], centres: list[list[float]], wanted: int):
    """Batches of queries with ``among``: a bit for each cell number, those of the ``wanted`` nearest centres set."""
    x, places = np.array(centres, dtype=np.float64), np.array(numbers)

    def run(batches):
        for batch in batches:
            queries = pa.Table.from_batches([batch])
            out = np.zeros((batch.num_rows, places[-1] + 1), bool)
            out[:, places] = tiles.largest(x, tiles.vectors_of(queries["q"], x.shape[1]), wanted)
            bits = pa.array([row.tobytes() for row in np.packbits(out, axis=1)], pa.binary())
            yield from queries.append_column("among", bits).to_batches()

    return run


def _centres_of(wanted: dict[int, int], seed: int):
    """The centres of a cell's rows by k-means on the sphere, as many as ``wanted`` has for it; those without a row are left out."""

    def run(rows: pa.Table) -> pa.Table:
        cell = rows["cell"][0].as_py()
        x = _unit(np.array(rows.sort_by("place")["embedding"].to_pylist(), dtype=np.float64))
        k, rng = min(wanted[cell], len(x)), np.random.default_rng(seed)
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            at = _closest(x, centres)
            order = np.argsort(at, kind="stable")
            centres = _unit(np.add.reduceat(x[order], np.flatnonzero(np.diff(at[order], prepend=-1))))
        return pa.table({"cell": pa.array([cell] * len(centres), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    return run


class VectorCells:
    """The index under ``root``: ``apply`` writes a delta of chunks (node_id, chunk_id, project_id, embedding), ``search`` answers queries."""

    def __init__(self, spark: SparkSession, root: str, most: int = 2000, probes: int = 10, seed: int = 1):
        self.spark, self.root, self.most, self.probes, self.seed = spark, root.rstrip("/"), most, probes, seed
        self.pointer = Pointer(spark, f"{self.root}/current")

    @property
    def state(self) -> dict:
        """cells (number -> folder of its pack, made, n, centre), packs (folder -> rows), made (writes), split (number -> the numbers it was split into), next number, places (bucket -> folder)."""
        return self.pointer.read({"cells": {}, "packs": {}, "made": 0, "split": {}, "next": 0, "places": {}})

    def _read(self, folders, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rows(self, cells: dict, numbers=None) -> DataFrame:
        """The rows of all cells, or of some."""
        live = [(int(c), x["made"]) for c, x in cells.items() if x["folder"] and (numbers is None or int(c) in numbers)]
        folders = sorted({x["folder"] for c, x in cells.items() if x["folder"] and (numbers is None or int(c) in numbers)})
        rows = self._read(folders, f"{ROWS}, made int")
        return (rows.join(F.broadcast(self.spark.createDataFrame(live, "cell int, made int")), ["cell", "made"], "left_semi") if live else rows).select(*NAMES)

    def _centres(self, rows: DataFrame, k: int) -> list[list[float]]:
        fit = rows.orderBy(F.xxhash64("node_id", "chunk_id")).limit(SAMPLE).select(F.lit(0).alias("cell"), "embedding", F.xxhash64("node_id", "chunk_id").alias("place"))
        made = fit.groupBy("cell").applyInArrow(_centres_of({0: k}, self.seed), "cell int, centre array<double>").collect()
        return [list(r["centre"]) for r in made]

    @staticmethod
    def _nearest(centres: dict[int, list[float]]):
        """A column function: the number of the nearest of ``centres``, the lowest of equals."""
        numbers = np.array(sorted(centres), dtype=np.int32)
        matrix = np.array([centres[int(c)] for c in numbers], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

        @F.pandas_udf("int")
        def nearest(vectors: pd.Series) -> pd.Series:
            return pd.Series(numbers[_closest(np.stack(vectors.to_numpy()).astype(np.float64), matrix)] if len(vectors) else [], dtype="int32")

        return nearest

    def _write(self, rows: DataFrame, n: int, state: dict) -> dict[int, dict]:
        """About ``n`` rows by their cell into packs, which ``state`` is told of; the cells' folders, numbers of the write and sizes."""
        path, packs = f"{self.root}/rows/{uuid.uuid4().hex}", max(1, -(-n // PACK))
        state["made"] += 1
        piece = F.pmod(F.xxhash64("node_id"), F.lit(8))
        dealt = rows.select(*NAMES, F.lit(state["made"]).alias("made"), F.pmod("cell", F.lit(packs)).alias("at")).repartition("at", piece)
        dealt.sortWithinPartitions("at", "cell").write.partitionBy("at").parquet(path)
        sizes = self.spark.read.parquet(path).groupBy("cell").count().collect() if self._any(path) else []
        written = {r["cell"]: {"folder": f"{path}/at={r['cell'] % packs}", "made": state["made"], "n": r["count"]} for r in sizes}
        for x in written.values():
            state["packs"][x["folder"]] = state["packs"].get(x["folder"], 0) + x["n"]
        return written

    def _any(self, path: str) -> bool:
        return any(s.isDirectory() for s in self.pointer.system.listStatus(self.pointer.jvm.org.apache.hadoop.fs.Path(path)))

    def apply(self, chunks: DataFrame | None = None, deleted: DataFrame | None = None) -> dict:
        """Put ``chunks`` in, in place of all chunks of their nodes, and take the nodes of ``deleted`` (node_id) out. Returns the state."""
        state, name = self.state, uuid.uuid4().hex
        cells = {int(c): x for c, x in state["cells"].items()}
        new = self.spark.createDataFrame([], "node_id string, chunk_id string, project_id string, embedding array<float>") if chunks is None else chunks
        new = new.filter(F.col("embedding").isNotNull()).select("node_id", "chunk_id", "project_id", F.col("embedding").cast("array<float>").alias("embedding"))
        if not cells and (n := new.count()):
            k = max(1, -(-2 * n // self.most))
            fitted = self._centres(new, k) if k > 1 else [[1.0] * new.select(F.size("embedding")).first()[0]]
            cells = {state["next"] + i: {"folder": None, "made": 0, "n": 0, "centre": c} for i, c in enumerate(fitted)}
            state["next"] += len(cells)
        if not cells:
            return state
        placed = new.withColumns(eighth(F.col("embedding"))).withColumn("cell", self._nearest({c: x["centre"] for c, x in cells.items()})(F.col("embedding")))
        # placed once, as this is the costly part
        incoming = f"{self.root}/incoming/{name}"
        placed.write.parquet(incoming)
        placed = self.spark.read.schema(placed.schema).parquet(incoming)
        gone = placed.select("node_id") if deleted is None else placed.select("node_id").union(deleted.select("node_id"))
        gone = gone.distinct()
        bucket = F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("string")
        touched_buckets = [r[0] for r in gone.select(bucket).distinct().collect()]  # at most BUCKETS
        places = self._read([state["places"][b] for b in touched_buckets if b in state["places"]], "node_id string, cell int")
        was = {r[0] for r in places.join(gone, "node_id", "left_semi").select("cell").distinct().collect()}
        lost = self.rows({c: x for c, x in cells.items() if x["folder"]}, self._leaves(was, state["split"])).join(gone, "node_id", "left_semi")
        touched = {r[0] for r in lost.select("cell").distinct().collect()} | {r[0] for r in placed.select("cell").distinct().collect()}
        kept = self.rows({c: x for c, x in cells.items() if x["folder"]}, touched).join(gone, "node_id", "left_anti")
        written = self._write(kept.unionByName(placed), placed.count() + sum(cells[c]["n"] for c in touched), state)
        for c in touched:
            cells[c] = {**cells[c], **written.get(c, {"folder": None, "made": 0, "n": 0})}
        placing = places.join(gone, "node_id", "left_anti").unionByName(placed.select("node_id", "cell").distinct())
        path = f"{self.root}/places/{name}"
        placing.withColumn("at", bucket).repartition("at").write.partitionBy("at").parquet(path)
        stale = [state["places"][b] for b in touched_buckets if b in state["places"]]
        there = {s.getPath().getName() for s in self.pointer.system.listStatus(self.pointer.jvm.org.apache.hadoop.fs.Path(path))}
        for b in touched_buckets:
            state["places"].pop(b, None)
            if f"at={b}" in there:
                state["places"][b] = f"{path}/at={b}"
        if over := sorted(c for c in touched if cells[c]["n"] > self.most):
            self._split(over, cells, state)
        dropped = self._packed(cells, state)
        state["cells"] = {str(c): x for c, x in cells.items() if x["folder"]} or {str(c): x for c, x in cells.items()}
        state = self.pointer.move(state)
        for folder in [*dropped, *stale, incoming]:
            remove(self.spark, folder)
        return state

    @staticmethod
    def _leaves(numbers: set[int], split: dict) -> set[int]:
        """The cells that these were split into, or themselves."""
        out, queue = set(), list(numbers)
        while queue:
            c = queue.pop()
            queue += split.get(str(c), [])
            if str(c) not in split:
                out.add(c)
        return out

    def _packed(self, cells: dict, state: dict) -> list[str]:
        """Write the cells of packs that are less than half live anew; the packs without a live row, which ``state`` then has no more."""
        live = {}
        for x in cells.values():
            live[x["folder"]] = live.get(x["folder"], 0) + x["n"]
        if weak := {c for c, x in cells.items() if x["folder"] and 2 * live[x["folder"]] < state["packs"][x["folder"]]}:
            for c, x in self._write(self.rows(cells, weak), sum(cells[c]["n"] for c in weak), state).items():
                cells[c] = {**cells[c], **x}
        held = {x["folder"] for x in cells.values()}
        dropped = [folder for folder in state["packs"] if folder not in held]
        for folder in dropped:
            del state["packs"][folder]
        return dropped

    def _split(self, over: list[int], cells: dict, state: dict) -> None:
        """Cut cells into ones of about half of ``most``, all at once."""
        rows = self.rows(cells, set(over))
        wanted = {c: max(2, -(-2 * cells[c]["n"] // self.most)) for c in over}
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("node_id", "chunk_id")))
        fit = rows.select("cell", "embedding", place.alias("place")).filter(F.col("place") <= SAMPLE)
        # a centre for each new cell, as the state has
        made = fit.groupBy("cell").applyInArrow(_centres_of(wanted, self.seed), "cell int, centre array<double>").collect()
        centres = {state["next"] + i: (r["cell"], list(r["centre"])) for i, r in enumerate(sorted(made))}
        state["next"] += len(centres)
        written = self._write(rows.withColumn("cell", self._nearest_within(centres)(F.col("cell"), F.col("embedding"))), sum(cells[c]["n"] for c in over), state)
        for cell in over:
            state["split"][str(cell)] = [c for c in written if centres[c][0] == cell]
        for cell in over:
            del cells[cell]
        cells |= {c: {**x, "centre": centres[c][1]} for c, x in written.items()}

    @staticmethod
    def _nearest_within(centres: dict[int, tuple[int, list[float]]]):
        """A column function of a cell and a vector: the number of the nearest of the ``centres`` (number -> cell, centre) of that cell."""
        within = {}
        for number, (cell, centre) in sorted(centres.items()):
            within.setdefault(cell, []).append((number, centre))
        within = {c: (np.array([n for n, _ in x], dtype=np.int32), _unit(np.array([v for _, v in x], dtype=np.float64))) for c, x in within.items()}

        @F.pandas_udf("int")
        def nearest(cell: pd.Series, vectors: pd.Series) -> pd.Series:
            out = np.empty(len(cell), dtype=np.int32)
            numbers = cell.to_numpy()
            for c in np.unique(numbers):
                at = np.flatnonzero(numbers == c)
                found, matrix = within[int(c)]
                out[at] = found[_closest(np.stack(vectors.to_numpy()[at]).astype(np.float64), matrix)]
            return pd.Series(out)

        return nearest

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, scope: str | None = None) -> DataFrame:
        """(query_id, rank, node_id, chunk_id, project_id, cell, score): the ``k`` closest of each of ``queries`` (query_id, q) among its nearest cells."""
        cells = {int(c): x for c, x in self.state["cells"].items()}
        rows = self.rows({c: x for c, x in cells.items() if x["folder"]})
        rows = rows if scope is None else rows.filter(F.col("project_id") == scope)
        asked, wanted = queries.select("query_id", "q"), probes or self.probes
        if wanted >= len(cells):
            found = tiles.vector_top(rows, asked, k)
        elif wanted * PART > len(cells):
            numbers = sorted(cells)
            dim = len(cells[numbers[0]]["centre"])
            fine = asked.filter(tiles.regular(F.col("q"), dim)).withColumn("q", F.col("q").cast("array<double>"))
            schema = T.StructType([*fine.schema.fields, T.StructField("among", T.BinaryType())])
            fine = fine.mapInArrow(_probed(numbers, [cells[c]["centre"] for c in numbers], wanted), schema)
            found, odd = tiles.vector_top(rows, fine, k), asked.filter(~tiles.regular(F.col("q"), dim))
            if odd.limit(1).count():
                found = found.unionByName(self._by_cell(rows, odd, k, wanted, cells))
        else:
            found = self._by_cell(rows, asked, k, wanted, cells)
        best = lexical.top(found, k, F.desc("score"), F.asc("node_id"), F.asc("chunk_id"))
        return best.select("query_id", "node_id", "chunk_id", "project_id", "cell", "score", "rank")

    def _by_cell(self, rows: DataFrame, asked: DataFrame, k: int, wanted: int, cells: dict) -> DataFrame:
        """Candidates from the ``wanted`` nearest cells of each query, which is sent to each of them."""
        # the centres are a row for each cell; those closest to each query come by tiles as well
        centres = self.spark.createDataFrame([(f"{c:012d}", x["centre"]) for c, x in cells.items()], "node_id string, embedding array<double>").withColumn("chunk_id", F.lit(""))
        near = lexical.top(tiles.vector_top(centres, asked, wanted), wanted, F.desc("score"), F.asc("node_id"))
        asked = near.select("query_id", F.col("node_id").cast("int").alias("cell")).join(asked, "query_id")
        return tiles.vector_top(rows, asked, k, "cell")
