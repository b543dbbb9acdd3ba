"""Many small cells: files follow the rows and not the cells, and probes by bits find what probes by cell do."""

import glob
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import cells, tiles

SCHEMA = "node_id string, chunk_id string, project_id string, embedding array<float>"


def found(df):
    return sorted((r["query_id"], r["rank"], r["node_id"], r["cell"], r["score"]) for r in df.collect())


def test_packs_and_probes(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    data = [(f"v{i}", "c", f"p{i % 3}", [round(rng.gauss(0, 1), 1) for _ in range(6)]) for i in range(800)]
    rows = spark.createDataFrame(data, SCHEMA)
    at = cells.VectorCells(spark, str(tmp_path / "packs"), most=10)
    at.apply(rows.filter("cast(substring(node_id, 2, 9) as int) % 2 = 0"))
    at.apply(rows.filter("cast(substring(node_id, 2, 9) as int) % 2 = 1"), spark.createDataFrame([("v0",), ("v2",)], "node_id string"))
    state = at.state
    assert len(state["cells"]) > 80 and len(glob.glob(f"{tmp_path}/packs/rows/**/*.parquet", recursive=True)) < len(state["cells"])
    assert sorted(r["node_id"] for r in at.rows(state["cells"]).collect()) == sorted(d[0] for d in data if d[0] not in ("v0", "v2"))
    assert sum(x["n"] for x in state["cells"].values()) == 798
    # packs hold no more than twice the live rows
    live = {}
    for x in state["cells"].values():
        live[x["folder"]] = live.get(x["folder"], 0) + x["n"]
    assert set(live) == set(state["packs"]) and all(2 * n >= state["packs"][f] for f, n in live.items())
    asked = [(i, [float(x) for x in d[3]]) for i, d in enumerate(data[::40])] + [(100, [0.0] * 6), (101, [1e-150] * 6), (102, [1e-160] + [0.0] * 5)]
    asked = spark.createDataFrame(asked, "query_id long, q array<double>")
    for probes in (20, len(state["cells"]) - 1):
        bits = found(at.search(asked, 7, probes))
        monkeypatch.setattr(cells, "PART", 0)
        assert bits == found(at.search(asked, 7, probes)) and len(bits) == 23 * 7
        monkeypatch.undo()
    # odd rows of cells that are looked into, and of others
    monkeypatch.setattr(tiles, "regular", lambda vector, dim: (F.size(vector) == dim) & (vector[0] > 0))
    bits = found(at.search(asked, 7, 40))
    monkeypatch.setattr(cells, "PART", 0)
    assert bits == found(at.search(asked, 7, 40))


def test_largest():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-2, 3, (50, 3)).astype(float), rng.integers(-2, 3, (300, 3)).astype(float)
    for k in (1, 20, 49):
        rows, queries = np.repeat(np.arange(50), 300), np.tile(np.arange(300), 50)
        scores = tiles._cosines(x, y, tiles._lengths(x), tiles._lengths(y), rows, queries).reshape(50, 300)
        told = np.zeros((300, 50), bool)
        for q in range(300):
            told[q, np.lexsort((np.arange(50), -scores[:, q]))[:k]] = True
        assert (tiles.largest(x, y, k) == told).all()
