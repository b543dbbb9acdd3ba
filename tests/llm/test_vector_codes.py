"""Vector codes against a plain version, and the tree's search against comparing all entries."""

import math

import numpy as np
import pytest
from llm_rows import SF

from tidemark.llm import vector_codes


def brute_force(rows, entries=256, rounds=4):
    """Rows (vec_id, vector, label) as [(vec_id, label, code, error, label_error)] and the codebooks."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-max([len(v) for _, v, _ in kept], default=0) // 4)
    parts = [[[max(-(2**27), min(2**27, math.floor(1024 * c))) for c in [*v, *[0.0] * (4 * size - len(v))][p * size : (p + 1) * size]] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book)) for x in part] for part, book in zip(parts, books, strict=True)]

    for _ in range(rounds):
        for part, book, found in zip(parts, books, assigned(), strict=True):
            for i in range(len(book)):
                own = [x for x, (_, at) in zip(part, found, strict=True) if at == i]
                if own:
                    book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = list(zip(*assigned(), strict=True))
    errors, labels = [sum(d for d, _ in f) for f in found], {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    return [(i, label, "".join(f"{at:02x}" for _, at in f), e, labels[label]) for (i, _, label), f, e in zip(kept, found, errors, strict=True)], books


def check(df, entries=256):
    found, books = vector_codes.compressed(df, entries=entries)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    expected, plain = brute_force(rows, entries)
    assert sorted(map(repr, (tuple(r) for r in found.select("vec_id", "label", "code", "error", "label_error").collect()))) == sorted(map(repr, expected))
    assert [b.tolist() for b in books] == plain


def test_table(ready):
    check(ready.read.parquet(f"{SF}/embeddings.parquet"), entries=32)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, n long"


def test_odd_rows(ready):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5] * 8, [0.5] * 8, None, [1.0, None] * 4, [nan] * 8, [inf, *[0.0] * 7], [], [-0.25], [1e30] * 8, [-3e38] * 8, [0.1 * i for i in range(8)], [0.0] * 9]
    rows = [(i, v, i % 3 if i % 4 else None, "x", "y", 1) for i, v in enumerate(vectors)]
    rows += [(None, [0.5] * 8, None, "x", "y", 1), (0, [0.5] * 8, 0, "x", "y", 1), (0, [9.0] * 8, 1, "x", "y", 1), (None, None, 1, None, None, None)]
    for entries in (2, 5, 256):
        check(ready.createDataFrame(rows, SCHEMA).repartition(3), entries)


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "x", "y", 1)], [(1, [], 1, "x", "y", 1)]])
def test_nothing_to_code(ready, rows):
    df = ready.createDataFrame(rows, SCHEMA)
    found, _ = vector_codes.compressed(df)
    assert [(r["code"], r["error"], r["label_error"]) for r in found.collect()] == [("00000000", 0, 0) for r in rows if r[1] is not None]


def test_one_vector_in_most_rows(ready):
    rows = [(i, [0.25] * 8 if i % 4 else [float(i % 7)] * 8, 1 if i % 4 else i, "x", "y", 1) for i in range(400)]
    check(ready.createDataFrame(rows, SCHEMA).repartition(5), 16)


@pytest.mark.parametrize("scale", [3, 1000, 1 << 27])
def test_tree_finds_the_nearest(scale):
    """Ties, equal entries and the largest values too; clustered entries are mostly skipped."""
    rng = np.random.default_rng(scale)
    entries = rng.integers(-scale, scale + 1, (256, 4))
    entries[100:140] = entries[:40]
    tree = vector_codes.VantageTree(entries)
    queries = np.concatenate([rng.integers(-scale, scale + 1, (5000, 4)), entries])
    code, apart = tree.nearest(queries)
    all_apart = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == all_apart.argmin(axis=1)).all() and (apart == all_apart.min(axis=1)).all()
    if scale > 3:
        assert tree.compared < 0.7 * 256 * len(queries)
