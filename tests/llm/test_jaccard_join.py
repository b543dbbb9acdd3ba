"""The Jaccard join against comparing all pairs of sets: the table, odd rows, families of borderline copies, hot passages."""

import random
import re

import numpy as np
import pytest
from llm_rows import SCHEMA

from tidemark.llm import jaccard


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """Rows (doc_id, text) as (doc_id, size, component); a null id is smaller than none."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d is None, d or 0, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def joined(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["component_id"]) for r in jaccard.similar_documents(df).collect())


def frame(ready, texts):
    return ready.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3), list(enumerate(texts))


def test_table_and_odd_rows(case):
    df, rows = case
    assert joined(df) == brute_force([(r["doc_id"], r["text"]) for r in rows])


def test_empty(empty):
    assert jaccard.similar_documents(empty).collect() == []


@pytest.mark.parametrize("square", [4, 512])
def test_borderline_families(ready, monkeypatch, square):
    """Families in which some pairs link and some just do not, so that tiles hold several components."""
    monkeypatch.setattr(jaccard, "SQUARE", square)
    rng = random.Random(5)
    texts = []
    for size in (12, 40, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(1 + size // 25)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            del words[: rng.randrange(1 + size // 20)]
            texts.append(" ".join(words))
    df, rows = frame(ready, texts)
    expected = brute_force(rows)
    assert joined(df) == expected and 4 < len({e[3] for e in expected}) < 100


def test_chains_and_hot_passages(ready):
    """Chains whose ends are far apart, and a long passage in a third of otherwise different texts."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    chain, texts = [word() for _ in range(200)], []
    for i in range(40):
        chain = [*chain[6:], *[word() for _ in range(6)]]
        texts.append(" ".join(chain))
    passage = " ".join(word() for _ in range(80))
    texts += [" ".join([*[word() for _ in range(rng.randrange(5, 60))], passage, *[word() for _ in range(rng.randrange(5, 30))]]) for _ in range(60)]
    texts += [passage, passage.upper(), passage + " end"]
    df, rows = frame(ready, texts)
    assert joined(df) == brute_force(rows)


def test_linked_sets_share_a_tile():
    """Whatever their sizes: also where a set's partner lies in the next band, and where cuts leave few slices."""
    rng = np.random.default_rng(7)
    for _ in range(3000):
        n = int(rng.integers(1, 80)) if rng.random() < 0.8 else int(rng.integers(80, 1500))
        pool = np.unique(rng.integers(0, 1 << 40, 2 * n + 2, dtype=np.uint64))
        a = np.sort(rng.permutation(pool)[:n])
        rest = np.setdiff1d(pool, a)
        gone = int(rng.integers(0, n // 5 + 1))
        new = int(rng.integers(0, n // 4 + 1))
        b = np.sort(np.concatenate([rng.permutation(a)[gone:], rest[:new]]))
        if len(b) and jaccard.linked(len(a) - gone, len(a), len(b)):
            assert np.intersect1d(jaccard.tiles(len(a), a), jaccard.tiles(len(b), b)).size
        bits = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b)) or 8) if len(b) else 8
        if len(b):
            assert jaccard.overlap_bound(jaccard.folded(jaccard.bitmap(a), bits), jaccard.folded(jaccard.bitmap(b), bits), len(a), len(b)) >= len(a) - gone
        assert (jaccard.unpacked(jaccard.packed(a)) == a).all()


def test_tiles_in_pieces():
    """A tile of more rows than are held gives its members and links them to its first sets."""
    import pyarrow as pa

    keys, fps = np.repeat([1, 2, 3], [2, 50, 2]), np.concatenate([[5, 6], np.arange(50), [7, 8]])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(fps[i : i + 7])], names=["key", "fp"]) for i in range(0, 54, 7)]
    out = [r for b in jaccard._met(iter(batches), most=10) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in out if r["key"] == 2} == {(0, x) for x in range(50)} and not [r for r in out if r["key"] in (1, 3)]
    assert {(r["a"], r["b"]) for r in out if r["key"] is None} == {(5, 6), (7, 8)}
