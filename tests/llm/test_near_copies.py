"""The pipeline's near-duplicate stage: planted pairs of known similarity, and links against brute force."""

import random

import corpus_pipeline
from llm_rows import SCHEMA, SF

from tidemark.llm import jaccard, near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(rng, n, least, most):
    """n pairs of texts of 300 random words, the second with words substituted."""
    out = []
    while len(out) < n:
        words = [f"w{rng.randrange(50_000)}" for _ in range(300)]
        other = list(words)
        for i in rng.sample(range(300), rng.randint(1, 14)):
            other[i] = f"v{rng.randrange(50_000)}"
        if least <= similarity(" ".join(words), " ".join(other)) < most:
            out.append((" ".join(words), " ".join(other)))
    return out


def kept(ready, texts):
    df = ready.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"] for r in corpus_pipeline.near_dedup(ready, df, SF).select("doc_id").collect()}


def test_planted_pairs(ready):
    rng = random.Random(3)
    bins = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)]
    near = [p for lo, hi in bins for p in planted(rng, 60, lo, hi)]
    far = planted(rng, 60, 0.6, 0.8)
    left = kept(ready, [t for p in near + far for t in p])
    recall = [sum(2 * i + 1 not in left for i in range(60 * b, 60 * b + 60)) / 60 for b in range(4)]
    assert min(recall) >= 0.98, recall
    assert all(2 * i in left for i in range(300)) and all(2 * i + 1 in left for i in range(240, 300))


def test_large_bucket(ready):
    rng = random.Random(4)
    base = [f"w{rng.randrange(50_000)}" for _ in range(200)]
    texts = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"v{i}"
        texts.append(" ".join(words))
    assert kept(ready, texts) == {0}


def test_template_on_a_third_of_rows(ready):
    """Thousands of texts of one template that differ by about as much as links allow: the components are those of the exact join."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(50_000)}" for _ in range(200)]
    texts = []
    for i in range(6000):
        words = list(base) if i % 3 == 0 else [f"u{rng.randrange(50_000)}" for _ in range(60)]
        for at in rng.sample(range(len(words)), rng.randint(2, 7) if i % 3 == 0 else 0):
            words[at] = f"v{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    df = ready.createDataFrame(texts, "doc_id long, text string").repartition(8)
    exact = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(df).collect()}
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(df).collect()}
    copies = [x for x in exact if exact[x] != x]
    assert len(copies) > 500 and all(exact[i] == i for i in range(6000) if i % 3)
    assert all(exact[found[x]] == exact[x] for x in found)
    assert sum(found[x] != x for x in copies) >= 0.98 * len(copies)


def test_groups_of_table(table):
    df, rows = table
    up = {r["doc_id"]: r["doc_id"] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {r["doc_id"]: shingles((r["text"] or "").strip()) for r in rows}
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    found = near_copies.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {x: top(x) for x in up}
