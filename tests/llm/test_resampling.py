"""Importance resampling against a plain version, on the table, odd rows, empty corpora, and with postings in many blocks."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import SF, multiset

from tidemark.llm import resampling


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_force(rows, targets):
    def counted(text):
        n, found = features(text)
        return n, len(found), Counter(zlib.crc32(f.encode()) % 10_000 for f in found)

    ours, aim = [(d, *counted(t)) for d, t in rows], sum((counted(t)[2] for t in targets), Counter())
    all_ours = sum((c for *_, c in ours), Counter())
    s, t = sum(all_ours.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((all_ours[b] + 1) * (t + 10_000)))) for b in all_ours}
    out = []
    for d, n_words, n, c in ours:
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n_words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = Counter((x[0], x[4]) for x in able[: 25 * len(able) // 100])
    return [(d, n, w, score) for d, _, n, w, score in out], drawn, len(able)


def check(ready, df, rows, target, texts):
    found = resampling.resampled(df, target).collect()
    expected, drawn, able = brute_force(rows, texts)
    assert multiset((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found) == multiset(expected)
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 25 * able // 100 + 1))
    # rows of one id and score may change places
    assert Counter((r["doc_id"], r["score"]) for r in ranked) == drawn
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked]
    assert order == sorted(order)


@pytest.fixture(scope="module")
def target(ready):
    df = ready.read.parquet(f"{SF}/benchmark.parquet")
    return df, [r["text"] for r in df.collect()]


def test_table_and_odd_rows(ready, case, target):
    df, rows = case
    check(ready, df, [(r["doc_id"], r["text"]) for r in rows], *target)


def test_salts(ready, table, target, monkeypatch):
    """Ranges dealt over several tasks give the same."""
    monkeypatch.setattr(resampling, "BLOCKS_OF_A_SALT", 1)
    df, rows = table
    check(ready, df.repartition(5), [(r["doc_id"], r["text"]) for r in rows], *target)


def test_empty_corpora(ready, table, empty, target):
    df, rows = table
    assert resampling.resampled(empty, target[0]).collect() == []
    check(ready, df, [(r["doc_id"], r["text"]) for r in rows], target[0].limit(0), [])
    nulls = ready.createDataFrame([(1, None), (2, ""), (3, " - ")], "doc_id long, text string")
    assert multiset((r["doc_id"], r["n_features"], r["weight"], r["rank"]) for r in resampling.resampled(nulls, target[0]).collect()) == multiset((i, 0, 0, None) for i in (1, 2, 3))


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 100 * 5000, 20_000))
    bucket, doc, n = key // 5000, key % 5000, rng.integers(1, 1 << 31, len(key))
    for got, was in zip(resampling.unpacked(resampling.packed(doc, bucket, n)), (doc, bucket, n), strict=True):
        assert (got == was).all()


def test_buckets_of_bigrams_go_on():
    assert resampling.buckets_of(resampling.words_of("Ab-c".encode())).tolist() == [zlib.crc32(x) % 10_000 for x in (b"ab", b"c", b"ab c")]
