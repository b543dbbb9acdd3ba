"""Each operator against a brute-force version, on the smallest table and on odd rows."""

import hashlib
import math
import random
import re
import string
import tarfile
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
import zstandard
from llm_rows import multiset
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import graph, language, media, mixing, packing, quality, secrets, simhash, substrings, token_counts, token_files, wavelet
from tidemark.llm.catalog import BYTE_BPE, RANKS, WORD_BPE


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


# token counts


def slow_count(token, costs):
    data = token.encode().decode("latin-1")
    best = [(0, 0)] + [None] * len(data)
    for end in range(1, len(data) + 1):
        best[end] = min((best[at][0] + costs[data[at:end]], best[at][1] + 1) for at in range(max(0, end - 128), end) if data[at:end] in costs)
    return best[-1][1]


def test_token_counts(case):
    df, rows = case
    costs, memo, expected = token_counts.piece_costs(RANKS), {}, []
    for r in rows:
        found = regex.findall(public_tokenizers.PATTERN, r["text"] or "")
        for t in found:
            if t not in memo:
                memo[t] = slow_count(t, costs)
        expected.append((r["doc_id"], len((r["text"] or "").encode()), len(found), sum(memo[t] for t in found)))
    assert multiset(map(tuple, token_counts.token_counts(df, RANKS).collect())) == multiset(expected)
    # a trie that starts anew all the time counts the same
    assert multiset(map(tuple, token_counts.token_counts(df, RANKS, most_nodes=300).collect())) == multiset(expected)


def test_forward_scores_are_shared():
    trie = token_counts.Trie(token_counts.piece_costs(RANKS))
    for t in ("shared", "share", "shares", "shared"):
        trie.count(t.encode())
    assert trie.computed == len("shared") + 1


# secret scans

BASE = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def slow_secrets(text):
    text, base = text or "", []
    for kind, pattern in BASE:
        for m in pattern.finditer(text):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                base.append((m.start(), secrets.KINDS.index(kind), m.end()))
    added = []
    for kind, chars, bits, holds in secrets.CLASSES:
        hot = []
        for m in re.finditer(f"[{chars}]{{{secrets.WINDOW},}}", text):
            run, s0 = m[0], m.start()
            if not re.search(holds, run) or re.search(secrets.ALLOW_WORDS, run) or all(re.fullmatch(secrets.PART, x) for x in re.split(secrets.BETWEEN, run)):
                continue
            for i in range(len(run) - secrets.WINDOW + 1):
                total = sum(secrets.CLOGC[c] for c in Counter(run[i : i + secrets.WINDOW]).values())
                if total <= secrets.most_clogc(bits):
                    s, e = s0 + i, s0 + i + secrets.WINDOW
                    if hot and hot[-1][2] >= s:
                        hot[-1] = (hot[-1][0], hot[-1][1], e)
                    else:
                        hot.append((s, secrets.KINDS.index(kind), e))
        earlier = base + added
        added += [x for x in hot if not any(a <= x[0] and x[2] <= e for a, _, e in earlier)]
    show = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return show(base), show(base + added), len(added)


def test_secrets(case):
    df, rows = case
    found = secrets.scan(df).select("doc_id", secrets.joined("base"), secrets.joined("spans"), F.size("added"))
    expected = [(r["doc_id"], *slow_secrets(r["text"])) for r in rows]
    assert multiset(map(tuple, found.collect())) == multiset(expected)


def test_secrets_find_by_entropy(ready):
    """Keys of all alphabets among words, in texts up to several chunks of windows long."""
    rng, rows = random.Random(5), []
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits + "_-", "ab1", "aB3xY"]
    for i in range(300):
        key = lambda: "".join(rng.choices(rng.choice(alphabets), k=rng.choice([20, 24, 30, 48, 90, 700])))
        rows.append((i, rng.choice([" ", "\n", "=", "/", ": token="]).join([key() if rng.random() < 0.5 else rng.choice(["word", "größe", "secret:", "AKIA" + key().upper()]) for _ in range(rng.randrange(1, 12))])))
    found = secrets.scan(ready.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.joined("base"), secrets.joined("spans"), F.size("added")).collect()
    expected = [(i, *slow_secrets(t)) for i, t in rows]
    assert sum(x[3] for x in expected) > 200 and multiset(map(tuple, found)) == multiset(expected)


@pytest.mark.parametrize("text", ["a1/" * 2000, "a1/" * 60_000, "aB3" * 70_000, "=" * 200_000, "0" * 100_000 + "a" * 100_000, " " * 200_000, "x" * 200_000, "token" + " " * 200_000 + "= abcdefgh", "token=abcdef12 " * 20_000, "AKIA" * 50_000, "é" * 200_000], ids=lambda x: x[:4])
def test_secrets_of_long_runs(ready, text):
    df = ready.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.scan(df).select(secrets.joined("base"), secrets.joined("spans"), F.size("added")).first()
    assert tuple(found) == slow_secrets(text)
    assert secrets.redacted(df).first()["text"] == slow_redacted(text)


def slow_redacted(text):
    out, at = [], 0
    spans = sorted(tuple(map(int, x.split(":")[1:])) for x in slow_secrets(text)[1].split(",") if x)
    for s, e in spans:
        if s >= at or not out:
            out.append(text[at:s])
        at = max(at, e)
    return "[secret]".join([*out, text[at:]])


def test_redaction(odd):
    df, rows = odd
    out = [r.asDict() for r in secrets.redacted(df).collect()]
    assert len(out) == len(rows) and set(out[0]) == set(df.columns)
    by_text = Counter(r["text"] for r in out)
    for r in rows:
        spans = slow_secrets(r["text"])[1]
        if not spans:
            assert by_text[r["text"]] > 0
    one = next(r["text"] for r in out if r["doc_id"] == 12)
    assert one == '[secret]" and [secret] then [secret]'


# simhash


def slow_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fp -> a name of its component, over distinct fingerprints."""
    fps, up = sorted(set(fps)), {}
    top = lambda x: x if up.get(x, x) == x else top(up[x])
    a = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4):
            up[top(fps[i + 1 + int(j)])] = top(fps[i])
    return {f: top(f) for f in fps}


def test_near_duplicates(case):
    df, rows = case
    fps = [slow_fingerprint(r["text"]) for r in rows]
    of, low = slow_components(fps), {}
    for r, f in zip(rows, fps, strict=True):
        ids = [x for x in (r["doc_id"], low.get(of[f])) if x is not None]
        low[of[f]] = min(ids) if ids else None
    found = simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()
    assert multiset((a, b % (1 << 64), c) for a, b, c in found) == multiset((r["doc_id"], f, low[of[f]]) for r, f in zip(rows, fps, strict=True))


def test_links_of_dense_groups(ready):
    """Groups of fingerprints within a few bits, so many that buckets overflow into the second index."""
    rng = np.random.default_rng(3)
    fps = {0}
    for centre in rng.integers(0, 1 << 63, 8):
        for _ in range(90):
            f = int(centre)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    df = ready.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    expected = slow_components(fps)
    for most in ((5, 80), (90, 70), (20_000, 100_000)):
        edges = simhash.links(df, *most).collect()
        assert all((a ^ b) % (1 << 64) and ((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in edges)
        up = {f: f for f in fps}
        top = lambda x: x if up[x] == x else top(up[x])  # noqa: E731, B023
        for a, b in edges:
            up[top(a % (1 << 64))] = top(b % (1 << 64))
        groups = lambda of: sorted(sorted(g) for g in group(of).values())
        assert groups({f: top(f) for f in fps}) == groups(expected)


def test_finer_keys_lose_no_link():
    """Any two fingerprints within the links' bits share a key at every level, down to no free bit."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(x) for x in rng.choice(64, 4, replace=False))
        level = {((1 << 64) - 1, (7, 7))}
        for _ in range(4):
            finer = set()
            for free, keys in sorted(level)[:3]:
                for found, rest in simhash.refined(np.array(keys, dtype=np.uint64), np.array([a, b], dtype=np.uint64), free):
                    if found[0] == found[1]:
                        finer.add((rest, tuple(found.tolist())))
            assert finer
            level = finer


def group(of):
    out = defaultdict(list)
    for x, y in of.items():
        out[y].append(x)
    return out


def test_component_roots(ready):
    path = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 50)] + [(1030, 2000), (2000, 2001), (5, 5)]
    found = {r["node"]: r["root"] for r in graph.component_roots(ready.createDataFrame(path + hub, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)} | {2000: 1000, 2001: 1000}
    assert graph.component_roots(ready.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_each(odd):
    df, rows = odd
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    found = simhash.near_duplicates(df).select("component_id").distinct().count()
    assert kept.count() == found


# media


def test_media(case):
    df, rows = case
    manifest = media.store(df)
    found = {}
    for r in media.media_columns(df).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for r in rows:
        data = (r["text"] or "").encode()
        padded = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        png = media.to_png(padded)
        assert media.from_png(png) == padded
        expected = (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(png), hashlib.sha256(png).hexdigest(), 576, len(padded) // 576)
        own = [(x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"], x["media_bytes"], x["media_sha256"], x["width"], x["height"]) for x in found[r["doc_id"]]]
        assert expected in own
    assert sum(map(len, found.values())) == len(rows)
    # the shards are tar files; members are named by what they hold, once a shard
    for shard in {r["shard"] for r in manifest.collect()}:
        with tarfile.open(shard.removeprefix("file:")) as tar:
            names = tar.getnames()
            assert len(names) == len(set(names))
            for member in tar.getmembers():
                assert hashlib.sha256(media.from_png(tar.extractfile(member).read())).hexdigest() + ".png" == member.name
    head = media.headers(media.dealt(media.resolved(manifest))).collect()
    assert all((x["width"], x["bit_depth"]) == (576, 8) for x in head)


# token files


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49_408, 5000), rng.zipf(1.3, 300_000) % 700, rng.integers(0, 3, 512), rng.integers(0, 2, 1 << 18), np.array([0]), np.array([70_000, 3, 70_000])):
        ids = ids.astype(np.uint32)
        data = wavelet.build(ids, [1, None], [len(ids), 0])
        m = wavelet.WaveletMatrix(data)
        assert (m.documents()[0].to_pylist(), m.documents()[1]) == ([1, None], [len(ids), 0])
        assert (m.all() == ids).all() and (m.access_many(np.arange(len(ids))) == ids).all()
        for i in [0, len(ids) - 1, *rng.integers(0, len(ids), 20)]:
            assert m.access(int(i)) == ids[i]
        for token in {int(x) for x in ids[rng.integers(0, len(ids), 8)]} | {1, 65_000}:
            at = np.flatnonzero(ids == token)
            assert m.count(token) == len(at)
            a, z = sorted(int(x) for x in rng.integers(0, len(ids) + 1, 2))
            assert m.count(token, a, z) == ((at >= a) & (at < z)).sum()
            for j in {0, len(at) // 2, len(at) - 1} if len(at) else ():
                assert m.locate(token, j) == at[j]
            with pytest.raises(IndexError):
                m.locate(token, len(at))


def reference_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files(case):
    df, rows = case
    k1 = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", token_files.row_keys(F.col("doc_id"), F.col("text"))[0].alias("h")).collect()}
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, k1[r["doc_id"], r["text"]]))
    expected, start = [], 0
    for r, ids in zip(rows, reference_ids(WORD_BPE, [r["text"] or "" for r in rows]), strict=True):
        ids = [*ids, 1]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids[0]))
        start += len(ids)
    for shard_tokens in (1 << 20, 500):
        found = token_files.read_documents(token_files.write_shards(df, WORD_BPE, shard_tokens=shard_tokens))
        assert multiset(map(tuple, found.collect())) == multiset(expected)


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,3)", "date"])
def test_token_files_of_other_id_types(table, kind):
    df = table[0].limit(20).withColumn("doc_id", F.expr("date_add(date '2024-01-01', cast(doc_id as int))") if kind == "date" else F.col("doc_id").cast(kind))
    found = token_files.read_documents(token_files.write_shards(df, WORD_BPE), kind)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in df.collect())


# packing


def test_pieces():
    for n in range(1, 5000, 7):
        cut = packing.pieces(n)
        assert sum(cut) == n and all(k & (k - 1) == 0 and k <= 2048 for k in cut) and cut == sorted(cut, reverse=True)
        assert len(cut) == n // 2048 + (n % 2048).bit_count()


def test_packing(case):
    df, rows = case
    found = packing.pack(df, BYTE_BPE, with_ids=True).collect()
    expected = Counter(tuple(ids) + (1,) for ids in reference_ids(BYTE_BPE, [r["text"] or "" for r in rows]))
    by_doc = defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] and r["offset"] == 0
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
    lengths = [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    batches = defaultdict(list)
    for r in found:
        batches[r["batch_id"]].append(r["length"])
    assert all(len(set(x)) == 1 and sum(x) <= packing.BATCH_TOKENS for x in batches.values())
    assert sum(r["length"] for r in found) == sum(len(x) * n for x, n in expected.items())
    for ids in expected:
        pieces = {(k, ids[at : at + k]) for at, k in zip(np.cumsum([0, *packing.pieces(len(ids))]).tolist(), packing.pieces(len(ids)), strict=False)}
        assert any(pieces <= {(r["length"], tuple(r["ids"])) for r in own} for (_, n), own in by_doc.items() if n == len(ids))


# substring dedup


def test_substrings(case):
    df, rows = case
    texts = [words(r["text"]) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    expected = []
    for r, w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert any(x[2] for x in expected)
    found = substrings.deduplicated(df).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    assert multiset(map(tuple, found.collect())) == multiset(expected)


def test_factors_have_sources(case):
    """A factor's words stand at its source, it is as long as the two go on alike from its start, and it is not its own source."""
    df, rows = case
    texts = defaultdict(list)
    for r in df.select(substrings.row_keys(F.col("doc_id"), F.col("text"))[0].alias("k1"), "text").collect():
        texts[r["k1"]].append(words(r["text"]))
    by_low = {substrings.low(k1): own[0] for k1, own in texts.items()}
    n = 0
    for r in substrings.deduplicated(df).collect():
        own = texts[r["k1"]][0]
        for x in r["spans"]:
            other = by_low[x["source"]]
            size = x["end"] - x["start"]
            assert size >= 35 and own[x["start"] : x["end"]] == other[x["source_start"] : x["source_start"] + size]
            assert (substrings.low(r["k1"]), x["start"]) != (x["source"], x["source_start"]) or len(texts[r["k1"]]) > 1
            n += 1
    assert n > 5


def test_a_hot_line(ready):
    """One passage in a third of all documents: every copy goes, whatever the batches, and nothing else."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    line = " ".join(word() for _ in range(50))
    rows = [(i, " ".join([word() for _ in range(rng.randrange(5, 60))] + [line] * (i % 3 == 0) + [word() for _ in range(20)])) for i in range(900)]
    df = ready.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.deduplicated(df).collect()}
    assert found == {i: (len(t.split()), 50 * (i % 3 == 0)) for i, t in rows}


def test_substrings_forget_and_still_find(odd, monkeypatch):
    df, _ = odd
    usual = multiset(map(tuple, substrings.parsed(df).selectExpr("k1", "found is null").collect()))
    assert usual == multiset(map(tuple, substrings.parsed(df, most_seen=3).selectExpr("k1", "found is null").collect()))


def test_factors():
    assert substrings.factors([(0, 1, 7, 100)]) == [(0, 35, 7, 100)]
    assert substrings.factors([(0, 3, 7, 100), (3, 2, 7, 103), (50, 1, 7, 0)]) == [(0, 39, 7, 100), (50, 85, 7, 0)]
    # at a boundary, what reaches over it is a factor of its own
    assert substrings.factors([(0, 1, 7, 100), (1, 1, 8, 5), (2, 1, 8, 6)]) == [(0, 35, 7, 100), (1, 37, 8, 5)]
    # windows between may not have been asked for, as long as the place goes on
    assert substrings.factors([(0, 1, 7, 100), (1, 1, 7, 101), (1, 1, 7, 101)]) == [(0, 36, 7, 100)]
    assert substrings.factors([]) == []


# quality rules


def slow_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, gone = Counter(triples), set()
    for i, t in enumerate(triples):
        if often[t] > 1:
            gone |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(gone)


def test_quality(case):
    df, rows = case
    expected = []
    for r in rows:
        n, chars, symbols, lines, dup, rep = slow_counts(r["text"])
        base = n < 50 or 100 * rep > 50 * n
        kept = not (base or 10 * symbols > 3 * n or chars < 2 * n or chars > 15 * n or 2 * dup > lines)
        text = r["text"] or ""
        kept &= 5 * len(regex.findall(r"[\p{L}\p{M}]", text)) >= 2 * chars and 25 * len(set(re.split(r"[\x20\x09-\x0d]+", text.lower()))) >= n
        kept &= 2 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0d]*$", x)) for x in text.split("\n")) <= lines
        expected.append((r["doc_id"], n, chars, symbols, lines, dup, rep, base, kept))
    assert multiset(map(tuple, quality.judged(df).drop("rejected_by").collect())) == multiset(expected)


def test_cascade_order(table):
    order = quality.plan_cascade(quality.counts(table[0]), rows=100)
    assert [x["gain"] for x in order] == sorted((x["gain"] for x in order), reverse=True) and len(order) == len(quality.RULES)
    forward, backward = (quality.judged(table[0], order=list(x)).drop("rejected_by").collect() for x in (quality.RULES, reversed(quality.RULES)))
    assert multiset(forward) == multiset(backward)


def test_cascade_work(ready, empty):
    """A rule that rejects most comes after one that rejects less for far less work; what rejects nothing comes last, the dearest of all at the end."""
    words = " ".join(f"word{i}" for i in range(80))
    texts = ["few"] * 3 + [" ".join(f"{i}" for i in range(1000, 1080))] * 6 + [words]
    df = quality.counts(ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = quality.plan_cascade(df)
    assert [x["rule"].name for x in plan[:2]] == ["few_words", "letters"] and plan[-1]["rule"].name == "distinct_words"
    assert {x["rule"].name: x["selectivity"] for x in plan if x["selectivity"]} == {"few_words": 0.3, "letters": 0.6}
    assert {x["rule"].name: x["cost"] for x in plan}["broken_lines"] == 3 * sum(map(len, texts)) / len(texts)
    assert quality.plan_cascade(df) == plan
    assert [x["rule"].name for x in quality.plan_cascade(quality.counts(empty))] == [r.name for r in quality.RULES]


def test_cascade_stops(ready):
    """A rule is evaluated on the documents only that those before it have let pass."""
    words = " ".join(f"word{i}" for i in range(80))
    df = ready.createDataFrame([(1, "few"), (2, words), (3, "#" * 30 + words)], "doc_id long, text string")
    late = quality.Rule("late", "if(doc_id = 2, false, cast(raise_error('evaluated') as boolean))")
    rules = (quality.RULES[0], quality.RULES[2], late)
    found = quality.judged(df, rules=rules, order=list(rules)).collect()
    assert {r["doc_id"]: r["rejected_by"] for r in found} == {1: "few_words", 2: None, 3: "symbols"}
    with pytest.raises(Exception, match="evaluated"):
        quality.judged(df, rules=rules, order=[late, *rules[:2]]).collect()


# mixing


def slow_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and rest and left * w[s] / rest > cap * sizes[s]]
        if not over:
            return {s: Fraction(cap * sizes[s]) if s in full else left * w[s] / rest for s in names}
        for s in over:
            full.add(s)
            left -= cap * sizes[s]


def test_mixing(case):
    df, rows = case
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    target = slow_targets(sizes)
    source = {(r["doc_id"], len(words(r["text"]))): r["source"] for r in rows}
    found = mixing.mix(df).collect()
    assert multiset((r["doc_id"], r["source"], r["size"]) for r in found) == multiset((r["doc_id"], r["source"], len(words(r["text"]))) for r in rows)
    taken = Counter()
    for r in found:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["again_position"] is None) == (r["taken"] <= r["size"])
        assert r["position"] is None or 0 <= r["position"] <= (r["again_position"] or 1) <= 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert multiset(found) == multiset(mixing.mix(df.repartition(2)).collect())
    assert source


def test_positions_follow_the_schedule(table):
    """At any time, a source's words trained on are the integral of its weight up to then."""
    found = mixing.mix(table[0]).filter("position is not null").collect()
    names = sorted({r["source"] for r in found})
    for i, s in enumerate(names):
        g = mixing.SLOPES[i % 3]
        own = sorted((p, n) for r in found if r["source"] == s for p, n in ((r["position"], min(r["size"], r["taken"])), (r["again_position"], r["taken"] - r["size"])) if p is not None)
        at = 0
        for p, n in own:
            assert math.isclose(at / own_target(found, s), p + g * (p * p - p), abs_tol=1e-9)
            at += n


def own_target(found, source):
    return next(r["target"] for r in found if r["source"] == source)


def test_mixed_documents(odd):
    df, rows = odd
    plan = mixing.mix(df).collect()
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len(words(r["text"])) for r in got) == sum(r["taken"] for r in plan)
    assert len(got) == sum(math.ceil(r["taken"] / r["size"]) for r in plan if r["taken"])


# language


def test_language(ready):
    df = ready.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language.learn(df.filter(~language.held_out(F.col("doc_id"))))
    assert sorted(learned) == ["de", "en", "es", "fr"] and all(len(x) <= language.DICT_BYTES for x in learned.values())
    found = language.classify(df, learned, keep=("doc_id", "lang")).withColumn("held", language.held_out(F.col("doc_id"))).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held"]]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert sum(r["accepted"] for r in found) / len(found) > 0.98 and all(0 <= r["score"] <= 1 for r in found)
    # neither label, source nor id is an input of a prediction
    blind = language.classify(df.selectExpr("doc_id", "text", "'xx' as lang", "'xx' as source"), learned, keep=("doc_id",)).collect()
    assert multiset((r["doc_id"], r["lang_pred"], r["score"]) for r in blind) == multiset((r["doc_id"], r["lang_pred"], r["score"]) for r in found)


def test_language_by_brute_force(case):
    """Each row by compressing it after each language's dictionary, which is made anew from the rows."""
    df, rows = case
    learned, out = language.learn(df, docs_per_lang=30), []
    hashes = df.filter("lang is not null").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").collect()
    plain = lambda t: regex.sub(r"[^\p{L}]+", " ", t.lower())
    for lang in {r["lang"] for r in hashes}:
        own = sorted((r["h"], r["text"][-2000:]) for r in hashes if r["lang"] == lang and regex.search(r"\p{L}", r["text"] or ""))[:30]
        assert learned[lang] == b"\n".join(plain(t).encode() for _, t in reversed(own))[-language.DICT_BYTES :]
    for r in rows:
        data = plain(r["text"] or "").encode()
        sizes = []
        for lang in sorted(learned):
            content = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(pack.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)), lang))
        if not data.strip():
            out.append((r["doc_id"], "und", 0.0, False))
            continue
        (least, lang), *others = sorted(sizes)
        score = 1 / sum(2 ** (-8 * language.TEMPER * (n - least)) for n, _ in sizes)
        out.append((r["doc_id"], lang, round(score, 9), not others or others[0][0] - least > language.MARGIN * least))
    found = language.classify(df, learned, keep=("doc_id",)).collect()
    assert multiset((a, b, round(c, 9), d) for a, b, c, d in found) == multiset(out)


def test_many_languages_are_bounded(ready):
    df = ready.createDataFrame([(i, f"text of number {i}", f"l{i % 40 if i < 400 else i}") for i in range(900)], "doc_id long, text string, lang string")
    assert sorted(language.learn(df, most_langs=40)) == sorted(f"l{i}" for i in range(40))


def test_language_of_odd_rows(odd):
    df, rows = odd
    found = language.classify(df, language.learn(df)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["lang_pred"] == "und") == (not regex.search(r"\p{L}", r["text"] or ""))
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    none = language.classify(df, language.learn(df.filter("lang is null"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_empty_tables(empty):
    assert token_counts.token_counts(empty, RANKS).count() == 0
    assert secrets.scan(empty).count() == 0 and secrets.redacted(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_each(empty).count() == 0
    assert media.media_columns(empty).count() == 0
    assert token_files.read_documents(token_files.write_shards(empty, WORD_BPE)).count() == 0
    assert substrings.deduplicated(empty).count() == 0
    assert quality.judged(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert language.learn(empty) == {} and language.classify(empty, {}).count() == 0
    assert packing.pack(empty, BYTE_BPE).count() == 0
