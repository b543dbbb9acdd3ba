"""Substring dedup by relative Lempel-Ziv parsing against an index of the whole corpus.

A factor of a document is a stretch of its words with a source: a place, elsewhere in the corpus, where
the same words stand. Factors of at least WINDOW = 35 words become duplicate spans. The reference
is the corpus itself, indexed by its 35-word phrases; the index is dealt over the tasks by phrase, and
each part of it is a block, so a document meets every block that could hold a source of it.

Parsing is greedy: a factor starts at the first word not yet parsed that starts a phrase found in a block
and takes the phrase's source, the least place where it stands; it goes on for as long as the next
phrase is found with its source one word further. Where it ends, the phrases that begin in its last 34
words and reach over the boundary were looked up too; those found start a factor of their own,
which overlaps the one before, so nothing that straddles a boundary is missed.

Only phrases that can be found are looked up. A phrase's anchor is the least of the hashes of its
GRAM-word grams (winnowing); phrases alike have one anchor, so a phrase whose anchor stands once in
the corpus stands once itself. Anchors are one for about 14 words; the rest of the work is on phrases
with repeated anchors.

Equality is of 96-bit hashes of the phrases' text. Hot anchors and phrases: a task sends on the first
two occurrences that it meets (of an anchor, in each batch until it is known to be hot) and keeps the
rest, which it knows to be repeats and of phrases also has a source for; so a phrase that a third
of the documents share reaches the index twice a task, and no pairs are made. The texts are
shuffled once, by a 64-bit key of id and text, for both the lookup and the removal; what is found
carries 16 more bits of key, so documents whose keys collide do not take each other's factors.

Cases: a null text has no words; with fewer than 35 words nothing is removed; windows are judged on the
input; repeated rows are copies of each other and lose all windows; texts of any length are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_keys

WINDOW = 35
GRAM = 8
#: Phrases that a task remembers having sent on; beyond, it forgets them and sends more. Likewise anchors known to be hot.
MOST_SEEN, MOST_HOT = 500_000, 200_000
#: Something found: 16 more bits of the document's key, the first of ``n`` windows, the source's place (32 bits of its key, and its word).
FOUND = np.dtype([("k2", "<i2"), ("n", "<u2"), ("at", "<u4"), ("source_at", "<u4"), ("source", "<i4")])
MOST_IN_ROW = 60_000
#: Phrases of whole documents that a task gathers before it sends them on.
MOST_ROWS = 20_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, so that the least hash is any."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window the hash of its anchor; the hashes of all grams."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    grams = np.zeros(len(words) - gram + 1, dtype=np.uint64)
    for j in range(gram):  # a polynomial of the words' hashes, modulo 2**64
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(grams)]
    grams = _mixed(grams)
    least, span, want = grams, 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return least, grams


def low(k1):
    """The lowest 32 bits of a key, signed: names a source."""
    return (k1 + (1 << 31) & 0xFFFFFFFF) - (1 << 31)


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes: only ASCII white space splits


def _emit_anchors(window: int, gram: int):
    """(key, k1, real): each document's anchors, twice where the gram stands twice in it; with ``real`` those known to be repeats, under a key of no meaning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.zeros(0, dtype=np.uint64)
        for b in batches:
            keys, docs = [], []
            for k1, t in zip(b.column("k1").to_pylist(), b.column("t").to_pylist(), strict=True):
                words = _split(t)
                if len(words) >= window:
                    least, grams = anchors(words, window, gram)
                    own, n = np.unique(grams[np.isin(grams, np.unique(least))], return_counts=True)
                    own = np.concatenate((own, own[n > 1]))
                    keys.append(own)
                    docs.append(np.full(len(own), k1, dtype=np.int64))
            if not keys:
                continue
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            starts = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
            sizes = np.diff(np.append(starts, len(keys)))
            known = np.arange(len(keys)) - np.repeat(starts, sizes) >= 2
            if len(hot):
                known |= hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
            hot = np.union1d(hot, keys[starts[sizes > 2]])
            hot = hot if len(hot) <= MOST_HOT else hot[:0]
            key = np.where(known, _mixed(keys ^ docs.view(np.uint64)), keys)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(docs), pa.array(keys.view(np.int64), mask=~known)], names=["key", "k1", "real"])

    return run


def _whole_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Of rows sorted by the columns ``by``: columns of whole runs of equal values, with the runs' starts and sizes."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = {c: b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)}
        if held is not None:
            columns = {c: np.concatenate((held[c], x)) for c, x in columns.items()}
        change = np.zeros(len(columns[by[0]]) - 1, dtype=bool)
        for c in by:
            change |= columns[c][1:] != columns[c][:-1]
        starts = np.append(0, np.flatnonzero(change) + 1)
        last = starts[-1]  # this run may go on
        held = {c: x[last:] for c, x in columns.items()}
        if last:
            yield {c: x[:last] for c, x in columns.items()}, starts[:-1], np.diff(starts)
    if held is not None:
        yield held, np.zeros(1, dtype=np.int64), np.array([len(held[by[0]])])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by key: (k1, key) of those that stand twice or are known to."""
    for columns, _, sizes in _whole_runs(batches, ["key"]):
        known = columns["known"].astype(bool)
        out = np.repeat(sizes > 1, sizes) | known
        yield pa.RecordBatch.from_arrays([pa.array(columns["k1"][out]), pa.array(np.where(known, columns["real"], columns["key"])[out])], names=["k1", "key"])


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of phrases sorted by p1 and p2: (k1, found) of those that stand twice or have a source already."""
    for columns, _, sizes in _whole_runs(batches, ["p1", "p2"]):
        w, s = columns.pop("w"), columns.pop("s")
        columns |= {"k2": w >> 48, "n": w >> 32 & 0xFFFF, "at": w & 0xFFFFFFFF, "source": s >> 32, "source_at": s & 0xFFFFFFFF}
        run = np.repeat(np.arange(len(sizes)), sizes)
        known = columns["n"] > 0
        asked = np.repeat(sizes > 1, sizes) & ~known
        c = {name: x[asked] for name, x in columns.items()}
        order = np.lexsort((c["at"], c["k1"], run[asked]))
        c, of = {name: x[order] for name, x in c.items()}, run[asked][order]
        first = np.append(True, of[1:] != of[:-1])[: len(of)]
        least = np.flatnonzero(first)[np.cumsum(first) - 1] if len(of) else np.zeros(0, dtype=np.int64)
        # the least place is the source of all others, and the second least its own
        place = np.where(first, np.minimum(least + 1, len(of) - 1), least)
        out = np.zeros(len(of) + int(known.sum()), dtype=FOUND)
        for name, own, source in (("k2", c["k2"], columns["k2"]), ("at", c["at"], columns["at"]), ("n", np.ones(len(of)), columns["n"]), ("source", low(c["k1"][place]), columns["source"]), ("source_at", c["at"][place], columns["source_at"])):
            out[name] = np.concatenate((own, source[known]))
        k1 = np.concatenate((c["k1"], columns["k1"][known]))
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.Array.from_buffers(pa.binary(FOUND.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())], names=["k1", "found"])


def _emit_phrases(window: int, gram: int, most_seen: int):
    """(p1, p2, k1, w, s): phrases with repeated anchors, n = 0; stretches of n windows whose source is known.

    w holds k2 (16 bits), n (16) and the first window (32), s the source (32) and its word (32): shuffled rows are to be small.
    """

    def batch_of(phrases: list[bytes], rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        p = np.frombuffer(b"".join(phrases), dtype=np.int64).reshape(-1, 2)
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array((p[:, 1] >> 32).astype(np.int32)), *columns], names=["p1", "p2", "k1", "w", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}  # phrase -> where it was met first (document, word) and whether a second time
        met: list[int] = []  # the documents that places in ``seen`` count from
        for b in batches:
            phrases, rows = [], []
            for k1, k2, t, keys in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("k1", "k2", "t", "keys")), strict=True):
                words = _split(t)
                least, _ = anchors(words, window, gram)
                ask = np.flatnonzero(np.isin(least, np.array(keys, dtype=np.int64).view(np.uint64)))
                joined = b" ".join(words)
                ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
                known: list[list[int]] = []
                for i in ask.tolist():
                    phrase = xxhash.xxh3_128_digest(joined[ends[i] - len(words[i]) : ends[i + window - 1]])
                    place = seen.get(phrase)
                    if place is not None and place & 1:
                        source, source_at = met[place >> 33], place >> 1 & 0xFFFFFFFF
                        if known and known[-1][0] + known[-1][1] == i and known[-1][2:] == [source, source_at - known[-1][1]] and known[-1][1] < MOST_IN_ROW:
                            known[-1][1] += 1
                        else:
                            known.append([i, 1, source, source_at])
                        continue
                    if place is None and len(seen) >= most_seen:
                        seen.clear()
                        met.clear()
                    if place is None:
                        if not met or met[-1] != low(k1):
                            met.append(low(k1))
                        seen[phrase] = (len(met) - 1) << 33 | i << 1
                    else:
                        seen[phrase] = place | 1
                    phrases.append(phrase)
                    rows.append((k1, (k2 << 48) + i, 0))
                for start, n, source, source_at in known:
                    phrases.append(xxhash.xxh3_128_digest(b"%d %d" % (k1, start)))  # any task will do
                    rows.append((k1, (k2 << 48) + (n << 32) + start, (source << 32) + source_at))
                if len(rows) >= MOST_ROWS:
                    yield batch_of(phrases, rows)
                    phrases, rows = [], []
            if rows:
                yield batch_of(phrases, rows)

    return run


def factors(found: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, source, source_at) in words, from (at, n, source, source_at): n windows in a row with their source."""
    out: list[tuple[int, int, int, int]] = []
    for at, n, source, source_at in sorted(set(found)):
        end = at + n - 1 + window
        if out:
            start, last, own, own_at = out[-1]
            if end <= last:  # parsed already
                continue
            if at <= last - window + 1 and (own, own_at + at - start) == (source, source_at):  # goes on
                out[-1] = (start, end, own, own_at)
                continue
        out.append((at, end, source, source_at))
    return out


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most_seen: int = MOST_SEEN) -> DataFrame:
    """doc_id, k1, t (the text as binary) and found: what its factors are made of, null if none."""
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), F.col(text_col).cast("binary").alias("t"), F.shiftright(k2, 48).cast("short").alias("k2"))
    keys = texts.select("k1", "t").mapInArrow(_emit_anchors(window, gram), "key long, k1 long, real long")
    again = keys.repartition("key").sortWithinPartitions("key").withColumn("known", F.col("real").isNotNull().cast("int")).mapInArrow(_again, "k1 long, key long")
    wanted = again.groupBy("k1").agg(F.collect_set("key").alias("keys")).withColumnRenamed("k1", "_k1")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(n, "k1")
    ask = dealt.join(wanted.hint("merge"), F.col("k1") == F.col("_k1")).select("doc_id", "k1", "k2", "t", "keys")  # all of the columns that the removal reads, so that the texts are shuffled once
    phrases = ask.mapInArrow(_emit_phrases(window, gram, most_seen), "p1 long, p2 int, k1 long, w long, s long")
    met = phrases.repartition("p1").sortWithinPartitions("p1", "p2").mapInArrow(_sources, "k1 long, found binary")
    found = met.groupBy(F.col("k1").alias("_k1")).agg(F.collect_list("found").alias("found"))
    return dealt.join(found.hint("merge"), F.col("k1") == F.col("_k1"), "left").select("doc_id", "k1", "k2", "t", "found")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, k1, n_words, n_removed, kept_sha256, spans and, if asked for, kept: the words left, joined by single spaces.

    spans are the factors: start and end (words, end exclusive), source (``low`` of the k1 of a row with the same words) and source_start.
    """
    found = parsed(docs, id_col, text_col, window, gram)
    id_type = dict(found.dtypes)["doc_id"]
    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "source", "source_start")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digests, spans, kept = [], [], [], [], []
            for t, k2, f in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("t", "k2", "found")), strict=True):
                words = _split(t)
                own = np.frombuffer(b"".join(f or []), dtype=FOUND)
                own = own[own["k2"] == k2]
                parts = factors(list(zip(*(own[c].tolist() for c in ("at", "n", "source", "source_at")), strict=True)), window)
                left, at = [], 0
                for start, end, _, _ in parts:
                    left += words[at:start]
                    at = max(at, end)
                left += words[at:]
                data = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(data).hexdigest())
                spans.append([dict(zip(("start", "end", "source", "source_start"), x, strict=True)) for x in parts])
                kept.append(data.decode(errors="replace"))
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, span)] + [pa.array(kept, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "k1", "n_words", "n_removed", "kept_sha256", "spans", *["kept"] * with_text])

    return found.mapInArrow(run, f"doc_id {id_type}, k1 long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long,source:long,source_start:long>>" + ", kept string" * with_text)
