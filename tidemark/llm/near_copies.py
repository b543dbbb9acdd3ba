"""Near copies by exact similarity of word shingles: MinHash bands for candidates, then the sets themselves.

A text is the set of its 5-word shingles. Texts link where the Jaccard similarity of their sets is
0.8 or more; a component is what links reach. SimHash within a few of 64 bits cannot reach
that: at 0.8 about 10 bits differ.

Search: BANDS keys of ROWS least hashes each; a pair of similarity s shares a key with probability
1 - (1 - s ** ROWS) ** BANDS, which is 0.998 at 0.8 and 0.9999 at 0.85. The keys take the place of the tiles in
``jaccard.links``, whose components are those of all linked pairs that share a key: pairs of small buckets are compared
outright, large buckets in squares of a bounded number of sets dealt over all tasks, bounded by bitmaps and
then verified. So no task holds a bucket, whatever its size, be its members alike by 0.8 or by a little less.

Verification is exact on sets of 40-bit hashes of the shingles. Texts with equal sets are one node.

Cases: letters A-Z count as a-z; fewer than five words are one shingle; null and empty texts have
the empty set and are copies of each other; all else as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jaccard, simhash
from tidemark.llm.common import row_keys, written

BANDS, ROWS = 16, 5
SEED = 43
_RANDOM = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
#: Permutations of 64 bits: an exclusive or, then the product with an odd number.
FLIPS, FACTORS = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """The keys of a set of hashes, as signed longs."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048] ^ FLIPS) * FACTORS).min(axis=1))
    digests = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, dtype=np.uint64).view(np.int64).tolist()


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2 (of common.row_keys), fp (names the set), n, and where a task meets a set that is not empty for the first time keys, bits and grams."""
    t = docs.select(F.col(id_col).alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            fps, ns, keys, bits, grams = [], [], [], [], []
            for x in b.column("t").to_pylist():
                found = jaccard.hashes(x)
                fps.append(fp := xxhash.xxh64_intdigest(found.tobytes(), SEED))
                ns.append(len(found))
                new = len(found) > 0 and fp not in seen
                if new:
                    if len(seen) >= jaccard.MOST_SEEN:
                        seen.clear()
                    seen.add(fp)
                    kept = np.unique(found >> np.uint64(64 - jaccard.KEPT_BITS))
                keys.append(bands(found) if new else None)
                bits.append(jaccard.bitmap(kept) if new else None)
                grams.append(jaccard.packed(kept) if new else None)
            made = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["doc_id", "k1", "k2", "fp", "n", "keys", "bits", "grams"])

    return t.mapInArrow(run, f"doc_id {dict(t.dtypes)['doc_id']}, k1 long, k2 long, fp long, n long, keys array<long>, bits binary, grams binary")


def links(sets: DataFrame) -> DataFrame:
    """(a, b): links of distinct sets (fp, n, keys, bits, grams) with the same components as all that share a key."""
    return jaccard.links(sets, sets.select(F.explode("keys").alias("key"), "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``simhash.near_duplicates``; fp names a text's set."""
    sets = written(_sets(docs, id_col, text_col), "sets")
    return simhash.grouped(sets.select("doc_id", "k1", "k2", "fp"), lambda nodes: links(sets))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, once if its row repeats."""
    return simhash.firsts(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def near_duplicates_of_both(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``near_duplicates``, by these links and those of ``simhash`` together; a component of either is whole in one of both."""
    sets = written(_sets(docs, id_col, text_col), "sets")
    rows = sets.select("doc_id", "k1", "k2", "fp")
    alike = simhash.near_duplicates(docs, id_col, text_col).select("k1", "k2", F.col("first_k1").alias("h1"), F.col("first_k2").alias("h2")).distinct()
    # a star in each component of fingerprints: its sets with the least of them
    groups = written(rows.select("k1", "k2", "fp").distinct().join(alike, ["k1", "k2"]).select("h1", "h2", "fp").distinct(), "groups")
    stars = groups.join(groups.groupBy("h1", "h2").agg(F.min("fp").alias("a")), ["h1", "h2"]).filter("a <> fp").select("a", F.col("fp").alias("b"))
    return simhash.grouped(rows, lambda nodes: links(sets).select("a", "b").union(stars).distinct())


def heads_of_both(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``simhash.heads`` of ``near_duplicates_of_both``."""
    return simhash.heads(near_duplicates_of_both(docs, id_col, text_col))
