"""Importance resampling towards a target corpus, over hashed word n-grams.

Features of a text are its runs of 1 to 2 words; a feature's bucket is the CRC-32 of its bytes modulo
BUCKETS. A bucket's gain is 1000 times the log of how much more often the target has it than the documents
(both smoothed by one), floored; a document's weight is the floored mean gain of its features. Adding
noise drawn from its id (Gumbel's distribution) and taking the highest sums draws without replacement in proportion to
exp(weight / 1000).

Plan: the texts are read once. Documents are taken in blocks; a block's counts by (bucket, document)
are cut into PARTS ranges of buckets and written as inverted postings, one compressed row for each block and range. The
postings are shuffled by (range, salt), the salt a hash of the block, together with both corpora's totals
of those buckets, so each task works out the gains of its own buckets and passes over its blocks one at a time; a bucket
that all documents hold is thereby dealt over all salts and never held. What a block's documents
gain from a range is one row again; these are summed by block. So what is shuffled is a few bytes a posting
and PARTS numbers a document, and no task holds more than one block. Totals are summed by bucket in the tasks that
read the texts, BUCKETS rows each.

Ranks are made without a global sort: the scores are whole numbers of a bounded range (the noise lies within
-3,131 and 22,874, weights within the log of the corpora's sizes), so that counting them by score and summing from the top gives
the first rank of each score; documents of equal score are numbered among themselves, and the noise spreads even
equal documents so that no score has more than about 0.04 % of them.

Cases: null and empty texts have no features and weight 0, and under LEAST_WORDS words are never drawn; null ids are
hashed as if empty and come last among equal scores; rows of one id and score are ordered by a hash of their texts;
repeated rows are documents of their own; an empty target gives gains of its smoothing alone; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import row_keys, written

BUCKETS = 10_000
PARTS = 100
SMOOTHING = BUCKETS
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: A block ends at so many documents or features.
BLOCK_DOCS, BLOCK_FEATURES = 16_384, 1_500_000
#: Blocks that a task passes over, about.
BLOCKS_OF_A_SALT = 2_000
#: Digits and letters of ASCII, and all bytes of other letters, stay; A-Z are lowered; the rest separates.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PER_PART = BUCKETS // PARTS


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The buckets of all features, repeats included."""
    crc = zlib.crc32
    single = list(map(crc, words))
    # a CRC goes on from that of the first word
    double = [crc(b" " + w, c) for w, c in zip(words[1:], single, strict=False)]
    return np.array(single + double, dtype=np.int64) % BUCKETS


def packed(doc: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> bytes:
    """Postings of one range and block, sorted by (bucket, doc), bytes of equal worth together."""
    step = np.diff(doc, prepend=0).astype("<i4")  # negative where a bucket ends
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T) for x in (step, np.diff(bucket, prepend=0).astype("<i4"), n.astype("<u4"))]
    return zstandard.compress(b"".join(p.tobytes() for p in planes), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(3, 4, -1)
    step, bucket, n = (np.ascontiguousarray(x.T).view("<i4").ravel().astype(np.int64) for x in raw)
    return np.cumsum(step), np.cumsum(bucket), n


POSTED = "block long, idx long, k1 long, n_features long, n_words long, part int, bucket int, n long, data binary"
_NAMES = [x.split()[0] for x in POSTED.split(", ")]
_TYPES = [pa.int32() if x.endswith(" int") else pa.binary() if x.endswith("binary") else pa.int64() for x in POSTED.split(", ")]


def _batch(ids: pa.Array, **columns) -> pa.RecordBatch:
    """Rows of POSTED with the columns given."""
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(len(ids), t) for c, t in zip(_NAMES, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", *_NAMES])


def _posted(id_type: pa.DataType, postings: bool):
    """Over (doc_id, k1, t): rows of documents (block, idx, ...), of postings (block, part, data) and of the task's totals (part, bucket, n)."""

    def block_of(ids, k1s, counts, words, found):
        # the rows are written before they are read, so a name drawn at random is the same for all readers
        n, block = len(k1s), int.from_bytes(os.urandom(8), "big") >> 1
        yield _batch(ids, block=np.full(n, block), idx=np.arange(n), k1=k1s, n_features=counts, n_words=words)
        key, times = np.unique(found * BLOCK_DOCS + np.repeat(np.arange(n), counts), return_counts=True)
        bucket, doc = key // BLOCK_DOCS, key % BLOCK_DOCS
        cuts = np.searchsorted(bucket, np.arange(PARTS + 1) * PER_PART)
        full = [p for p in range(PARTS) if cuts[p] < cuts[p + 1]]
        data = [packed(doc[a:b], bucket[a:b] - p * PER_PART, times[a:b]) for p in full for a, b in [cuts[p : p + 2]]]
        yield _batch(pa.nulls(len(full), id_type), block=np.full(len(full), block), part=full, data=data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, dtype=np.int64)
        ids, k1s, words, found = [], [], [], []

        def flushed():
            if not k1s:
                return
            features = np.concatenate(found)
            totals[:] += np.bincount(features, minlength=BUCKETS)
            if postings:
                yield from block_of(pa.concat_arrays(ids), k1s, np.array([len(x) for x in found]), words, features)
            for x in (ids, k1s, words, found):
                x.clear()

        held = 0
        for b in batches:
            for i, (k1, t) in enumerate(zip(b.column("k1").to_pylist(), b.column("t").to_pylist(), strict=True)):
                own = words_of(t)
                ids.append(b.column("doc_id").slice(i, 1))
                k1s.append(k1)
                words.append(len(own))
                found.append(buckets_of(own))
                held += len(found[-1])
                if held >= BLOCK_FEATURES or len(k1s) >= BLOCK_DOCS:
                    yield from flushed()
                    held = 0
        yield from flushed()
        at = np.flatnonzero(totals)
        yield _batch(pa.nulls(len(at), id_type), part=at // PER_PART, bucket=at % PER_PART, n=totals[at])

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), row_keys(F.col(id_col), F.col(text_col))[0], F.col(text_col).cast("binary").alias("t"))


def gain(s: int, t: int, all_s: int, all_t: int) -> int:
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + SMOOTHING) / (float(s + 1) * float(all_t + SMOOTHING))))


def _gained(all_s: int, all_t: int):
    """Over rows (part, salt, block, data, bucket, s, t) sorted by (part, salt), totals before postings: what each block gains of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gains = None, {}
        for b in batches:
            blocks, out = [], []
            for part, salt, block, data, bucket, s, t in zip(*(b.column(c).to_pylist() for c in ("part", "salt", "block", "data", "bucket", "s", "t")), strict=True):
                if key != (part, salt):
                    key, gains = (part, salt), np.zeros(PER_PART, dtype=np.int64)
                if data is None:
                    gains[bucket] = gain(s, t, all_s, all_t)
                    continue
                docs, own, n = unpacked(data)
                total = np.zeros(docs.max() + 1, dtype=np.int64)
                np.add.at(total, docs, n * gains[own])
                blocks.append(block)
                out.append(zstandard.compress(np.ascontiguousarray(total.view(np.uint8).reshape(-1, 8).T).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["block", "data"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (block, data) sorted by block: the sums of each of its documents (block, idx, total)."""

    def rows(block, total):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(total), block or 0)), pa.array(np.arange(len(total))), pa.array(total)], names=["block", "idx", "total"])

    last, total = None, np.zeros(0, dtype=np.int64)
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
            if block != last:
                yield rows(last, total)
                last, total = block, np.zeros(0, dtype=np.int64)
            planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
            own = np.ascontiguousarray(planes.T).view("<i8").ravel()
            if len(own) > len(total):
                own, total = total, own.copy()
            total[: len(own)] += own
    yield rows(last, total)


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, k1, n_words, n_features and weight (longs) of each document."""
    t = _texts(docs, id_col, text_col)
    kind = dict(t.dtypes)["doc_id"]
    posted = written(t.mapInArrow(_posted(to_arrow_type(t.schema["doc_id"].dataType), True), f"doc_id {kind}, {POSTED}"), "postings")
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("k1"), F.col(target_text_col).cast("binary").alias("t"))
    aim = aim.mapInArrow(_posted(pa.int64(), False), f"doc_id long, {POSTED}")
    both = posted.filter("bucket is not null").select("part", "bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.union(aim.select("part", "bucket", F.lit(0).cast("long"), "n"))
    totals = written(both.groupBy("part", "bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "totals")
    whole = totals.agg(F.sum("s"), F.sum("t")).first()
    lists = posted.filter("data is not null")
    salts = 1 + lists.count() // (PARTS * BLOCKS_OF_A_SALT)
    ours = lists.select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "data", *[F.lit(None).cast(k).alias(c) for c, k in (("bucket", "int"), ("s", "long"), ("t", "long"))])
    corpora = totals.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"), "bucket", "s", "t")
    dealt = ours.unionByName(corpora).repartition("part", "salt").sortWithinPartitions("part", "salt", F.col("data").isNotNull())
    gained = dealt.mapInArrow(_gained(whole[0] or 0, whole[1] or 0), "block long, data binary")
    sums = gained.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block long, idx long, total long")
    rows = posted.filter("idx is not null").select("doc_id", "block", "idx", "k1", "n_words", "n_features")
    found = rows.join(sums, ["block", "idx"], "left")
    # floors go down: the remainder is never negative
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    return found.select("doc_id", "k1", "n_words", "n_features", weight.cast("long").alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, k1, n_words, n_features, weight, score and rank: ``percent`` of the documents of LEAST_WORDS words or more are drawn, the others have no rank."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, target, id_col, text_col, target_text_col).withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    able = scored.filter(F.col("n_words") >= LEAST_WORDS)
    # scores are summed from the top within hundreds of them, these above one another; both are bounded by the range of scores
    counts = able.groupBy("score").agg(F.count("*").alias("here")).withColumn("band", F.floor(F.col("score") / 256))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = counts.groupBy(F.col("band").alias("_band")).agg(F.sum("here").alias("of_band")).withColumns({"before": F.coalesce(F.sum("of_band").over(above), F.lit(0)), "able": F.sum("of_band").over(Window.partitionBy(F.lit(0)))})
    within = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.join(bands, F.col("band") == F.col("_band")).select(F.col("score").alias("_score"), (F.col("before") + F.coalesce(F.sum("here").over(within), F.lit(0))).alias("base"), F.expr(f"able * {percent} div 100").alias("most"))
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "k1"))
    drawn = able.withColumn("nth", nth).join(bases, F.col("score") == F.col("_score"))
    place = F.col("base") + F.col("nth")
    ranked = drawn.withColumn("rank", F.when(place <= F.col("most"), place))
    columns = ["doc_id", "k1", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < LEAST_WORDS)
    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).union(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
