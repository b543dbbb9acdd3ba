"""Packing by power-of-two decomposition.

A document's ids are cut into as many pieces of the full length (2048) as fit and one piece for each
binary digit of what is left, longest first. A piece is a sequence of its own: its length is a
power of two, so it needs no padding and no sequence crosses documents. Sequences are
bucketed by length: they are numbered bucket by bucket, longest first, in the order of a hash
within a bucket, and equal lengths make up batches of ``batch_tokens`` ids.

Sequences are numbered by sums over ranges of the hash, so no task holds a bucket.

Cases: a null or empty text is the end id alone, a piece of length 1; texts of any length are cut
whole; repeated rows are packed each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import range_bits, row_keys, running_sum, written
from tidemark.llm.encoders import encoder

LENGTH = 2048
END_ID = 1
BATCH_TOKENS = 1 << 16


def pieces(n: int, most: int = LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids; ``most`` is a power of two."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if (n % most) >> b & 1]


def cut(docs: DataFrame, tokenizer: str, kind: str = "spaced_words", id_col: str = "doc_id", text_col: str = "text", most: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, k1, k2, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)), F.col(text_col).cast("binary").alias("t"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(kind, tokenizer).encode
        for b in batches:
            which, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                own, at = encode(t or b"") + end, 0
                for k in pieces(len(own) // 4, most):
                    part = own[4 * at : 4 * (at + k)]
                    which.append(i)
                    starts.append(at)
                    lengths.append(k)
                    crcs.append(zlib.crc32(part))
                    totals.append(len(own) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    at += k
            take = pa.array(which, pa.int64())
            columns = [b.column(c).take(take) for c in ("doc_id", "k1", "k2")] + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "k1", "k2", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, k1 long, k2 long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, kind: str = "spaced_words", id_col: str = "doc_id", text_col: str = "text", most: int = LENGTH, end_id: int = END_ID, batch_tokens: int = BATCH_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id, offset (0: each fills its sequence from the start) and batch_id."""
    cuts = written(cut(docs, tokenizer, kind, id_col, text_col, most, end_id, with_ids), "pieces")
    counts = cuts.groupBy("length").count()  # a row for each power of two up to `most`
    longer = Window.partitionBy(F.lit(0)).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    buckets = counts.select(F.col("length").alias("_length"), F.coalesce(F.sum("count").over(longer), F.lit(0)).alias("_base"), F.coalesce(F.sum(F.ceil(F.col("count") / per_batch)).over(longer), F.lit(0)).alias("_batches"))
    numbered = running_sum(cuts.withColumn("_one", F.lit(1)), ["length"], ["k1", "k2", "start"], "_one", "_number", range_bits(cuts.count())).join(F.broadcast(buckets), F.col("length") == F.col("_length"))
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_base") + F.col("_number")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        (F.col("_batches") + F.floor(F.col("_number") / per_batch)).cast("long").alias("batch_id"),
        *["ids"] * with_ids,
    )
