"""Token-ID output: the ids of all documents, in ascending id order, in wavelet-matrix files.

Documents are range-partitioned by id and sorted; each task encodes its range and writes files
of about SHARD_TOKENS ids through the file system of their folder, under names of their own, so that a
task that runs again leaves no half-written file in use: only files that the manifest names count,
and the manifest is a table that Spark commits. Where each document starts follows from the
manifest's sums: files within a partition, partitions (one row each) above them. Reading back undoes
the planes of a whole file; each document's last id, which must be the end id, and its first are also read
by rank, so a file whose ranks do not fit its planes is an error.

Cases: a null or empty text is the end id alone; null ids come first; rows of one id stand in the
order of a hash of their text; repeated rows are written each; one document over SHARD_TOKENS has a
file of its own size; an empty table gives no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, row_keys, written
from tidemark.llm.encoders import encoder
from tidemark.llm.storage import read_bytes, write_bytes
from tidemark.llm.wavelet import WaveletMatrix, build

SHARD_TOKENS = 1 << 20
END_ID = 1
MANIFEST = "part int, number int, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, kind: str = "lower_words", id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files; returns the manifest (part, number, path, n_docs, n_ids), in whose order ids ascend."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_keys(F.col(id_col), F.col(text_col))[0], F.col(text_col).cast("binary").alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(kind, tokenizer).encode, TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, held, id_type = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            path = f"{folder}/ids-{part:06d}-{number:06d}-{uuid.uuid4().hex}.wm"
            write_bytes(path, build(np.frombuffer(b"".join(ids), dtype="<u4"), doc_ids, lengths, id_type))
            row = pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": path, "n_docs": len(lengths), "n_ids": held}], schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            number, held = number + 1, 0
            for x in (ids, doc_ids, lengths):
                x.clear()
            return row

        for b in batches:
            id_type = b.column("doc_id").type
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), strict=True):
                own = encode(t or b"") + end
                if held and held + len(own) // 4 > shard_tokens:
                    yield flush()
                ids.append(own)
                doc_ids.append(doc_id)
                lengths.append(len(own) // 4)
                held += len(own) // 4
        if held:
            yield flush()

    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "k1").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "k1")
    return written(ranged.mapInArrow(run, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids in all files before each."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row for each partition
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before(Window.partitionBy(F.lit(0)).orderBy("part"))), F.lit(0)).alias("_above"))
    within = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("number"))), F.lit(0))
    return manifest.withColumn("_within", within).join(parts, F.col("part") == F.col("_part")).withColumn("start", (F.col("_within") + F.col("_above")).cast("long")).drop("_within", "_part", "_above")


def read_documents(manifest: DataFrame, id_type: str = "long", end_id: int = END_ID) -> DataFrame:
    """From the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as 32-bit little-endian), first_id (by rank)."""
    files = with_starts(manifest).select("path", "start")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                matrix = WaveletMatrix(read_bytes(path))
                doc_ids, lengths = matrix.documents()
                data = matrix.all().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                firsts = ends - np.array(lengths)
                edges = matrix.access_many(np.stack((firsts, ends - 1), axis=1).ravel())
                if (edges[1::2] != end_id).any():
                    raise ValueError(f"a document of {path} does not end with the end id")
                crcs = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths, strict=True)]
                columns = [pa.array(x, pa.int64()) for x in (start + firsts, lengths, crcs, edges[::2])]
                yield pa.RecordBatch.from_arrays([doc_ids, *columns], names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id"])

    return files.repartition(n).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, first_id long")
