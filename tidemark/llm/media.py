"""Media columns: content-addressed payloads in tar shards.

Payload: a text's UTF-8 bytes, filled with bytes 255 up to a positive multiple of 576. Stored form: a
grey PNG of 8-bit samples, 576 wide, one row for each 576 bytes; lossless. A task writes the
payloads of its rows into one tar file of its own, each distinct payload once, named by the digest
of the payload; rows carry digest, shard, offset and length. Payloads that several shards hold resolve
to one place, the first by shard name and offset. Metadata columns (width, height, bit depth) are filled by ``headers``,
which reads a stored form's first 33 bytes by range; ``features`` reads it whole for what its samples say, and
``media_columns`` does one after the other, shard by shard, without another shuffle.

Shards go through the shared folder's file system under names of their own, and count only where the
manifest, a table that Spark commits, names them: a task that runs again leaves nothing in use.

Cases: a null or empty text is one row of 576 bytes 255; texts of any length are stored whole; equal
texts have equal values; rows are kept as they are, nulls and repeats included; an empty table
gives no shard and an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, written
from tidemark.llm.storage import open_input, open_output

#: Fixed values of the format.
WIDTH = 576
FILL = b"\xff"
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes that hold a stored form's metadata: the signature and the first chunk.
HEADER = 33
LEVEL = 6


def payload(text: bytes | None) -> bytes:
    data = text or b""
    return data + FILL * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG whose samples are ``data``, a multiple of ``width``."""
    rows = np.zeros((len(data) // width, width + 1), dtype=np.uint8)  # each row leads with filter 0
    rows[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> dict[str, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if first[:8] != PNG or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", first[16:25])
    return {"width": width, "height": height, "bit_depth": depth}


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG of ``to_png``."""
    width, at, parts = png_header(stored)["width"], 8, []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            parts.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """64 bits in hexadecimal: of 64 equal stretches of the samples, those brighter than all together."""
    a = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    stretches = a.reshape(64, -1)  # 576 is a multiple of 64
    bright = stretches.sum(axis=1) * 64 > a.sum()
    return np.packbits(bright).tobytes().hex()


def store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; returns doc_id, n_bytes, digest (binary), shard, offset, length, a row for each of ``docs``."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "media-shards")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, at, places = f"{folder}/media-{uuid.uuid4().hex}.tar", None, 0, {}
        try:
            for b in batches:
                found = []
                for t in b.column("t").to_pylist():
                    data = payload(t)
                    digest = hashlib.sha256(data).digest()
                    if digest not in places:
                        out = out or open_output(shard)
                        png = to_png(data)
                        member = tarfile.TarInfo(f"{digest.hex()}.png")
                        member.size = len(png)
                        head = member.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + png + bytes(-len(png) % 512))
                        places[digest] = (at + len(head), len(png))
                        at += len(head) + len(png) + -len(png) % 512
                    found.append((len(t or b""), digest, shard, *places[digest]))
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            if out:
                out.write(bytes(1024))  # the end of a tar file
        finally:
            if out:
                out.close()

    return written(rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, digest binary, shard string, offset long, length long"), "media-manifest")


def resolved(manifest: DataFrame) -> DataFrame:
    """A row for each digest: the one place that it resolves to."""
    place = F.min(F.struct("shard", "offset", "length"))
    return manifest.groupBy("digest").agg(place.alias("p")).select("digest", "p.shard", "p.offset", "p.length")


def dealt(places: DataFrame) -> DataFrame:
    """``places`` spread evenly and, within a task, shard by shard and ascending."""
    return places.repartition("digest").sortWithinPartitions("shard", "offset")


def headers(places: DataFrame) -> DataFrame:
    """``places`` (digest, shard, offset, length) with width, height and bit_depth, by reading the headers only."""
    return _read(places, HEADER, png_header, (("width", "long"), ("height", "long"), ("bit_depth", "long")))


def features(places: DataFrame) -> DataFrame:
    """``places`` with what reading them back whole gives."""

    def look(stored: bytes) -> dict:
        samples = from_png(stored)
        return {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature(samples)}

    return _read(places, None, look, (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")))


def _read(places: DataFrame, most: int | None, look, columns) -> DataFrame:
    """Each place's first ``most`` bytes (None: all), by range, in the order in which the rows come."""
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for b in batches:
                found = []
                for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                    if shard != name:
                        if file:
                            file.close()
                        name, file = shard, open_input(shard)
                    found.append(look(file.read_at(length if most is None else min(most, length), offset)))
                new = [pa.array([x[c] for x in found], kinds[k]) for c, k in columns]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(c for c, _ in columns)])
        finally:
            if file:
                file.close()

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in places.schema), *(f"{c} {k}" for c, k in columns)])
    return places.mapInArrow(run, schema)


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, the place of each row's payload, its header's metadata and its features."""
    manifest = store(docs, folder, id_col, text_col)
    read = features(headers(dealt(resolved(manifest)))).withColumnRenamed("digest", "_digest")
    return manifest.select("doc_id", "n_bytes", "digest").join(read, F.col("digest") == F.col("_digest")).drop("_digest")
