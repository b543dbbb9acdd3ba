"""Vectors as Spark columns: products, the hash embedder, 8-bit quantisation."""

from __future__ import annotations

import struct as _struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import let

HASH_DIM = 96


def dot(a: Column, b: Column) -> Column:
    """In doubles, whatever the elements are; added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length, 1 for a vector of zeros."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def guarded_cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    """0 where either vector is all but zero."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < least) | (nb < least), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def hash_embedding(text: Column | str, dim: int = HASH_DIM) -> Column:
    """The bytes of the text's SHA-256, repeated up to ``dim``, as numbers from -1 to 1."""
    digest = F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)
    byte = lambda d, i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
    # one digest a text; a lambda that held it would compute it for each of its elements
    numbers = let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(d, i) / F.lit(127.5) - F.lit(1.0)))
    return F.slice(F.flatten(F.array_repeat(numbers, -(-dim // 32))), 1, dim)


def int8_scale(a: Column) -> Column:
    most = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.lit(127.0) / F.when(most < 1e-8, F.lit(1.0)).otherwise(most)


def with_value(value: Column, of) -> Column:
    """``of`` a value computed once; within a lambda over a vector's elements it would be computed for each of them."""
    return F.transform(F.array(value), of)[0]


def quantize(a: Column) -> Column:
    """Whole numbers from -127 to 127: the vector scaled by ``int8_scale``, halves to even."""
    scaled = lambda scale: F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") * scale).cast("int"))))
    return with_value(int8_scale(a), scaled)


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / scale)


def mean_squared_error(a: Column, b: Column) -> Column:
    """Infinite where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(total / F.size(a))


def storage_ratio(dim: int) -> float:
    return (4 + dim) / (4 * dim)


@F.pandas_udf(T.BinaryType())
def to_int8_blob(vectors: pd.Series) -> pd.Series:
    """The stored form: the inverse scale as a 32-bit float, then a byte for each element, offset by 128."""

    def pack(v):
        if v is None:
            return None
        most = max((abs(float(x)) for x in v), default=0.0)
        scale = 127.0 / (most if most >= 1e-8 else 1.0)
        return _struct.pack("<f", 1.0 / scale) + bytes(max(-127, min(127, round(float(x) * scale))) + 128 for x in v)

    return vectors.map(pack)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_int8_blob(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else [(x - 128) * _struct.unpack("<f", b[:4])[0] for x in b[4:]])


#: Embedding backends by name: text column -> array of doubles. Others can be registered.
EMBEDDERS = {"hash": hash_embedding}


def register_embedder(name: str, embed) -> None:
    EMBEDDERS[name] = embed


def embedder(name: str = "hash"):
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {name}")
    return EMBEDDERS[name]
