"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: 64 bits of the hashes of a text's 4-word shingles (repeats included); a bit is 1 if set
in over half of them. Fingerprints link at BITS = 4 or fewer differing bits; a component is what
links reach.

Search: the 64 bits are cut into three segments, fewer than the BITS + 1 that an exact match would
need, so that of any linked pair one segment differs in at most one bit. Each distinct
fingerprint is indexed under all variants of its segments with one bit taken out (64 in all); linked
fingerprints share a variant. Rows are brought together by variant and verified there on all 64
bits. A bucket yields at most a forest of its links, which has the same components as all of
them: of pairs that meet in several buckets only the first counts, and large buckets are searched
breadth first over the members not yet reached, which a dense group of near copies exhausts at once.
A bucket over MOST_IN_BUCKET members is not held: its members go on to a finer index, in which the
bits that its key leaves free are cut into three again and one-bit variants of those refine the
key; no link is lost, as at most BITS bits differ there too. This repeats while a bucket has over
MOST_IN_FINER members. Each level fixes a third of the free bits but one, so a bucket of level l with f
free bits has at most 2 ** (f + l) members: 2 ** 17 at the fourth, where f is 13.

Equal fingerprints are one node, so exact copies cost nothing here.

Cases: a null or empty text has fingerprint 0 and is linked like any other; fewer than four words
are one shingle; repeated rows are documents of one node; a null id counts as no id (it is smaller
than none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, row_keys, written
from tidemark.llm.graph import component_roots

BITS = 4
SHINGLE = 4
SEED = 42
#: Segments of the fingerprint: (lowest bit, bits). floor(BITS / 3) = 1.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Buckets up to this size are compared pair by pair, larger ones breadth first.
SMALL_BUCKET = 64
#: Buckets over this size are cut by a finer index, and over this one those of a finer index.
MOST_IN_BUCKET, MOST_IN_FINER = 20_000, 100_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text (UTF-8), unsigned. Letters A-Z count as a-z."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, lengths = b" ".join(words), list(map(len, words))
    ends = list(accumulate(lengths, lambda at, n: at + 1 + n))
    starts = map(int.__sub__, ends, lengths)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, k1, k2 (of common.row_keys) and fp, the fingerprint as a signed long."""
    t = docs.select(F.col(id_col).alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column("t").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps)], names=["doc_id", "k1", "k2", "fp"])

    return t.mapInArrow(run, f"doc_id {dict(t.dtypes)['doc_id']}, k1 long, k2 long, fp long")


def _mask(low: int, n: int) -> int:
    return ((1 << n) - 1) << low


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: the bit taken out (6 bits), then its segment without that bit."""
    keys = []
    for low, n in SEGMENTS:
        for w in range(low, low + n):
            rest = F.shiftrightunsigned(fp.bitwiseAND(F.lit(_signed(_mask(low, n) & ~(1 << w)))), low)
            keys.append(rest.bitwiseOR(F.lit(w << 22)).cast("int"))
    return F.array(*keys)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def refined(keys: np.ndarray, fps: np.ndarray, free: int) -> Iterator[tuple[np.ndarray, int]]:
    """Finer keys of members of buckets that leave the bits ``free`` free, with the bits that they leave free."""
    bits = [b for b in range(64) if free >> b & 1]
    third = -(-len(bits) // 3)
    for at in range(0, len(bits), third):
        part = bits[at : at + third]
        rest = free & ~sum(1 << b for b in part)
        for w in part:
            mask = np.uint64(sum(1 << b for b in part if b != w))
            yield _mixed(_mixed(keys + np.uint64(w + 1)) ^ (fps & mask)), rest


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (fp, key, free): the same with finer keys, a row for each variant."""
    for b in batches:
        fps, keys, frees = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "key", "free"))
        for free in np.unique(frees).tolist():
            own = np.flatnonzero(frees == free)
            for finer, rest in refined(keys[own], fps[own], free):
                columns = (finer, fps[own], np.full(len(own), rest, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["key", "fp", "free"])


def _free_of(key: Column) -> Column:
    """The bits that a key of ``variants`` leaves free: all but its segment's."""
    bit, out = F.shiftright(key, 22), F.lit(None).cast("long")
    for low, n in SEGMENTS:
        out = F.when((bit >= low) & (bit < low + n), F.lit(_signed(((1 << 64) - 1) & ~_mask(low, n)))).otherwise(out)
    return out


def _first_key(diff: np.ndarray) -> np.ndarray:
    """Of the variants that a pair shares, the bit taken out of the first one, by the bits in which the pair differs."""
    out = np.full(len(diff), -1, dtype=np.int64)
    for low, n in reversed(SEGMENTS):
        own = (diff >> np.uint64(low)) & np.uint64((1 << n) - 1)
        one = np.bitwise_count(own) <= 1
        # a segment alike in all bits: its first bit; in all but one: that bit
        bit = np.where(own == 0, 0, np.bitwise_count(own - np.uint64(1)).astype(np.int64))
        out = np.where(one, low + bit, out)
    return out


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what those before them have not joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for a, b in pairs:
        if (x := top(a)) != (y := top(b)):
            up[x] = y
            kept.append((a, b))
    return kept


def _breadth_first(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all linked members of one bucket, each found from the first member of its component."""
    rest, out = fps, []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(root), int(x)) for x in found]
                queue += list(found)
    return out


def _links(keys: np.ndarray, fps: np.ndarray, first_only: bool) -> list[tuple[int, int]]:
    """Links within the runs of equal keys. first_only: keys are those of ``variants``."""
    change = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate(([0], change)) if len(keys) else change
    sizes = np.diff(np.append(starts, len(keys)))
    out: list[tuple[int, int]] = []
    for s, n in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        out += _breadth_first(fps[s : s + n])
    small = (sizes > 1) & (sizes <= SMALL_BUCKET)
    last = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat(small, sizes))
    found = []
    for d in range(1, SMALL_BUCKET):
        at = at[at + d < last[at]]
        if not len(at):
            break
        diff = fps[at] ^ fps[at + d]
        near = np.bitwise_count(diff) <= BITS
        if first_only:
            near &= np.where(near, _first_key(diff), -1) == (keys[at] >> 22)
        found.append(np.stack([fps[at[near]], fps[at[near] + d]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)
    return out + _forest((int(a), int(b)) for a, b in pairs.tolist())


def _search(most: int, first_only: bool):
    """Over rows (key, fp, free) sorted by key: links (a, b), and (a, null, key, free) for members of buckets over ``most``."""
    names = ["a", "b", "key", "free"]

    def linked(keys, fps):
        ab = np.array(_links(keys, fps, first_only), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), *[pa.nulls(len(ab), pa.int64())] * 2], names=names)

    def unheld(keys, fps, frees):
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(keys), pa.array(frees)], names=names)

    def searched(keys, fps, frees):
        """Of whole buckets: large ones that leave bits free unheld, the others searched."""
        starts = np.append(0, np.flatnonzero(np.diff(keys)) + 1)[: len(keys)]
        sizes = np.diff(np.append(starts, len(keys)))
        over = np.repeat(sizes > most, sizes) & (frees != 0)
        if over.any():
            yield unheld(keys[over], fps[over], frees[over])
        yield linked(keys[~over], fps[~over])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)], None
        for b in batches:
            keys, fps, frees = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "free"))
            new = [keys.astype(np.int64), fps.view(np.uint64), frees]
            if passing is not None:
                n = np.searchsorted(new[0], passing, side="right")
                yield unheld(*(x[:n] for x in new))
                passing = passing if n == len(new[0]) else None
                new = [x[n:] for x in new]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            tail = np.searchsorted(held[0], held[0][-1], side="left")  # the last bucket may go on
            yield from searched(*(x[:tail] for x in held))
            held = [x[tail:] for x in held]
            if len(held[0]) > most and held[2][0] != 0:
                passing = int(held[0][0])
                yield unheld(*held)
                held = [x[:0] for x in held]
        yield from searched(*held)

    return run


def links(fps: DataFrame, most_in_bucket: int = MOST_IN_BUCKET, most_in_finer: int = MOST_IN_FINER) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp) with the same components as all links of BITS or fewer bits."""
    schema = "a long, b long, key long, free long"
    keyed = fps.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    found = written(keyed.repartition("key").sortWithinPartitions("key").select("key", "fp", F.lit(-1).cast("long").alias("free")).mapInArrow(_search(most_in_bucket, True), schema), "links")
    out = found.filter("b is not null").select("a", "b")
    large = found.filter("b is null").select(F.col("a").alias("fp"), "key", _free_of(F.col("key")).alias("free"))
    while not large.isEmpty():
        finer = large.mapInArrow(_refine, "key long, fp long, free long").repartition("key").sortWithinPartitions("key")
        found = written(finer.mapInArrow(_search(most_in_finer, False), schema), "finer-links")
        out = out.union(found.filter("b is not null").select("a", "b"))
        # a bucket that leaves no bit free is searched whatever its size, which is at most 2 ** (levels)
        large = found.filter("b is null").select(F.col("a").alias("fp"), "key", "free")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """doc_id, k1, k2, fp (signed long), component_id and first_k1: the smallest id of the component and the k1 of a row that has it."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return grouped(rows, lambda nodes: links(nodes, most_in_bucket))


def grouped(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (doc_id, k1, k2, fp) with component_id, first_k1 and first_k2, by the links of their distinct fp."""
    lowest = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("k1").alias("k1"), F.col("k2").alias("k2"))
    nodes = written(rows.groupBy("fp").agg(F.min(lowest).alias("low")), "nodes")
    roots = component_roots(links_of(nodes.select("fp")))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("low").alias("head"))
    placed = placed.select("fp", "root").join(heads, "root").select(F.col("fp").alias("_fp"), F.col("head.id").alias("component_id"), F.col("head.k1").alias("first_k1"), F.col("head.k2").alias("first_k2"))
    return rows.join(placed, rows["fp"] == placed["_fp"]).drop("_fp")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, once if its row repeats."""
    return firsts(docs, near_duplicates(docs, id_col, text_col, shingle), id_col, text_col)


def firsts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are first in their component of ``found``."""
    return of_heads(docs, heads(found), id_col, text_col)


def heads(found: DataFrame) -> DataFrame:
    """(_h1, _h2): the keys of the rows that are first in their component of ``found``."""
    return found.filter("k1 = first_k1 and k2 = first_k2").select(F.col("k1").alias("_h1"), F.col("k2").alias("_h2")).distinct()


def of_heads(docs: DataFrame, heads: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with these keys, each once."""
    rows, name = numbered(docs)
    k1, k2 = row_keys(F.col(name[id_col]), F.col(name[text_col]))
    kept = rows.select("*", k1.alias("_k1"), k2.alias("_k2")).join(heads, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left_semi")
    return kept.dropDuplicates(["_k1", "_k2"]).select(*[F.col(n).alias(c) for c, n in name.items()])
