"""Exact Jaccard join of word n-gram sets: size-banded tiles, bitmap signatures, sorted-array intersection.

A text is the set of its SHINGLE-word shingles; two texts link where 100 * intersection >= 80 * union. A
component is what links reach. No link between different sets is lost.

Tiles. Linked sets differ in at most a ninth of the sum of their sizes. Sizes are banded by powers of four. In a band the
space of hashes is cut into slices; what a set has in one slice names a tile (band, slice, content), and
sets meet in the tiles that they share. Each differing shingle spoils one slice, so of k + 1 slices one is
whole, where k is the most that two linked sets of these sizes can differ by: each set enters k + 1 of
its slices that are not empty, the fullest first, an order that is the same for all sets, so that the first slice that two linked sets
share is among those of both. A set whose partners may lie in the next band enters that as well. A set
with too few slices that are not empty enters anew by another cut of the space, and again until it has enough, so one of two
linked sets always has. Fuller slices come first as they are rarer: a passage that many texts share fills few slices alone.

Within a tile. Up to SMALL sets meet in all pairs, more with the smallest of them. Each set is compared with the smallest
that it meets at all; then components are taken, and only what may join two of them is looked at: pairs of small tiles,
and large tiles that hold several components, in squares of up to SQUARE by SQUARE sets, each a group of its own,
so that neither a square nor its pairs grow with the tile. There bitmaps (one hashed bit a shingle, in WIDE bits
a shingle or more, folded for a first look) bound the overlap from above: each bit that only one of two sets has is a shingle that
the other lacks. Pairs of different components that pass are intersected exactly: twice only the likeliest partner of
each set, with components taken anew after each time, and then, in tiles where that left some out, all pairs. So a large group of near
copies costs links in proportion to its size, and none is missed that would join two components.

Verification compares bit counts, then sorted arrays of 40-bit hashes (a pair of texts of 500 words has equal
hashes of different shingles with a chance of 1e-8; sizes are counted on 64 bits).

Cases: letters A-Z count as a-z; fewer than SHINGLE words are one shingle; null and empty texts have the empty set and link with
nothing; texts with equal sets are one node; repeated rows are documents of one node; a null id counts as no id (it is
smaller than none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import row_keys, written
from tidemark.llm.graph import component_roots

SHINGLE = 5
#: Links have 100 * intersection >= LEAST * union.
LEAST = 80
SEED = 44
#: Tiles of up to so many sets yield all pairs; larger ones pairs with their smallest set.
SMALL = 8
#: Sets of one side of a square.
SQUARE = 512
#: Sets whose copies are left out within a task.
MOST_SEEN = 100_000
KEPT_BITS = 40
#: Sets whose tiles are sent on together.
SETS_AT_A_TIME = 100
#: Bits of a bitmap for each hash, at least, and of the narrow form that is looked at first.
WIDE = 4
#: Between the cuts of the space of hashes.
STEP = 0x9E3779B97F4A7C15


def hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, lengths = b" ".join(words), list(map(len, words))
    ends = list(accumulate(lengths, lambda at, n: at + 1 + n))
    digest, n = xxhash.xxh64_intdigest, min(shingle, len(words))
    return np.unique(np.array([digest(joined[b - k : e], SEED) for b, k, e in zip(ends, lengths, ends[n - 1 :], strict=False)], dtype=np.uint64))


def packed(grams: np.ndarray) -> bytes:
    """Sorted hashes, by differences, bytes of equal worth together."""
    steps = np.diff(grams, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8].T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(KEPT_BITS // 8, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, : KEPT_BITS // 8] = planes.T
    return np.cumsum(steps.view("<u8").ravel())


def bitmap(grams: np.ndarray) -> bytes:
    """One bit a hash, by its lowest bits, in a power of two of bits, WIDE times their number or more."""
    bits = max(64, 1 << (WIDE * max(1, len(grams)) - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(grams & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: bytes, n_bytes: int) -> np.ndarray:
    """A bitmap as words of 64 bits, folded to ``n_bytes``."""
    words = np.frombuffer(bits, dtype="<u8").reshape(-1, n_bytes // 8)
    return np.bitwise_or.reduce(words, axis=0)


def linked(both, na, nb):
    """Whether so many shingles in common are enough for sets of these sizes."""
    return 100 * both >= LEAST * (na + nb - both)


def overlap_bound(a: np.ndarray, b: np.ndarray, na, nb):
    """No fewer than the shingles that sets with these bitmaps (words in the last axis) have in common."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def similar(a: tuple, b: tuple) -> bool:
    """Whether two sets (n, bitmap, packed hashes) link: by their sizes, their bitmaps, their hashes."""
    (na, bits_a, data_a), (nb, bits_b, data_b) = a, b
    if not linked(min(na, nb), na, nb):
        return False
    width = min(len(bits_a), len(bits_b))
    if not linked(overlap_bound(folded(bits_a, width), folded(bits_b, width), na, nb), na, nb):
        return False
    small, large = sorted((unpacked(data_a), unpacked(data_b)), key=len)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return bool(linked(both, na, nb))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, k) of the bands that a set of n shingles enters; k is the most that it and a linked set that meets it there can differ by."""
    band = (n.bit_length() - 1) // 2
    top, most = 4 ** (band + 1), n * 100 // LEAST
    apart = lambda other: (n + other) * (100 - LEAST) // (100 + LEAST)
    return [(band, apart(min(top - 1, most)))] + ([(band + 1, apart(most))] if most >= top else [])


def slices_of(band: int) -> int:
    top = 4 ** (band + 1)
    return top if top <= 64 else top * 2 // 5


def tiles(n: int, grams: np.ndarray) -> np.ndarray:
    """The tiles that a set enters, as signed longs."""
    out = []
    for band, k in bands_of(n):
        m, cut = slices_of(band), 0
        while True:
            x = _mixed(grams + np.uint64((cut + 1) * STEP % (1 << 64)))
            part = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(starts, len(part)))
            content = np.add.reduceat(_mixed(x[order]), starts)
            key = _mixed(content ^ _mixed(part[starts] + np.uint64(band << 40 | cut << 48)))
            out.append(key[np.lexsort((key, -size))[: k + 1]])
            if len(key) > k:
                break
            cut += 1
    return np.concatenate(out).view(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, k1, k2 (of common.row_keys), fp (names the set), n, and where a task meets a set for the first time bits and grams."""
    t = docs.select(F.col(id_col).alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            fps, ns, bits, grams = [], [], [], []
            for x in b.column("t").to_pylist():
                found = hashes(x, shingle)
                fps.append(fp := xxhash.xxh64_intdigest(found.tobytes(), SEED))
                ns.append(len(found))
                new = len(found) > 0 and fp not in seen
                if new:
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(fp)
                    found = np.unique(found >> np.uint64(64 - KEPT_BITS))
                bits.append(bitmap(found) if new else None)
                grams.append(packed(found) if new else None)
            new = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(bits, pa.binary()), pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *new], names=["doc_id", "k1", "k2", "fp", "n", "bits", "grams"])

    return t.mapInArrow(run, f"doc_id {dict(t.dtypes)['doc_id']}, k1 long, k2 long, fp long, n long, bits binary, grams binary")


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SETS_AT_A_TIME):
            some = b.slice(at, SETS_AT_A_TIME)
            found = [tiles(n, unpacked(g)) for n, g in zip(some.column("n").to_pylist(), some.column("grams").to_pylist(), strict=True)]
            fps = np.repeat(some.column("fp").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(fps)], names=["key", "fp"])


def _met(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Over rows (key, fp) sorted by both: pairs (a, b, null), and (smallest set, set, key) for each set of a tile of over SMALL."""

    def of(keys, fps, cut):
        once = np.append(True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1]))[: len(keys)]
        keys, fps = keys[once], fps[once]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        sizes = np.diff(np.append(starts, len(keys)))
        large, first, last = (np.repeat(x, sizes) for x in ((sizes > SMALL) | (cut & (keys[starts] == keys[:1])), starts, starts + sizes))
        place = np.arange(len(keys)) - first
        a, b = [fps[:0]], [fps[:0]]
        for d in range(1, SMALL):
            at = np.flatnonzero(~large & (place + d < last - first))
            a.append(fps[at])
            b.append(fps[at + d])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])
        yield pa.RecordBatch.from_arrays([pa.array(fps[first[large]]), pa.array(fps[large]), pa.array(keys[large])], names=["a", "b", "key"])

    def held_in_pieces():
        """Rows of whole tiles, and whether the first tile among them is but a piece: one of over ``most`` rows is taken in pieces, each led by its smallest set."""
        keys, fps, cut = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
        for batch in batches:
            keys, fps = (np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False)]) for c, old in (("key", keys), ("fp", fps)))
            tail = np.searchsorted(keys, keys[-1], side="left") if len(keys) else 0  # the last tile may go on
            if tail:
                yield keys[:tail], fps[:tail], cut
                keys, fps, cut = keys[tail:], fps[tail:], False
            if len(keys) > most:
                yield keys, fps, True
                keys, fps, cut = keys[:1], fps[:1], True
        yield keys, fps, cut

    for piece in held_in_pieces():
        yield from of(*piece)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sides = [zip(*(b.column(f"{c}_{x}").to_pylist() for c in ("n", "bits", "grams")), strict=True) for x in "ab"]
        yield b.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(*sides, strict=True)], pa.bool_()))


def _square(rows: list[tuple], likeliest: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """Of rows (side, fp, root, n, bits) the pairs of side 0 and 1, or of side 0 alone, of different roots whose bitmaps may link; whether some were left out.

    likeliest: only the likeliest partner of each set.
    """
    width = min(len(r[4]) for r in rows)
    side, fp, root, n = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(4))
    wide = np.stack([folded(r[4], width) for r in rows])
    narrow = np.bitwise_or.reduce(wide.reshape(len(rows), -1, max(1, wide.shape[1] // WIDE)), axis=1)
    held = np.bitwise_count(narrow).sum(axis=1, dtype=np.int64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    out, left_out = [], False
    for place, x in enumerate(left):
        others = left[place + 1 :] if alone else right
        others = others[root[others] != root[x]]
        if not len(others):
            continue
        # bits in common, and so those that only one of two has
        both = np.bitwise_count(narrow[others] & narrow[x]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(n[x] - held[x], n[others] - held[others]) + both
        others = others[linked(bound, n[x], n[others])]
        bound = overlap_bound(wide[x], wide[others], n[x], n[others])
        may = linked(bound, n[x], n[others])
        found = others[may]
        if likeliest and len(found) > 1:
            found, left_out = found[[np.argmax(bound[may] / np.maximum(n[x], n[found]))]], True
        out.append((np.minimum(fp[x], fp[found]), np.maximum(fp[x], fp[found])))
    return out, left_out


def _squares(likeliest: bool):
    """Over rows (key, i, j, side, fp, root, n, bits) sorted by the first three: pairs (a, b), and (null, null, key) of tiles that left some out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, held = None, []

        def done():
            found, left_out = _square(held, likeliest) if len(held) > 1 else ([], False)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])
            if left_out:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([square[0]])], names=["a", "b", "key"])

        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "fp", "root", "n", "bits")), strict=True):
                if (key, i, j) != square:
                    yield from done()
                    square, held = (key, i, j), []
                held.append(tuple(row))
        yield from done()

    return run


def _mixed_tiles(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The squares of the tiles whose sets are not all of one component."""
    placed = members.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low <> high")
    rows = placed.join(mixed.select("key", "size"), "key").join(sets.select("fp", "n", "bits"), "fp")
    n = F.ceil(F.col("size") / SQUARE)
    own = rows.withColumn("own", F.pmod(F.xxhash64("fp", "key"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("long").alias("side"), "fp", "root", "n", "bits")


def links(sets: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """(a, b): links of distinct sets (fp, n, bits, grams; copies may have null grams) with the same components as all links.

    keyed: (key, fp) of other tiles; then with the components of the links whose sets share one.
    """
    once = sets.filter("grams is not null")
    if keyed is None:
        keyed = once.select("fp", "n", "grams").mapInArrow(_entered, "key long, fp long")
    found = written(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_met, "a long, b long, key long"), "met")
    pairs = written(found.filter("a <> b").groupBy("a", "b").agg(F.max(F.isnull("key")).alias("small")), "pairs")
    members = found.filter("key is not null").select("key", F.col("b").alias("fp"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()  # a member of a large tile is in a pair
    # merged at any size: these names grow with the documents, so they are not to be broadcast while they are few
    kept = written(once.select("fp", "n", "bits", "grams").join(named.hint("merge"), "fp", "left_semi").dropDuplicates(["fp"]), "kept")
    of = lambda c: kept.select(F.col("fp").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "bits", "grams")])
    verified = lambda some: written(some.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(_verified, "a long, b long"), "links")
    # first each set with the smallest that it meets, which joins most; then what may join components
    tried = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    out = verified(tried)
    more = pairs.filter("small").select("a", "b")
    for likeliest in (True, True, False):
        roots = component_roots(out)
        squares = _mixed_tiles(members, roots, kept)
        dealt = squares.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        met = written(dealt.mapInArrow(_squares(likeliest), "a long, b long, key long"), "squares")
        more = met.filter("a is not null").select("a", "b").union(_apart(more, roots)).distinct()
        more = written(more.join(tried, ["a", "b"], "left_anti"), "more")
        out = out.union(verified(more))
        left_out = met.filter("key is not null").select("key").distinct()
        if left_out.isEmpty():
            break
        tried, members, more = tried.union(more), members.join(left_out, "key", "left_semi"), more.limit(0)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets are of different components so far."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    placed = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return placed.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, k1, k2, fp, n, component_id and first_k1, first_k2: the smallest id of the component and the keys of a row that has it."""
    sets = written(_sets(docs, id_col, text_col, shingle), "sets")
    rows = sets.select("doc_id", "k1", "k2", "fp", "n")
    grouped = simhash.grouped(rows.filter("n > 0"), lambda nodes: links(sets))
    alone = rows.filter("n = 0").select("*", F.col("doc_id").alias("component_id"), F.col("k1").alias("first_k1"), F.col("k2").alias("first_k2"))
    return grouped.unionByName(alone)
