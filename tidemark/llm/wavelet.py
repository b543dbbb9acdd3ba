"""Token ids as a wavelet matrix: one bit-plane for each bit of an id, with ranks, in one compressed file.

File: an 8-byte magic, the header's length (8 bytes, little-endian), the header (JSON, compressed),
then the parts that the header places: documents' ids and lengths (an Arrow stream), ranks, and the
planes in blocks of BLOCK bits, each compressed alone. Plane by plane, from the highest bit, ids are
dealt stably to the left (bit 0) and right (bit 1); ``zeros`` holds how many went left. Ranks are the
ones before each block and, inside a block, before each group of GROUP bits, so a position needs one
block of each plane, and of that at most GROUP bits are counted.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"WAVELET2"
BLOCK = 1 << 18
#: Bits between the ranks inside a block.
GROUP = 512
WORDS = GROUP // 64
LEVEL = 1


def build(ids: np.ndarray, doc_ids: list, lengths: list[int], id_type: pa.DataType | None = None) -> bytes:
    """The file of ``ids`` (whole numbers from 0), made of documents of these ids (of ``id_type``) and lengths."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    parts, places, at = [], {}, 0

    def put(name: str, data: bytes) -> None:
        nonlocal at
        parts.append(data)
        places[name] = [at, len(data)]
        at += len(data)

    zeros = []
    for b in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << b)) != 0
        words = _words(np.packbits(one, bitorder="little"))
        ranks = [0]
        for k in range(0, len(words), BLOCK // 64):
            block = words[k : k + BLOCK // 64]
            groups = np.concatenate(([0], np.bitwise_count(block).reshape(-1, WORDS).sum(axis=1).cumsum()))
            ranks.append(ranks[-1] + int(groups[-1]))
            put(f"{b}/{k // (BLOCK // 64)}", pack(block.tobytes()))
            put(f"groups/{b}/{k // (BLOCK // 64)}", pack(groups[:-1].astype("<u4").tobytes()))
        put(f"ranks/{b}", pack(np.array(ranks, dtype="<u8").tobytes()))
        zeros.append(len(now) - ranks[-1])
        now = np.concatenate((now.compress(~one), now.compress(one)))
    table = pa.record_batch([pa.array(doc_ids, type=id_type), pa.array(lengths, type=pa.int64())], names=["doc_id", "length"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_batch(table)
    put("docs", pack(out.getvalue().to_pybytes()))
    header = pack(json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "places": places}).encode())
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *parts])


def _words(packed: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit words, filled with 0 up to a whole group."""
    return np.concatenate((packed, np.zeros(-len(packed) % (GROUP // 8), dtype=np.uint8))).view("<u8")


class WaveletMatrix:
    """Answers from a file's bytes, or from any ``read(offset, length)`` of it; blocks are decompressed as needed."""

    def __init__(self, source):
        self.read = source if callable(source) else lambda at, n: source[at : at + n]
        head = self.read(0, 16)
        if head[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        n = int.from_bytes(head[8:], "little")
        self.unpack = zstandard.ZstdDecompressor().decompress
        header = json.loads(self.unpack(self.read(16, n)))
        self.base, self.n, self.bits, self.zeros, self.places = 16 + n, header["n"], header["bits"], header["zeros"], header["places"]
        self._block = lru_cache(maxsize=256)(self._load_block)
        self._ranks = lru_cache(maxsize=64)(lambda b: np.frombuffer(self._part(f"ranks/{b}"), dtype="<u8").astype(np.int64))

    def _part(self, name: str) -> bytes:
        at, n = self.places[name]
        return self.unpack(self.read(self.base + at, n))

    def _load_block(self, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a block and the ones before each of its groups."""
        return np.frombuffer(self._part(f"{b}/{k}"), dtype="<u8"), np.frombuffer(self._part(f"groups/{b}/{k}"), dtype="<u4")

    def documents(self) -> tuple[pa.Array, list[int]]:
        with pa.ipc.open_stream(self._part("docs")) as stream:
            table = stream.read_all().combine_chunks()
        return pa.concat_arrays(table["doc_id"].chunks) if table.num_rows else table["doc_id"].combine_chunks(), table["length"].to_pylist()

    def _bit(self, b: int, i: int) -> int:
        words, _ = self._block(b, i // BLOCK)
        i %= BLOCK
        return int(words[i >> 6]) >> (i & 63) & 1

    def _ones(self, b: int, i: int) -> int:
        """Ones of plane ``b`` before position ``i``."""
        k, rest = divmod(i, BLOCK)
        if i == self.n:
            return self.n - self.zeros[self.bits - 1 - b]
        out = int(self._ranks(b)[k])
        if rest:
            words, groups = self._block(b, k)
            group, word = rest // GROUP, rest >> 6
            out += int(groups[group]) + sum(int(x).bit_count() for x in words[group * WORDS : word])
            if rest & 63:
                out += (int(words[word]) & (1 << (rest & 63)) - 1).bit_count()
        return out

    def _find(self, b: int, bit: int, j: int) -> int:
        """The position in plane ``b`` of the ``j``-th (from 0) ``bit``."""
        ranks = self._ranks(b)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        k = int(np.searchsorted(before, j, side="right")) - 1
        words, groups = self._block(b, k)
        inside = groups.astype(np.int64)
        inside = inside if bit else np.arange(len(inside)) * GROUP - inside
        j -= int(before[k])
        group = int(np.searchsorted(inside, j, side="right")) - 1
        bits = np.unpackbits(words[group * WORDS : (group + 1) * WORDS].view(np.uint8), bitorder="little")
        return k * BLOCK + group * GROUP + int(np.flatnonzero(bits == bit)[j - int(inside[group])])

    def _planes(self):
        return zip(range(self.bits - 1, -1, -1), self.zeros, strict=True)

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for b, zeros in self._planes():
            ones = self._ones(b, i)
            if self._bit(b, i):
                out |= 1 << b
                i = zeros + ones
            else:
                i -= ones
        return out

    def access_many(self, places: np.ndarray) -> np.ndarray:
        """The ids at ascending positions, plane by plane for all of them."""
        at, out = np.asarray(places, dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for b, zeros in self._planes():
            one, ones = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
            for k in np.unique(at // BLOCK):
                own = np.flatnonzero(at // BLOCK == k)
                words, groups = self._block(b, int(k))
                rest = at[own] % BLOCK
                word, below = rest >> 6, (np.uint64(1) << (rest & 63).astype(np.uint64)) - np.uint64(1)
                before = np.bitwise_count(words).astype(np.int64).cumsum() - np.bitwise_count(words)
                # a group's rank, the words of the group before this one, and the bits below in this one
                ones[own] = self._ranks(b)[k] + groups[rest // GROUP] + (before[word] - before[word // WORDS * WORDS]) + np.bitwise_count(words[word] & below)
                one[own] = words[word] >> (rest & 63).astype(np.uint64) & np.uint64(1) > 0
            out |= one.astype(np.int64) << b
            at = np.where(one, zeros + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for b, zeros in self._planes():
            a, z = self._ones(b, start), self._ones(b, end)
            start, end = (zeros + a, zeros + z) if token >> b & 1 else (start - a, end - z)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` stands in [start, end)."""
        if token >> self.bits or token < 0:
            return 0
        a, z = self._range(token, start, self.n if end is None else end)
        return z - a

    def locate(self, token: int, j: int) -> int:
        """The position of the ``j``-th (from 0) ``token``."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        at = self._range(token, 0, self.n)[0] + j
        for b, zeros in reversed(list(self._planes())):
            at = self._find(b, 1, at - zeros) if token >> b & 1 else self._find(b, 0, at)
        return at

    def all(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        blocks = -(-self.n // BLOCK)
        for b, zeros in reversed(list(self._planes())):
            packed = b"".join(self._part(f"{b}/{k}") for k in range(blocks))
            one = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little", count=self.n).view(bool)
            was = np.empty_like(now)
            was[np.flatnonzero(~one)] = now[:zeros]  # by places: several times faster than by a mask
            was[np.flatnonzero(one)] = now[zeros:] | kind(1 << b)
            now = was
        return now
