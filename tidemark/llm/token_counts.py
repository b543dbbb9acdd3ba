"""Token counts under a unigram model, by dynamic programming shared over a trie.

Model: the pieces of a public byte-level vocabulary; a piece of rank r (from 0) has the probability
1 / ((r + 1) * H), H making them sum to 1, and costs its negative logarithm in whole millionths. A
pre-token's segmentation is the one of least cost, among equals of fewest pieces; whole numbers
make ties exact. Every byte is a piece, so everything has a segmentation.

Sharing: distinct pre-tokens are inserted in a trie of bytes. Each node holds the forward score of its
prefix (least cost and its number of pieces), computed once from its ancestors when the node is
made; where a pre-token ends, that is its count, so every further occurrence is a lookup. A Python
worker keeps one trie over all its tasks; at MOST_NODES nodes it starts anew, which bounds memory
and changes no count. The model is given, not trained: a tokenizer's pieces are fixed by its vocabulary.

Rows never meet: no shuffle, any skew is harmless.

Cases: a null text counts as empty and has no tokens; a pre-token over LONG bytes is computed on a
sliding window of scores without being stored; repeated rows give repeated results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoders import piece_text, spaced_pieces

#: Nodes that a trie holds before it starts anew.
MOST_NODES = 1_000_000
#: Stretches between spaces that are taken in before those not used since are dropped.
MOST_PIECES = 500_000
#: Pre-tokens over so many bytes are not stored.
LONG = 256
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def piece_costs(path: str) -> dict[str, int]:
    """Piece (its bytes as Latin-1 letters) -> cost, from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}
    norm = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
    return {p: round((math.log(r + 1) + norm) * 1_000_000) for p, r in ranks.items()}


class Trie:
    """Pre-tokens, byte by byte; a node holds the forward score of its prefix, and so the count of a pre-token that ends there.

    The pieces stand in a trie of their own, written backwards, so that from the end of a prefix only letters
    that go on to some piece are looked at. Both tries are one table each: node * 256 + byte -> next node.
    """

    def __init__(self, costs: dict[str, int], most_nodes: int = MOST_NODES):
        self.most_nodes, self.computed = most_nodes, 0
        self.longest = max(map(len, costs))
        self.back: dict[int, int] = {}
        self.piece_cost = array("q", [0])  # 0: no piece ends here
        for piece, cost in costs.items():
            node = 0
            for byte in reversed(piece.encode("latin-1")):
                key = node << 8 | byte
                node = self.back.get(key)
                if node is None:
                    self.back[key] = node = len(self.piece_cost)
                    self.piece_cost.append(0)
            self.piece_cost[node] = cost
        self.start()

    def start(self) -> None:
        self.child: dict[int, int] = {}
        self.cost, self.pieces = array("q", [0]), array("q", [0])

    def count(self, data: bytes) -> int:
        """The number of pieces of a pre-token."""
        if len(data) > LONG:
            return self.slide(data)
        child, node = self.child, 0
        for i, byte in enumerate(data):
            next_node = child.get(node << 8 | byte)
            if next_node is None:
                return self.insert(data, i)
            node = next_node
        return self.pieces[node]

    def insert(self, data: bytes, known: int) -> int:
        """The same where the trie ends after ``known`` bytes: adds a node for each byte from there on."""
        if len(self.cost) + len(data) > self.most_nodes:
            self.start()
            known = 0
        child, cost, pieces, path, node = self.child, self.cost, self.pieces, [0], 0
        for byte in data[:known]:
            node = child[node << 8 | byte]
            path.append(node)
        scores = [(cost[x], pieces[x]) for x in path]
        for end in range(known, len(data)):
            child[node << 8 | data[end]] = node = len(cost)
            scores.append(best := self.score(data, end + 1, scores, 0))
            cost.append(best[0])
            pieces.append(best[1])
        self.computed += len(data) - known
        return pieces[node]

    def score(self, data: bytes, end: int, scores: list[tuple[int, int]], first: int) -> tuple[int, int]:
        """The least (cost, pieces) of ``data[:end]``, by ``scores`` of the prefixes of ``first`` bytes and more."""
        back, piece_cost, node, best = self.back, self.piece_cost, 0, None
        for at in range(end - 1, first - 1, -1):
            node = back.get(node << 8 | data[at])
            if node is None:
                break
            if own := piece_cost[node]:
                cost, n = scores[at - first]
                found = (cost + own, n + 1)
                if best is None or found < best:
                    best = found
        return best

    def slide(self, data: bytes) -> int:
        """The same for a long pre-token, holding as many scores as the longest piece has bytes."""
        scores = [(0, 0)]
        for end in range(1, len(data) + 1):
            scores.append(self.score(data, end, scores, end - len(scores)))
            if len(scores) > self.longest:
                del scores[0]
        return scores[-1][1]


class Pieces(dict):
    """A piece of ``spaced_pieces`` -> its numbers of pre-tokens (high 32 bits) and of tokens (low 32 bits).

    When full, stretches not used since it last was are dropped.
    """

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie, self.find = trie, regex.compile(PATTERN).findall
        self.before: dict[bytes, int] = {}

    def __missing__(self, piece: bytes) -> int:
        n = self.before.get(piece)
        if n is None:
            n = self.count(piece_text(piece))
            if len(piece) > LONG:
                return n
        if len(self) >= MOST_PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = n
        return n

    def whole(self, text: bytes) -> int:
        """The numbers of a whole text."""
        cut = spaced_pieces(text)
        return self.count(text.decode(errors="replace")) if cut is None else sum(map(self.__getitem__, cut)) - self[b"\n"]

    def count(self, text: str) -> int:
        found = self.find(text)
        return len(found) << 32 | sum(self.trie.count(x.encode()) for x in found)


@lru_cache(maxsize=2)
def tables(path: str, most_nodes: int) -> Pieces:
    """The worker's tables, with what earlier tasks have filled in."""
    return Pieces(Trie(piece_costs(path), most_nodes))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens (longs) of each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tables(vocabulary, most_nodes)
        for b in batches:
            out = []
            for t in b.column("t").to_pylist():
                both = pieces.whole(t or b"")
                out.append((len(t or b""), both >> 32, both & 0xFFFFFFFF))
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_pretokens long, n_tokens long")
