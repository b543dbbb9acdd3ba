"""The table of pieces of ops 5 and 10 and the pipeline's packing: its memory is bounded by bytes, whatever the pieces are."""

import sys

import pytest

from tidemark.llm import catalog, encoders


class Long(encoders.SpacedPieces):
    def make(self, piece: str) -> bytes:
        return b"\1\0\0\0" * len(piece)


def size(table: dict) -> int:
    return sys.getsizeof(table) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in table.items())


@pytest.mark.parametrize("letters", [8, 150])
def test_the_tables_memory_is_bounded_by_bytes(letters):
    table = Long(catalog.BYTE_BPE)
    for i in range(900_000 if letters == 8 else 200_000):
        piece = f"{i:0{letters}d}".encode()
        assert len(table[piece]) == 4 * (letters + 1)  # with the space before it
    assert size(table) + size(table.before) < 125 << 20


def test_ids_are_those_of_the_tokenizer_when_the_table_has_been_dropped(monkeypatch):
    monkeypatch.setattr(encoders, "MOST_BYTES", 2000)
    table = encoders.SpacedPieces(catalog.BYTE_BPE)
    for i in range(200):
        text = f"word{i} and again, Word{i % 7}: x{i * i}\nline {i}"
        assert table.encode(text.encode()) == table.whole(text)
