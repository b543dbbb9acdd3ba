"""Random texts: pieces encode as whole texts do; forward scores equal the plain recurrence; payloads come back."""

import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import encoders, media, simhash, substrings, token_counts
from tidemark.llm.catalog import BYTE_BPE, RANKS, WORD_BPE

WORDS = st.sampled_from(["the", "The", "größe", "ÉTÉ", "niño", "it's", "we'll", "x1", "42", "...", "a.b", "AND!!", "ſ", "İstanbul", "ΟΔΟΣ", "é", "日本", "😀", "<|endoftext|>", " ", "\x1c", "\x85", "'", "n't", "word,", "ß.", "ɐ"])
GAPS = st.sampled_from([" ", " ", " ", "\n", "  ", "\t", "\n\n", " \n", "\r\n", ""])
TEXTS = st.one_of(st.text(max_size=60), st.lists(st.tuples(WORDS, GAPS), max_size=30).map(lambda x: "".join(a + b for a, b in x)))


@pytest.mark.parametrize(("kind", "path"), [("lower_words", WORD_BPE), ("spaced_words", BYTE_BPE)])
def test_pieces_encode_as_whole_texts(kind, path):
    own, whole = encoders.encoder(kind, path), encoders.load(path)

    @settings(max_examples=600, deadline=None)
    @given(TEXTS)
    def check(text):
        assert np.frombuffer(own.encode(text.encode()), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

    check()


def test_piece_counts_equal_whole_texts():
    pieces = token_counts.Pieces(token_counts.Trie(token_counts.piece_costs(RANKS)))

    @settings(max_examples=400, deadline=None)
    @given(TEXTS)
    def check(text):
        assert pieces.whole(text.encode()) >> 32 == len(regex.findall(token_counts.PATTERN, text))
        assert pieces.whole(text.encode()) == pieces.count(text)

    check()


def test_long_pre_tokens_slide():
    trie, stored = (token_counts.Trie(token_counts.piece_costs(RANKS)) for _ in range(2))
    rng = random.Random(3)
    for n in (300, 700):
        data = "".join(rng.choice("abcdefgh") for _ in range(n)).encode()
        assert trie.count(data) == stored.insert(data, 0) and not trie.computed


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=2000))
def test_payloads_come_back(data):
    padded = media.payload(data)
    assert len(padded) % 576 == 0 and padded and padded.startswith(data) and set(padded[len(data) :]) <= {255}
    assert media.from_png(media.to_png(padded)) == padded and len(media.feature(padded)) == 16


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("abcd")), max_size=60))
def test_anchors_of_equal_windows_are_equal(letters):
    words = [x.encode() for x in letters]
    if len(words) >= 12:
        least, grams = substrings.anchors(words, 12, 4)
        assert len(least) == len(words) - 11 and len(grams) == len(words) - 3
        seen = {}
        for i, a in enumerate(least.tolist()):
            assert a == min(grams[i : i + 9].tolist())
            assert seen.setdefault(tuple(words[i : i + 12]), a) == a


def test_variants_meet_exactly_when_a_segment_is_within_one_bit(ready):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    pairs = []
    for _ in range(60):
        a, b = rng.getrandbits(64), 0
        for bit in rng.sample(range(64), rng.randint(0, 8)):
            b |= 1 << bit
        pairs.append((a, a ^ b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = ready.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    got = df.select(F.arrays_overlap(simhash.variants(F.col("a")), simhash.variants(F.col("b")))).collect()
    for (a, b), (met,) in zip(pairs, got, strict=True):
        assert met == any((((a ^ b) >> low) & ((1 << n) - 1)).bit_count() <= 1 for low, n in simhash.SEGMENTS)
        if (a ^ b).bit_count() <= 4:
            assert met
