"""Recall of the secret scan on random keys of each alphabet, and what it must leave alone."""

import random
import string

import pytest

from tidemark.llm import secrets

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALPHABETS = {
    "hex": DIGITS + "abcdef", "upper hex": DIGITS + "ABCDEF", "hex of both cases": DIGITS + "abcdefABCDEF", "base32": UPPER + "234567", "lower base36": LOWER + DIGITS, "upper base36": UPPER + DIGITS,
    "alphanumeric": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
CLEAN = ["Rindfleischetikettierungsueberwachungsaufgaben", "see src/main/java/tidemark/operators/lexical2024", "internationalisation_of_documents_2024", "=" * 60 + "a1B", "SECTION" * 8]


@pytest.fixture(scope="module")
def cases(ready):
    rng = random.Random(9)
    rows = [(f"{name}:{n}", f"the key is {''.join(rng.choice(chars) for _ in range(n))} of it") for name, chars in ALPHABETS.items() for n in (24, 32, 40) for _ in range(200)]
    rows += [("clean", t) for t in CLEAN]
    return secrets.redacted(ready.createDataFrame(rows, "doc_id string, text string")).collect()


@pytest.mark.parametrize("name", ALPHABETS)
def test_recall_of_random_keys(cases, name):
    for n in (24, 32, 40):
        texts = [r["text"] for r in cases if r["doc_id"] == f"{name}:{n}"]
        # a run without a digit is taken for a word: 0.8 to 1.9 % of the keys of 24 characters with 10 of 62 or 64 symbols digits, 0.7 % with 6 of 32
        assert sum(t == "the key is [secret] of it" for t in texts) / len(texts) >= (0.95 if n == 24 else 0.98), (name, n)


def test_clean_texts_stay(cases):
    assert [r["text"] for r in cases if r["doc_id"] == "clean"] == CLEAN
