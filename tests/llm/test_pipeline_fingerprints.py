"""The pipeline's near-duplicate stage follows op 3's links too."""

import random

import corpus_pipeline
from llm_rows import SF

from tidemark.llm import near_copies, simhash


def test_links_of_fingerprints_count(ready):
    rng = random.Random(6)
    # pairs of sixty words that differ in two, under 0.8 alike; those with few differing bits are op 3's links
    texts = []
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        other = list(words)
        other[20] = other[40] = "changed"
        texts += [" ".join(words), " ".join(other)]
    docs = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [simhash.fingerprint(t.encode()) for t in texts]
    linked = {i + 1 for i in range(0, len(texts), 2) if (bits[i] ^ bits[i + 1]).bit_count() <= 4}
    only = linked & {r[0] for r in near_copies.first_of_each(docs).select("doc_id").collect()}
    kept = {r[0] for r in corpus_pipeline.near_dedup(ready, docs, SF).select("doc_id").collect()}
    assert only and not linked & kept and kept >= set(range(0, len(texts), 2))
