"""Language ID rejects mixed, unlearned and meaningless texts and keeps clean ones."""

import random

import pyarrow.parquet as pq

from tidemark.llm import language

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_rejects_what_is_not_clear(ready):
    df = ready.read.parquet(DOCUMENTS)
    known = language.learn(df.filter(~language.held_out(language.F.col("doc_id"))))
    held = {r[0] for r in df.filter(language.held_out(language.F.col("doc_id"))).select("doc_id").collect()}
    texts = {}
    for r in pq.read_table(DOCUMENTS).to_pylist():
        if r["doc_id"] in held and len(set((r["text"] or "").split())) > 100:
            texts.setdefault(r["lang"], []).append(r["text"])
    assert set(texts) == set(known)
    accepted = lambda of, ts: sum(of(t)[2] for t in ts) / len(ts)
    of, rng = language.Classifier(known), random.Random(6)
    assert all(of(t)[2] and of(t)[0] == lang for lang, ts in texts.items() for t in ts)
    mixed = []
    for _ in range(100):
        a, b = (rng.choice(texts[lang]).split() for lang in rng.sample(sorted(texts), 2))
        words = [w for pair in zip(a, b, strict=False) for w in pair][:400]
        mixed.append(" ".join(words))
    assert accepted(of, mixed) <= 0.3
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200)) for _ in range(100)]
    assert accepted(of, junk) == 0
    for lang in texts:
        without = language.Classifier({k: v for k, v in known.items() if k != lang})
        assert accepted(without, texts[lang]) <= 0.05, lang


def test_margin_by_cross_validation_over_training_rows(ready):
    """Two folds of the rows that are not held out: nearly all right predictions stay, nearly all texts of a language left out go."""
    df = ready.read.parquet(DOCUMENTS)
    train = df.filter(~language.held_out(language.F.col("doc_id")) & language.F.col("lang").isNotNull())
    fold = language.F.pmod(language.F.xxhash64("doc_id"), language.F.lit(2))
    right, outside = [], []
    for i in range(2):
        known = language.learn(train.filter(fold == i))
        of = language.Classifier(known)
        without = {lang: language.Classifier({k: v for k, v in known.items() if k != lang}) for lang in known}
        for r in train.filter(fold != i).collect():
            name, _, accepted = of(r["text"])
            right += [accepted] if name == r["lang"] else []
            outside.append(without[r["lang"]](r["text"])[2])
    assert len(right) > 650 and sum(right) / len(right) >= 0.99
    assert sum(outside) / len(outside) <= 0.05
