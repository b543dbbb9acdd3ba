"""The pipeline's stages on the smallest table, each judged on its own input."""

import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
from llm_rows import SF

from tidemark.llm import mixing, secrets


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(table, ready):
    docs, rows = table
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(ready, docs, SF)
        path = f"{ready.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        seen[name] = (docs, ready.read.parquet(path))
        docs = seen[name][1]
        if name != "pack":
            assert docs.columns == columns
    before, after = seen["language_id"]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 4 and all(len(r["text"]) < 60 for r in gone)
    before, after = seen["near_dedup"]
    # one document of each group of five-word shingle sets that are alike by 0.8 or more, by comparing all with all
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}
    top = lambda x: x if up[x] == x else top(up[x])
    for a, b in combinations(sorted(texts), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted({top(i) for i in texts})
    before, after = seen["secret_scan"]
    assert before.count() == after.count()
    assert secrets.scan(after).filter("size(spans) > 0").count() == 0
    old, new = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, after))
    clean = {r["doc_id"] for r in secrets.scan(before).filter("size(spans) = 0").collect()}
    assert all(old[i] == new[i] for i in clean)
    before, after = seen["mix"]
    taken = mixing.mix(before).agg({"taken": "sum"}).first()[0]
    assert sum(len(re.findall(r"[^\x20\x09-\x0d]+", r["text"])) for r in after.collect()) == taken
    before, after = seen["pack"]
    assert Counter(r["doc_id"] for r in after.filter("start = 0").collect()) == Counter(r["doc_id"] for r in before.collect())


def test_run(ready):
    assert corpus_pipeline.run(ready, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
