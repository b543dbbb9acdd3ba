"""Postings of ids that stand once are not shuffled; those of repeated ids stay distinct."""

import pytest
from test_retrieval import ledger

import __spark_entry__
from tidemark.operators import lexical


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_no_shuffle_of_single_ids(spark):
    e = __spark_entry__.queries()
    assert shuffles(e["keyword_postings"](spark, "/root/testdata/sf0.001")) == 0
    assert shuffles(e["keyword_document_frequency"](spark, "/root/testdata/sf0.001")) == 1


@pytest.mark.parametrize("most", [1, 10_000])
def test_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "MOST_REPEATED", most)
    rows = [("a", "one two three"), ("b", "two four"), ("a", "three five three"), ("c", "two"), ("b", None), (None, "lost")]
    nodes = ledger(spark, [{"id": i, "type": "note", "scope": "s", "text": t, "ord": n} for n, (i, t) in enumerate(rows)])
    found = sorted(map(tuple, lexical.postings(nodes).collect()))
    whole = {i: " ".join(["note", *(t or "" for j, t in rows if j == i)]).split() for i in "abc"}
    assert found == sorted({(t, i) for i, ts in whole.items() for t in ts})
