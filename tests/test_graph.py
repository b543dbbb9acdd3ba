"""Cycles and components against brute force."""

import random

from tidemark.operators import context, graph


def slow_cyclic(edges):
    reach = set(edges)
    while True:
        more = {(s, a, d) for s, a, b in reach for t, c, d in edges if s == t and b == c} - reach
        if not more:
            return {(s, a) for s, a, b in reach if a == b}
        reach |= more


def test_cycles(spark):
    rng = random.Random(4)
    edges = {(s, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for s in ("a", "b", None, "c") for _ in range(9)}
    edges |= {("d", f"p{i}", f"p{i + 1}") for i in range(40)} | {("d", "q0", "q1"), ("d", "q1", "q0"), ("d", "q1", "q2"), ("d", "q2", "q3"), ("d", "q3", "q2"), ("d", "loop", "loop")}
    df = spark.createDataFrame(sorted(edges, key=repr), "scope string, src string, dst string")
    for most in (graph.MOST_EDGES, 60, 3):
        assert {(r["scope"], r["id"]) for r in graph.cyclic(df, most).collect()} == slow_cyclic(edges)
    assert graph.cyclic(df.limit(0)).count() == 0


def test_a_long_chain_is_no_cycle(spark):
    rows = [(i, f"n{i}", "a", [f"n{i - 1}"]) for i in range(3000)] + [(3001, "x", "a", ["y"]), (3002, "y", "a", ["x"])]
    nodes = spark.createDataFrame(rows, "ord long, id string, scope string, supersedes array<string>")
    assert sorted(r["id"] for r in context.active(nodes).collect()) == ["n2999", "x", "y"]
    assert sorted(graph.on_cycles([(f"n{i}", f"n{(i + 1) % 50_000}") for i in range(50_000)])) == sorted(f"n{i}" for i in range(50_000))


def parts_of(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["part"], set()).add(r["node"])
    return sorted(map(sorted, groups.values()))


def test_large_strong_parts(spark):
    """Rings, chains, dense parts, two-cycles and random graphs, with next to nothing left to a single task."""
    rng = random.Random(9)
    ring = [(i, (i + 1) % 40) for i in range(40)]
    chain = [(1000 + i, 1001 + i) for i in range(20)] + [(5, 1000)]
    dense = [(2000 + a, 2000 + b) for a in range(8) for b in range(8) if a != b]
    tail = [(2003, 3000), (3000, 3001), (3001, 3000), (3001, 3002), (3002, 3003), (3003, 3002), (4000, 4000)]
    wild = [(5000 + rng.randrange(20), 5000 + rng.randrange(20)) for _ in range(25)]
    edges = ring + chain + dense + tail + wild
    expected = sorted(sorted(g) for g in graph.strong_parts(edges) if len(g) > 1)
    assert len(expected) >= 4
    df = spark.createDataFrame(edges, "u long, v long")
    assert parts_of(graph.large_strong_parts(df, most_edges=30)) == expected
    named = spark.createDataFrame([("s", f"n{a}", f"n{b}") for a, b in edges], "scope string, src string, dst string")
    found = {r["id"] for r in graph.cyclic(named, most_edges=70).collect()}
    assert found == {f"n{x}" for g in expected for x in g} | {f"n{a}" for a, b in edges if a == b}
