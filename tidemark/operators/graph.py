"""Components and cycles of graphs of any shape, held in tables."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import remove, written_at

#: Components of up to so many edges are looked at by one task each.
MOST_EDGES = 100_000
#: Nodes bridged in a round, under which parts are looked for by colours.
FEW = 8


def component_roots(edges: DataFrame, write=written_at, remove=remove) -> DataFrame:
    """(node, root): the smallest node reachable from each node that ``edges`` (a, b: longs) name, itself excepted; directions do not count.

    Large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond"): each round
    links every neighbour of a node to the least of them. A node's neighbours are only aggregated to
    a minimum and joined, never gathered, so a hub's rows can be split over tasks. Rounds end when the
    edges no longer change, which they must come to; only their count and a checksum reach the driver. A
    round's table is deleted when the next one is written.
    """
    stars, path = write(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "stars")
    seen = None
    while True:
        both = stars.union(stars.select("u", "v")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select("v", F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.select(F.col("v").alias("n"), F.col("u").alias("w"))
        floor = low.groupBy("n").agg(F.min("w").alias("m"))
        small = low.join(floor, "n").select(F.col("w").alias("v"), F.col("m").alias("u")).union(floor.select("n", "m")).filter("v <> u").distinct()
        old = path
        stars, path = write(small, "stars")
        remove(edges.sparkSession, old)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.toDF("node", "root")
        seen = now


def strong_parts(edges: list[tuple]) -> list[list]:
    """The strongly connected parts of a directed graph, in time linear in its edges (two passes of depth-first search)."""
    ahead, back = defaultdict(list), defaultdict(list)
    for a, b in edges:
        ahead[a].append(b)
        back[b].append(a)
    done, finished = set(), []
    for start in list(ahead):
        stack = [] if start in done else [(start, iter(ahead[start]))]
        done.add(start)
        while stack:
            node, rest = stack[-1]
            child = next((c for c in rest if c not in done), None)
            if child is None:
                finished.append(stack.pop()[0])
            else:
                done.add(child)
                stack.append((child, iter(ahead.get(child, ()))))
    taken, out = set(), []
    for start in reversed(finished):
        group, queue = [], [] if start in taken else [start]
        taken.add(start)
        while queue:
            group.append(queue.pop())
            for before in back.get(group[-1], ()):
                if before not in taken:
                    taken.add(before)
                    queue.append(before)
        if group:
            out.append(group)
    return out


def on_cycles(edges: list[tuple[str, str]]) -> list[str]:
    """Nodes on a directed cycle of one graph."""
    loops = {a for a, b in edges if a == b}
    return [x for group in strong_parts(edges) for x in group if len(group) > 1 or x in loops]


def cyclic(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(scope, id) of nodes on a directed cycle of ``edges`` (scope, src, dst).

    A cycle lies within one component, so each component is looked at on its own, by one task in linear
    time if it has at most ``most_edges``. Larger ones are cut down in tables (``large_strong_parts``). Up to
    ``most_edges`` in all, a scope is looked at as it is.
    """
    key = lambda c: F.xxhash64("scope", F.isnull("scope"), c)
    edges, _ = written_at(edges.select("scope", "src", "dst").distinct(), "edges")

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        scope = pdf["scope"].iloc[0]
        return pd.DataFrame([(scope, x) for x in on_cycles(list(zip(pdf["src"], pdf["dst"], strict=True)))], columns=["scope", "id"])

    if edges.count() <= most_edges:
        return edges.groupBy("scope").applyInPandas(look, "scope string, id string")
    roots = component_roots(edges.select(key("src").alias("a"), key("dst").alias("b")))
    placed = edges.withColumn("_a", key("src")).join(roots, F.col("_a") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_a")).select("scope", "src", "dst", "_root")
    sizes = placed.groupBy("_root").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > most_edges).select("_root")
    of_small = placed.join(large, "_root", "left_anti")
    found = of_small.groupBy("_root", "scope").applyInPandas(look, "scope string, id string")
    if large.isEmpty():
        return found
    rest = placed.join(large, "_root", "left_semi")
    names = rest.select(key("src").alias("k"), "scope", F.col("src").alias("id")).union(rest.select(key("dst"), "scope", "dst")).distinct()
    numbered = rest.select(key("src").alias("u"), key("dst").alias("v"))
    nodes = large_strong_parts(numbered, most_edges).select("node").union(numbered.filter("u = v").select("u")).distinct()
    return found.union(names.join(nodes, F.col("k") == F.col("node")).select("scope", "id"))


def large_strong_parts(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(node, part): the strongly connected parts of two nodes or more of ``edges`` (u, v: longs), in tables that never outgrow the edges.

    Nodes without an edge in or out are taken off, and nodes with one of each are bridged: of neighbours of that kind a
    coin picks some, so that a chain or ring shrinks by a quarter a round. Where fewer than FEW are left to bridge, every node takes the largest
    colour that reaches it, and what reaches the node that a colour is named after, within it, is a part
    (Orzan's colouring); edges between colours lie on no cycle. What at most ``most_edges`` are left of is
    settled by one task. At last bridged nodes are put back in reverse: one is in a part if both of its neighbours are in the same.
    """
    core, _ = written_at(edges.filter("u <> v").distinct(), "core")
    bridged, parts, turn = [], [], 0
    while core.count() > most_edges:
        core, log = _shrunk(core, turn)
        bridged.append(log)
        turn += 1
        # colours travel an edge a round, so chains and rings are bridged first
        if log.count() < FEW:
            core, found = _coloured(core)
            parts.append(found)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g for g in strong_parts(list(zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True))) if len(g) > 1]
        return pd.DataFrame([(x, min(g)) for g in groups for x in g], columns=["node", "part"])

    parts.append(core.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(settle, "node long, part long"))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    out, _ = written_at(out, "parts")
    for log in reversed(bridged):
        of = lambda c, known=out: known.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
        placed = log.join(of("before"), "before", "left").join(of("after"), "after", "left")
        part = F.coalesce("part_before", "before")
        within = placed.filter(part == F.coalesce("part_after", "after")).select("node", "before", part.alias("part"))
        # both neighbours may be one node that was in no part yet
        alone = within.filter("part = before").select(F.col("before").alias("node"), "part")
        out, _ = written_at(out.union(within.select("node", "part")).union(alone).distinct(), "parts")
    return out


def _shrunk(core: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """``core`` without nodes that have no edge in or none out, and with some of those with one of each bridged; these with their neighbours (node, before, after)."""
    into, out_of = core.select(F.col("v").alias("x")).distinct(), core.select(F.col("u").alias("x")).distinct()
    trimmed, _ = written_at(core.join(into, F.col("u") == F.col("x"), "left_semi").join(out_of, F.col("v") == F.col("x"), "left_semi"), "core")
    ins = trimmed.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"), F.min("u").alias("before"))
    outs = trimmed.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"), F.min("v").alias("after"))
    heads = ins.join(outs, "node").filter("n_in = 1 and n_out = 1").filter(F.xxhash64("node", F.lit(turn)) % 2 == 0).select("node", "before", "after")
    log, _ = written_at(heads.join(heads.select(F.col("node").alias("before")), "before", "left_anti").select("node", "before", "after"), "bridged")
    picked = log.select(F.col("node").alias("x"))
    rest = trimmed.join(picked, F.col("u") == F.col("x"), "left_anti").join(picked, F.col("v") == F.col("x"), "left_anti")
    return written_at(rest.union(log.filter("before <> after").select("before", "after")).distinct(), "core")[0], log


def _coloured(core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges within colours between nodes of no part yet, and the parts (node, part) that the colours are named after."""
    colours, _ = written_at(core.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
    changed = True
    while changed:
        reached = core.join(colours, F.col("u") == F.col("node")).groupBy(F.col("v").alias("at")).agg(F.max("colour").alias("new"))
        new, _ = written_at(colours.join(reached, F.col("node") == F.col("at"), "left").select("node", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("moved")), "colours")
        changed = not new.filter("moved").isEmpty()
        colours = new.select("node", "colour")
    of = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"colour_{c}"))
    within, _ = written_at(core.join(of("u"), "u").join(of("v"), "v").filter("colour_u = colour_v").select("u", "v", F.col("colour_u").alias("colour")), "within")
    found, _ = written_at(colours.filter("node = colour").select("node", F.col("colour").alias("part")), "found")
    fresh = found
    while not fresh.isEmpty():
        before = within.join(fresh.select(F.col("node").alias("v")), "v", "left_semi").select(F.col("u").alias("node"), F.col("colour").alias("part")).distinct()
        fresh, _ = written_at(before.join(found, "node", "left_anti"), "fresh")
        found = found.union(fresh)
    found, _ = written_at(found, "found")
    large = found.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
    taken = found.select(F.col("node").alias("x"))
    rest = within.join(taken, F.col("u") == F.col("x"), "left_anti").join(taken, F.col("v") == F.col("x"), "left_anti").select("u", "v")
    return written_at(rest, "core")[0], found.join(large, "part", "left_semi").select("node", "part")
