"""What a session starts with: active nodes under supersession, ranked context, rules under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import classify as C
from tidemark.functions import text as X
from tidemark.operators.graph import cyclic

#: Fixed values.
SIGNAL_TAGS = ("constraint", "risk", "decision", "rule", "next-step")
INJECT_TYPES = ("rule", "decision", "constraint")
CORE_TAGS = ("core", "policy", "security", "ops", "style")
POLICY_HEADER = (
    "# Policy Core (compiled)",
    "",
    "This file is auto-generated from `memory/nodes.jsonl`.",
    "- Goal: a tiny, always-on behavior constitution",
    "- Budget: max %d chars",
    "",
)


def supersessions(nodes: DataFrame) -> DataFrame:
    """(scope, src, dst): the last row of each (scope, id) retires nodes of its scope that exist."""
    last = nodes.filter(F.col("id").isNotNull()).groupBy("scope", "id").agg(F.max_by(F.struct("supersedes"), "ord").alias("m"))
    edges = last.select("scope", F.col("id").alias("src"), F.explode("m.supersedes").alias("dst")).distinct()
    there = last.select(F.col("scope").alias("_s"), F.col("id").alias("_d"))
    return edges.join(there, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("dst") == F.col("_d")), "left_semi")


def active(nodes: DataFrame) -> DataFrame:
    """Nodes that no other of their scope supersedes; members of cycles stay, for people to resolve."""
    edges = supersessions(nodes)
    loops = cyclic(edges)
    targets = edges.select("scope", F.col("dst").alias("id")).distinct()
    gone = targets.join(loops.toDF("_s", "_i"), F.col("scope").eqNullSafe(F.col("_s")) & (F.col("id") == F.col("_i")), "left_anti").toDF("_gs", "_gi")
    return nodes.join(gone, nodes["scope"].eqNullSafe(F.col("_gs")) & (nodes["id"] == F.col("_gi")), "left_anti")


def context_score(today: Column) -> Column:
    signals = F.size(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, SIGNAL_TAGS))))
    kind = F.when(F.col("type") == "rule", 10.0).when(F.col("type") == "decision", 8.0).when(F.col("type") == "constraint", 9.0).when((F.col("type") == "note") & (signals > 0), 5.0).otherwise(1.0)
    return kind + signals * 2 + C.recency(F.col("ts"), today)


def injectable() -> Column:
    return F.col("type").isin(*INJECT_TYPES) | ((F.col("type") == "note") & F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, SIGNAL_TAGS))))


def session_context(nodes: DataFrame, scope: str | None, today: Column, k: int = 5) -> DataFrame:
    """The ``k`` most important active nodes of a scope and of all scopes."""
    rows = nodes if scope is None else nodes.filter(F.col("scope").isin(scope, "global"))
    return active(rows).filter(injectable()).withColumn("score", context_score(today)).orderBy(F.desc("score"), "ord").limit(k)


def context_markdown(context: DataFrame) -> DataFrame:
    """A line for each node of a context."""
    return context.select("ord", F.concat(F.lit("- ["), "type", F.lit("] "), "id", F.lit(": "), X.clip("text", 200)).alias("line"))


def priority(column: Column) -> Column:
    return F.coalesce(column.cast("string").try_cast("int"), F.lit(0))


def bullet() -> Column:
    return F.trim(F.concat(F.lit("- ("), "id", F.lit(") "), F.coalesce("text", F.lit(""))))


def within_budget(rules: DataFrame, chars: int, header: int = 0, most: int | None = None) -> DataFrame:
    """The longest prefix, by priority and id, whose bullets fit the budget: rank, id, priority, bullet, used.

    Bullets have a length, so running totals only grow and a prefix is all rows whose total fits. The
    first rows by rank are enough: each bullet takes at least 6 characters, so no more can fit.
    """
    bound = chars // 6 + 1 if most is None else most
    order = [F.desc("_p"), F.asc("id"), F.asc("ord")]
    ranked = rules.withColumn("_p", priority(F.col("priority"))).withColumn("bullet", bullet()).orderBy(*order).limit(bound)
    one = Window.partitionBy(F.lit(0)).orderBy(*order)
    ranked = ranked.withColumn("rank", F.row_number().over(one).cast("long")).withColumn("used", (F.sum(F.length("bullet") + 1).over(one) + header).cast("long"))
    return ranked.filter(F.col("used") <= chars).select("rank", "id", F.col("_p").cast("long").alias("priority"), "bullet", "used")


def is_core_rule() -> Column:
    tags = X.tag_list(F.col("tags"))
    return (F.col("type") == "rule") & (F.col("scope").isNull() | (F.col("scope") == "global")) & (F.arrays_overlap(tags, F.array(*map(F.lit, CORE_TAGS))) | (priority(F.col("priority")) >= 50))


def policy_header(chars: int) -> list[str]:
    return [line % chars if "%d" in line else line for line in POLICY_HEADER]


def core_policy(nodes: DataFrame, chars: int = 900) -> DataFrame:
    """Core rules that fit the compiled policy, whose header is charged first."""
    return within_budget(nodes.filter(is_core_rule()), chars, sum(len(x) + 1 for x in policy_header(chars)))


def policy_document(nodes: DataFrame, chars: int = 900) -> DataFrame:
    """The compiled policy as one text."""
    lines = core_policy(nodes, chars).agg(F.array_sort(F.collect_list(F.struct("rank", "bullet"))).alias("b"))  # bounded by the budget
    return lines.select(F.concat_ws("\n", F.array(*map(F.lit, policy_header(chars))), F.transform("b", lambda x: x["bullet"])).alias("text"))


def triggered_rules(nodes: DataFrame, text: str, core: DataFrame | None = None, most: int = 3, chars: int = 1200) -> DataFrame:
    """Rules that a text's buckets ask for and the core (id) does not hold, under both limits."""
    wanted = C.bucket_tags(C.rule_buckets(F.lit(text)))
    rules = nodes.filter((F.col("type") == "rule") & (F.coalesce("id", F.lit("")) != "") & (X.strip("text") != ""))
    rules = rules.filter((F.size(wanted) == 0) | F.arrays_overlap(X.tag_list(F.col("tags")), wanted))
    rules = rules if core is None else rules.join(core.select("id"), "id", "left_anti")
    return within_budget(rules, chars, 0, most)


def tag_violations(nodes: DataFrame, base: list[str], allowed: list[str]) -> DataFrame:
    """id, unknown (tags outside the registry), has_base, valid."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    known = F.array(*map(F.lit, sorted({*base, *allowed})))
    unknown = F.array_sort(F.array_except(tags, known))
    has_base = F.arrays_overlap(tags, F.array(*map(F.lit, base)))
    return nodes.select("id", unknown.alias("unknown"), has_base.alias("has_base"), ((F.size(tags) > 0) & (F.size(unknown) == 0) & has_base).alias("valid"))
