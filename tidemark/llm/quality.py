"""Quality rules as a short-circuit cascade, in Spark SQL expressions only.

A rule is a condition on which a document is rejected, over the counts that every document gets and
over the text itself (``_t``). ``plan_cascade`` takes, on a bounded sample, how many documents each rule
rejects and what work it is where the counts are there (the time that a character takes, measured once and
given with the rule, for the characters that the sample's texts have), and orders the rules by rejections for that work. So one short job
plans, its order does not hang on a clock, and of each sampled document only two numbers a rule reach the driver;
``cascade`` turns the order into one nested CASE, so that for each document evaluation stops at the
first rule that rejects, and rules that read the text do so for the documents left. As the verdict is
that of any rule rejecting, the order (and so the sample) changes only the time, never a verdict.

Repeated words: the text's 3-word windows are hashed, the hashes are sorted with their positions, and
windows with an equal neighbour are those found twice or more; the words that these cover are counted
over their positions in order. All this is within one row: no shuffle, n log n in its words.

Cases: null counts as empty text; a text without words has all counts 0 and fails the base rules;
empty lines are not counted; repeated rows give repeated results; an empty table gives an empty
result and any order of rules; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP

#: Fixed values.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Documents that the costs and rejections of the rules are estimated on, whole texts: the first that Spark meets, so that it reads few partitions.
SAMPLE_ROWS = 256


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP, -1), "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _t (the text), n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines, n_repeat_words (longs)."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.select("doc_id", "_t", word_chars(F.col("_t")).alias("word_chars"), n_symbols(F.col("_t")).alias("n_symbols"), lines_of(F.col("_t")).alias("_l"), words_of(F.col("_t")).alias("_w"))
    at = F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.expr("cast(array() as array<int>)"))
    windows = F.transform(at, lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))
    n_lines, n_dup = F.size("_l").cast("long"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")
    t = t.select("doc_id", "_t", "word_chars", "n_symbols", n_lines.alias("n_lines"), n_dup.alias("n_dup_lines"), F.size("_w").cast("long").alias("n_words"), F.sort_array(windows).alias("_s"))
    # the sort key leads with the hash, so windows alike stand side by side
    twice = F.filter("_s", lambda x, k: (F.get(F.col("_s"), k - 1)["h"] == x["h"]) | (F.get(F.col("_s"), k + 1)["h"] == x["h"]))
    t = t.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")))["n"]
    repeated = F.when(F.size("_p") > 0, covered).otherwise(0).cast("long")
    return t.select("doc_id", "_t", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL condition on which a document is rejected, over the columns of ``counts``.
    rejects: str
    #: SQL number: about how many tens of nanoseconds that takes for a document (measured on 25 million characters, one core).
    work: str = "2"


#: Kept lenient, as each is to reject junk only. Those after the first five read the text.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines"),
    Rule("letters", r"5 * length(regexp_replace(_t, '[^\\p{L}\\p{M}]+', '')) < 2 * word_chars", "4 * length(_t)"),
    Rule("distinct_words", r"25 * size(array_distinct(split(lower(_t), '[\\x20\\x09-\\x0D]+'))) < n_words", "6 * length(_t)"),
    Rule("broken_lines", r"2 * size(filter(split(_t, '\n'), x -> x rlike '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) > n_lines", "3 * length(_t)"),
)
#: The rules that the counts' contract names.
BASE = ("few_words", "repeats")


def plan_cascade(counted: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules by rejections for their work on at most ``rows`` rows of ``counts``; ties to less work, then as listed."""
    rejected = F.array(*[F.expr(f"cast(coalesce({r.rejects}, true) as int)") for r in rules])
    work = F.array(*[F.expr(f"cast({r.work} as double)") for r in rules])
    seen = counted.select(rejected.alias("rejected"), work.alias("work")).limit(rows).collect()
    n, found = max(1, len(seen)), []
    for i, rule in enumerate(rules):
        share, cost = sum(x["rejected"][i] for x in seen) / n, max(1.0, sum(x["work"][i] for x in seen) / n)
        found.append({"rule": rule, "selectivity": share, "cost": cost, "gain": share / cost})
    return sorted(found, key=lambda x: (-x["gain"], x["cost"]))


def cascade(order: list[Rule]) -> Column:
    """The name of the first rule that rejects, without looking at those after it; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(F.expr(f"coalesce({rule.rejects}, true)"), F.lit(rule.name)).otherwise(out)
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, order: list[Rule] | None = None) -> DataFrame:
    """The columns of ``counts`` but the text, with base_failed, kept and rejected_by; ``order`` instead of one from a sample.

    rejected_by is the first rule in the cascade's order, so where several reject it depends on the sample.
    """
    base = F.lit(False)
    for rule in rules:
        if rule.name in BASE:
            base = base | F.expr(f"coalesce({rule.rejects}, true)")
    counted = counts(docs, id_col, text_col)
    if order is None:
        order = [x["rule"] for x in plan_cascade(counted, rules, sample_rows)]
    df = counted.select("*", base.alias("base_failed"), cascade(order).alias("rejected_by"))
    return df.select("*", F.isnull("rejected_by").alias("kept")).drop("_t")
