"""Mixing sources to target weights along a time-varying curriculum.

Targets: every source gets a weight; the mix is ``share`` times all words; a target is at most
``cap`` times its source's words and what exceeds that is dealt to the others by weight
(water-filling, solved in closed form over the sources ordered by cap per weight).

Curriculum: source ``s`` with slope ``g`` has the weight schedule ``w(t) = W * (1 + g * (2t - 1))``
over training time ``t`` in [0, 1]. Its integral, ``W * (t + g * (t*t - t))``, is the cumulative
demand for its words, so the word at cumulative count ``c`` of target ``W`` is trained on at the
``t`` that solves ``t + g * (t*t - t) = c / W``. Documents get the position of their first word and
are range-sorted by it. Slopes average to nothing over the run, so the targets hold exactly.

Sums run over ranges of a hash of the id, so a source with a third of all rows is spread over many
tasks, and nothing but one row a source meets in a single task.

Cases: a null text or one without words has size 0, takes nothing and has a null position; a null
source is a source of its own, after all others; repeated rows are rows of their own; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, WORD, n_words, numbered, range_bits, row_keys, running_sum, written

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Slopes of the schedules of the sources by code point, repeating: rising, falling and level.
SLOPES = (0.5, -0.5, 0.0)
#: The mix has this share of all words, as a fraction.
SHARE = (3, 2)
#: No target exceeds so many times its source's words.
CAP = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, slopes=SLOPES) -> DataFrame:
    """(source, source_size, target, slope) of ``sizes`` (source, size); one row a source.

    All sums are of whole numbers and each target is one division, so that reruns and other engines
    give the same doubles.
    """
    num, den = share
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("_rank") % len(values) + 1).cast("int"))
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_w", pick(weights, "long")).withColumn("slope", pick(slopes, "double"))
    # sources in the order in which they reach their cap as the level of the water rises
    fill = one.orderBy(F.col("source_size") / F.col("_w"), "_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_all", F.sum("source_size").over(one))
        .withColumn("_weights", F.sum("_w").over(one))
        .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_spent", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # left for this source and those after it, times den; the first that stays under its cap sets the level
        .withColumn("_left", num * F.col("_all") - den * cap * F.col("_full"))
        .withColumn("_rest", F.col("_weights") - F.col("_spent"))
        .withColumn("_under", F.col("_w") * F.col("_left") <= den * cap * F.col("source_size") * F.col("_rest"))
        .withColumn("_order", F.row_number().over(fill))
    )
    first = F.min(F.when(F.col("_under"), F.struct("_order", "_left", "_rest"))).over(one)
    return level.withColumn("_first", first).select(
        "source",
        "source_size",
        F.when(F.col("_order") < F.col("_first._order"), (cap * F.col("source_size")).cast("double"))
        .otherwise((F.col("_w") * F.col("_first._left")).cast("double") / (den * F.col("_first._rest")).cast("double"))
        .alias("target"),
        "slope",
    )


def order_hash(id_col: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, by which a source's documents are ordered; any engine can compute them."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", id_col.cast("string"), text)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """One row a document: doc_id, k1, k2, source, size, source_size, target, taken, position, again_position.

    Within a source, words stand in the order of a hash of (id, text); the mix takes the first
    ``round(target)`` of the source's words, repeated as often as needed, so ``taken`` sums to that and
    is at most ``ceil(target / source_size)`` times the size. ``again_position`` is where the second
    pass over the document begins, null if there is none.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *row_keys(F.col(id_col), F.col(text_col)), n_words(F.col(text_col)).alias("size"), order_hash(F.col(id_col), F.col(text_col)).alias("h"))
    sizes = written(sizes, "mix-sizes")
    of = source_targets(sizes, **targets).withColumnRenamed("source", "_source")
    placed = running_sum(sizes, ["source"], ["h", "k1", "k2", "size"], "size", "_start", range_bits(sizes.count()), 60)
    joined = placed.join(F.broadcast(of) if len(of.take(MAX_BROADCAST + 1)) <= MAX_BROADCAST else of, F.col("source").eqNullSafe(F.col("_source")))
    want = F.round("target").cast("long")
    # words of this document among the first `want` words of its endlessly repeated source
    whole = F.floor(want / F.col("source_size"))
    rest = want - whole * F.col("source_size")
    taken = F.when(F.col("source_size") > 0, whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))).otherwise(0).cast("long")

    def at(words):
        u = F.least(F.lit(1.0), words / F.col("target"))
        g = F.col("slope")
        # the root in [0, 1] of g*t*t + (1-g)*t - u, in the form that also holds for g = 0
        return 2 * u / ((1 - g) + F.sqrt((1 - g) * (1 - g) + 4 * g * u))

    return joined.withColumn("taken", taken).select(
        "doc_id", "k1", "k2", "source", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, at(F.col("_start"))).alias("position"),
        F.when(F.col("taken") > F.col("size"), at(F.col("_start") + F.col("source_size"))).alias("again_position"),
    )


#: The table of sources is broadcast up to so many rows and joined by shuffling beyond.
MAX_BROADCAST = 10_000


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """The documents of the mix, range-sorted by training position, with the columns of ``docs``.

    A document stands once for each pass over it; where the last pass ends within it, that copy keeps
    the words up to there. Documents of which the mix takes nothing are left out.
    """
    plan = mix(docs, id_col, text_col, source_col, **targets).filter("taken > 0")
    plan = plan.select(F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("position").alias("_position"), F.col("again_position").alias("_again"))
    # rows of the same id and text are alike but for where the target ends: each keeps a plan of its own
    plan = plan.withColumn("_n", F.row_number().over(Window.partitionBy("_p1", "_p2").orderBy("_taken", "_position")))
    rows, name = numbered(docs)
    text = F.col(name[text_col])
    k1, k2 = row_keys(F.col(name[id_col]), text)
    rows = rows.select("*", k1.alias("_k1"), k2.alias("_k2"))
    rows = rows.withColumn("_m", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(0))))
    # the difference, as an equality of columns would have the texts shuffled a second time
    kept = rows.join(plan, (F.col("_k1") == F.col("_p1")) & (F.col("_k2") == F.col("_p2")) & (F.col("_m") - F.col("_n") == 0))
    passes = F.transform(F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")).cast("int") - 1), lambda p: F.struct(p.alias("p"), F.least(F.col("_size"), F.col("_taken") - p * F.col("_size")).alias("words")))
    kept = kept.withColumn("_pass", F.explode(passes))
    pieces = F.regexp_extract_all(text, F.lit(GAP[:-1] + "*" + WORD), F.lit(0))
    cut = F.when(F.col("_pass.words") < F.col("_size"), F.array_join(F.slice(pieces, F.lit(1), F.col("_pass.words").cast("int")), "")).otherwise(text)
    place = F.when(F.col("_pass.p") == 0, F.col("_position")).otherwise(F.col("_again"))
    kept = kept.withColumn("_place", place).withColumn("_text", cut)
    new = {text_col: F.col("_text"), "n_chars": F.length("_text")}
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.repartitionByRange(n, "_place", "_k1").sortWithinPartitions("_place", "_k1")
    return ranged.select(*[new.get(c, F.col(old)).cast(docs.schema[c].dataType).alias(c) for c, old in name.items()])
