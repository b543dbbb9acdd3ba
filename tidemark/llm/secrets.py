"""Secret scans: fixed patterns plus a sliding-window entropy detector, in Spark SQL expressions only.

Patterns: see KINDS. A text without a match is passed over by one test; else it is cut at the matches,
and the lengths of matches and pieces, summed up, are the positions.

Entropy: a candidate is a maximal run of at least WINDOW characters of a class (CLASSES). A window of
WINDOW characters slides over it; counts of the characters inside are kept up to date with each
step (one enters, one leaves), and with them the sum of c*log2(c) in whole millionths, from
which the Shannon entropy is log2(WINDOW) - sum / WINDOW. Windows at or above the class's
threshold are merged into spans. Candidates on the allow-list (ALLOW_WORDS, PART) add nothing, nor do
spans inside one of a pattern or of a class listed before.

All is n log n in a text's length and its number of matches, and no pattern repeats a group, which
Java's matcher would recurse on.

Cases: null counts as empty text; texts of any length are read whole; matches are leftmost and do
not overlap within a kind; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which ties at one start are listed.
KINDS = ("assign", "access", "hex", "entropy_alnum", "entropy_base64", "entropy_hex", "entropy_upper", "entropy_lower", "entropy_mixed")
#: The patterns. Runs are maximal, so a least length can stand in the pattern; where a short match still consumes text (assign), it is dropped afterwards.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters that a window spans.
WINDOW = 24
LETTER_AND_DIGIT = r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]"
BOTH_CASES_AND_DIGIT = r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"
WIDEST = "A-Za-z0-9+/=_-"
#: Character classes of candidates: (kind, characters in a pattern, least entropy in bits, what a candidate must hold). log2(24) = 4.58
#: is the most; prose stays under 3.8. Of 20,000 random windows each, 99.5 % reach 3.00 (hexadecimal), 3.49 (base32), 3.55 (one case
#: and digits), 3.82 (alphanumeric), so classes of fewer symbols have thresholds of their own.
CLASSES = (
    ("entropy_alnum", "A-Za-z0-9", 4.0, LETTER_AND_DIGIT),
    ("entropy_base64", WIDEST, 4.15, LETTER_AND_DIGIT),
    ("entropy_hex", "0-9A-Fa-f", 3.0, LETTER_AND_DIGIT),
    ("entropy_upper", "A-Z0-9", 3.48, LETTER_AND_DIGIT),
    ("entropy_lower", "a-z0-9", 3.48, LETTER_AND_DIGIT),
    ("entropy_mixed", WIDEST, 3.82, BOTH_CASES_AND_DIGIT),
)
#: Candidates with one of these are no secrets: placeholders, alphabets in order.
ALLOW_WORDS = r"EXAMPLE|[eE]xample|[pP]laceholder|[cC]hange[mM]e|[dD]ummy|[xX]{8}|abcdefghij|ABCDEFGHIJ|0123456789"
#: Nor are paths of words with numbers after them: candidates whose parts between BETWEEN all match PART. Written apart, as
#: Java's matcher recurses once for each repetition of a group.
BETWEEN, PART = r"[/_=+-]+", r"[A-Za-z]?[a-z]*[0-9]{0,4}"
SPAN = "struct<kind:string,s:int,e:int,rank:int>"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: c*log2(c) in whole millionths for c from 0 to WINDOW.
CLOGC = [0, *(round(c * math.log2(c) * 1_000_000) for c in range(1, WINDOW + 1))]


def most_clogc(bits: float) -> int:
    """A window has at least ``bits`` of entropy where its sum of CLOGC is at most this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1_000_000)


NONE = f"cast(array() as array<{SPAN}>)"
#: Windows that are walked over in one go; a walk copies what it has found so far, so it must not be long.
CHUNK = 512
#: Letters that a cut counts at most to find its place.
BLOCK = 4096
#: Arrays of up to two to this power elements are summed.
DOUBLINGS = 30


def _prefixes(values: Column | str, both) -> Column:
    """Of an array, ``both`` applied over all elements up to each, by doubling: n log n."""

    def step(acc: Column, p: Column) -> Column:
        back = F.pow(F.lit(2), p).cast("int")
        return F.when(back < F.size(acc), F.transform(acc, lambda x, i: F.when(i >= back, both(F.get(acc, i - back), x)).otherwise(x))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(DOUBLINGS - 1)), F.col(values) if isinstance(values, str) else values, step)


def _span(kind: str, s: Column, e: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(KINDS.index(kind)).alias("rank"))


def _cut(text: Column, pattern: str, name: str, when: Column) -> list[Column]:
    """The matches of a pattern and the pieces of text around them; none where ``when`` is false."""
    empty = F.expr("cast(array() as array<string>)")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return [F.when(when, found).otherwise(empty).alias(f"{name}_found"), F.when(when, gaps).otherwise(empty).alias(f"{name}_gaps")]


def _ends(name: str) -> Column:
    """Where each match of ``_cut`` ends: lengths summed up."""
    lengths = F.transform(f"{name}_found", lambda x, i: F.length(x) + F.length(F.get(F.col(f"{name}_gaps"), i)))
    return F.when(F.size(f"{name}_found") > 0, _prefixes(lengths, lambda a, b: a + b)).otherwise(F.expr("cast(array() as array<int>)")).alias(f"{name}_ends")


def _spans(kind: str) -> Column:
    return F.transform(f"{kind}_ends", lambda e, i: _span(kind, e - F.length(F.get(F.col(f"{kind}_found"), i)), e)).alias(kind)


def _runs(kind: str, holds: str) -> Column:
    """The candidates that neither lack what the class must hold nor match the allow-list: (s, codes)."""
    fit = lambda x: x.rlike(holds) & ~x.rlike(ALLOW_WORDS) & ~F.forall(F.split(x, BETWEEN, -1), lambda part: part.rlike(f"^{PART}$"))
    suspects = F.filter(F.transform(kind, lambda x, i: F.struct(x["s"].alias("s"), F.get(F.col(f"{kind}_found"), i).alias("run"))), lambda x: fit(x["run"]))
    return F.transform(suspects, lambda x: F.struct(x["s"].alias("s"), F.transform(F.split(x["run"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1).alias("codes"))).alias(f"{kind}_runs")


def _walk(run: Column, first: Column, bits: float) -> Column:
    """Stretches (s, e) of hot windows among the CHUNK windows of ``run`` from ``first`` on.

    The counts of the window are letters of a string, one for each symbol: A for none, B for one, ...
    """
    clogc = F.array(*[F.lit(x) for x in CLOGC])
    letter = lambda n: F.char(n + ord("A"))
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - ord("A")

    def step(acc: Column, i: Column) -> Column:
        came = F.get(run["codes"], i)
        full = i - first >= WINDOW
        left = F.when(full, F.get(run["codes"], i - WINDOW)).otherwise(F.lit(-1))
        n_in, n_out = count(acc["counts"], came), count(acc["counts"], F.greatest(left, F.lit(0)))
        enters = F.overlay(acc["counts"], letter(n_in + 1), came + 1, F.lit(1))
        counts = F.when(came == left, acc["counts"]).when(full, F.overlay(enters, letter(n_out - 1), left + 1, F.lit(1))).otherwise(enters)
        grows = F.get(clogc, n_in + 1) - F.get(clogc, n_in)
        change = F.when(came == left, F.lit(0)).when(full, grows - F.get(clogc, n_out) + F.get(clogc, n_out - 1)).otherwise(grows)
        total = acc["total"] + change
        s, e = run["s"] + i - (WINDOW - 1), run["s"] + i + 1
        hot = (i - first >= WINDOW - 1) & (total <= most_clogc(bits))
        apart = hot & (acc["e"] < s)
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(apart, s).otherwise(acc["s"]).alias("s"),
            F.when(hot, e).otherwise(acc["e"]).alias("e"),
            F.when(apart & (acc["e"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"]).alias("out"),
        )

    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    begin = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("out"))
    last = F.least(F.size(run["codes"]), first + CHUNK + WINDOW - 1) - 1
    return F.aggregate(F.sequence(first, last), begin, step, lambda acc: F.when(acc["e"] < 0, none).otherwise(F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))))


def _hot(kind: str, bits: float) -> Column:
    """Stretches of hot windows of all runs, in order; those of neighbouring chunks may touch."""

    def of(run: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(run["codes"]) - WINDOW, F.lit(CHUNK))
        return F.flatten(F.transform(firsts, lambda first: _walk(run, first, bits)))

    return F.when(F.size(f"{kind}_runs") > 0, F.flatten(F.transform(f"{kind}_runs", of))).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias(f"{kind}_hot")


def _merged(kind: str) -> Column:
    """Spans of the class: its stretches, those that touch as one."""
    hot = F.col(f"{kind}_hot")
    firsts = F.filter(hot, lambda x, i: (i == 0) | (F.get(hot, i - 1)["e"] < x["s"]))
    lasts = F.filter(hot, lambda x, i: (i == F.size(hot) - 1) | (F.get(hot, i + 1)["s"] > x["e"]))
    return F.transform(F.arrays_zip(firsts.alias("a"), lasts.alias("z")), lambda x: _span(kind, x["a"]["s"], x["z"]["e"])).alias(f"{kind}_new")


def _by_start(spans: Column) -> Column:
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["rank"].alias("rank")))


def _level(rank: Column) -> Column:
    """0 for the kinds of the patterns, then one a class: a span inside one of a lower level adds nothing."""
    return F.greatest(rank - 2, F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, base, added and spans (both): arrays of (kind, s, e, rank) by start, then kind."""
    text = F.col("_t")
    t = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    # hexadecimal matches and the runs of every class are part of a run of the widest class
    t = t.select("*", text.rlike(ASSIGN).alias("_assign"), F.contains(text, F.lit("AKIA")).alias("_access"), text.rlike(f"[{WIDEST}]{{{WINDOW},}}").alias("_long"))
    # each step reads columns of the step before, as an expression inside a lambda would be evaluated for each element
    t = t.select(
        "*",
        *_cut(text, ASSIGN, "assign", F.col("_assign")),
        F.when(F.col("_assign"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(F.expr("cast(array() as array<string>)")).alias("assign_values"),
        *_cut(text, ACCESS, "access", F.col("_access")),
        *_cut(text, HEX, "hex", F.col("_long")),
        *[c for kind, chars, *_ in CLASSES for c in _cut(text, f"[{chars}]{{{WINDOW},}}", kind, F.col("_long"))],
    )
    t = t.select("*", *map(_ends, KINDS))
    t = t.select("*", *map(_spans, KINDS))
    fit = F.filter("assign", lambda x, i: F.length(F.get("assign_values", i)) >= ASSIGN_LEAST)
    t = t.select("doc_id", *keep, _by_start(F.concat(fit, "access", "hex")).alias("base"), *[_runs(kind, holds) for kind, _, _, holds in CLASSES])
    t = t.select("doc_id", *keep, "base", *[_hot(kind, bits) for kind, _, bits, _ in CLASSES])
    t = t.select("doc_id", *keep, "base", *[_merged(kind) for kind, *_ in CLASSES])
    t = t.select("doc_id", *keep, "base", _by_start(F.concat("base", *[f"{kind}_new" for kind, *_ in CLASSES])).alias("all"))
    # for each span, the furthest end of each level among the spans up to it
    ends = F.transform("all", lambda x: F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES))), lambda level: F.when(level == _level(x["rank"]), x["e"]).otherwise(F.lit(0))))
    furthest = _prefixes(ends, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    t = t.select("*", F.when(F.size("all") > F.size("base"), furthest).alias("_furthest"))
    inside = lambda x, i: F.exists(F.slice(F.get(F.col("_furthest"), i), F.lit(1), _level(x["rank"])), lambda end: end >= x["e"])
    added = F.when(F.col("_furthest").isNull(), F.expr(NONE)).otherwise(F.filter("all", lambda x, i: F.when(x["rank"] < len(KINDS) - len(CLASSES), F.lit(False)).otherwise(~inside(x, i))))
    t = t.select("doc_id", *keep, "base", added.alias("added"))
    return t.select("*", _by_start(F.concat("base", "added")).alias("spans"))


def joined(spans: Column | str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each stretch of overlapping spans replaced by ``[secret]``; texts without spans stay as they are."""
    names = [f"_in_{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with the scan's
    found = scan(docs.toDF(*names), id_col=names[0], text_col=names[docs.columns.index(text_col)], keep=tuple(names))
    text = F.col(names[docs.columns.index(text_col)])
    some = F.size("spans") > 0
    reach = _prefixes(F.transform("spans", lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    found = found.select("*", F.when(some, reach).alias("_reach"), F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("_blocks"))
    # stretches of overlapping spans, and the text before each
    reach = F.col("_reach")
    firsts = F.transform(F.filter(F.transform("spans", lambda x, i: F.struct(x["s"].alias("s"), F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("before"), (i == 0).alias("first"))), lambda x: x["first"] | (x["s"] >= x["before"])), lambda x: F.struct(x["before"].alias("from"), x["s"].alias("to")))
    found = found.select("*", firsts.alias("_firsts"))

    def piece(at: Column, end: Column) -> Column:
        def of(b: Column) -> Column:
            start = F.greatest(at - b * BLOCK, F.lit(0))
            return F.substring(F.get(F.col("_blocks"), b), start + 1, F.least(end - b * BLOCK, F.lit(BLOCK)) - start)

        blocks = F.sequence(F.floor(at / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
        return F.when(at < end, F.array_join(F.transform(blocks, of), "")).otherwise("")

    last = F.get(reach, F.size(reach) - 1)
    parts = F.concat(F.transform("_firsts", lambda x: piece(x["from"], x["to"])), F.array(piece(last, F.length(text))))
    cut = F.array_join(parts, "[secret]")
    new = F.when(F.size("spans") > 0, cut).otherwise(text)
    out = [new.alias(c) if c == text_col else F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)]
    out = [F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, out, strict=True)]
    return found.select(*out)
