"""Text functions as Spark columns: tokens, slugs, clips, chunks, redaction, searchable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The secrets that excerpts hide; the named prefix stays.
REDACTIONS = (
    (r"(?i)(authorization\s*:\s*bearer)\s+[^\s]+", "$1 ***REDACTED***"),
    (r"\bsk-[A-Za-z0-9]{16,}\b", "sk-***REDACTED***"),
    (r'(?i)(api[_-]?key"?\s*[:=]\s*"?)[^"\s]+', "$1***REDACTED***"),
    (r'(?i)(gatewayToken"?\s*[:=]\s*"?)[^"\s]+', "$1***REDACTED***"),
    (r'(?i)(token"?\s*[:=]\s*"?)[^"\s]{20,}', "$1***REDACTED***"),
)
#: Words that carry no topic.
STOPWORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by "
    "can cannot could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our "
    "ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they "
    "this those through to too under until up very was we were what when where which while who whom why with you your yours "
    "yourself yourselves"
).split()
QUERY_TOKENS = 30


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


#: What a strip takes off.
SPACE = " \t\n\x0b\f\r"


def strip(x: Column | str) -> Column:
    return F.btrim(_text(x), F.lit(SPACE))


def tokens(x: Column | str) -> Column:
    """Runs of at least three of a-z, 0-9, _ and -, in lower case, repeats included."""
    return F.regexp_extract_all(F.lower(_text(x)), F.lit(r"[a-z0-9_\-]{3,}"), F.lit(0))


def query_tokens(x: Column | str, most: int | None = QUERY_TOKENS) -> Column:
    """The same of a query, at most ``most`` of them; repeats count."""
    return tokens(x) if most is None else F.slice(tokens(x), 1, most)


def token_set(x: Column | str) -> Column:
    return F.array_distinct(tokens(x))


def excerpt_tokens(x: Column | str) -> Column:
    """Distinct runs of at least three of a-z and 0-9, in order, at most 30."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(_text(x)), F.lit(r"[a-z0-9]{3,}"), F.lit(0))), 1, QUERY_TOKENS)


def topic_tokens(x: Column | str, known: list[str] | None = None, stopwords: list[str] = STOPWORDS) -> Column:
    """Runs of at least four letters that are no stop words, after blanking ``known`` keywords, repeats included."""
    text = F.lower(_text(x))
    for keyword in known or ():
        text = F.replace(text, F.lit(keyword.lower()), F.lit(" "))
    found = F.regexp_extract_all(text, F.lit("[a-z]{4,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stopwords))


def bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= 2, pairs).otherwise(F.expr("cast(array() as array<string>)"))


def squeeze(x: Column | str) -> Column:
    return strip(F.regexp_replace(_text(x), r"\s+", " "))


def clip(x: Column | str, n: int) -> Column:
    s = squeeze(x)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def slug(x: Column | str, most: int | None = 60, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_text(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.when(s == "", F.lit(default)).otherwise(s)
    return s if most is None else F.substring(s, 1, most)


def safe_filename(x: Column | str) -> Column:
    return F.substring(F.regexp_replace(_text(x), r"[^a-zA-Z0-9_\-]", "_"), 1, 100)


def id_of_filename(x: Column | str) -> Column:
    """The node id that a rendered file's name stands for: the first _ is a colon, the others are hyphens."""
    name = F.regexp_replace(_text(x), r"\.md$", "")
    head, tail = F.substring_index(name, "_", 1), F.substring(name, F.length(F.substring_index(name, "_", 1)) + 2, F.length(name))
    return F.when(F.instr(name, "_") > 0, F.concat(head, F.lit(":"), F.translate(tail, "_", "-"))).otherwise(name)


def without_front_matter(x: Column | str) -> Column:
    parts = F.split(_text(x), "---", 3)
    return F.when(F.startswith(_text(x), F.lit("---")) & (F.size(parts) >= 3), strip(F.get(parts, 2))).otherwise(_text(x))


def redact(x: Column | str) -> Column:
    out = _text(x)
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return out


def preview(x: Column | str, n: int = 180) -> Column:
    return F.substring(F.replace(strip(x), F.lit("\n"), F.lit(" ")), 1, n)


def phrase_count(x: Column, phrase: Column) -> Column:
    """Occurrences that do not overlap; none of an empty phrase."""
    gone = F.length(x) - F.length(F.replace(x, phrase, F.lit("")))
    return F.when(F.length(phrase) > 0, (gone / F.length(phrase)).cast("long")).otherwise(F.lit(0).cast("long"))


def tag_list(x: Column) -> Column:
    """Tags of an array whose members may list several with commas: trimmed, without empty ones."""
    return F.filter(F.flatten(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda t: F.transform(F.split(t, ","), lambda s: F.trim(s)))), lambda s: s != "")


def searchable(*columns: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def substring_hits(haystack: Column, needles: Column) -> Column:
    """How many of the needles, repeats included, stand anywhere in the haystack."""
    return F.size(F.filter(needles, lambda t: F.contains(haystack, t))).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often lambdas inside read it."""
    return F.get(F.transform(F.array(value), body), 0)


def packed(pieces: Column, joint: str, most: int) -> Column:
    """Pieces, none empty, joined in order for as long as they have up to ``most`` characters; lengths decide, then each chunk is joined once."""

    def of(p: Column, lengths: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            longer = acc["used"] + len(joint) + F.get(lengths, i)
            fits = (acc["used"] > 0) & (longer <= most)
            return F.struct(F.when(fits, longer).otherwise(F.get(lengths, i)).alias("used"), F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(i))).alias("starts"))

        none = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("starts"))
        starts = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), none, step)["starts"]
        return let(starts, lambda at: F.transform(at, lambda s, k: F.array_join(F.slice(p, s + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - s), joint)))

    empty = F.expr("cast(array() as array<string>)")
    return let(pieces, lambda p: F.when(F.size(p) == 0, empty).otherwise(let(F.transform(p, lambda x: F.length(x)), lambda lengths: of(p, lengths))))


def chunks(x: Column | str, most: int = 800, separator: str = "\n\n") -> Column:
    """Paragraphs packed up to ``most`` characters; a piece that is still longer is packed by words; a longer word stays whole."""
    paragraphs = F.filter(F.transform(F.split(strip(x), separator), strip), lambda p: p != "")

    def by_words(piece: Column) -> Column:
        words = F.filter(F.split(F.replace(piece, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
        return F.when(F.length(piece) <= most, F.array(piece)).otherwise(packed(words, " ", most))

    return F.flatten(F.transform(packed(paragraphs, separator, most), by_words))


def chunks_cutting(x: Column | str, most: int = 800, separator: str = "\n\n") -> Column:
    """The other chunker: a text that fits stays as it is; a paragraph over ``most`` is cut off there."""

    def of(t: Column) -> Column:
        cut = F.transform(F.filter(F.transform(F.split(t, separator), strip), lambda p: p != ""), lambda p: F.substring(p, 1, most))
        return F.when(t == "", F.expr("cast(array() as array<string>)")).when(F.length(t) <= most, F.array(t)).otherwise(packed(cut, separator, most))

    return let(strip(x), of)
