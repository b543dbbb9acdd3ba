"""Stateful operators of streams: the last messages of each session, and excerpts that expire by timers.

Both hold a bounded state for each key (a list of n messages; one row and one timer) in Spark's own state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import classify as C
from tidemark.functions import text as X
from tidemark.shipping import workers_can_import

SAMPLE = "session string, ord long, role string, snippet string"
EXCERPT = "id string, has_file boolean, pinned boolean, expires_ms long"
FATE = "id string, fate string, at_ms long"
#: The state store that lists and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Recent(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ord long, role string, snippet string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r) for r in self.last.get()} if self.last.exists() else {}
        for pdf in rows:
            # a place that is read again has the same message
            for r in zip(pdf["ord"].tolist(), pdf["role"].tolist(), pdf["snippet"].tolist(), strict=True):
                held[r[0]] = r
            held = dict(sorted(held.items())[-self.n :])
        kept = list(held.values())
        self.last.put(kept)
        yield pd.DataFrame({"session": [key[0]] * len(kept), "ord": [r[0] for r in kept], "role": [r[1] for r in kept], "snippet": [r[2] for r in kept]})

    def close(self) -> None:
        pass


def recent_samples(messages: DataFrame, n: int, most_text: int = 220) -> DataFrame:
    """A stream of (session, ord, role, snippet): for each session that a batch touches, its last ``n`` messages with a text so far."""
    workers_can_import(messages.sparkSession)
    rows = messages.filter(X.strip("text") != "").select("session", "ord", "role", X.clip("text", most_text).alias("snippet"))
    return rows.groupBy("session").transformWithStateInPandas(_Recent(n), SAMPLE, "Update", "None")


class _Expiry(StatefulProcessor):
    """An excerpt's last row decides: a pinned one or one without a readable time has no timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "has_file boolean, expires_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ord_, newest = None, None
        for pdf in rows:
            for at, *own in zip(pdf["ord"].tolist(), pdf["has_file"].tolist(), pdf["pinned"].tolist(), pdf["expires_ms"].tolist(), strict=True):
                if ord_ is None or at > ord_:
                    ord_, newest = at, own
        has_file, pinned, ms = newest
        expires = None if pinned or pd.isna(ms) else int(ms)
        # state is kept, and so has to be asked for, only of excerpts with a timer
        if self.row.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if expires is None:
                self.row.clear()
        if expires is not None:
            self.row.update((bool(has_file), expires))
            # over once the time has passed; a time in the past is over at the next one
            self.handle.registerTimer(max(expires + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        has_file, expires = self.row.get()
        self.row.clear()
        yield pd.DataFrame({"id": [key[0]], "fate": ["deleted" if has_file else "missing"], "at_ms": [expires]})

    def close(self) -> None:
        pass


def expired_excerpts(excerpts: DataFrame, time: str = "seen_at") -> DataFrame:
    """A stream of (id, fate, at_ms): excerpts as the stream's time passes their ``expires_at``; those without a file are ``missing``.

    ``excerpts`` is a stream of ord, id, pinned, expires_at, source_path and ``time``, by which the clock moves; rows without an id
    move the clock alone. A later row of an id replaces the earlier: it can pin an excerpt or give it more time.
    """
    workers_can_import(excerpts.sparkSession)
    ms = F.unix_millis(C.instant(F.col("expires_at")))
    rows = excerpts.withWatermark(time, "0 seconds").select("ord", F.coalesce("id", F.lit("")).alias("id"), (F.coalesce("source_path", F.lit("")) != "").alias("has_file"), (F.coalesce("pinned", F.lit(False)) | F.col("id").isNull()).alias("pinned"), ms.alias("expires_ms"), time)
    return rows.groupBy("id").transformWithStateInPandas(_Expiry(), FATE, "Update", "EventTime")
