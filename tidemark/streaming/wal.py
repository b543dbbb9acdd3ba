"""The change feed as a stream: last operation of each node, kept in buckets.

Nodes are dealt into BUCKETS by a hash of their id. Each micro-batch is folded by (node_id, ord) with
the buckets that it touches, which are written anew; a pointer then names the folder of each bucket. So a
batch costs what its buckets hold, and one that runs again gives the same state. Folders that no pointer
names any more are deleted one batch later, when readers have moved on. Batches are bounded by the
trigger; the stream's own checkpoint holds what was read, which replaces truncating the feed.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import Pointer, remove

FEED = "ord long, op string, node_id string, text string, ts string"
STATE = "node_id string, ord long, op string, text string, ts string"
BUCKETS = 64


class WalFold:
    """Folds batches into the state under ``root``; deletes stay as marks, so late replays do not bring a node back."""

    def __init__(self, root: str, buckets: int = BUCKETS):
        self.root, self.buckets = root.rstrip("/"), buckets

    def _pointer(self, spark: SparkSession) -> Pointer:
        return Pointer(spark, f"{self.root}/current")

    def _last(self, spark: SparkSession) -> dict:
        """The newest state: buckets (number -> folder) and folders to be deleted."""
        return self._pointer(spark).read({"buckets": {}, "stale": []})

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(STATE).parquet(*folders) if folders else spark.createDataFrame([], STATE)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """All nodes with their last operation."""
        return self._read(spark, sorted(self._last(spark)["buckets"].values()))

    def live(self, spark: SparkSession) -> DataFrame:
        return self.snapshot(spark).filter("op <> 'delete'").select("node_id", "text", "ts", "op")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("node_id"), F.lit(self.buckets))
        rows = batch.filter(F.col("op").isNotNull() & F.col("node_id").isNotNull()).select("node_id", "ord", "op", "text", "ts")
        touched = [str(r[0]) for r in rows.select(bucket).distinct().collect()]  # at most BUCKETS
        if not touched:
            return
        last = self._last(spark)
        old = [last["buckets"][b] for b in touched if b in last["buckets"]]
        both = self._read(spark, old).unionByName(rows)
        state = both.groupBy("node_id").agg(F.max_by(F.struct("ord", "op", "text", "ts"), "ord").alias("l")).select("node_id", "l.*")
        path = f"{self.root}/batch-{batch_id:012d}-{uuid.uuid4().hex}"
        state.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)
        # the pointer moves after the buckets are whole
        self._pointer(spark).move({**last, "buckets": last["buckets"] | {b: f"{path}/bucket={b}" for b in touched}, "stale": old})
        for folder in last["stale"]:
            remove(spark, folder)


def merge_stream(spark: SparkSession, feed: str, root: str, files_per_batch: int = 100) -> WalFold:
    """Read all Parquet files of ``feed`` that were not read before, in batches, and fold them."""
    fold = WalFold(os.path.join(root, "state"))
    rows = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(feed)
    query = rows.writeStream.foreachBatch(fold).option("checkpointLocation", os.path.join(root, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return fold


def distinct_stream(rows: DataFrame, keys: list[str], time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows whose keys were not seen before; with a time column, state is dropped after ``late``."""
    if time is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
