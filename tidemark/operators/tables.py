"""Tables in the folder that driver and executors share, for loops that must not grow their lineage."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and no cluster runs, a temporary folder."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table of its own, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Pointer:
    """The newest of the numbered states kept in a folder, one small JSON file each; a state is never changed once it is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path
        self.path = lambda name="": path(f"{self.folder}/{name}" if name else self.folder)
        self.system = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, start: dict) -> dict:
        """The newest state, or ``start`` where there is none; ``number`` says which."""
        names = [s.getPath().getName() for s in self.system.listStatus(self.path())] if self.system.exists(self.path()) else []
        newest = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        if newest is None:
            return {**start, "number": 0}
        stream = self.system.open(self.path(newest))
        try:
            return {**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")), "number": int(newest.removesuffix(".json"))}
        finally:
            stream.close()

    def move(self, state: dict) -> dict:
        """Keep what follows ``state``, which must still be the newest; older ones but the last few are deleted."""
        number = state["number"] + 1
        name, draft = f"{number:012d}.json", f".{uuid.uuid4().hex}"
        out = self.system.create(self.path(draft))
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "number"}).encode()))
        out.close()
        if self.system.exists(self.path(name)) or not self.system.rename(self.path(draft), self.path(name)):
            self.system.delete(self.path(draft), False)
            raise RuntimeError(f"another writer has moved {self.folder} on to {number}")
        self.system.delete(self.path(f"{number - 5:012d}.json"), False)
        return {**state, "number": number}
