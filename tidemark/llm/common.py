"""Helpers shared by the training-data operators.

Nothing here holds rows: sessions, shared folders, row keys and blocked running sums.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space separates words; everything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


ROOT = Path(__file__).resolve().parents[2]
#: Arrow batches are bounded by bytes, not only by rows, where the caller has set nothing else.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_SHIPPED: set[str] = set()
_MADE: list[str] = []


def is_local(spark: SparkSession) -> bool:
    """Whether the driver runs all tasks itself."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, on other hosts too, and keep Arrow batches small."""
    sc = spark.sparkContext
    env = sc.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in paths:
        env["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    if not is_local(spark) and sc.applicationId not in _SHIPPED:
        archive = Path(tempfile.mkdtemp()) / "tidemark.zip"  # the driver serves it from here
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted((ROOT / "tidemark").rglob("*.py")):
                out.write(f, f.relative_to(ROOT))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and no cluster runs.

    With its scheme, so that Python workers open it where Spark does.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.getCheckpointDir():
            if not is_local(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = spark.sparkContext.getCheckpointDir()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with its path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module's own making through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, on leaving, what operators have written for their own use inside, but for paths that the caller adds to the list given."""
    mark, keep = len(_MADE), []
    try:
        yield keep
    finally:
        for path in _MADE[mark:]:
            if path not in keep:
                remove(spark, path)
        # those that are kept are left to an outer one of these
        _MADE[mark:] = [path for path in _MADE[mark:] if path in keep]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named _in0, _in1, ... so that none clashes with an operator's own; old name -> new name."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def n_words(text: Column) -> Column:
    """Words of a text, as a long; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """k1, k2: 128 bits that name a row's id and text, also where ids are null or repeat; k1 alone spreads uniformly."""
    return [F.xxhash64(F.lit(i), id_col, F.isnull(id_col), text, F.isnull(text)).alias(f"k{i}") for i in (1, 2)]


#: Rows that a range of a running sum holds, about.
RANGE_ROWS = 500_000


def range_bits(rows: int) -> int:
    """How many bits of a uniform hash cut so many rows into ranges of about RANGE_ROWS, 10 at least."""
    return max(10, (rows // RANGE_ROWS).bit_length())


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, into: str, bucket_bits: int = 10, hash_bits: int = 64) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, for groups of any size.

    ``order[0]`` must be a uniform hash of ``hash_bits`` bits (64: signed). Rows are cut into ``2**bucket_bits`` ranges of that
    hash; each range is summed on its own and range totals (at most ``2**bucket_bits`` a group) are
    summed above them, so that no task holds a whole group.
    """
    bucket = "_bucket"
    cut = df.withColumn(bucket, F.shiftright(order[0], hash_bits - bucket_bits))
    totals = cut.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    above = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(bucket).alias("_b"), F.coalesce(F.sum("_total").over(above), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    match = F.col(bucket) == F.col("_b")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return summed.join(bases, match).withColumn(into, (F.col("_within") + F.col("_base")).cast("long")).drop(bucket, "_b", "_base", "_within", *[f"_g{i}" for i in range(len(group))])
