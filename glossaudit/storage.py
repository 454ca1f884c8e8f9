"""Stage tables in the shared folder, and helpers that look at size before choosing a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="glossaudit-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_STAGED: dict[str, list[str]] = {}


def drop_staged(spark: SparkSession) -> int:
    """Delete all tables that this application has staged; call it once their results are written."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so lost executors cost a re-read and not a re-computation, and lets several
    consumers share one evaluation.
    """
    path = stage_path(df.sparkSession, name)
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame, *columns: str) -> str:
    """Number and summed hashes of the rows: equal for equal rows in any order. One pass, one row to the driver."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64(*columns), 24)), F.lit(0))).first()
    return f"{n}:{total}"


def small_enough(rows: int, bytes_per_row: int) -> bool:
    return rows * bytes_per_row <= BROADCAST_LIMIT_BYTES


def broadcast_if_small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast only after counting; beyond the limit the join shuffles (AQE splits skew).

    ``df`` should be a staged table, so that the count is a footer read.
    """
    return F.broadcast(df) if small_enough(df.count(), bytes_per_row) else df


def planned_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``, from file sizes; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Give a table that is planned smaller than one full split per core more partitions.

    A table at scale, and a plan whose size Spark cannot tell (a join), pass through without a shuffle. ``like``: the
    table whose size counts, for what a join leaves of it. Nothing runs.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if df.isStreaming or planned_bytes(df if like is None else like) >= cores * split:
        return df
    return df.repartition(cores, *keys)
