"""Ordered URL lists: dense positions, slices and batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaudit.fixed_values import DEFAULT_BATCH_SIZE
from glossaudit.storage import staged


def with_position(rows: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given total order, without sorting them in one task.

    Rows are range-partitioned and written once with their part number, which freezes the ranges;
    the part sizes (one row per partition) give each part its start.
    """
    parts = staged(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    start, starts = 0, []
    for part in range(max(sizes, default=-1) + 1):
        starts.append(start)
        start += sizes.get(part, 0)
    offsets = F.array(*[F.lit(s).cast("long") for s in starts]) if starts else F.array(F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn(name, F.get(offsets, F.col("part")) + within - 1).drop("part")


def url_slice(urls: DataFrame, offset: int = 0, limit: int = 0, position: str = "ord") -> DataFrame:
    """Rows ``[offset, offset + limit)``; a limit of 0 or less means no limit. A plain filter."""
    start = max(offset, 0)
    chosen = F.col(position) >= start
    if limit > 0:
        chosen = chosen & (F.col(position) < start + limit)
    return urls.where(chosen)


def with_batch(urls: DataFrame, size: int = DEFAULT_BATCH_SIZE, position: str = "ord") -> DataFrame:
    return urls.withColumn("batch_id", F.floor(F.col(position) / size))


def url_batches(urls: DataFrame, size: int = DEFAULT_BATCH_SIZE, position: str = "ord") -> DataFrame:
    """(batch_id, first_ord, last_ord, n_urls), one row per batch; the last one may be short."""
    return with_batch(urls, size, position).groupBy("batch_id").agg(
        F.min(position).alias("first_ord"), F.max(position).alias("last_ord"), F.count("*").alias("n_urls"))


def batch_count(total: int, size: int = DEFAULT_BATCH_SIZE) -> int:
    return math.ceil(total / size)
