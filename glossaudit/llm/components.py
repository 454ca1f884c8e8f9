"""Connected components of an edge table, by alternating star steps; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaudit.llm.stages import Stages


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(id, component): the smallest id reachable, for each id of ``edges`` (a, b).

    Each round links the larger neighbours of a vertex, then its smaller ones, to the smallest of them.
    The table never grows, and the number of rounds grows with the logarithm of the longest path.
    An id without edges has no row. Loops and repeated edges change nothing.
    """
    def tidy(a, b):
        return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()

    now = stages.keep(edges.where("a <> b").select(*tidy("a", "b")).distinct(), "edges")
    before = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(*tidy(F.col("v"), F.col("m"))).where("u <> v").distinct()
        large = stages.keep(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(*tidy(F.col("v"), F.col("m"))).where("u <> v")
        now = stages.keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    ends = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct().join(ends.select("id"), "id", "left_anti")
    return ends.unionByName(roots.select("id", F.col("id").alias("component")))
