"""Tables written once to the shared folder, with an owner that can drop them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaudit.storage import stage_path


class Stages:
    """Owner of the tables that one run writes. ``keep`` writes and rereads; ``drop`` deletes the named ones, ``drop_all`` all.

    A written table cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        path = stage_path(self.spark, f"{self.name}-{table}")
        df.write.parquet(path)
        self.paths.setdefault(table, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Delete the named tables, and nothing without names; what was read from them is gone too."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            for path in self.paths.pop(table, []):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)

    def drop_all(self) -> None:
        self.drop(*list(self.paths))
