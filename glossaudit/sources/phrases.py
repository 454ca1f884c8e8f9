"""The user's ignore list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from glossaudit import schemas
from glossaudit.functions.text import ignore_key


def phrases_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(phrase): trimmed, lower-cased, blank lines and repetitions dropped."""
    # A plain filter would be pushed below an aggregation of the lines, which gives a few of many.
    said = F.filter(F.array(ignore_key(F.col(column))), lambda phrase: phrase != "")
    return lines.select(F.explode_outer(said).alias("phrase")).where("phrase IS NOT NULL").distinct()


def load_ignore_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Read one phrase per line; a missing file is an empty list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_phrases(spark)
    return phrases_from_lines(lines)


def no_phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.IGNORE_PHRASES)
