"""The audit of a folder to which pages keep being added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from glossaudit import schemas
from glossaudit.operators.langid import LanguageModel
from glossaudit.params import AuditParams
from glossaudit.plans.audit import audit
from glossaudit.storage import broadcast_if_small


def start_incremental_audit(
    spark: SparkSession, source: str, schema: T.StructType, output: str, checkpoint: str,
    model: LanguageModel, phrases: DataFrame | None = None, params: AuditParams = AuditParams(),
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Audit what has arrived and stop; call again for what arrives later.

    Findings concern one page each, so every micro-batch is a plain audit of its new files. What the chunks have in
    common is which of them landed a URL last: each writes the URLs it saw (``output/landed/chunk=N``) before its findings
    (``output/findings/chunk=N``), and :func:`incremental_findings` merges them by URL. Both folders are overwritten, which
    makes a replay after a failure harmless. Of a URL that a chunk holds several times only the file written last
    counts; a file may list it twice.
    """
    def audit_chunk(pages: DataFrame, chunk: int) -> None:
        if "status" not in pages.columns:
            pages = pages.withColumn("status", F.lit(200))
        here = pages.sparkSession
        last = pages.groupBy("url").agg(F.max(F.struct("landed_at", "landed_in")).alias("last"))
        last.select("url", "last.*").write.mode("overwrite").parquet(f"{output}/landed/chunk={chunk}")
        landed = here.read.parquet(f"{output}/landed/chunk={chunk}")
        latest = pages.join(broadcast_if_small(landed.select("url", "landed_in"), 400), ["url", "landed_in"], "left_semi")
        found = audit(latest.select("page_id", "url", "status", "html"), model, phrases, params)
        found.write.mode("overwrite").parquet(f"{output}/findings/chunk={chunk}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (
        arriving.select("*", F.col("_metadata.file_modification_time").alias("landed_at"), F.col("_metadata.file_path").alias("landed_in"))
        .writeStream.foreachBatch(audit_chunk)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All chunks at ``path``; empty before the first."""
    try:
        return spark.read.option("basePath", path).schema(schema).parquet(f"{path}/chunk=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def incremental_findings(spark: SparkSession, output: str) -> DataFrame:
    """The findings of each URL from the chunk that landed it last; empty before the first chunk.

    A page that lands again replaces its earlier findings, also where it has none any more. The merge compares one
    number per URL and chunk; pages are not read.
    """
    chunk = T.StructField("chunk", T.LongType())
    landed = _chunks(spark, f"{output}/landed", T.StructType([T.StructField("url", T.StringType()), chunk]))
    found = _chunks(spark, f"{output}/findings", T.StructType([*schemas.ISSUES.fields, chunk]))
    latest = landed.groupBy("url").agg(F.max("chunk").alias("chunk"))
    return found.join(latest, ["url", "chunk"], "left_semi")
