"""Stages over the documents table, each on all that its predecessor kept; the last one gives token ids.

A stage reads its working tables when its result is computed. Whoever passes ``tables`` owns them and drops them when
the result is written, as ``run`` does; without it they stay below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaudit.llm.bpe import bpe_encode
from glossaudit.llm.mixing import take_mix
from glossaudit.llm.ngram_join import ngram_join
from glossaudit.llm.pii import redact_pii
from glossaudit.llm.quality_rules import filter_quality
from glossaudit.llm.stages import Stages


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Stages | None = None) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return filter_quality(docs, tables or Stages(spark, "quality"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Stages | None = None) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; rows without an id stay."""
    found = ngram_join(docs, stages=tables or Stages(spark, "near-duplicates"))
    spare = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(spare, "doc_id", "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Stages | None = None) -> DataFrame:
    """With personal data replaced."""
    return redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Stages | None = None) -> DataFrame:
    """Each document as often as the mix takes it."""
    return take_mix(docs, stages=tables or Stages(spark, "mixing"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, tables: Stages | None = None) -> DataFrame:
    """doc_id, tokens and n_tokens, one row for each time a document was taken."""
    return bpe_encode(docs).withColumn("n_tokens", F.size("tokens").cast("long"))


STAGES = [
    ("quality rules", quality_stage), ("near duplicates", near_duplicates_stage), ("personal data", pii_stage),
    ("mixing", mixing_stage), ("encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written and reread; its working tables, and the result of the stage
    before it, are deleted then."""
    docs, results, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stages(spark, "pipeline"), None
    for name, stage in STAGES:
        tables, table = Stages(spark, f"pipeline-{name.replace(' ', '-')}"), name.replace(" ", "-")
        docs = results.keep(stage(spark, docs, sf_dir, tables), table)
        tables.drop_all()
        if before:
            results.drop(before)
        before = table
    return docs
