"""Bounded samples of labelled texts, for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """text and label (0 or 1) of at most ``rows`` labelled texts, chosen by a hash of the id.

    ``learn`` says which rows of ``labels`` may be learnt from. Null ids and labels are left out; of an id with
    several labels the largest counts. The chosen ids are ``rows`` at most, so they are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
