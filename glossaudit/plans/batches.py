"""The audit in URL batches that survive an interruption."""

from __future__ import annotations

import math
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from glossaudit import schemas
from glossaudit.operators.langid import LanguageModel
from glossaudit.operators.slicing import url_slice, with_batch
from glossaudit.params import AuditParams
from glossaudit.plans.audit import audit
from glossaudit.storage import fingerprint, spread, staged

MARKS = "batch_id long, first long, last long, n_pages long, digest long, settings string, commit long"
BATCHES_PER_COMMIT = 100_000  # the batches of a commit are broadcast: some 40 bytes each


def _read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``; empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path) if spark.read.parquet(path).columns else spark.createDataFrame([], schema)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise


def completion_marks(spark: SparkSession, output: str) -> DataFrame:
    """The last mark of each batch: which pages its findings cover, under which settings, in which commit."""
    marks = _read_if_there(spark, f"{output}/done", MARKS)
    fields = [f.split()[0] for f in MARKS.split(", ")[1:]]
    latest = marks.groupBy("batch_id").agg(F.max_by(F.struct(*fields), "commit").alias("mark"))
    return latest.select("batch_id", "mark.*")


def audit_settings(model: LanguageModel, phrases: DataFrame | None, params: AuditParams) -> str:
    """What findings depend on besides the pages: parameters, the model's scores, the ignored phrases."""
    ignored = "none" if phrases is None else fingerprint(phrases.distinct(), "phrase")
    return f"{replace(params, offset=0, limit=0)} model {model.fingerprint()} phrases {ignored}"


def page_digests(pages: DataFrame, params: AuditParams = AuditParams()) -> DataFrame:
    """(page_id, key), written once: a page's digest covers its address, its status and its HTML.

    Of a slice only the pages of its batches are read: no others decide whether these are done.
    """
    said = [c for c in ("page_id", "url", "status", "html") if c in pages.columns]
    size, start = params.batch_size, max(params.offset, 0)
    first, end = start // size * size, math.ceil((start + params.limit) / size) * size
    concerned = url_slice(pages, first, end - first if params.limit > 0 else 0, "page_id")
    return staged(concerned.select("page_id", F.xxhash64(*said).alias("key")), "digests")


def pending_batches(digests: DataFrame, output: str, settings: str, params: AuditParams) -> DataFrame:
    """(batch_id, first, last, n_pages, digest) of the batches of the slice whose mark does not cover them.

    A batch covers the pages of the slice and those of its mark. It is done if its mark names just these pages, by
    range, number and digest of their content, under the same settings. ``digests``: see :func:`page_digests`; the pages
    themselves are not read.
    """
    narrow = with_batch(digests, params.batch_size, "page_id")
    marks = completion_marks(digests.sparkSession, output).select(
        "batch_id", *(F.col(c).alias(f"old_{c}") for c in ("first", "last", "n_pages", "digest", "settings")))
    wanted = url_slice(narrow, params.offset, params.limit, "page_id").groupBy("batch_id").agg(
        F.min("page_id").alias("low"), F.max("page_id").alias("high")).join(marks, "batch_id", "left")
    wanted = wanted.withColumns({"low": F.least("low", "old_first"), "high": F.greatest("high", "old_last")})
    covered = narrow.join(wanted, "batch_id").where(F.col("page_id").between(F.col("low"), F.col("high")))
    old = [c for c in wanted.columns if c.startswith("old_")]
    found = covered.groupBy("batch_id", *old).agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n_pages"),
        F.sum(F.shiftright("key", 24)).alias("digest"))
    same = F.lit(True)
    for name in ("first", "last", "n_pages", "digest"):
        same = same & F.col(name).eqNullSafe(F.col(f"old_{name}"))
    done = same & F.col("old_settings").eqNullSafe(F.lit(settings))
    return found.where(~done).select("batch_id", "first", "last", "n_pages", "digest")


def run_batches(
    pages: DataFrame, model: LanguageModel, output: str, phrases: DataFrame | None = None,
    params: AuditParams = AuditParams(), batches_per_commit: int = BATCHES_PER_COMMIT,
) -> int:
    """Audit the batches that are not done yet; returns how many were audited.

    ``page_id`` is the position of a page in the URL list (see ``slicing.with_position``). A commit audits up to
    ``batches_per_commit`` batches, writes their findings to ``output/findings/commit=T`` and then their completion
    marks to ``output/done``. A batch is audited again if any of its pages, the model's scores, the ignored phrases or the
    parameters have changed. Only what a batch's last mark points to counts, so neither a crash between the two nor
    findings of an earlier run are ever read. The first failing commit stops the run, and the next run starts there.
    Pages are read by the ids of a commit's batches, and moved only if their table is so small that it would not keep all
    cores busy.
    """
    if not 0 < batches_per_commit <= BATCHES_PER_COMMIT:
        raise ValueError(f"batches_per_commit must be between 1 and {BATCHES_PER_COMMIT}")
    settings = audit_settings(model, phrases, params)
    pending = staged(pending_batches(page_digests(pages, params), output, settings, params), "pending")
    total = pending.agg(F.min("batch_id").alias("low"), F.max("batch_id").alias("high"), F.count("*").alias("n")).first()
    plain, commit = replace(params, offset=0, limit=0), 0
    for low in range(total["low"], total["high"] + 1, batches_per_commit) if total["n"] else ():
        part = pending.where(F.col("batch_id").between(low, low + batches_per_commit - 1))
        if part.isEmpty():
            continue
        commit = max(commit + 1, time.time_ns())
        edges = F.broadcast(part.select(F.col("batch_id").alias("of_batch"), "first", "last"))
        inside = with_batch(pages, params.batch_size, "page_id").where(F.col("page_id").between(
            low * params.batch_size, (low + batches_per_commit) * params.batch_size - 1))  # pruned at the scan
        inside = inside.join(edges, (F.col("batch_id") == F.col("of_batch"))
                             & F.col("page_id").between(F.col("first"), F.col("last"))).select(pages.columns)
        inside = spread(inside, like=pages)  # the join hides how small the table is, and few files would be few tasks
        issues = with_batch(audit(inside, model, phrases, plain), params.batch_size, "page_id")
        issues.write.mode("overwrite").parquet(f"{output}/findings/commit={commit}")
        marks = part.withColumns({"settings": F.lit(settings), "commit": F.lit(commit)})
        marks.write.mode("append").parquet(f"{output}/done")
    return total["n"]


def batch_findings(spark: SparkSession, output: str) -> DataFrame:
    """(batch_id, findings) of all batches that are done; empty before the first."""
    schema = f"{schemas.ISSUES.simpleString()[7:-1].replace(':', ' ')}, batch_id bigint, commit bigint"
    found = _read_if_there(spark, f"{output}/findings", schema)
    return found.join(completion_marks(spark, output).select("batch_id", "commit"), ["batch_id", "commit"]).drop("commit")


def write_batch_reports(spark: SparkSession, output: str, folder: str) -> None:
    """The findings as CSV, a folder ``batch_id=N`` for each batch that has any; clustered, so few files each."""
    rows = batch_findings(spark, output).repartition("batch_id").sortWithinPartitions("batch_id", "page_id", "seq")
    rows.write.partitionBy("batch_id").csv(folder, header=True, escape='"', emptyValue="")
