"""Report rows and sinks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaudit.fixed_values import REPORT_COLUMNS
from glossaudit.functions.text import csv_safe, json_for_script, timestamp_name
from glossaudit.operators.findings import scan_summary
from glossaudit.operators.slicing import with_position

PLACE = ["page_id", "seq"]  # where a finding stands among all of a scan


def placed_rows(issues: DataFrame, urls: DataFrame, sitemap_url: str, scan_time: str) -> DataFrame:
    """page_id and seq, then the issues with the four scan columns in front. No issue, no row.

    The scan columns are scalar subqueries: computed once, then constants for every row. ``issues``
    is read twice and should be a staged table.
    """
    summary = scan_summary(urls, issues)
    return issues.select(
        "*", F.lit(sitemap_url).alias("sitemap_url"),
        summary.select("total_urls").scalar().alias("total_urls"),
        summary.select("flagged_urls").scalar().alias("flagged_urls"),
        F.lit(scan_time).alias("scan_time"),
    ).select(*PLACE, *REPORT_COLUMNS)


def report_rows(issues: DataFrame, urls: DataFrame, sitemap_url: str, scan_time: str) -> DataFrame:
    """The columns of a report; see :func:`placed_rows`, which a report in page order is written from."""
    return placed_rows(issues, urls, sitemap_url, scan_time).select(*REPORT_COLUMNS)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows that have a place sorted by it, over partitions that hold one range after the other.

    Written, the parts by name and the rows of each part are in page order, and no task sorts more than its range. The
    ranges come from a sample, so ``rows`` should be a staged table. Rows without a place stay as they are.
    """
    return rows.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE) if set(PLACE) <= set(rows.columns) else rows


def scan_scalars(issues: DataFrame, urls: DataFrame, sitemap_url: str, scan_time: str) -> DataFrame:
    """One row: sitemap_url, total_urls, flagged_urls, scan_time; also when there is no issue."""
    return scan_summary(urls, issues).select(
        F.lit(sitemap_url).alias("sitemap_url"), "total_urls", "flagged_urls", F.lit(scan_time).alias("scan_time"))


def csv_safe_columns(rows: DataFrame) -> DataFrame:
    """Guard every string column against spreadsheet formulas; other types stay as they are."""
    return rows.select(*[
        csv_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in rows.schema.fields
    ])


def issues_json(issues: DataFrame, *columns: str) -> DataFrame:
    """(json): one JSON object per issue, safe inside a script element."""
    fields = columns or tuple(issues.columns)
    return issues.select(json_for_script(F.struct(*fields)).alias("json"))


def scan_stamp(spark, at: datetime | None = None) -> tuple[str, str]:
    """(ISO time, time for file names): one moment for all reports of a run."""
    moment = at or datetime.now(timezone.utc).replace(tzinfo=None)
    iso = moment.isoformat()
    text: Column = timestamp_name(F.to_timestamp_ntz(F.lit(moment.strftime("%Y-%m-%dT%H:%M:%S"))))
    return iso, spark.range(1).select(text).first()[0]


def write_csv(report: DataFrame, output: str, stamp: str) -> str:
    """Write ``output/report_<stamp>`` as CSV with a header; an existing report is an error.

    Rows of :func:`placed_rows` are written in page order, see :func:`in_order`. An empty report still has its header,
    from one empty part.
    """
    path = f"{output}/report_{stamp}"
    csv_safe_columns(in_order(report).select([c for c in report.columns if c not in PLACE])).write.mode("error").csv(
        path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)
    return path


def write_json(issues: DataFrame, output: str, stamp: str, scan: DataFrame | None = None) -> str:
    """Write the dashboard feed as JSON lines next to the CSV report: ``issues`` in page order, and ``scan`` with its scalars."""
    path = f"{output}/report_{stamp}_json"
    issues_json(in_order(issues)).write.mode("error").text(f"{path}/issues")
    if scan is not None:
        issues_json(scan).coalesce(1).write.mode("error").text(f"{path}/scan")  # one row
    return path


def read_report(spark, path: str, lines: bool = False) -> DataFrame:
    """A saved CSV report; empty cells are empty strings. ``lines`` adds ``line``, the row's number in the whole report."""
    schema = T.StructType([
        T.StructField(c, T.LongType() if c in ("total_urls", "flagged_urls") else T.StringType())
        for c in REPORT_COLUMNS
    ])
    rows = spark.read.schema(schema).csv(
        path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)
    if not lines:
        return rows.fillna("")
    # A part is read by one task from its first row to its last.
    found = rows.select("*", F.col("_metadata.file_name").alias("part_file"), F.monotonically_increasing_id().alias("nth"))
    return with_position(found, "part_file", "nth", name="line").drop("part_file", "nth").fillna("")


def search_report(report: DataFrame, words: str = "", sort_by: str | None = None, descending: bool = False) -> DataFrame:
    """Rows in which any text column contains ``words`` (case ignored), optionally sorted."""
    if words:
        texts = [F.lower(F.col(f.name)) for f in report.schema.fields if isinstance(f.dataType, T.StringType)]
        haystack = F.concat_ws("\n", *texts)
        report = report.where(F.contains(haystack, F.lower(F.lit(words))))
    if sort_by:
        report = report.orderBy(F.desc(sort_by) if descending else F.asc(sort_by))
    return report
