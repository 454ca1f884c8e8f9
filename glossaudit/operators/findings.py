"""From detections to findings: ignore list, confidence, dominant language, WU1 and WU2.

A *page* is whatever ``page`` names; detections are (page, idx, lang, confidence, ...) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaudit.fixed_values import DEFAULT_CONFIDENCE
from glossaudit.functions.text import ignore_key, page_fix, part_fix
from glossaudit.storage import broadcast_if_small, staged

ISSUE_COLUMNS = [
    "url", "declared_lang", "detected_lang", "issue_type", "snippet", "element", "suggested_fix",
]


def drop_ignored(blocks: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """Blocks whose whole text is not an ignored phrase."""
    keyed = blocks.withColumn("ignore_key", ignore_key(F.col(text)))
    return keyed.join(phrases, F.col("ignore_key") == phrases["phrase"], "left_anti").drop("ignore_key")


def only_ignored(blocks: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """The complement of :func:`drop_ignored`."""
    keyed = blocks.withColumn("ignore_key", ignore_key(F.col(text)))
    return keyed.join(phrases, F.col("ignore_key") == phrases["phrase"], "left_semi").drop("ignore_key")


def confident(detections: DataFrame, threshold: float = DEFAULT_CONFIDENCE) -> DataFrame:
    return detections.where(F.col("lang").isNotNull() & (F.col("lang") != "") & (F.col("confidence") >= threshold))


def dominant_language(sure: DataFrame, page: str = "page_id", order: str = "idx") -> DataFrame:
    """(page, dominant_lang, n_blocks): the most frequent language; on a tie the one seen first.

    Counts are combined before the shuffle, so a page of any number of blocks is fine; what is
    compared per page is one row per language.
    """
    per_lang = sure.groupBy(page, "lang").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), "first_seen", "lang")).alias("best")
    return per_lang.groupBy(page).agg(best).select(
        page, F.col("best.lang").alias("dominant_lang"), (-F.col("best.minus_n")).alias("n_blocks"))


def wu1_differs(declared: Column, dominant: Column) -> Column:
    return (declared != "") & (declared != dominant)


def wu1_page_mismatch(declared: DataFrame, dominant: DataFrame, page: str = "page_id") -> DataFrame:
    """One finding per page whose declared language is not its dominant one.

    ``declared`` has one row per page: page, url, declared_lang.
    """
    return (
        declared.join(dominant, page)
        .where(wu1_differs(F.col("declared_lang"), F.col("dominant_lang")))
        .select(
            page, F.lit(0).cast("long").alias("seq"), "url", "declared_lang",
            F.col("dominant_lang").alias("detected_lang"),
            F.lit("WU1").alias("issue_type"), F.lit("").alias("snippet"), F.lit("html").alias("element"),
            page_fix(F.col("declared_lang"), F.col("dominant_lang")).alias("suggested_fix"))
    )


def wu2_part_mismatch(
    sure: DataFrame, dominant: DataFrame, page: str = "page_id", order: str = "idx",
) -> DataFrame:
    """One finding per confident block in another language than the dominant one of its page.

    The declared_lang column holds the dominant language. ``sure`` carries url, snippet, element.
    """
    return (
        sure.join(dominant, page)
        .where(F.col("lang") != F.col("dominant_lang"))
        .select(
            page, (F.col(order) + 1).cast("long").alias("seq"), "url", F.col("dominant_lang").alias("declared_lang"),
            F.col("lang").alias("detected_lang"), F.lit("WU2").alias("issue_type"), "snippet", "element",
            part_fix(F.col("lang")).alias("suggested_fix"))
    )


def findings_by_join(
    sure: DataFrame, declared: DataFrame, page: str, order: str = "idx",
) -> DataFrame:
    """Findings of pages that may hold any number of blocks, WU1 and WU2 together.

    ``sure`` is read three times and should be a staged table. The dominant languages are few
    against the blocks; they are broadcast only after counting, otherwise AQE splits hot pages.
    """
    dominant = broadcast_if_small(staged(dominant_language(sure, page, order), "dominant"), 128)
    return wu1_page_mismatch(declared, dominant, page).unionByName(
        wu2_part_mismatch(sure, dominant, page, order))


def findings_in_pages(sure: DataFrame, declarations: DataFrame) -> DataFrame:
    """(page_id, row, seq, declared_lang, detected_lang, issue_type) of pages that are single rows of HTML.

    ``sure``: page_id, idx, row, lang, ... numbers alone; ``declarations``: row, declared_lang. All blocks of such a
    page came out of one row, so a window over them is bounded by that row. ``row`` names a block of the page (for WU1
    its first one in the dominant language). ``seq`` gives the order: 0 for WU1, block number + 1 for WU2.
    """
    per_lang = Window.partitionBy("page_id", "lang")
    best_first = Window.partitionBy("page_id").orderBy(F.desc("n"), "first_seen", "idx")
    ranked = (
        sure.repartition("page_id").withColumn("n", F.count("*").over(per_lang))
        .withColumn("first_seen", F.min("idx").over(per_lang))
        .withColumn("dominant_lang", F.first("lang").over(best_first))
        .withColumn("leads_page", F.row_number().over(best_first) == 1)
    )
    told = ranked.where(F.col("leads_page") | (F.col("lang") != F.col("dominant_lang"))).join(declarations, "row")
    declared, dominant, lang = F.col("declared_lang"), F.col("dominant_lang"), F.col("lang")

    def issue(seq: Column, said: Column, found: Column, kind: str) -> Column:
        return F.struct(seq.cast("long").alias("seq"), said.alias("declared_lang"), found.alias("detected_lang"),
                        F.lit(kind).alias("issue_type"))

    issues = F.array_compact(F.array(
        F.when(F.col("leads_page") & wu1_differs(declared, dominant), issue(F.lit(0), declared, dominant, "WU1")),
        F.when(lang != dominant, issue(F.col("idx") + 1, dominant, lang, "WU2"))))
    return told.select("page_id", "row", F.explode(issues).alias("issue")).select("page_id", "row", "issue.*")


def described_findings(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Findings with what they show: url, snippet and element of their block, and the suggested fix.

    ``blocks``: row, url, snippet, element. Findings are few against the blocks.
    """
    whole = F.col("issue_type") == "WU1"
    return found.join(blocks, "row").select(
        "page_id", "seq", "url", "declared_lang", "detected_lang", "issue_type",
        F.when(whole, F.lit("")).otherwise(F.col("snippet")).alias("snippet"),
        F.when(whole, F.lit("html")).otherwise(F.col("element")).alias("element"),
        F.when(whole, page_fix(F.col("declared_lang"), F.col("detected_lang"))).otherwise(
            part_fix(F.col("detected_lang"))).alias("suggested_fix"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """One row: flagged_urls (distinct), total_issues."""
    per_url = issues.groupBy("url").agg(F.count("*").alias("n"))
    return per_url.agg(F.count("*").alias("flagged_urls"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_issues"))


def scan_summary(urls: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: total_urls (failed fetches included), flagged_urls (distinct), total_issues."""
    total = urls.agg(F.count("*").alias("total_urls"))
    return issue_summary(issues).select(total.scalar().alias("total_urls"), "flagged_urls", "total_issues")
