"""Whole audits: HTML pages, and labelled text tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from glossaudit.functions.text import collapse_whitespace, element_descriptor, snippet
from glossaudit.operators.dom import text_blocks
from glossaudit.operators.findings import (
    confident, described_findings, drop_ignored, findings_by_join, findings_in_pages, issue_summary)
from glossaudit.operators.langid import LanguageModel, detect_language, language_scores, numbered
from glossaudit.operators.slicing import url_slice
from glossaudit.params import AuditParams
from glossaudit.sources.pages import scan_input, usable_pages
from glossaudit.storage import spread, staged


def described(blocks: DataFrame, *keep: str) -> DataFrame:
    """What a finding shows of a block (bounded in size), next to the text to classify."""
    return blocks.select(
        *keep, snippet(F.col("text")).alias("snippet"),
        element_descriptor(F.col("tag"), F.col("classes"), F.col("id")).alias("element"), "text")


def page_detections(
    pages: DataFrame, model: LanguageModel, phrases: DataFrame | None = None,
    params: AuditParams = AuditParams(),
) -> DataFrame:
    """(page_id, url, declared_lang, idx, snippet, element, lang, confidence) per text block.

    Ignored blocks are absent. The blocks are written once when this is called.
    """
    blocks = page_blocks(pages, phrases, params)
    scores = language_scores(blocks, model, "page_id", "idx", "row", temperature=params.temperature)
    return blocks.drop("text").join(scores.drop("page_id", "idx"), "row").drop("row")


def page_blocks(
    pages: DataFrame, phrases: DataFrame | None, params: AuditParams, seen: Observation | None = None,
) -> DataFrame:
    """The described text blocks of the pages in the slice, written once and numbered.

    ``seen`` counts the pages (``total_urls``) as they are read for it: those that are not usable too. It stands in the
    stage that writes, whose tasks count once each, however often they are tried.
    """
    sliced = spread(url_slice(pages, params.offset, params.limit, "page_id"))
    if seen is not None:
        sliced = sliced.observe(seen, F.count(F.lit(1)).alias("total_urls"))
    blocks = text_blocks(usable_pages(sliced, params.strict), params)
    if phrases is not None:
        blocks = drop_ignored(blocks, phrases)
    return numbered(described(blocks, "page_id", "url", "declared_lang", "idx"), "blocks")


def audit(
    pages: DataFrame, model: LanguageModel, phrases: DataFrame | None = None,
    params: AuditParams = AuditParams(), seen: Observation | None = None,
) -> DataFrame:
    """All findings of a table of pages: (page_id, seq, url, declared_lang, ..., suggested_fix).

    ``page_id`` is the place of a page in the URL list, which ``params`` may slice. Pages are parsed once and their
    blocks written when this is called. Languages are decided on numbers alone; what a finding shows of its block is
    joined to the findings only. Findings are ordered by (page_id, seq); the order is left to whoever writes them.
    ``seen`` observes the number of pages, see :func:`page_blocks`.
    """
    blocks = page_blocks(pages, phrases, params, seen)
    scores = language_scores(blocks, model, "page_id", "idx", "row", temperature=params.temperature)
    sure = confident(scores, params.confidence)
    marked = findings_in_pages(sure, blocks.select("row", "declared_lang"))
    return described_findings(marked, blocks.select("row", "url", "snippet", "element"))


def audit_summary(
    pages: DataFrame, model: LanguageModel, phrases: DataFrame | None = None, params: AuditParams = AuditParams(),
) -> DataFrame:
    """One row: total_urls, flagged_urls, total_issues of an audit, whose pages are counted as it reads them."""
    seen = Observation("scanned pages")
    issues = audit(pages, model, phrases, params, seen)
    return issue_summary(issues).select(F.lit(seen.get["total_urls"]).cast("long").alias("total_urls"), "flagged_urls", "total_issues")


def scan(
    urls: DataFrame, pages: DataFrame, model: LanguageModel, phrases: DataFrame | None = None,
    params: AuditParams = AuditParams(),
) -> tuple[DataFrame, DataFrame]:
    """(scanned pages, findings) of a URL list (ord, url): its slice, in its order, with what was landed.

    The scanned pages hold every URL of the slice, also those that were not landed (status 0), and are what
    ``findings.scan_summary`` counts. They are joined with the pages by URL and read again as they are.
    """
    scanned = scan_input(url_slice(urls, params.offset, params.limit), pages)
    return scanned, audit(scanned, model, phrases, replace(params, offset=0, limit=0))


def text_detections(
    texts: DataFrame, model: LanguageModel, phrases: DataFrame | None = None,
    params: AuditParams = AuditParams(),
) -> DataFrame:
    """Detections for text blocks that do not come from HTML: (page, idx, text, tag, classes, id)."""
    # Filtering inside the array evaluates the text once, and leaves the work behind the spread scan.
    collapsed = F.array(collapse_whitespace(F.col("text")))
    long_enough = F.filter(collapsed, lambda text: F.char_length(text) >= params.min_length)
    blocks = texts.select(*[c for c in texts.columns if c != "text"], F.explode(long_enough).alias("text"))
    if phrases is not None:
        blocks = drop_ignored(blocks, phrases)
    return detect_language(described(blocks, "page", "idx"), model, temperature=params.temperature)


def audit_texts(
    texts: DataFrame, declared: DataFrame, model: LanguageModel, phrases: DataFrame | None = None,
    params: AuditParams = AuditParams(),
) -> DataFrame:
    """The audit rules over any grouping of texts, e.g. documents by source.

    ``texts``: page, idx, text, tag, classes, id; ``declared``: page, declared_lang. A page may
    hold any share of all rows: detections are written once (when this is called), counted with partial
    sums, and compared with their page's dominant language by a join.
    """
    sure = staged(confident(text_detections(texts, model, phrases, params), params.confidence), "detections")
    named = sure.withColumn("url", F.col("page"))
    return findings_by_join(named, declared.withColumn("url", F.col("page")), "page")


def audit_documents(
    documents: DataFrame, model: LanguageModel, params: AuditParams = AuditParams(),
) -> DataFrame:
    """Documents as blocks of their source; the first document's label is what the source declares."""
    texts = documents.select(
        F.col("source").alias("page"), F.col("doc_id").alias("idx"), "text",
        F.lit("document").alias("tag"), F.lit("").alias("classes"), F.col("doc_id").cast("string").alias("id"))
    declared = documents.groupBy(F.col("source").alias("page")).agg(
        F.min(F.struct("doc_id", "lang")).alias("first")).select("page", F.col("first.lang").alias("declared_lang"))
    return audit_texts(texts, declared, model, None, params)


def line_blocks(documents: DataFrame) -> DataFrame:
    """(page, idx, text, tag, classes, id): the lines of every document."""
    return documents.select(
        F.col("doc_id").cast("string").alias("page"), F.posexplode(F.split("text", "\n")).alias("idx", "text"),
        F.lit("line").alias("tag"), F.lit("").alias("classes"), F.lit("").alias("id"))


def audit_lines(
    documents: DataFrame, model: LanguageModel, params: AuditParams = AuditParams(),
) -> DataFrame:
    """Lines as blocks of their document; the document's label is what it declares."""
    declared = documents.select(F.col("doc_id").cast("string").alias("page"), F.col("lang").alias("declared_lang"))
    return audit_texts(line_blocks(documents), declared, model, None, params)


def audit_conversations(
    conversations: DataFrame, model: LanguageModel, params: AuditParams = AuditParams(),
) -> DataFrame:
    """Turns as blocks of their conversation, which declares nothing."""
    texts = conversations.select(
        F.col("conv_id").cast("string").alias("page"), F.col("turn").alias("idx"), "text",
        F.lit("turn").alias("tag"), F.col("role").alias("classes"), F.lit("").alias("id"))
    declared = texts.select("page").distinct().withColumn("declared_lang", F.lit(None).cast("string"))
    return audit_texts(texts, declared, model, None, params)
