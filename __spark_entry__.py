
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import derived_inputs as inputs  # noqa: E402
import oracles  # noqa: E402
from glossaudit.functions import text  # noqa: E402
from glossaudit.operators import dom, findings, langid, report, slicing  # noqa: E402
from glossaudit.params import AuditParams  # noqa: E402
from glossaudit.plans import audit as audits  # noqa: E402
from glossaudit.plans import batches  # noqa: E402
from glossaudit.sources import pages as page_source  # noqa: E402
from glossaudit.sources import phrases as phrase_source  # noqa: E402
from glossaudit.sources import sitemaps as sitemap_source  # noqa: E402
from glossaudit.storage import stage_path, staged  # noqa: E402
from glossaudit.streaming import incremental  # noqa: E402

if importlib.util.find_spec("glossaudit.llm") and importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline  # noqa: E402
    from glossaudit.llm import queries as llm  # noqa: E402
else:  # the rest stands without this subpackage
    llm = None

ENTRY_DIR = "/root/testdata/sf0.001"
ARGUMENTS = {
    "offset": 60, "limit": 120, "batch_size": 40, "sitemap_url": "https://maps.example.org/index-0.xml",
    "scan_time": "2024-05-06T07:08:09", "search": 'change <html lang="en"',
    "temperature": 40,
}
Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents")


_MODELS: dict[tuple[str, ...], langid.LanguageModel] = {}


def _trained(spark: SparkSession, sf: str) -> langid.LanguageModel:
    return langid.train(page_source.spread(_documents(spark, sf)))


def _model(spark: SparkSession, sf: str) -> langid.LanguageModel:
    """The model of a data folder: trained and written once per application, then shared."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = _trained(spark, sf)
    return _MODELS[key]


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    return page_source.audit_input(inputs.pages(spark, sf))


def _rewritten(spark: SparkSession, sf: str) -> DataFrame:
    return page_source.audit_input(inputs.rewritten_pages(spark, sf))


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    return staged(phrase_source.phrases_from_lines(inputs.repeated_lines(spark, sf)), "phrases")


# --- Sources, slices, batches --------------------------------------------------------------------

def usable_pages(spark: SparkSession, sf: str) -> DataFrame:
    usable = page_source.usable_pages(inputs.pages(spark, sf))
    return usable.select("page_id", "url", "status", F.char_length("html").alias("html_chars"))


def _by_status(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    """Pages of which some failed, some are errors, and some are empty."""
    kind = F.col("page_id") % 5
    pages = inputs.pages(spark, sf).withColumns({
        "status": F.when(kind == 0, 0).when(kind == 1, 404).otherwise(200),
        "html": F.when(kind == 2, "").otherwise(F.col("html"))})
    return page_source.usable_pages(pages, strict).select("page_id", "url", "status", F.char_length("html").alias("html_chars"))


def usable_pages_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return _by_status(spark, sf, strict=False)


def usable_pages_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _by_status(spark, sf, strict=True)


def _landed_as_bytes(spark: SparkSession, sf: str) -> DataFrame:
    folder = stage_path(spark, "landed")
    inputs.pages_as_bytes(spark, sf).write.parquet(folder)
    return page_source.read_pages(spark, folder)


def text_blocks_from_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages landed as bytes, many of them not valid UTF-8."""
    return dom.text_blocks(page_source.audit_input(_landed_as_bytes(spark, sf)))


def audit_from_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit(_landed_as_bytes(spark, sf), _model(spark, sf))


def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    documents, _ = inputs.sitemaps(spark, sf)
    return sitemap_source.sitemap_entries(sitemap_source.parse_sitemaps(documents))


def _parsed_sitemaps(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    documents, root = inputs.sitemaps(spark, sf)
    return staged(sitemap_source.parse_sitemaps(documents), "sitemaps"), root


def resolved_urls(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap_source.url_list(*_parsed_sitemaps(spark, sf))


def url_count(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap_source.url_count(*_parsed_sitemaps(spark, sf))


def ignore_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_source.phrases_from_lines(inputs.document_lines(spark, sf))


def ignore_phrases_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The list as its text files give it."""
    folder = stage_path(spark, "phrases")
    inputs.document_lines(spark, sf).write.text(folder)
    return phrase_source.load_ignore_phrases(spark, folder)


def url_slice(spark: SparkSession, sf: str) -> DataFrame:
    urls = slicing.with_position(inputs.url_table(spark, sf).withColumnRenamed("ord", "page_id"), "page_id")
    return slicing.url_slice(urls, ARGUMENTS["offset"], ARGUMENTS["limit"]).select("ord", "url")


def url_batches(spark: SparkSession, sf: str) -> DataFrame:
    return slicing.url_batches(inputs.url_table(spark, sf), ARGUMENTS["batch_size"])


# --- Pages -----------------------------------------------------------------------------------------

def _on_pages(operator: Callable[[DataFrame], DataFrame], source: Query = _plain) -> Query:
    return lambda spark, sf: operator(source(spark, sf))


# --- Text functions --------------------------------------------------------------------------------

def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    normal = text.flatten_newlines(text.normalize_text(F.col("text")))
    return _documents(spark, sf).select("doc_id", normal.alias("normalized"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def element_descriptor(spark: SparkSession, sf: str) -> DataFrame:
    described = text.element_descriptor(F.col("tag"), F.col("classes"), F.col("id")).alias("element")
    return dom.element_attributes(_rewritten(spark, sf)).select("page_id", "pos", described)


def csv_safe(spark: SparkSession, sf: str) -> DataFrame:
    words = _documents(spark, sf).select(F.explode(F.split("text", " ")).alias("cell"))
    marks = inputs.table(spark, sf, "conversations").select(
        F.explode(F.split("text", "(?i)[a-z0-9]+")).alias("cell"))
    cells = words.unionByName(marks).groupBy("cell").agg(F.count("*").alias("n"))
    return cells.select("cell", text.csv_safe(F.col("cell")).alias("safe"), "n")


def blank_guard(spark: SparkSession, sf: str) -> DataFrame:
    counted = inputs.document_lines(spark, sf).groupBy("value").agg(F.count("*").alias("n"))
    return counted.select("value", "n", text.is_blank(F.col("value")).alias("blank"))


def clean_label(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("__label__"), "lang", F.lit("_"), "source")
    return _documents(spark, sf).select("doc_id", text.clean_label(raw).alias("label"))


def timestamp_name(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "events").select("event_id", text.timestamp_name(F.col("ts")).alias("name"))


def is_remote(spark: SparkSession, sf: str) -> DataFrame:
    local = F.replace("url", F.lit("://"), F.lit(":/"))
    return inputs.table(spark, sf, "pages").select(
        "page_id", text.is_remote(F.col("url")).alias("remote"), text.is_remote(local).alias("local_remote"))


def issues_json(spark: SparkSession, sf: str) -> DataFrame:
    return report.issues_json(audit_documents(spark, sf), "page", "seq", *findings.ISSUE_COLUMNS)


# --- Detection -------------------------------------------------------------------------------------

def lang_model(spark: SparkSession, sf: str) -> DataFrame:
    return _trained(spark, sf).as_table()


def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    texts = page_source.spread(_documents(spark, sf).select("doc_id", "text"))
    return langid.detect_language(texts, _model(spark, sf)).withColumn("confidence", F.round("confidence", 4))


def ignored_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = dom.text_blocks(_plain(spark, sf))
    return findings.only_ignored(blocks, _phrases(spark, sf)).select("page_id", "idx", "text")


def _sure(spark: SparkSession, sf: str) -> DataFrame:
    return findings.confident(audits.page_detections(inputs.pages(spark, sf), _model(spark, sf)))


def confident_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _sure(spark, sf).select("page_id", "idx", "lang", F.round("confidence", 4).alias("confidence"))


def confident_blocks_flat(spark: SparkSession, sf: str) -> DataFrame:
    """At a temperature at which not every block is certain."""
    params = AuditParams(temperature=float(ARGUMENTS["temperature"]))
    found = findings.confident(audits.page_detections(inputs.pages(spark, sf), _model(spark, sf), None, params), params.confidence)
    return found.select("page_id", "idx", "lang", F.round("confidence", 4).alias("confidence"))


def _lines_of(spark: SparkSession, sf: str, fold: int) -> DataFrame:
    """Lines long enough to be blocks, of a fifth of the documents."""
    lines = _documents(spark, sf).where(F.col("doc_id") % 5 == fold).select(
        "doc_id", F.col("lang").alias("label"), F.posexplode(F.split("text", "\n")).alias("nth", "text"))
    return lines.where(F.char_length("text") >= AuditParams().min_length)


def _calibrated(spark: SparkSession, sf: str) -> langid.LanguageModel:
    """Trained on three fifths of the documents, calibrated on a fourth one."""
    key = (spark.sparkContext.applicationId, sf, "calibrated")
    if key not in _MODELS:
        model = langid.train(page_source.spread(_documents(spark, sf).where(F.col("doc_id") % 5 >= 2)))
        _MODELS[key] = langid.calibrated(model, page_source.spread(_lines_of(spark, sf, 0)), lang="label")
    return _MODELS[key]


def confidence_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """On the last fifth: the fitted temperature, and by tenths of confidence how often detections are right."""
    model = _calibrated(spark, sf)
    told = langid.detect_language(page_source.spread(_lines_of(spark, sf, 1)), model)
    return langid.calibration(told).select(
        F.lit(model.temperature).alias("temperature"), "bin", "n", F.round("confidence", 4).alias("confidence"),
        F.round("accuracy", 4).alias("accuracy"))


def confident_blocks_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """At the default threshold, which blocks a model is sure of that knows how sure it may be."""
    found = findings.confident(audits.page_detections(inputs.pages(spark, sf), _calibrated(spark, sf)))
    return found.select("page_id", "idx", "lang", F.round("confidence", 4).alias("confidence"))


# --- Findings --------------------------------------------------------------------------------------

def dominant_language(spark: SparkSession, sf: str) -> DataFrame:
    return findings.dominant_language(_sure(spark, sf))


def dominant_language_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = audits.line_blocks(page_source.spread(_documents(spark, sf)))
    return findings.dominant_language(findings.confident(audits.text_detections(lines, _model(spark, sf))), "page")


def _rewritten_sure(spark: SparkSession, sf: str) -> DataFrame:
    detected = audits.page_detections(inputs.rewritten_pages(spark, sf), _model(spark, sf), _phrases(spark, sf))
    return staged(findings.confident(detected), "detections")


def wu1_page_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    source = _rewritten(spark, sf)
    declared = dom.page_declared_lang(source).join(source.select("page_id", "url"), "page_id")
    return findings.wu1_page_mismatch(declared, findings.dominant_language(_rewritten_sure(spark, sf)))


def wu2_part_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    sure = _rewritten_sure(spark, sf).drop("declared_lang")
    return findings.wu2_part_mismatch(sure, findings.dominant_language(sure))


def page_issues(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit(inputs.rewritten_pages(spark, sf), _model(spark, sf), _phrases(spark, sf))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit(inputs.pages(spark, sf), _model(spark, sf))


def audit_documents(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_documents(page_source.spread(_documents(spark, sf)), _model(spark, sf))


def audit_lines(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_lines(page_source.spread(_documents(spark, sf)), _model(spark, sf))


def audit_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = page_source.spread(inputs.table(spark, sf, "conversations"))
    return audits.audit_conversations(turns, _model(spark, sf))


def audit_quoting_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that quote documents, each document in one of them."""
    turns, documents = inputs.table(spark, sf, "conversations"), _documents(spark, sf)
    quotes = documents.select(
        (F.col("doc_id") % turns.select("conv_id").distinct().count()).alias("conv_id"), (F.col("doc_id") + 1000).alias("turn"),
        F.lit("quote").alias("role"), "text")
    return audits.audit_conversations(page_source.spread(turns.unionByName(quotes)), _model(spark, sf))


def _scan(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    params = AuditParams(offset=ARGUMENTS["offset"], limit=ARGUMENTS["limit"])
    return audits.scan(inputs.listed_urls(spark, sf), inputs.rewritten_pages(spark, sf), _model(spark, sf), None, params)


def sitemap_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf)[1]


def sitemap_scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return findings.scan_summary(*_scan(spark, sf))


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_summary(inputs.rewritten_pages(spark, sf), _model(spark, sf), _phrases(spark, sf))


def sitemap_audit_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every listed URL, not a slice of them."""
    return audits.scan(inputs.listed_urls(spark, sf), inputs.rewritten_pages(spark, sf), _model(spark, sf))[1]


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    issues = staged(page_issues(spark, sf), "issues")
    return report.report_rows(issues, inputs.pages(spark, sf), ARGUMENTS["sitemap_url"], ARGUMENTS["scan_time"])


def report_search(spark: SparkSession, sf: str) -> DataFrame:
    return report.search_report(report_rows(spark, sf), ARGUMENTS["search"], sort_by="url")


def csv_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report as a CSV file gives it back."""
    return report.read_report(spark, report.write_csv(report_rows(spark, sf), stage_path(spark, "report"), "csv"))


def csv_report_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the report as they stand in it, page by page."""
    issues = staged(page_issues(spark, sf), "issues")
    rows = staged(report.placed_rows(issues, inputs.pages(spark, sf), ARGUMENTS["sitemap_url"], ARGUMENTS["scan_time"]), "report")
    return report.read_report(spark, report.write_csv(rows, stage_path(spark, "report"), "csv"), lines=True)


def json_feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    issues, folder = staged(page_issues(spark, sf), "issues"), stage_path(spark, "feed")
    summary = report.scan_scalars(issues, inputs.pages(spark, sf), ARGUMENTS["sitemap_url"], ARGUMENTS["scan_time"])
    return spark.read.text(report.write_json(issues, folder, "feed", summary) + "/scan").toDF("json")


# --- Resumable and incremental -----------------------------------------------------------------------

def batched_audit(spark: SparkSession, sf: str) -> DataFrame:
    output = stage_path(spark, "batches")
    params = AuditParams(batch_size=ARGUMENTS["batch_size"])
    batches.run_batches(inputs.pages(spark, sf), _model(spark, sf), output, params=params)
    return batches.batch_findings(spark, output).drop("batch_id")


def batched_audit_in_steps(spark: SparkSession, sf: str) -> DataFrame:
    """First a slice that ends within a batch, then the rest: findings as of one whole audit."""
    output, pages, model = stage_path(spark, "batches"), inputs.rewritten_pages(spark, sf), _model(spark, sf)
    first = AuditParams(batch_size=ARGUMENTS["batch_size"], limit=ARGUMENTS["offset"])
    batches.run_batches(pages, model, output, params=first)
    batches.run_batches(pages, model, output, params=AuditParams(batch_size=ARGUMENTS["batch_size"]))
    return batches.batch_findings(spark, output).drop("batch_id")


def batched_audit_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The same URLs audited again after their HTML has changed: findings as of the pages as they are now."""
    output, model = stage_path(spark, "batches"), _model(spark, sf)
    params = AuditParams(batch_size=ARGUMENTS["batch_size"])
    batches.run_batches(inputs.pages(spark, sf), model, output, params=params)
    batches.run_batches(inputs.rewritten_pages(spark, sf), model, output, params=params)
    return batches.batch_findings(spark, output).drop("batch_id")


def _incremental(spark: SparkSession, sf: str, pages: DataFrame) -> DataFrame:
    arriving, output = stage_path(spark, "arriving"), stage_path(spark, "incremental")
    pages.repartition(4, "page_id").write.parquet(arriving)
    incremental.start_incremental_audit(
        spark, arriving, pages.schema, output, stage_path(spark, "progress"), _model(spark, sf),
        files_per_trigger=2).awaitTermination()
    return incremental.incremental_findings(spark, output).drop("chunk")


def incremental_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(spark, sf, inputs.pages(spark, sf))


def incremental_audit_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(spark, sf, inputs.rewritten_pages(spark, sf))


def incremental_audit_landed_again(spark: SparkSession, sf: str) -> DataFrame:
    """All pages land, then land again with other HTML: only their last findings count."""
    arriving, output, progress = (stage_path(spark, n) for n in ("arriving", "incremental", "progress"))
    for pages in (inputs.pages(spark, sf), inputs.rewritten_pages(spark, sf)):
        pages.repartition(4, "page_id").write.mode("append").parquet(arriving)
        incremental.start_incremental_audit(
            spark, arriving, pages.schema, output, progress, _model(spark, sf), files_per_trigger=4).awaitTermination()
    return incremental.incremental_findings(spark, output).drop("chunk")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the audit rules over the labelled documents."""
    return audit_documents(spark, ENTRY_DIR)


def queries() -> dict[str, Query]:
    """One entry per operator; each reads whole tables."""
    found = {
        "usable_pages": usable_pages,
        "sitemap_entries": sitemap_entries,
        "resolved_urls": resolved_urls,
        "url_count": url_count,
        "ignore_phrases": ignore_phrases,
        "url_slice": url_slice,
        "url_batches": url_batches,
        "html_tokens": _on_pages(dom.html_tokens),
        "html_elements": _on_pages(dom.html_elements),
        "html_elements_rewritten": _on_pages(dom.html_elements, _rewritten),
        "page_declared_lang": _on_pages(dom.page_declared_lang),
        "page_declared_lang_rewritten": _on_pages(dom.page_declared_lang, _rewritten),
        "content_root": _on_pages(dom.content_roots),
        "content_root_rewritten": _on_pages(dom.content_roots, _rewritten),
        "lang_scope": _on_pages(dom.lang_scope),
        "lang_scope_rewritten": _on_pages(dom.lang_scope, _rewritten),
        "element_text": _on_pages(dom.element_text),
        "text_blocks": _on_pages(dom.text_blocks),
        "text_blocks_rewritten": _on_pages(dom.text_blocks, _rewritten),
        "normalize_text": normalize_text,
        "snippets": snippets,
        "element_descriptor": element_descriptor,
        "csv_safe": csv_safe,
        "issues_json": issues_json,
        "lang_model": lang_model,
        "detect_language": detect_language,
        "ignored_blocks": ignored_blocks,
        "confident_blocks": confident_blocks,
        "dominant_language": dominant_language,
        "dominant_language_lines": dominant_language_lines,
        "wu1_page_mismatch": wu1_page_mismatch,
        "wu2_part_mismatch": wu2_part_mismatch,
        "page_issues": page_issues,
        "audit": audit,
        "audit_documents": audit_documents,
        "audit_lines": audit_lines,
        "audit_conversations": audit_conversations,
        "scan_summary": scan_summary,
        "report_rows": report_rows,
        "report_search": report_search,
        "batched_audit": batched_audit,
        "incremental_audit": incremental_audit,
        "usable_pages_by_status": usable_pages_by_status,
        "usable_pages_strict": usable_pages_strict,
        "blank_guard": blank_guard,
        "clean_label": clean_label,
        "timestamp_name": timestamp_name,
        "is_remote": is_remote,
        "confident_blocks_flat": confident_blocks_flat,
        "audit_quoting_conversations": audit_quoting_conversations,
        "sitemap_audit": sitemap_audit,
        "sitemap_scan_summary": sitemap_scan_summary,
        "csv_report": csv_report,
        "json_feed_scan": json_feed_scan,
        "batched_audit_in_steps": batched_audit_in_steps,
        "incremental_audit_rewritten": incremental_audit_rewritten,
        "confidence_calibration": confidence_calibration,
        "confident_blocks_calibrated": confident_blocks_calibrated,
        "incremental_audit_landed_again": incremental_audit_landed_again,
        "batched_audit_after_changes": batched_audit_after_changes,
        "csv_report_in_order": csv_report_in_order,
        "sitemap_audit_whole": sitemap_audit_whole,
        "text_blocks_from_bytes": text_blocks_from_bytes,
        "audit_from_bytes": audit_from_bytes,
        "ignore_phrases_from_file": ignore_phrases_from_file,
    }
    return found | (llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {})


def oracle_sql() -> dict[str, str]:
    """The same results by DuckDB, one statement per query."""
    found = oracles.oracle_statements(ARGUMENTS)
    if llm:
        found |= llm.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return found
