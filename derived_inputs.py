"""Inputs that Spark derives from the given tables, for operators the raw tables do not exercise.

Nothing is dropped or capped: every page, line or document takes part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaudit.fixed_values import SITEMAP_NAMESPACE
from glossaudit.operators.slicing import with_position
from glossaudit.sources.pages import read_pages
from glossaudit.sources.sitemaps import parse_sitemaps, url_list
from glossaudit.storage import staged

SITEMAP_BASE = "https://maps.example.org"

# Page markup by declared language: (what, by what). The same list rewrites the oracle's pages.
REWRITES = {
    "en": [("<article>", "<main>"), ("</article>", "</main>")],
    "fr": [("<article>", '<div class="wide  content">'), ("</article>", "</div>")],
    "de": [("<article>", "<div id='content'>"), ("</article>", "</div>"), ("<p><b>", '<p id="q" lang="de"><b>')],
    "es": [("<article>", "<section class=body>"), ("</article>", "</section>"),
           ('<html lang="es">', '<html xml:lang=" EN-GB ">')],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def rewritten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with other content roots, language markup and declarations."""
    html = F.col("html")
    rewritten = html
    for lang, steps in REWRITES.items():
        changed = html
        for what, by in steps:
            changed = F.replace(changed, F.lit(what), F.lit(by))
        rewritten = F.when(F.contains(html, F.lit(f'<html lang="{lang}">')), changed).otherwise(rewritten)
    return pages(spark, sf_dir).withColumn("html", rewritten)


def pages_as_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with html as bytes; three of four hold bytes that are not UTF-8 behind their first ``<p>`` (or at the end)."""
    at = F.locate("<p>", F.col("html"))
    at = F.when(at > 0, at + 2).otherwise(F.char_length("html"))
    kind = F.col("page_id") % 4  # whole, a byte that never occurs, a character cut after its first or second byte
    bad = F.when(kind == 1, F.unhex(F.lit("FF"))).when(kind == 2, F.unhex(F.lit("C3"))).when(
        kind == 3, F.unhex(F.lit("E282"))).otherwise(F.unhex(F.lit("")))
    cut = [F.substr("html", F.lit(1), at).cast("binary"), bad, F.substr("html", at + 1).cast("binary")]
    return pages(spark, sf_dir).where("html <> ''").withColumn("html", F.concat(*cut))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found at least five times, such as licence notices: what a user would ignore."""
    return document_lines(spark, sf_dir).groupBy("value").agg(F.count("*").alias("n")).where("n >= 5").select("value")


def url_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url")


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, url): the URLs the sitemaps resolve to, some of them twice, and some that were never landed."""
    documents, root = sitemaps(spark, sf_dir)
    resolved = url_list(staged(parse_sitemaps(documents), "sitemaps"), root)
    kind = F.col("ord") % 7
    more = resolved.where(kind.isin(0, 3)).select(
        "ord", F.lit(1).alias("copy"), F.when(kind == 3, F.concat("url", F.lit("/gone"))).otherwise(F.col("url")).alias("url"))
    both = resolved.withColumn("copy", F.lit(0)).unionByName(more).withColumnRenamed("ord", "place")
    return with_position(both, "place", "copy").select("ord", "url")


def sitemaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(sitemap_url, xml) documents listing all page URLs through two levels of indexes.

    A file holds about the cube root of the number of pages, so no group grows with the table.
    """
    urls = url_table(spark, sf_dir)
    per_file = max(2, math.ceil(urls.count() ** (1 / 3)))

    def xml(rows: DataFrame, level: str, root: str, item: str, extra: str) -> DataFrame:
        escaped = F.replace(F.replace("loc", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        entry = F.concat(F.lit(f"<{item}>{extra}<loc> "), escaped, F.lit(f"</loc></{item}>"))
        grouped = rows.groupBy(F.floor(F.col("ord") / per_file).alias("ord")).agg(
            F.sort_array(F.collect_list(F.struct("ord", entry.alias("entry")))).alias("entries"))
        return grouped.select(
            "ord",
            F.concat(F.lit(f"{SITEMAP_BASE}/{level}-"), F.col("ord").cast("string"), F.lit(".xml")).alias("loc"),
            F.concat(
                F.lit(f'<?xml version="1.0" encoding="UTF-8"?><{root} xmlns="{SITEMAP_NAMESPACE}"'
                      ' xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'),
                F.array_join("entries.entry", ""),
                F.lit(f"<{item}><loc> </loc></{item}></{root}>")).alias("xml"))

    image = "<image:image><image:loc>https://img.example.org/x.png</image:loc></image:image>"
    leaves = xml(urls.withColumnRenamed("url", "loc"), "leaf", "urlset", "url", image)
    middle = xml(leaves.select("ord", "loc"), "part", "sitemapindex", "sitemap", "")
    top = xml(middle.select("ord", "loc"), "index", "sitemapindex", "sitemap", "")
    documents = leaves.unionByName(middle).unionByName(top).select(F.col("loc").alias("sitemap_url"), "xml")
    return documents, f"{SITEMAP_BASE}/index-0.xml"
