"""Landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaudit.storage import broadcast_if_small, spread, staged


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, status, html) from parquet; a table without status counts as fetched (200).

    HTML landed as bytes is read as UTF-8; what is not valid becomes the replacement character.
    """
    raw = spark.read.parquet(path)
    status = F.col("status").cast("int") if "status" in raw.columns else F.lit(200)
    html = F.col("html")
    if isinstance(raw.schema["html"].dataType, T.BinaryType):
        html = F.make_valid_utf8(html.cast("string"))
    return raw.select("page_id", "url", status.alias("status"), html.alias("html"))


def usable_pages(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Pages that were fetched and are not empty; ``strict`` also drops HTTP errors."""
    usable = (F.col("status") != 0) & (F.col("html") != "")
    if strict:
        usable = usable & (F.col("status") < 400)
    return pages.where(usable)


def scan_input(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of a URL list (ord, url), in its order: page_id is the place in the list.

    A URL that is listed twice is scanned twice, one that was not landed has status 0, and pages that are not listed
    take no part. Of several landed pages of a URL the one with the largest page_id counts. Slice the list first. The
    list with its page ids is written when this is called; pages are moved only if it is too large to broadcast, or if the
    table is so small that it would not keep all cores busy.
    """
    latest = pages.groupBy("url").agg(F.max("page_id").alias("landed_id"))
    listed = staged(urls.select(F.col("ord").cast("long").alias("ord"), "url").join(latest, "url", "left"), "listed")
    landed = pages.select(F.col("page_id").alias("landed_id"), "status", "html")
    found = landed.join(broadcast_if_small(listed.where("landed_id IS NOT NULL"), 250), "landed_id")
    found = spread(found, like=landed)  # few files would be few tasks for all that follows
    missing = listed.where("landed_id IS NULL").withColumns({"status": F.lit(0), "html": F.lit(None).cast("string")})
    columns = [F.col("ord").alias("page_id"), "url", "status", "html"]
    return found.select(*columns).unionByName(missing.select(*columns))


def audit_input(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Usable pages over enough partitions for the cores at hand."""
    return usable_pages(spread(pages), strict)
