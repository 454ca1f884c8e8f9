"""Pages -> tokens, elements, content roots, text blocks. Narrow operators: no shuffle anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaudit.functions import html
from glossaudit.params import AuditParams


def html_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, token): every token of every page."""
    return pages.select("page_id", F.posexplode(html.tokens("html")).alias("pos", "t")).select(
        "page_id", "pos", "t.kind", "t.tag", "t.token")


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, end_pos, depth, parent_pos, tag): pre-order intervals instead of pointers."""
    return pages.select("page_id", F.inline(html.elements("html"))).select(
        "page_id", "pos", "end_pos", "depth", "parent_pos", "tag")


def page_declared_lang(pages: DataFrame) -> DataFrame:
    """(page_id, declared_lang): null if nothing is declared."""
    return pages.select("page_id", html.page_language("html").alias("declared_lang"))


def content_roots(pages: DataFrame) -> DataFrame:
    """(page_id, root_tag, root_pos, root_end): null where the whole document is the root."""
    return pages.select("page_id", html.content_root("html").alias("root")).select(
        "page_id", F.col("root.tag").alias("root_tag"), F.col("root.pos").alias("root_pos"),
        F.col("root.end_pos").alias("root_end"))


def lang_scope(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, scoped): is the element inside explicit language markup?"""
    return pages.select("page_id", F.inline(html.elements("html"))).select(
        "page_id", "pos", "tag", "scoped")


def element_text(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text): text of every element, its descendants included."""
    return pages.select("page_id", F.inline(html.element_texts("html")))


def text_blocks(pages: DataFrame, params: AuditParams = AuditParams()) -> DataFrame:
    """Leaf text blocks of the content root, numbered in document order from 0.

    Returns the columns of ``pages`` without ``html``, plus declared_lang, idx, text, tag,
    classes and id.
    """
    kept = [c for c in pages.columns if c not in ("html", "status")]
    parsed = html.parsed_page("html", params.min_length, params.prune_skipped)
    # Two columns before the explode, so that an exploded row does not carry all blocks of its page;
    # the outer form, because Spark would test the blocks of an inner one by parsing once more.
    return (
        pages.select(*kept, parsed.alias("parsed"))
        .select(*kept, F.col("parsed.declared_lang").alias("declared_lang"), F.col("parsed.blocks").alias("blocks"))
        .select(*kept, "declared_lang", F.posexplode_outer("blocks").alias("idx", "block"))
        .where("idx IS NOT NULL")
        .select(*kept, "declared_lang", "idx", "block.*")
    )


def element_attributes(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, classes, id): class list and id of every element, empty if absent."""
    return pages.select("page_id", F.inline(html.element_attributes("html")))
