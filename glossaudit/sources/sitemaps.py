"""Sitemaps and sitemap indexes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaudit.fixed_values import MAX_SITEMAP_DEPTH, SITEMAP_NAMESPACE
from glossaudit.functions.text import decode_xml_entities, strip
from glossaudit.operators.slicing import with_position
from glossaudit.storage import staged

ANY_NAMESPACE = "[\"'][^\"']*[\"']"
OUR_NAMESPACE = f"[\"']{SITEMAP_NAMESPACE}[\"']"
COMMENT_RE = "(?s)<!--.*?-->"
ROOT_TAG_RE = r"(?s)^.*?(<[A-Za-z_][^>]*>)"
BINDING_RE = rf"xmlns(?::([\w.-]+))?\s*=\s*{OUR_NAMESPACE}"
# An element that changes the default namespace to another one, with all it holds.
FOREIGN_RE = rf"(?s)<([\w:.-]+)(?=\s[^>]*xmlns\s*=\s*(?!{OUR_NAMESPACE}){ANY_NAMESPACE})[^>]*(?<!/)>.*?</\1\s*>"
CDATA_RE = r"(?s)<!\[CDATA\[(.*?)\]\]>"


def decoded_xml(content: Column) -> Column:
    """XML bytes as text: by byte order mark, else by the declared encoding, else as UTF-8.

    Invalid UTF-8 becomes the replacement character; an encoding that is not known raises.
    """
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    declared = F.upper(F.regexp_extract(head, r"(?s)^(?:\xEF\xBB\xBF)?\s*<\?xml[^>]*?encoding\s*=\s*[\x22\x27]([\w.:-]+)", 1))
    mark = F.hex(F.substring(content, 1, 2))
    latin = F.decode(content, "ISO-8859-1")
    utf8 = F.make_valid_utf8(F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(
        content).cast("string"))
    return (
        F.when(mark.isin("FEFF", "FFFE"), F.decode(content, "UTF-16"))
        .when(mark == "003C", F.decode(content, "UTF-16BE")).when(mark == "3C00", F.decode(content, "UTF-16LE"))
        .when(declared.isin("", "UTF-8", "UTF8", "US-ASCII", "ASCII"), utf8)
        .when(declared.isin("ISO-8859-1", "LATIN1", "LATIN-1"), latin)
        .when(declared.isin("WINDOWS-1252", "CP1252"), F.translate(latin, *_WINDOWS_1252))
        .otherwise(F.raise_error(F.concat(F.lit("sitemap in an unknown encoding: "), declared)).cast("string")))


def _windows_1252() -> tuple[str, str]:
    """The characters whose code is not their byte, as ISO-8859-1 reads them and as they are meant."""
    known = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in known if c), "".join(c for _, c in known if c)


_WINDOWS_1252 = _windows_1252()


def read_sitemap_files(
    spark: SparkSession, path: str, base_url: str | None = None, addresses: DataFrame | None = None,
) -> DataFrame:
    """(sitemap_url, xml): one row per file. The protocol bounds a file to 50 MB.

    Indexes name their children by URL, so landed files need their addresses: ``addresses`` (file, sitemap_url) tells
    them by file name, ``base_url`` is put before the file name. Without either a file is named by its path.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), decoded_xml(F.col("content")).alias("xml"))
    if addresses is not None:
        return files.join(addresses, "file").select("sitemap_url", "xml")
    where = F.col("path") if base_url is None else F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("file"))
    return files.select(where.alias("sitemap_url"), "xml")


def parse_sitemaps(sitemaps: DataFrame, on_malformed: str = "fail") -> DataFrame:
    """(sitemap_url, kind, locs): root element and non-blank locations in document order.

    Only ``loc`` elements of the sitemap namespace count, at any depth. A malformed document
    raises, or is left out with ``on_malformed='skip'``.
    """
    if on_malformed == "skip":
        broken = F.from_xml(F.col("xml"), "_corrupt_record string")["_corrupt_record"]
        sitemaps = sitemaps.where(broken.isNull())
    # The XPath functions know prefixes but no namespaces: they check the document and name its
    # root; the element names bound to the sitemap namespace are read from the declarations.
    clean = F.regexp_replace("xml", COMMENT_RE, "")
    root_tag = F.regexp_extract("clean", ROOT_TAG_RE, 1)
    bound = F.regexp_extract_all("clean", F.lit(BINDING_RE), F.lit(1))
    default_is_ours = F.col("root_tag").rlike(rf"\sxmlns\s*=\s*{OUR_NAMESPACE}")
    names = F.array_union(
        F.when(default_is_ours, F.array(F.lit("loc"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter("bound", lambda p: p != ""), lambda p: F.concat(p, F.lit(":loc"))))
    body = F.regexp_replace(F.replace("clean", "root_tag", F.lit("")), FOREIGN_RE, "")
    pattern = F.concat(F.lit("(?s)<("), F.array_join("names", "|"), F.lit(r")(?:\s[^>]*)?>(.*?)</\1\s*>"))
    found = F.when(F.size("names") > 0, F.regexp_extract_all("body", pattern, F.lit(2)))
    return (
        sitemaps.select("sitemap_url", F.xpath_string("xml", F.lit("local-name(/*)")).alias("kind"), clean.alias("clean"))
        .select("sitemap_url", "kind", "clean", root_tag.alias("root_tag"), bound.alias("bound"))
        .select("sitemap_url", "kind", body.alias("body"), names.alias("names"))
        .select("sitemap_url", "kind", F.coalesce(found, F.array().cast("array<string>")).alias("found"))
        .select("sitemap_url", "kind", F.filter(
            F.transform("found", _location), lambda loc: loc != "").alias("locs"))
    )


def _location(content: Column) -> Column:
    """Text of a location: CDATA taken as it is, references resolved elsewhere."""
    plain = decode_xml_entities(F.regexp_extract(content, "^[^<]*", 0))
    return strip(F.when(F.contains(content, F.lit("<![CDATA[")), F.regexp_replace(content, CDATA_RE, "$1")).otherwise(plain))


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """(sitemap_url, kind, ord, loc), from parsed sitemaps."""
    return documents.select("sitemap_url", "kind", F.posexplode("locs").alias("ord", "loc"))


class SitemapError(RuntimeError):
    """A sitemap tree that cannot be resolved."""


# Index entries alone are followed; the path holds the entry number at every level.
TREE = f"""
WITH RECURSIVE tree(path, sitemap_url) AS (
  SELECT cast(array() AS array<int>), :root
  UNION ALL
  SELECT concat(t.path, array(e.ord)), e.child FROM tree t JOIN {{edges}} e ON t.sitemap_url = e.parent
  WHERE size(t.path) <= {MAX_SITEMAP_DEPTH})
SELECT path, sitemap_url FROM tree"""


def sitemap_tree(documents: DataFrame, root: str) -> DataFrame:
    """(path, sitemap_url, kind, locs): every sitemap that is reached from ``root``, as often as it is; kind is null where
    it was not landed. One recursive query; levels beyond the deepest one allowed are not followed.

    The entries of all indexes together are bounded by the session's ``spark.sql.cteRecursionRowLimit`` (1,000,000), beyond
    which the query fails; page URLs are not counted.
    """
    edges = documents.where("kind = 'sitemapindex'").select(
        F.col("sitemap_url").alias("parent"), F.posexplode("locs").alias("ord", "child"))
    reached = documents.sparkSession.sql(TREE, args={"root": root}, edges=edges)
    return reached.join(documents.select("sitemap_url", "kind", "locs"), "sitemap_url", "left")


def resolve_urls(documents: DataFrame, root: str, on_missing: str = "fail") -> DataFrame:
    """(path, url): page URLs below ``root``, nested indexes followed; sort by ``path``.

    ``path`` lists the entry number at every level, so its order is the depth-first document
    order. The tree is written once when this is called. A root that was not landed raises, as does nesting deeper than
    MAX_SITEMAP_DEPTH (or a cycle), and a child that was not landed unless ``on_missing='skip'``. ``documents`` is read
    once for each level and should be a staged table.
    """
    tree = staged(sitemap_tree(documents, root), "sitemap-tree")
    depth, missing = F.size("path"), F.col("kind").isNull()
    first = lambda where: F.min(F.when(where, F.col("sitemap_url")))
    no_root, too_deep, gone = tree.agg(
        first(missing & (depth == 0)), first(depth > MAX_SITEMAP_DEPTH), first(missing & (depth > 0))).first()
    if no_root is not None:
        raise SitemapError(f"sitemap was not landed: {root}")
    if too_deep is not None:
        raise SitemapError(f"sitemap index nesting exceeded {MAX_SITEMAP_DEPTH} levels at {too_deep}")
    if gone is not None and on_missing != "skip":
        raise SitemapError(f"sitemap was not landed: {gone}")
    opened = tree.where("kind <> 'sitemapindex'").select("path", F.posexplode("locs").alias("ord", "url"))
    return opened.select(F.concat("path", F.array("ord")).alias("path"), "url")


def url_list(documents: DataFrame, root: str, on_missing: str = "fail") -> DataFrame:
    """(ord, url): the resolved URLs numbered from 0, duplicates kept."""
    return with_position(resolve_urls(documents, root, on_missing), "path").select("ord", "url")


def url_count(documents: DataFrame, root: str, on_missing: str = "fail") -> DataFrame:
    """(n_urls): how many pages the sitemap resolves to."""
    return resolve_urls(documents, root, on_missing).agg(F.count("url").alias("n_urls"))
