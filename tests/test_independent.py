"""Checks that share no code and no list with the package: another parser, and held-out accuracy."""

from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from glossaudit.operators import dom, langid
from glossaudit.sources import pages as page_source

DATA = "/root/testdata/sf0.001"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INSIDE_LINES = set("""span a strong em b i small mark del ins sub sup code abbr dfn time q cite br wbr img picture source
    video audio label figcaption""".split())
NEVER = {"script", "style", "nav", "header", "footer"}


# Start tags that end an open element whose end tag may be left out, and where to stop looking for it.
ENDS_P = set("""address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr main menu nav ol p pre search section table ul""".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
        "option": ({"option"}, {"select"})}


class Tree(HTMLParser):
    """Elements of a page that only leaves out end tags where it may: [tag, attributes, children, parent]; a child is an element or a string."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.top = ["", {}, [], None]
        self.elements = []
        self.feed(html)
        self.close()

    def leave(self, tags, stops):
        node, last = self.top, None
        while node[3] is not None and node[0] not in stops:
            last = node if node[0] in tags else last
            node = node[3]
        self.top = last[3] if last is not None else self.top

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self.leave({"p"}, {"button", "table", "td", "th", "caption"})
        if tag in ENDS:
            self.leave(*ENDS[tag])
        node = [tag, dict(attrs), [], self.top]
        self.top[2].append(node)
        self.elements.append(node)
        if tag not in VOID:
            self.top = node

    def handle_endtag(self, tag):
        node = self.top
        while node[3] is not None and node[0] != tag:
            node = node[3]
        if node[3] is not None:
            self.top = node[3]

    def handle_data(self, data):
        self.top[2].append(data)


def strings(node):
    for child in node[2]:
        if isinstance(child, str):
            if node[0] not in ("script", "style"):
                yield child
        else:
            yield from strings(child)


def above(node):
    while node[3] is not None:
        yield node
        node = node[3]


def blocks(html):
    tree = Tree(html)

    def first(test):
        return next((n for n in tree.elements if test(n)), None)

    root = (first(lambda n: n[0] == "main") or first(lambda n: n[0] == "article")
            or first(lambda n: "content" in n[1].get("class", "").split()) or first(lambda n: n[1].get("id") == "content")
            or first(lambda n: n[0] == "body") or tree.root)
    found = []
    for node in tree.elements:
        inside = any(n is root for n in above(node)) and node is not root
        scoped = any((n[1].get("lang") or n[1].get("xml:lang")) and n[0] != "html" for n in above(node))
        leaf = all(isinstance(c, str) or c[0] in INSIDE_LINES for c in node[2])
        text = " ".join(" ".join(strings(node)).split())
        if inside and not scoped and leaf and node[0] not in NEVER and len(text) >= 20:
            found.append((node[0], text))
    return found


def test_blocks_agree_with_the_standard_parser(spark):
    pages = page_source.read_pages(spark, f"{DATA}/pages.parquet")
    want = {r.page_id: blocks(r.html) for r in pages.collect()}
    got = {page: [] for page in want}
    for r in dom.text_blocks(pages).orderBy("page_id", "idx").collect():
        got[r.page_id].append((r.tag, r.text))
    assert got == want and sum(map(len, got.values())) > 100


def test_tags_agree_with_the_standard_parser(spark):
    pages = page_source.read_pages(spark, f"{DATA}/pages.parquet")
    want = {r.page_id: Counter(n[0] for n in Tree(r.html).elements) for r in pages.collect()}
    got = {page: Counter() for page in want}
    for r in dom.html_elements(pages).select("page_id", "tag").collect():
        got[r.page_id][r.tag] += 1
    assert got == want


def test_language_of_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 100")
    part = F.pmod(F.hash("doc_id"), F.lit(4))
    model = langid.train(documents.where(part != 0))
    told = langid.detect_language(documents.where(part == 0).select("doc_id", F.col("lang").alias("label"), "text"), model)
    right, total = told.agg(F.sum((F.col("lang") == F.col("label")).cast("int")), F.count("*")).first()
    assert total > 150 and right / total > 0.98, f"{right} of {total}"


@pytest.mark.parametrize("unit", ["<a ", "<!x ", "</b ", "<a href='x "])
def test_unfinished_tags_take_time_in_proportion(spark, unit):
    import time

    def seconds(n):
        page = spark.createDataFrame([(1, "u", 200, "<p>some text " + unit * n)], "page_id long, url string, status int, html string")
        start = time.perf_counter()
        tokens = dom.html_tokens(page).collect()
        return time.perf_counter() - start, tokens

    seconds(100)
    small, large = seconds(20_000)[0], seconds(200_000)
    assert large[0] < 10 * small + 5
    assert "".join(t.token for t in large[1]) == "<p>some text " + unit * 200_000
