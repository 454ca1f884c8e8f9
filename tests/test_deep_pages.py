"""The element tree of tag soup and of deep pages, against a plain walker that keeps a list of open elements."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossaudit.functions import html
from glossaudit.operators import dom

TAGS = ["div", "p", "b", "a", "li", "ul", "ol", "table", "tr", "td", "th", "tbody", "tfoot", "option", "select", "optgroup", "dl", "dt", "dd",
        "span", "br", "body", "html", "button", "section", "x-a", "x-b", "h1", "object", "caption", "font"]


def barrier(tag, closes):
    if tag in html.INLINE_TAGS:
        return lambda t: t not in html.INLINE_TAGS
    if closes and tag == "li":
        return lambda t: t in html.SCOPE + ["ol", "ul"]
    if closes and tag not in html.TABLE_TAGS:
        return lambda t: t in html.SCOPE
    if tag in ("li", "dd", "dt"):
        return lambda t: t in html.LIST_SCOPE
    if tag in ("option", "optgroup"):
        return lambda t: t == "select" or t == "optgroup" and tag == "option"
    more = {"td": ["tr"], "th": ["tr"], "tr": html.TABLE_SECTIONS}.get("" if closes else tag, [])
    return lambda t: t in html.TABLE_SCOPE + more


def targets(tag, closes, names):
    if closes or tag in ("li", "a", "tr"):
        return [tag]
    for group in (["dd", "dt"], ["td", "th"], html.TABLE_SECTIONS):
        if tag in group:
            return group
    if tag == "optgroup" and tag in names:
        return [tag]
    return ["option"] if tag in ("option", "optgroup") else []


def walk(page):
    """(pos, end_pos, parent_pos, depth, tag) of every element."""
    tokens, found, stack = re.findall("<[^>]*>|[^<]+", page), [], []

    def level(wanted, stops):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i]["tag"] in wanted:
                return i
            if stops(stack[i]["tag"]):
                break
        return len(stack)

    for pos, token in enumerate(tokens):
        tag = token.strip("</>").split(" ")[0]
        if not token.startswith("<"):
            continue
        closes, names = token.startswith("</"), [e["tag"] for e in stack]
        if tag in html.SINGLETONS and not closes and tag in names:
            continue
        keep = level(targets(tag, closes, names), barrier(tag, closes))
        if not closes and tag in html.P_CLOSERS:
            keep = min(keep, level(["p"], lambda t: t in html.SCOPE + ["button"]))
        for e in stack[keep:]:
            e["end"] = pos
        del stack[keep:]
        if not closes:
            e = {"pos": pos, "end": pos, "parent": stack[-1]["pos"] if stack else None, "depth": len(stack) + 1, "tag": tag}
            found.append(e)
            if tag not in html.VOID_TAGS:
                stack.append(e)
    for e in stack:
        e["end"] = len(tokens)
    return [(e["pos"], e["end"], e["parent"], e["depth"], e["tag"]) for e in found]


def soup(seed, tags, deep):
    draw = random.Random(seed)
    return "".join(draw.choice(["<{}>", "<{}>", "</{}>", "text"] + ["<{}>"] * deep).format(draw.choice(tags)) for _ in range(700))


def trees(df, chunk):
    column = html._with_names(html._let("toks", html._tokens("html"), html._elements("toks", "names", chunk)))
    return [[(e.pos, e.end_pos, e.parent_pos, e.depth, e.tag) for e in r.e] for r in df.select("n", F.expr(column).alias("e")).orderBy("n").collect()]


@pytest.mark.parametrize("chunk", [1, 50, html.CHUNK])
def test_tag_soup(spark, chunk):
    pages = [soup(i, TAGS if i % 2 else random.Random(i).sample(TAGS, 5), i % 4) for i in range(24)]
    pages += ["<div>" * 300 + "</b>" * 9 + "</div>" * 150 + "<p>" * 99, "<font>" * 500 + "<p>x</font>" * 70, "", "text"]
    got = trees(spark.createDataFrame(list(enumerate(pages)), "n int, html string"), chunk)
    for page, tree in zip(pages, got):
        assert tree == walk(page)


@pytest.mark.parametrize("unit", ["<div>", "<font>x", "<b><div>"])
def test_depth_costs_in_proportion(spark, unit):
    def seconds(n):
        page = spark.createDataFrame([(1, "u", 200, unit * n)], "page_id long, url string, status int, html string")
        start = time.perf_counter()
        deepest = dom.html_elements(page).agg(F.max("depth")).first()[0]
        assert deepest >= n
        return time.perf_counter() - start

    seconds(100)
    fixed, small, large = seconds(100), seconds(10_000), seconds(40_000)
    assert large - fixed < 4 * 2 * (small - fixed) + 3
