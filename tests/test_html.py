"""Hand-made pages, one per rule."""

import pytest
from pyspark.sql import functions as F

from glossaudit.functions import html
from glossaudit.operators import dom
from glossaudit.params import AuditParams

LONG = "This sentence is long enough to count."


def blocks_of(pages, **params):
    rows = dom.text_blocks(pages, AuditParams(**params)).orderBy("page_id", "idx").collect()
    found = {}
    for row in rows:
        found.setdefault(row.page_id, []).append(row)
    return found


def texts(rows):
    return [(row.tag, row.text) for row in rows or []]


@pytest.mark.parametrize("start, expected", [
    ('<html lang="en-GB">', "en"),
    ("<html>", None),
    ('<HTML LANG=fr>', "fr"),
    ('<html lang="">', None),
    ('<html lang="" xml:lang="de-AT">', "de"),
    ('<html xml:lang="it">', "it"),
    ('<html lang="es" xml:lang="it">', "es"),
    ('<html lang="en_US">', "en_us"),
    ('<html lang="  ">', ""),
    ('<html data-lang="xx" class="lang" title=" lang=yy ">', None),
    ('<html hreflang="xx" lang = \' PT-br \'>', "pt"),
    ('<html lang="&#101;n">', "en"),
])
def test_declared_language(make_pages, start, expected):
    pages = make_pages(f"<!-- <html lang='zz'> -->{start}<body><p>{LONG}</p></body></html>")
    assert dom.page_declared_lang(pages).first().declared_lang == expected


def test_reference_cases(make_pages):
    pages = make_pages(
        "<html lang='en-GB'><body><p>Some text here for testing.</p></body></html>",
        "<html><body><p>hello world this is a test</p></body></html>",
        "<html><body><script>var x = 1;</script><style>.red { color: red; }</style>"
        "<p>This is a real paragraph with enough text.</p></body></html>",
        "<html><body><p>hi</p><p>This is a much longer paragraph.</p></body></html>",
        '<html><body><p id="intro" class="lead">Introduction paragraph here.</p></body></html>')
    found = blocks_of(pages, min_length=10)
    assert found[0][0].declared_lang == "en" and found[1][0].declared_lang is None
    assert texts(found[2]) == [("p", "This is a real paragraph with enough text.")]
    assert texts(found[3]) == [("p", "This is a much longer paragraph.")]
    assert (found[4][0].tag, found[4][0].id, found[4][0].classes) == ("p", "intro", "lead")


CASES = {
    "main beats an earlier article": (
        f"<body><article><p>First: {LONG}</p></article><main><p>{LONG}</p></main></body>", [("p", LONG)]),
    "article beats class and id": (
        f"<body><div class=content><p>no {LONG}</p></div><article><p>{LONG}</p></article></body>", [("p", LONG)]),
    "class among several, white space": (
        f"<body><p>no {LONG}</p><div class='a \n content b'><p>{LONG}</p></div></body>", [("p", LONG)]),
    "class must match as a word": (
        f"<body><p>{LONG}</p><div class='content-x'><p>{LONG}</p></div></body>", [("p", LONG)] * 2),
    "id": (f"<body><p>no {LONG}</p><div id=content><p>{LONG}</p></div></body>", [("p", LONG)]),
    "class beats an earlier id": (
        f"<body><div id=content><p>no {LONG}</p></div><div class=content><p>{LONG}</p></div></body>", [("p", LONG)]),
    "only body": (f"<body><p>{LONG}</p></body>", [("p", LONG)]),
    "no body: what is in the head does not count": (
        f"<html><title>Title {LONG}</title><p>{LONG}</p></html>", [("p", LONG)]),
    "text directly in the root": (f"<body>{LONG}</body>", []),
    "K1 inside skipped tags": (f"<body><nav><ul><li>{LONG}</li></ul></nav></body>", [("li", LONG)]),
    "K1 skipped tag itself": (f"<body><nav>{LONG}</nav><footer>{LONG}</footer></body>", []),
    "K2 own text next to a block": (f"<body><div>{LONG}<p>{LONG}</p></div></body>", [("p", LONG)]),
    "K3 long inline child counts twice": (f"<body><p><b>{LONG}</b></p></body>", [("p", LONG), ("b", LONG)]),
    "K4 other children": (f"<body><p>{LONG}<u>x</u></p><p>{LONG}<script>1</script></p><p>{LONG}<hr></p></body>", [("p", LONG)]),
    "K4 inline void": (f"<body><p>{LONG}<br><img src=x></p></body>", [("p", LONG)]),
    "K5 space between pieces": ("<body><p>foo<b>bar</b>, and some more text</p></body>", [("p", "foo bar , and some more text")]),
    "white space": ("<body><p>  a  b\n\tc and some more words&nbsp;</p></body>", [("p", "a b c and some more words")]),
    "K6 on the block": (f"<body><p lang=fr>{LONG}</p><p>{LONG}</p></body>", [("p", LONG)]),
    "K6 above the block": (f"<body><div lang=fr><section><p>{LONG}</p></section></div><p>{LONG}</p></body>", [("p", LONG)]),
    "K6 above the root": (f"<body lang=en><main><p>{LONG}</p></main></body>", []),
    "K6 not from html": (f"<html lang=en><body><p>{LONG}</p></body></html>", [("p", LONG)]),
    "K7 empty lang": (f"<body><p lang=''>{LONG}</p></body>", [("p", LONG)]),
    "K7 blank lang is explicit": (f"<body><p lang=' '>{LONG}</p></body>", []),
    "K8 xml:lang": (f"<body><p xml:lang='fr'>{LONG}</p></body>", []),
    "block inside an inline child": (
        f"<body><section><span><div>{LONG}</div></span></section></body>", [("section", LONG), ("div", LONG)]),
    "entities once": (
        "<body><p>a &amp;lt; b &lt; c &eacute;&#233;&#xE9; &copy 1 &am; &unknown; &#0;&#x110000;</p></body>",
        [("p", "a &lt; b < c ééé © 1 &am; &unknown; ��")]),
    "lone <": ("<body><p>if a<5 and b << 7 then <b>x</b> it is</p></body>", [("p", "if a<5 and b << 7 then x it is")]),
    "quoted >": (f"<body><p title='a > b' data-x=\"c>d\">{LONG}</p></body>", [("p", LONG)]),
    "unclosed b in p": (f"<body><p><b>{LONG}<br><p>{LONG}</p></body>", [("p", LONG), ("b", LONG), ("p", LONG)]),
    "unclosed p": (f"<body><p>{LONG}<p>{LONG}<div>{LONG}</div></body>", [("p", LONG), ("p", LONG), ("div", LONG)]),
    "stray end tags": (f"<body><p>{LONG}</b></section></p></body>", [("p", LONG)]),
    "late </b> in the next p": (f"<body><p><b>x<p>{LONG}</b> more</p></body>", [("p", f"{LONG} more")]),
    "inline end tag does not end a block": (f"<body><b><p>{LONG}</b> more</p></b></body>", [("p", f"{LONG} more")]),
    "a around div": (f"<body><a href=x><div>{LONG}</div></a></body>", [("div", LONG)]),
    "unclosed li and dd": (
        f"<body><ul><li>{LONG}<li>{LONG}<ul><li>{LONG}</ul></ul><dl><dt>{LONG}<dd>{LONG}</dl></body>",
        [("li", LONG), ("li", LONG), ("dt", LONG), ("dd", LONG)]),
    "unclosed cells": (
        f"<body><table><tr><td>{LONG}<td>{LONG}<tr><td><p>{LONG}</table><p>{LONG}</p></body>",
        [("td", LONG), ("td", LONG), ("p", LONG), ("p", LONG)]),
    "unclosed div ends with its parent": (f"<body><article><div><p>{LONG}</p></article><p>no {LONG}</p></body>", [("p", LONG)]),
    "self-closed": (f"<body><svg><path d='x'/></svg><p>{LONG}<a name=x />tail</p></body>", [("p", f"{LONG} tail")]),
    "unquoted value ending in a slash": (f"<body><p><a href=/x/>{LONG}</a></p></body>", [("p", LONG), ("a", LONG)]),
    "comment between strings": ("<body><p>some words<!-- <p> -->and other words</p></body>", [("p", "some words and other words")]),
    "unclosed comment and script": (f"<body><p>{LONG}</p><script>x <p>{LONG}</p>", [("p", LONG)]),
    "template and ruby keep their text": (
        f"<body><template><p>{LONG}</p></template><p>{LONG}<ruby>x<rt>yy</rt></ruby></p><p>{LONG}<b>k<rt>y</rt></b></p></body>",
        [("p", f"{LONG} k")]),
    "repeated html and body tags": (f"<html><body><p>{LONG}</p><html><body><p>{LONG}</p></body></html>", [("p", LONG)] * 2),
}


def test_hand_made_pages(make_pages):
    found = blocks_of(make_pages(*[page for page, _ in CASES.values()]))
    got = {name: texts(found.get(i)) for i, name in enumerate(CASES)}
    assert got == {name: expected for name, (_, expected) in CASES.items()}


def test_minimum_length_is_inclusive_and_counts_code_points(make_pages):
    found = blocks_of(make_pages("<body><p>1234567890123456789</p><p>1234567890123456789\U0001F600</p></body>"))
    assert texts(found[0]) == [("p", "1234567890123456789\U0001F600")]


def test_prune_skipped_option(make_pages):
    pages = make_pages(f"<body><nav><ul><li>{LONG}</li></ul></nav><p>{LONG}</p></body>")
    assert texts(blocks_of(pages, prune_skipped=True)[0]) == [("p", LONG)]


def test_ruby_text_is_hidden_from_its_surroundings(make_pages):
    pages = make_pages("<body><p>kanji with readings <rt>kana</rt> inside</p></body>")
    rows = {r.tag: r.text for r in dom.element_text(pages).collect()}
    assert rows["p"] == "kanji with readings inside" and rows["rt"] == "kana"


def test_long_pages_and_long_tags(make_pages):
    many = "".join(f"<div><p>paragraph number {i} with text</p></div>" for i in range(3000))
    attributes = " ".join(f'a{i}="{i}>"' for i in range(5000))
    deep = "<div>" * 300 + f"<p>{LONG}</p>" + "</div>" * 300
    pages = make_pages(f"<body>{many}</body>", f"<body><p {attributes}>{LONG}</p></body>", f"<body>{deep}</body>",
                       f"<body><p title='{'x' * 200_000}'>{LONG}</p></body>")
    found = blocks_of(pages)
    assert len(found[0]) == 3000 and found[0][2999].text == "paragraph number 2999 with text"
    assert texts(found[1]) == texts(found[2]) == texts(found[3]) == [("p", LONG)]


def test_chunk_size_does_not_matter(spark, make_pages):
    pages = make_pages("<body><ul>" + "<li>x<p>y" * 40 + "</ul><p>z</body>")
    def tree(chunk):
        column = F.expr(html._with_names(html._let("toks", html._tokens("html"), html._elements("toks", "names", chunk))))
        return pages.select(column.alias("e")).first().e
    assert tree(1) == tree(7) == tree(10_000)
