import re
import time
from html import unescape
from itertools import product

import numpy as np
import pytest
from pyspark.sql import Row

from glossaudit.llm import html_extraction as x

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    from glossaudit.llm.queries import page_model

    return page_model(spark, DATA)


def test_marginals_are_those_of_all_labellings():
    draw = np.random.default_rng(4)
    for _ in range(20):
        n = int(draw.integers(1, 9))
        parents = [-1] + [int(draw.integers(-1, i)) for i in range(1, n)]
        kinds = draw.integers(0, 4, n).tolist()
        unary, edges = draw.normal(size=(n, 2)) * 2, draw.normal(size=(4, 2, 2)) * 2
        node, joint, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
        for y in product((0, 1), repeat=n):
            p = np.exp(sum(unary[i, y[i]] + (edges[kinds[i], y[parents[i]], y[i]] if parents[i] >= 0 else 0) for i in range(n)))
            total += p
            for i in range(n):
                node[i, y[i]] += p
                if parents[i] >= 0:
                    joint[i, y[parents[i]], y[i]] += p
        got = x.Forest(parents, kinds).marginals(unary, edges)
        assert np.allclose(got[0], node / total) and np.allclose(got[1], joint / total)


@pytest.mark.parametrize("html, lines", [
    ("<p>a<b>b</b> c&amp;d&nbsp; &lt;e&gt;\n f</p>", ["ab c&d <e> f"]),
    ("<div>one<p>two<p>three</div>four", ["one", "two", "three", "four"]),
    ("x<script>if (a<b) '<p>no'</script>y<style>p{}</style><!-- <p>no --> z", ["x", "y", "z"]),
    ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", ["a", "b", "c", "d"]),
    ("<p><b>t<br>u<p>v</b>w", ["t u", "vw"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("a < b <3 </x> c", ["a < b <3 c"]), ("<p title='a>b'>t</p><p title=\"x", ["t"]),
    ("<head><title>T</title></head><body>b</body>", ["b"]), ("a<hr>b&#x41;&#0;", ["a", "bA�"]),
    ("<textarea><p>x</textarea><select><option>o</select>s", ["s"]), ("", []), (" \n&nbsp;", [])])
def test_runs_of_text(html, lines):
    assert [text for _, text, _ in x.parse(html)[3]] == lines


def test_labels_follow_the_gold_lines():
    page = x.parse("<body><nav><a>m</a></nav><div><p>long text here</p><p>more text</p><i></i></div></body>")
    assert dict(zip(page[1], x.node_labels(page, "long text here\nmore text"))) == {"#page": 1, "body": 1, "nav": 0, "div": 1, "p": 1}


def test_pages_of_the_table(spark, model):
    """Against a plain reading of these pages, whose article holds paragraphs alone."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in x.extract_main_text(pages, model).collect()}
    plain = pages.withColumn("html", x.F.regexp_replace("html", "(?i)(</?)(article|nav|footer|header)", "$1div"))
    bare = {r.page_id: r.text for r in x.extract_main_text(plain, model).collect()}
    right = 0
    for r in pages.collect():
        article = re.search("(?s)<article>(.*)</article>", r.html)[1]
        blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
        right += bare[r.page_id] == want
    assert right >= 0.9 * len(got)  # an article of two words is too little to go by


BODY = ["Die Brücke am Fluss", "Am Montag hat der Rat beschlossen, die alte Brücke zu erneuern, die seit dem Winter gesperrt ist.",
        "Viele Bürger hatten das seit Jahren verlangt. Es fehlte aber, wie so oft, das Geld für die Steine und für die Arbeit.",
        "Die Arbeiten beginnen im Frühjahr. Wer zu Fuß geht, kann den Weg am Ufer weiter nutzen, auch am Abend.",
        "Am Ende soll sie hundert Jahre halten, sagt der Meister, und niemand im Ort möchte ihm da widersprechen."]
TEXT = f"<h1>{BODY[0]}</h1>" + "".join(f"<p>{b}</p>" for b in BODY[1:])
LINKS = "".join(f"<li><a href='{w}'>{w}</a></li>" for w in ("Start", "Politik", "Kultur", "Reise"))
SAID = "Ich finde das gut. Hoffentlich bleibt der Turm stehen, denn er gehört zu unserer Stadt."


@pytest.mark.parametrize("html", [
    f"<body><div class=masthead><ul>{LINKS}</ul></div><div id=wrapper><div class=left-menu><ul>{LINKS}</ul></div><div id=content>{TEXT}</div></div></body>",
    f"<body><nav>{LINKS}</nav><article>{TEXT}<aside>Lesen Sie auch unser Heft. Es kommt jede Woche.</aside></article><footer>Impressum</footer></body>",
    f"<body><div class='cookie-banner'>Wir nutzen Cookies. Bitte stimmen Sie zu.</div><main>{TEXT}</main></body>",
    f"<body><article>{TEXT}</article><section class='comments'><h3>Kommentare</h3><p>{SAID}</p><p>{SAID}</p></section></body>",
    f"<body><div class='post'>{TEXT}</div><div id='comments'><div class='comment'><p>{SAID}</p></div><div class='comment'><p>{SAID}</p></div></div></body>",
    f"<body><article>{TEXT}<div class='ad'>Nur heute: alles zum halben Preis.</div></article><div class='sidebar'><a>Mehr</a></div></body>",
    f"<body><header><p>Das Blatt</p></header><div><div>{TEXT}</div></div><form><p>Ihr Name, bitte.</p><input></form><footer>© Das Blatt</footer></body>",
    f"<body><div class='notice'>Am Sonntag ist geschlossen. Danke.</div><article>{TEXT}</article></body>",
])
def test_pages_of_other_sites(model, html):
    assert x.main_texts([html], model) == ["\n".join(BODY)]


def test_nothing_to_extract(spark, model):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "v", "<nav><a>b</a></nav>", "x"), (2, "v", "<nav><a>b</a></nav>", "x")]
    got = x.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert sorted(map(str, got)) == sorted(map(str, [Row(page_id=a, url=b, text="", n_chars=0) for a, b, *_ in rows]))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert x.extract_main_text(empty, model).count() == 0
    assert len(x.train_extractor(x.markup_labelled(empty, x.F.col("page_id")))[0]) > 0  # from the examples alone


@pytest.mark.parametrize("piece", ["<div>", "<font>", "<p>a", "<a '", "<!--", "</p>", "<b><p>", "<li>x", "&amp", "<div class='", "<script>", "<"])
def test_time_grows_with_the_page(model, piece):
    start = time.time()
    x.main_texts([piece * 20_000], model)
    assert time.time() - start < 20
