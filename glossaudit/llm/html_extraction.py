"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is content or not. A node has a potential from what it is
(tag, class words, length of its text, links, sentences, share of the page) and an edge potential with its parent. Sum-product
message passing, from the leaves to the root and back, gives each node's marginal; the text runs of nodes that are more
likely content than not are the page's main text. The potentials are trained by the exact gradient of the labels'
likelihood, which the same messages give. All trees of a batch are one forest, passed level by level by numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 256  # labelled pages that are learnt from, at most
TRAIN_CHARS = 65_536  # longer pages are not learnt from
ROUNDS, RATE, SHRINK = 150, 0.3, 0.02
EXAMPLE_WEIGHT = 4.0  # of a page of EXAMPLES against one of the table

# --- Fixed values: HTML's own lists ----------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var wbr nobr picture source input label output".split())
P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre search section table ul".split())
#: start tag: (open elements that it ends, open elements that keep it from doing so)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
    "body": (("head",), ())}
P_KEEPERS = ("td", "th", "table", "caption", "button", "object")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)", re.S)
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_GOLD = re.compile(r"\bdata-gold\b")
_SENTENCE = re.compile(r"[.!?。]\s|[.!?。]$|,\s")

Nodes = dict[str, list]


def _clean(pieces: list[str]) -> str:
    return " ".join(unescape("".join(pieces)).split())


def parse(html: str) -> tuple[list[int], list[str], list[str], list[tuple[int, str, int]]]:
    """(parents, tags, attributes, runs) of a page's block elements, in document order; node 0 is the page itself.

    A run is (node, text, characters of it in links): what an element holds itself, also in inline elements, up to the
    next block's beginning or end. Missing end tags are supplied, stray ones ignored; each step takes constant time.
    """
    parents, tags, attributes, runs = [-1], ["#page"], [""], []
    stack: list[tuple[str, int]] = [("#page", 0)]  # tag and node; inline elements have their block's node
    open_at: dict[str, list[int]] = {}
    pieces: list[str] = []
    links, linked, unseen = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _clean(pieces)
            if text:
                runs.append((stack_node, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(down_to: int) -> None:
        nonlocal links, unseen, stack_node
        while len(stack) > down_to:
            tag, _ = stack.pop()
            open_at[tag].pop()
            if tag not in INLINE:
                flush()
            if tag == "a":
                links -= 1
            if tag in UNSEEN:
                unseen -= 1
            stack_node = stack[-1][1]

    def last(names: tuple[str, ...]) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    stack_node, at, size = 0, 0, len(html)
    while at < size:
        token = _TOKEN.match(html, at)
        at = token.end()
        if token["text"]:
            if not unseen:
                pieces.append(token["text"])
                if links:
                    linked += len(token["text"])
            continue
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        rest = token["rest"] or token["rest2"] or ""
        if token["end"] or token["end2"]:
            where = open_at.get(tag)
            if where and (tag not in INLINE or stack[where[-1]][1] == stack_node):
                close(where[-1])
            elif tag in ("p", "br") and not unseen:
                flush() if tag == "p" else pieces.append(" ")
            continue
        if tag in P_ENDERS and open_at.get("p") and open_at["p"][-1] > last(P_KEEPERS):
            close(open_at["p"][-1])
        ends, keeps = IMPLIED.get(tag, ((), ()))
        if ends and last(ends) > last(keeps):
            close(last(ends))
        if tag in RAW:  # what is in it is no markup
            end = _RAW_END[tag].search(html, at)
            inside, at = html[at:end.start() if end else size], end.start() if end else size
        if tag in VOID:
            if not unseen:
                flush() if tag == "hr" else pieces.append(" ") if tag in ("br", "img") else None
            continue
        if tag not in INLINE and tag not in UNSEEN and not unseen:
            flush()
            parents.append(stack_node)
            tags.append(tag)
            attributes.append(rest)
            stack_node = len(tags) - 1
            if tag in RAW and tag != "title":
                pieces.append(inside)
        elif tag in UNSEEN:
            flush()
            unseen += 1
        if tag == "a":
            links += 1
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, stack_node))
    close(1)
    flush()
    return parents, tags, attributes, runs


def _bucket(value: float, *edges: float) -> int:
    return sum(value >= e for e in edges)


def features(parsed: tuple) -> list[list[str]]:
    """Names of each node's features."""
    parents, tags, attributes, runs = parsed
    n = len(tags)
    own, in_links, sentences, count, sign = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for node, text, linked in runs:
        own[node] += len(text)
        in_links[node] += linked
        sentences[node] += len(_SENTENCE.findall(text))
        count[node] += 1
        sign[node] = sign[node] or "©" in text
    below, linked_below = own.copy(), in_links.copy()
    for i in range(n - 1, 0, -1):
        below[parents[i]] += below[i]
        linked_below[parents[i]] += linked_below[i]
    whole = max(below[0], 1)
    out = []
    for i in range(n):
        chars = max(own[i], 1)
        names = ["bias", f"tag {tags[i]}", f"own {_bucket(own[i], 1, 20, 60, 150, 400)}",
                 f"share {_bucket(below[i] / whole, 0.001, 0.02, 0.2, 0.5, 0.9)}",
                 f"links below {_bucket(linked_below[i] / max(below[i], 1), 0.05, 0.3, 0.7)} {_bucket(below[i], 1, 100)}"]
        if own[i]:
            names += [f"links {_bucket(in_links[i] / chars, 0.05, 0.3, 0.7)}", f"sentences {_bucket(sentences[i], 1, 2, 5)}"]
        if sign[i]:
            names.append("sign")
        rest = attributes[i]
        if rest:
            said = " ".join(a or b or c for a, b, c in _NAMES.findall(rest))
            names += sorted({f"word {w.lower()}" for w in _WORD.findall(said)})
            if _HIDDEN.search(rest):
                names.append("hidden")
        out.append(names)
    return out


EDGE_KINDS = ("heading", "text", "list", "container")


def edge_kind(tag: str) -> int:
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return 0
    if tag in ("p", "blockquote", "pre", "figcaption", "td", "th", "caption", "dd", "dt"):
        return 1
    return 2 if tag in ("ul", "ol", "li", "dl", "menu", "table", "tbody", "thead", "tfoot", "tr") else 3


class Forest:
    """Trees laid out for message passing, level by level."""

    def __init__(self, parents: list[int], kinds: list[int]):
        """``parents``: -1 for a root, else the index of an earlier node."""
        self.parent, self.kind = np.array(parents, np.int64), np.array(kinds, np.int64)
        depth = np.zeros(len(parents), np.int64)
        for i, p in enumerate(parents):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]  # all but the roots, top down

    def marginals(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node marginals (n, 2), edge marginals (n, 2, 2) by label of the parent and of the node; a root's are 0).

        ``unary``: log-potentials (n, 2); ``edges``: log-potentials (kind, 2, 2) by label of the parent and of the node.
        """
        n = len(self.parent)
        up, sent = unary.copy(), np.zeros((n, 2))
        for level in reversed(self.levels):
            sent[level] = np.logaddexp.reduce(up[level][:, None, :] + edges[self.kind[level]], axis=2)
            np.add.at(up, self.parent[level], sent[level])
        whole, joint = up.copy(), np.zeros((n, 2, 2))  # ``whole``: with what comes from above
        for level in self.levels:
            above = whole[self.parent[level]] - sent[level]
            pair = above[:, :, None] + edges[self.kind[level]]
            whole[level] += np.logaddexp.reduce(pair, axis=1)
            pair = pair + up[level][:, None, :]
            joint[level] = np.exp(pair - np.logaddexp.reduce(pair.reshape(-1, 4), axis=1)[:, None, None])
        return np.exp(whole - np.logaddexp.reduce(whole, axis=1)[:, None]), joint


class Batch:
    """The forest and the features of several pages."""

    def __init__(self, pages: list[tuple], known: dict[str, int]):
        parents, kinds, at, which, self.starts = [], [], [], [], []
        for page in pages:
            start = len(parents)
            self.starts.append(start)
            parents += [p + start if p >= 0 else -1 for p in page[0]]
            kinds += [edge_kind(t) for t in page[1]]
            for i, names in enumerate(features(page), start):
                found = [known[name] for name in names if name in known]
                at += [i] * len(found)
                which += found
        self.forest, self.n = Forest(parents, kinds), len(parents)
        self.at, self.which = np.array(at, np.int64), np.array(which, np.int64)

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unary = np.zeros((self.n, 2))
        unary[:, 1] = np.bincount(self.at, weights[self.which], self.n)
        return self.forest.marginals(unary, edges)


def node_labels(page: tuple, gold: str) -> list[int]:
    """1 for nodes of whose text at least half is in ``gold`` (lines); nodes without text are as their parents are."""
    parents, _, _, runs = page
    left = Counter(gold.split("\n"))
    held, hit = [0] * len(parents), [0] * len(parents)
    for node, text, _ in runs:
        held[node] += len(text)
        if left[text] > 0:
            left[text] -= 1
            hit[node] += len(text)
    own = [2 * h >= n for h, n in zip(hit, held)]
    empty = [n == 0 for n in held]
    for i in range(len(parents) - 1, 0, -1):
        held[parents[i]] += held[i]
        hit[parents[i]] += hit[i]
    labels: list[int] = []
    for i, p in enumerate(parents):
        labels.append(labels[p] if held[i] == 0 and p >= 0 else int(held[i] > 0 and 2 * hit[i] >= held[i] and (empty[i] or own[i])))
    return labels


_MEANING = re.compile(r"(</?)(?:article|main|nav|footer|header|aside|section|form)\b", re.I)


def without_meaning(html: str) -> str:
    """The page with plain div elements in the place of those whose tag says what they are."""
    return _MEANING.sub(r"\1div", html)


def fit(labelled: list[tuple[str, str, float]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(feature numbers, weights, edge potentials) from (html, main text, weight); each page counts with and without its
    telling tags, so that neither they nor the rest are relied on alone."""
    pages, labels, weight = [], [], []
    for html, gold, w in labelled:
        for form in (html, without_meaning(html)):
            page = parse(form)
            pages.append(page)
            labels += node_labels(page, gold)
            weight += [w / len(page[0]) ** 0.5] * len(page[0])
    seen = Counter(name for page in pages for names in features(page) for name in set(names))
    known = {name: i for i, name in enumerate(sorted(seen))}
    batch, y, weight = Batch(pages, known), np.array(labels, np.int64), np.array(weight)
    weights, edges = np.zeros(len(known)), np.zeros((len(EDGE_KINDS), 2, 2))
    if not batch.n:
        return known, weights, edges
    inner = np.flatnonzero(batch.forest.parent >= 0)
    kind, above = batch.forest.kind[inner], y[batch.forest.parent[inner]]
    steps_w, steps_e, total = np.full(len(known), 1e-6), np.full(edges.shape, 1e-6), weight.sum()
    for _ in range(ROUNDS):
        node, joint = batch.marginals(weights, edges)
        error = weight * (y - node[:, 1])
        slope = np.bincount(batch.which, error[batch.at], len(known)) / total - SHRINK * weights / len(known)
        miss = -joint[inner] * weight[inner][:, None, None]
        miss[np.arange(len(inner)), above, y[inner]] += weight[inner]
        slope_e = np.zeros_like(edges)
        np.add.at(slope_e, kind, miss)
        slope_e = slope_e / total - SHRINK * edges / edges.size
        steps_w, steps_e = steps_w + slope ** 2, steps_e + slope_e ** 2
        weights = weights + RATE * slope / np.sqrt(steps_w)
        edges = edges + RATE * slope_e / np.sqrt(steps_e)
    return known, weights, edges


def marked_text(html: str) -> str | None:
    """The main text as the markup itself tells it: what is in the one article or main element, but for elements in it
    that are something else by their tag. None if there is no such element, or more than one."""
    parents, tags, _, runs = page = parse(html)
    roots = [i for i, t in enumerate(tags) if t == "main"] or [i for i, t in enumerate(tags) if t == "article"]
    if len(roots) != 1:
        return None
    inside = [False] * len(tags)
    for i in range(1, len(tags)):
        inside[i] = i == roots[0] or inside[parents[i]] and tags[i] not in ("nav", "aside", "footer", "form")
    return "\n".join(text for node, text, _ in page[3] if inside[node])


_FIRST = "The council agreed on Monday to repair the old bridge, which has been closed since the floods of last winter."
_SECOND = "Work will begin in spring, and the road beside the river stays open for people on foot. Nobody expects delays."
_THIRD = "Residents had asked for this for years. They were told that money, not will, was what the town lacked."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "Contact"))
_CARDS = "".join(f'<div class="card"><a href="/{i}">Another story that you may like to read</a></div>' for i in range(4))
_COMMENT = "I crossed that bridge as a child, and I hope that they keep the old lamps. It was never too narrow for us."


def _example(before: str, after: str, attributes: str = "", inside: str = "", tag: str = "div") -> str:
    """A page whose main text is marked by ``data-gold``."""
    return (f"<html><head><title>Bridge</title></head><body>{before}<{tag} {attributes}><h1 data-gold>The bridge opens again</h1>"
            f"<p data-gold>{_FIRST}</p>{inside}<p data-gold>{_SECOND} <a href='/x'>Plans</a> are public.</p><h2 data-gold>Costs</h2>"
            f"<p data-gold>{_THIRD}</p><ul><li data-gold>Stone from the quarry, about a third</li><li data-gold>Labour, paid by the town</li></ul>"
            f"<blockquote data-gold>It will last another hundred years.</blockquote></{tag}>{after}</body></html>")


#: Labelled by hand: page furniture that a table of pages may lack.
EXAMPLES = [
    _example(f'<div class="menu"><ul>{_LINKS}</ul></div><div class="cookie-notice banner">We use cookies on this site. Please agree, or read'
             ' our policy first.<a href="/p">Policy</a></div>', '<div class="footer"><p>© 2024 The Paper. All rights reserved.</p></div>',
             'class="post content"'),
    _example(f'<header class="site-header"><h2>The Paper</h2><p>News from the valley, every day.</p></header><nav id="nav">{_LINKS}</nav>',
             f'<aside class="sidebar widget"><h3>Most read</h3>{_CARDS}</aside><footer>Printed by us. Imprint. Terms.</footer>', "", tag="article"),
    _example(f'<div id="topbar" class="header"><ul>{_LINKS}</ul></div>', f'<div class="comments" id="comments"><h3>3 comments</h3>'
             + f'<div class="comment"><p class="comment-author">Ann, yesterday</p><p>{_COMMENT}</p></div>' * 3
             + '<form class="reply"><label>Your name</label><p>Write what you think about this story.</p></form></div>', 'class="entry-content"'),
    _example('<div class="alert notice">This site will be closed for repairs on Sunday. Thank you for your patience.</div>',
             f'<section id="comments" class="comments"><h2>Comments</h2><ol><li class="comment">{_COMMENT}</li><li class="comment">{_COMMENT}</li></ol>'
             '</section>', 'id="main" role="main"', '<div class="ad advert sponsored">Buy one, get one free. Only this week, in all shops.</div>'),
    _example(f'<div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div><div class="banner ads">Cheap flights, now.</div>',
             f'<div class="related related-posts"><h3>Related</h3>{_CARDS}</div><div class="share social"><a>Share</a> <a>Mail</a></div>',
             'class="article-body story"', '<aside class="newsletter promo subscribe"><p>Subscribe to our letter. It comes every week, and it is free.</p></aside>'),
    _example(f'<table class="nav"><tr><td><a href="/a">A</a></td><td><a href="/b">B</a></td></tr></table>',
             f'<div class="popup modal overlay"><p>Before you go: sign in to read more stories. It takes a minute.</p></div><div class="copyright">'
             '© The Paper, 2023</div>', 'class="text main"', f'<figure><figcaption data-gold>The bridge in June, seen from the mill.</figcaption></figure>'),
    _example('<form class="search"><p>Search our pages for a word or two.</p></form><div class="login">Sign in to comment, or join us today.</div>',
             f'<div class="author bio"><p>Jo Hill writes about towns, and lives in one. Their book is in print.</p></div><div class="tags"><a>Town</a> '
             f'<a>River</a></div><div id="disqus" class="discussion responses"><p>{_COMMENT}</p><p>{_COMMENT}</p></div>', 'itemprop="articleBody"'),
    _example(f'<nav role="navigation"><ul>{_LINKS}</ul></nav>', f'<div class="reader-comments feedback"><div class="reply">{_COMMENT}</div></div>'
             '<footer role="contentinfo"><p>Write to us. We answer within a week, as a rule.</p></footer>', "", tag="main"),
    _example('<header><h2>The Paper</h2><p>News from the valley, written every day. Ask for it.</p></header>',
             f'<ul class="comment-list"><li>{_COMMENT}</li><li>{_COMMENT}</li></ul><footer><p>Write to us. We answer soon, as a rule.</p></footer>',
             'class="page"', '<ul><li data-gold>Oak</li><li data-gold>Iron, new</li></ul>'),
    _example(f'<header><p>The Paper. Since 1890, every day.</p></header><ul class="menu">{_LINKS}</ul>',
             f'<section id="reader-comments" class="comments"><h2>What readers say</h2><article class="comment"><p>{_COMMENT}</p></article></section>',
             'id="story"', '<ol><li data-gold>Plan</li><li data-gold>Build</li></ol><table><tr><td data-gold>Stone</td><td data-gold>12</td></tr></table>',
             "article"),
    _example('', f'<div class="comment-section"><h3>Discussion</h3><ul><li>{_COMMENT}</li><li>{_COMMENT}</li></ul></div>', '',
             '<pre data-gold>load 12 t</pre><dl><dt data-gold>Span</dt><dd data-gold>40 m</dd></dl>'),
    "<html><body><nav>" + _LINKS + f'</nav><div class="list">{_CARDS}</div><footer><p>© The Paper</p></footer></body></html>',
    f"<html><body><p data-gold>{_FIRST}</p><p data-gold>{_SECOND}</p></body></html>",
]


def example_pages() -> list[tuple[str, str, float]]:
    found = []
    for html in EXAMPLES:
        parents, _, attributes, runs = parse(html)
        gold = [text for node, text, _ in runs if _GOLD.search(attributes[node])]
        found.append((html, "\n".join(gold), EXAMPLE_WEIGHT))
    return found


def markup_labelled(pages: DataFrame, key: Column) -> DataFrame:
    """(html, main): at most TRAIN_PAGES pages whose markup tells their main text; see :func:`marked_text`.

    The labels come from markup that the trained model may not rely on alone, so it also knows pages that lack it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"html": batch.column(0), "main": pa.array([marked_text(h) for h in htmls], pa.string())})

    short = pages.where(F.col("html").isNotNull() & (F.length("html") <= TRAIN_CHARS))
    some = short.select("html", key.alias("key")).orderBy("key", "html").limit(TRAIN_PAGES)
    return some.select("html").mapInArrow(run, "html string, main string").where("main <> ''")


def train_extractor(labelled: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Potentials from labelled pages (html, main: lines of text) and EXAMPLES. At most TRAIN_PAGES rows count, one task fits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(h or "", m or "", 1.0) for batch in batches for h, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        known, weights, edges = fit(sorted(rows) + example_pages())
        names = [*known, *(f"edge {i}" for i in range(edges.size))]
        yield pa.RecordBatch.from_pydict({"name": pa.array(names), "weight": pa.array(np.concatenate([weights, edges.ravel()]))})

    bounded = labelled.select("html", "main").limit(TRAIN_PAGES).coalesce(1).mapInArrow(run, "name string, weight double")
    rows = bounded.toArrow().to_pylist()  # one row for each feature of the bounded sample
    n = len(rows) - 4 * len(EDGE_KINDS)
    values = np.array([r["weight"] for r in rows])
    return {r["name"]: i for i, r in enumerate(rows[:n])}, values[:n], values[n:].reshape(-1, 2, 2)


def main_texts(htmls: list[str], model: tuple[dict[str, int], np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page; empty if no run is likely content."""
    known, weights, edges = model
    pages = [parse(h) for h in htmls]
    batch = Batch(pages, known)
    likely = batch.marginals(weights, edges)[0][:, 1] >= 0.5 if batch.n else np.zeros(0, bool)
    return ["\n".join(text for node, text, _ in page[3] if likely[start + node]) for page, start in zip(pages, batch.starts)]


BATCH_CHARS = 4_000_000


def extract_main_text(pages: DataFrame, model: tuple[dict[str, int], np.ndarray, np.ndarray]) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    ``pages`` needs page_id, url and html; no other column is read, whatever its name. A null or empty page, and one
    without main text, has an empty text. Repeated rows and rows without an id return as often as they come. Whole
    pages are read, whatever their length; an empty table gives no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = [h or "" for h in batch.column(2).to_pylist()]
            sizes = np.cumsum([len(h) for h in htmls])
            texts: list[str] = []
            while len(texts) < len(htmls):
                low = len(texts)
                before = int(sizes[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, before + BATCH_CHARS, "right")))
                texts += main_texts(htmls[low:high], sent.value)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
