"""HTML as arrays: tokens, attributes, entities and the element tree of one page.

A page is one row, and all of this stays inside that row: whatever the size of the table, parsing
needs no shuffle and no Python worker. The helpers build Spark SQL expression text (quick to
compose, one parse on the JVM); the functions at the end of the module return Columns.
"""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaudit.fixed_values import CONTENT_SELECTORS, INLINE_TAGS, SKIP_TAGS
from glossaudit.functions.text import SPACES

WS = r" \t\r\n\f"
SQ, DQ = r"\x27", r"\x22"  # quotes, written so that a pattern fits into r'...'

# Comments, raw-text elements, tags (a quoted value may hold ">"), other markup, text. The groups
# are possessive, which makes Java match them in a loop: no recursion on tags with many attributes. A
# tag that nothing ends is one token up to the end of the page, so no page is scanned again for each "<".
TOKEN_RE = (
    r"(?is)(<!--.*?(?:-->|\z)"
    rf"|<script\b.*?(?:</script[{WS}]*>|\z)"
    rf"|<style\b.*?(?:</style[{WS}]*>|\z)"
    rf"|</?[a-zA-Z](?:[^>=]++|=[{WS}]*{DQ}[^{DQ}]*{DQ}|=[{WS}]*{SQ}[^{SQ}]*{SQ}|=)*+>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z!?/][^>]*+\z"
    r"|(?:[^<]++|<++[^a-zA-Z/!?<])++"
    r"|<)"
)
# Markup that no ">" ends is text, but for comments, scripts and styles, which may run to the end.
MARKUP_RE = r"(?is)^<(?:/?[a-zA-Z][^>]*>|[!?/][^>]*>|!--|script\b|style\b)"
TAG_NAME_RE = rf"^</?([a-zA-Z][^{WS}/>]*)"
HTML_TAG_RE = rf"(?i)^<html[{WS}/>]"
ATTRIBUTE_RE = (
    rf"([^{WS}{DQ}{SQ}>/=]+)"
    rf"(?:[{WS}]*=[{WS}]*(?:{DQ}[^{DQ}]*{DQ}|{SQ}[^{SQ}]*{SQ}|[^{WS}{DQ}{SQ}>][^{WS}>]*))?"
)
ATTRIBUTE_NAME_RE = rf"^([^{WS}=]+)"
BEFORE_VALUE_RE = rf"^[^=]*(?:=[{WS}]*)?"
OUTER_QUOTES_RE = rf"^{DQ}|{DQ}$|^{SQ}|{SQ}$"
# "<a href=x/>" ends in an unquoted value, it is not self-closed.
UNQUOTED_SLASH_RE = rf"=[{WS}]*[^{WS}{DQ}{SQ}>][^{WS}>]*/>$"
ENTITY_RE = r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&)"

# Facts of the HTML standard about tags.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
]
RAW_TAGS = ["script", "style"]
SINGLETONS = ["html", "head", "body"]
HEAD_ONLY_TAGS = ["html", "head", "title", "base", "meta", "link"]
# Their text is visible only to themselves, not to the elements around them.
OWN_TEXT_TAGS = ["template", "rt", "rp"]
P_CLOSERS = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div",
    "dl", "dd", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "table", "ul",
]
SCOPE = ["applet", "caption", "html", "table", "td", "th", "marquee", "object", "template"]
LIST_SCOPE = SCOPE + [
    "ul", "ol", "menu", "dir", "dl", "section", "article", "main", "nav", "blockquote",
]
TABLE_SCOPE = ["html", "table", "template"]
TABLE_SECTIONS = ["tbody", "thead", "tfoot"]
TABLE_TAGS = ["table", "caption", "tr", "td", "th"] + TABLE_SECTIONS


# --- Small pieces of SQL ------------------------------------------------------------------------

def _let(name: str, value: str, body: str) -> str:
    """Bind a heavy expression to a lambda variable, so that it is evaluated once.

    The finish step of a fold over nothing does it; ``transform`` would copy the result deeply.
    """
    return f"aggregate(cast(array() AS array<int>), {value}, ({name}, none) -> {name}, {name} -> {body})"


def _list(values: list[str]) -> str:
    return f"split('{' '.join(values)}', ' ')"


def _is_in(tag: str, values: list[str]) -> str:
    return f"{tag} IN ({', '.join(repr(v) for v in values)})"


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, r'{SPACES}+', ' '))"


# --- Tokens -------------------------------------------------------------------------------------

def _tokens(html: str) -> str:
    return f"regexp_extract_all({html}, r'{TOKEN_RE}', 1)"


def _is_markup(token: str) -> str:
    return f"(startswith({token}, '<') AND {token} RLIKE r'{MARKUP_RE}')"


def _tag_name(token: str) -> str:
    return f"lower(regexp_extract({token}, r'{TAG_NAME_RE}', 1))"


def _kind(token: str, tag: str) -> str:
    return f"if({_is_markup(token)}, {_markup_kind(token, tag)}, 'text')"


def _markup_kind(token: str, tag: str) -> str:
    return f"""CASE
        WHEN {tag} = '' THEN 'other'
        WHEN startswith({token}, '</') THEN 'close'
        WHEN {_is_in(tag, RAW_TAGS)} THEN 'raw'
        WHEN {_is_in(tag, VOID_TAGS)} THEN 'void'
        WHEN endswith({token}, '/>') AND NOT {token} RLIKE r'{UNQUOTED_SLASH_RE}' THEN 'void'
        ELSE 'open' END"""


# --- Entities and attributes --------------------------------------------------------------------

def _entity_table() -> dict[str, str]:
    """Reference -> character: the named ones with a semicolon, and without where that is allowed."""
    table = {f"&{name};": chr(code) for name, code in name2codepoint.items()}
    table["&apos;"] = "'"
    table |= {f"&{n}": c for n, c in html5.items() if not n.endswith(";") and n in name2codepoint}
    return table


def _entity_map() -> str:
    text = json.dumps(_entity_table()).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', 'map<string,string>')"


def _code_point(digits: str, base: int) -> str:
    """Number -> character; what is no character becomes U+FFFD. Long digit runs do not overflow."""
    significant = f"regexp_replace({digits}, '^0+', '')"
    code = f"cast(conv(if(length({significant}) <= 8, {significant}, '0'), {base}, 10) AS bigint)"
    return _let("code", code, """if(code > 0 AND code <= 1114111 AND NOT code BETWEEN 55296 AND 57343,
        decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32'), '\\uFFFD')""")


def _decoded(text: str, names: str) -> str:
    """All references resolved in one pass, so that ``&amp;lt;`` gives ``&lt;``."""
    hexadecimal = _code_point("regexp_extract(piece, '([0-9a-fA-F]+);?$', 1)", 16)
    decimal = _code_point("regexp_extract(piece, '([0-9]+)', 1)", 10)
    piece = f"""CASE
        WHEN NOT startswith(piece, '&') THEN piece
        WHEN piece RLIKE '^&#[xX]' THEN {hexadecimal}
        WHEN startswith(piece, '&#') THEN {decimal}
        ELSE coalesce(try_element_at({names}, piece), piece) END"""
    pieces = f"regexp_extract_all(coded, r'{ENTITY_RE}', 1)"
    return _let("coded", text, f"""if(contains(coded, '&'),
        array_join(transform({pieces}, piece -> {piece}), ''), coded)""")


def _attributes(token: str, wanted: list[str], names: str) -> str:
    """Values of some attributes of a start tag, in the wanted order; the first of a name wins."""
    pairs = f"regexp_extract_all(regexp_replace({token}, r'{TAG_NAME_RE}', ''), r'{ATTRIBUTE_RE}', 0)"
    named = f"get(filter(pairs, a -> lower(regexp_extract(a, r'{ATTRIBUTE_NAME_RE}', 1)) = name), 0)"
    raw = f"regexp_replace({named}, r'{BEFORE_VALUE_RE}', '')"
    value = _decoded(f"regexp_replace({raw}, r'{OUTER_QUOTES_RE}', '')", names)
    return _let("pairs", pairs, f"transform({_list(wanted)}, name -> {value})")


def _declared(token: str, names: str) -> str:
    """``lang``, or ``xml:lang`` where ``lang`` is missing or empty; null if neither says anything."""
    values = _attributes(token, ["lang", "xml:lang"], names)
    return f"if({token} RLIKE '(?i)lang', get(filter({values}, v -> v <> ''), 0), NULL)"


def _page_language(toks: str, names: str) -> str:
    stripped = f"regexp_replace({_declared('html_tag', names)}, r'^{SPACES}+|{SPACES}+$', '')"
    return _let("html_tag", f"get(filter({toks}, t -> t RLIKE r'{HTML_TAG_RE}'), 0)",
                f"substring_index(lower({stripped}), '-', 1)")


# --- Element tree -------------------------------------------------------------------------------

CHUNK = 256  # tokens that are worked on before their open elements join the others
SEGMENT = 32  # open elements between two summaries
# What is asked of the open elements: the depth of the nearest one among these tags. None: of those that are not inline.
NEAREST = {
    "block": None, "scope": SCOPE, "item scope": SCOPE + ["ol", "ul"], "list scope": LIST_SCOPE, "p scope": SCOPE + ["button"],
    "options": ["select", "optgroup"], "select": ["select"], "table": TABLE_SCOPE, "row scope": TABLE_SCOPE + ["tr"],
    "section scope": TABLE_SCOPE + TABLE_SECTIONS, "li": ["li"], "a": ["a"], "tr": ["tr"], "dd": ["dd", "dt"], "td": ["td", "th"],
    "section": TABLE_SECTIONS, "optgroup": ["optgroup"], "option": ["option"], "p": ["p"],
}
BUCKETS = 128  # of tag names: the kinds after those of NEAREST
# A fold copies its state at every step, so the state of a chunk holds only what the chunk did, as numbers. An open
# element is its token's index << 1 | in a language scope.
EMPTY_TYPE = ("ints array<int>, cuts array<struct<low: int, high: int, pos: int>>, longs array<bigint>, lists array<array<bigint>>,"
              " marks array<array<int>>")


def _masks() -> str:
    """Bit i: an element with this tag is one of the i-th entry of NEAREST."""
    known = sorted({tag for tags in NEAREST.values() for tag in tags or INLINE_TAGS})
    by_length: dict[int, dict[int, list[str]]] = {}  # a long CASE is tried branch by branch
    for tag in known:
        mask = sum(1 << i for i, tags in enumerate(NEAREST.values()) if (tag in tags if tags else tag not in INLINE_TAGS))
        by_length.setdefault(len(tag), {}).setdefault(mask, []).append(tag)

    def cases(by_mask: dict[int, list[str]]) -> str:
        return "".join(f" WHEN {_is_in('tag', tags)} THEN {mask}" for mask, tags in by_mask.items())

    lengths = "".join(f" WHEN {n} THEN CASE{cases(by_length[n])} ELSE 1 END" for n in sorted(by_length))
    return f"CASE octet_length(tag){lengths} ELSE 1 END"


def _tag_events(toks: str, names: str) -> str:
    """For each token that is a tag what the tree walk needs to know about it, null for others."""
    event = f"""named_struct('pos', i, 'tag', tag, 'closes', kind = 'close', 'holds', kind = 'open',
        'has_lang', kind <> 'close' AND tag <> 'html' AND {_declared('t', names)} IS NOT NULL,
        'inline', {_is_in('tag', INLINE_TAGS)}, 'mask', {_masks()}, 'bucket', pmod(hash(tag), {BUCKETS}))"""
    known = f"if(kind IN ('open', 'close', 'void', 'raw'), {event}, NULL)"
    tagged = _let("tag", _tag_name("t"), _let("kind", _markup_kind("t", "tag"), known))
    return f"transform({toks}, (t, i) -> if({_is_markup('t')}, {tagged}, NULL))"


def _event_of(element: str) -> str:
    return f"get(events, shiftright({element}, 1))"


def _at(depth: str) -> str:
    """The open element at a depth, counted from 1: of earlier chunks, or of this one."""
    return f"if({depth} > s.base, get(s.tail, {depth} - s.base - 1), get(state.open, {depth} - 1))"


def _deepest(elements: str, before: str, condition: str) -> str:
    """Depth of the last element ``e`` of an array that fulfils a condition, or 0; ``before``: elements outside the array."""
    return f"coalesce(array_max(transform({elements}, (e, i) -> if({condition}, {before} + i + 1, 0))), 0)"


def _nearest(kind: str, condition: str) -> str:
    """Depth of the nearest open element of a kind, or 0: in this chunk, else since the last summary, else as that says."""
    start = f"(s.base - s.base % {SEGMENT})"
    earlier = f"slice(state.open, {start} + 1, s.base % {SEGMENT})"
    outer = f"""greatest({_deepest(earlier, start, condition)},
        get(get(state.marks, cast(s.base div {SEGMENT} AS int)), {kind}))"""
    return f"greatest({_deepest('s.tail', 's.base', condition)}, if(s.base = 0, 0, {outer}))"


def _near(name: str) -> str:
    bit = list(NEAREST).index(name)
    return _nearest(str(bit), f"({_event_of('e')}.mask & {1 << bit}) <> 0")


def _named() -> str:
    """Depth of the nearest open element with the event's name, or 0. Where another name's element is the nearest one of the
    bucket, all are looked at."""
    hit = _nearest(f"{len(NEAREST)} + ev.bucket", f"{_event_of('e')}.bucket = ev.bucket")
    whole = _deepest("concat(slice(state.open, 1, s.base), s.tail)", "0", f"{_event_of('e')}.tag = ev.tag")
    return _let("hit", hit, f"if(hit = 0 OR {_event_of(_at('hit'))}.tag = ev.tag, hit, {whole})")


DEPTH = "(s.base + size(s.tail))"


def _kept() -> str:
    """How many of the open elements stay open: those around what a tag closes, be it up to its own start tag or
    because end tags may be left out before it. -1: a tag that is there already. Searches only what the tag asks for."""
    tag = "ev.tag"
    target = f"""CASE
        WHEN ev.closes THEN {_named()}
        WHEN {tag} = 'li' THEN {_near('li')} WHEN {tag} = 'a' THEN {_near('a')} WHEN {tag} = 'tr' THEN {_near('tr')}
        WHEN {_is_in(tag, ["dd", "dt"])} THEN {_near('dd')}
        WHEN {_is_in(tag, ["td", "th"])} THEN {_near('td')}
        WHEN {_is_in(tag, TABLE_SECTIONS)} THEN {_near('section')}
        WHEN {tag} = 'optgroup' THEN coalesce(nullif({_near('optgroup')}, 0), {_near('option')})
        WHEN {tag} = 'option' THEN {_near('option')} ELSE 0 END"""
    barrier = f"""CASE
        WHEN ev.inline THEN {_near('block')}
        WHEN ev.closes AND {tag} = 'li' THEN {_near('item scope')}
        WHEN ev.closes AND NOT {_is_in(tag, TABLE_TAGS)} THEN {_near('scope')}
        WHEN {_is_in(tag, ["li", "dd", "dt"])} THEN {_near('list scope')}
        WHEN {tag} = 'option' THEN {_near('options')}
        WHEN {tag} = 'optgroup' THEN {_near('select')}
        WHEN ev.closes THEN {_near('table')}
        WHEN {_is_in(tag, ["td", "th"])} THEN {_near('row scope')}
        WHEN {tag} = 'tr' THEN {_near('section scope')}
        ELSE {_near('table')} END"""
    by_rule = _let("target", target, f"if(target = 0, {DEPTH}, if({barrier} > target, {DEPTH}, target - 1))")
    asking = sum(1 << list(NEAREST).index(name) for name in ("li", "a", "tr", "dd", "td", "section", "optgroup", "option"))
    by_rule = f"if(ev.closes OR (ev.mask & {asking}) <> 0, {by_rule}, {DEPTH})"  # most start tags end nothing by themselves
    open_p = _let("open_p", _near("p"), f"if(open_p = 0, {DEPTH}, if({_near('p scope')} > open_p, {DEPTH}, open_p - 1))")
    return f"""CASE
        WHEN ev.closes AND {DEPTH} > 0 AND {_event_of(_at(DEPTH))}.tag = {tag} THEN {DEPTH} - 1
        WHEN NOT ev.closes AND {_is_in(tag, SINGLETONS)} THEN if({_named()} > 0, -1, {DEPTH})
        WHEN ev.closes OR NOT {_is_in(tag, P_CLOSERS)} THEN {by_rule}
        ELSE least({by_rule}, {open_p}) END"""


def _step() -> str:
    """One tag: close what it ends, then open it, or emit it at once if it holds nothing.

    ``s``: how many elements of earlier chunks are still open (``base``) and which of those were closed (``cuts``), the
    elements opened in this chunk that still are (``tail``); for each element that was opened its parent, depth and scope
    (``opens``), for each one that was closed its token and its end (``closes``).
    """
    inner = "greatest(kept - s.base, 0)"
    closed = f"transform(slice(s.tail, {inner} + 1, size(s.tail)), e -> shiftleft(cast(shiftright(e, 1) AS bigint), 32) | ev.pos)"
    cuts = "if(kept >= s.base, s.cuts, concat(s.cuts, array(named_struct('low', kept + 1, 'high', s.base, 'pos', ev.pos))))"
    left = f"""if(kept = {DEPTH}, s, named_struct('base', least(kept, s.base), 'tail', slice(s.tail, 1, {inner}), 'opens', s.opens,
        'closes', concat(s.closes, {closed}), 'cuts', {cuts}))"""
    # From here on ``s`` is what is left open.
    up = f"if(kept = 0, NULL, {_at('kept')})"
    scoped = "if(ev.has_lang OR coalesce(up & 1, 0) = 1, 1, 0)"
    entry = f"""shiftleft(cast(coalesce(shiftright(up, 1) + 1, 0) AS bigint), 32) | shiftleft(cast(kept + 1 AS bigint), 1) | {scoped}"""
    after = f"""named_struct('base', s.base, 'tail', if(ev.holds, array_append(s.tail, shiftleft(ev.pos, 1) | {scoped}), s.tail),
        'opens', array_append(s.opens, {entry}), 'closes', if(ev.holds, s.closes,
            array_append(s.closes, shiftleft(cast(ev.pos AS bigint), 32) | ev.pos)), 'cuts', s.cuts)"""
    opened = _let("s", left, f"if(ev.closes, s, {_let('up', up, after)})")
    decided = _let("kept", _kept(), f"if(kept = -1 OR ev.closes AND kept = {DEPTH}, s, {opened})")
    return f"if(ev IS NULL, s, {decided})"


def _chunk(chunk: int) -> str:
    """The open elements, their summaries and what was opened and closed, after one more chunk of tokens."""
    inner = f"""aggregate(slice(events, first, {chunk}), named_struct('base', size(state.open), 'tail', empty.ints,
        'opens', empty.longs, 'closes', empty.longs, 'cuts', empty.cuts), (s, ev) -> {_step()})"""
    ended = """flatten(transform(after.cuts, c -> transform(slice(state.open, c.low, c.high - c.low + 1),
        e -> shiftleft(cast(shiftright(e, 1) AS bigint), 32) | c.pos)))"""
    is_kind = f"if(kind < {len(NEAREST)}, shiftright({_event_of('e')}.mask, kind) % 2 = 1, {_event_of('e')}.bucket = kind - {len(NEAREST)})"
    since = f"slice(now.open, now.whole * {SEGMENT} + 1, (part - now.whole) * {SEGMENT})"
    summary = f"""transform(get(state.marks, now.whole), (x, kind) ->
        greatest(x, {_deepest(since, f'now.whole * {SEGMENT}', is_kind)}))"""
    marks = f"""if(size(now.open) div {SEGMENT} <= now.whole, slice(state.marks, 1, now.whole + 1),
        concat(slice(state.marks, 1, now.whole + 1),
            transform(sequence(now.whole + 1, cast(size(now.open) div {SEGMENT} AS int)), part -> {summary})))"""
    joined = f"""named_struct('open', now.open, 'marks', {marks}, 'opens', concat(state.opens, array(after.opens)),
        'closes', concat(state.closes, array(after.closes, {ended})))"""
    now = f"""named_struct('open', concat(slice(state.open, 1, after.base), after.tail),
        'whole', cast(after.base div {SEGMENT} AS int))"""
    return _let("after", inner, _let("now", now, joined))


def _elements(toks: str, names: str, chunk: int = CHUNK) -> str:
    """Tokens -> array of elements in document order.

    A fold over chunks of tokens holds a fold over the tags of a chunk. The open elements of earlier chunks are looked up
    in it, not carried along, so a tag costs no more the deeper it stands. Which elements have a child that is not inline
    is found by sorting in the end.
    """
    starts = f"if(size({toks}) = 0, empty.ints, sequence(1, size({toks}), {chunk}))"
    last = f"""zip_with(flatten(state.opens), sort_array(concat(flatten(state.closes),
        transform(state.open, e -> shiftleft(cast(shiftright(e, 1) AS bigint), 32) | size({toks})))), (o, c) -> named_struct(
        'pos', cast(shiftright(c, 32) AS int), 'end_pos', cast(c & 4294967295 AS int),
        'parent_pos', if(o < 4294967296, NULL, cast(shiftright(o, 32) - 1 AS int)),
        'depth', cast(shiftright(o & 4294967295, 1) AS int), 'tag', get(events, cast(shiftright(c, 32) AS int)).tag, 'scoped', o % 2 = 1))"""
    fold = f"""aggregate({starts}, named_struct('open', empty.ints, 'marks', empty.marks, 'opens', empty.lists, 'closes', empty.lists),
        (state, first) -> {_chunk(chunk)}, state -> {last})"""
    parents = f"""array_distinct(transform(filter(found, f -> f.parent_pos IS NOT NULL AND NOT {_is_in('f.tag', INLINE_TAGS)}),
        f -> 2 * f.parent_pos + 1))"""
    both = f"sort_array(concat(transform(found, f -> 2 * f.pos), {parents}))"
    blocks = "filter(transform(both, (x, i) -> if(x % 2 = 1, NULL, coalesce(get(both, i + 1) = x + 1, false))), x -> x IS NOT NULL)"
    ordered = f"""zip_with(found, {blocks}, (f, b) -> named_struct('pos', f.pos, 'end_pos', f.end_pos,
        'parent_pos', f.parent_pos, 'depth', f.depth, 'tag', f.tag, 'scoped', f.scoped, 'block_child', b))"""
    nothing = json.dumps({"ints": [], "cuts": [], "longs": [], "lists": [], "marks": [[0] * (len(NEAREST) + BUCKETS)]})
    built = _let("events", _tag_events(toks, names), _let("found", fold, _let("both", both, ordered)))
    return _let("empty", f"from_json('{nothing}', '{EMPTY_TYPE}')", built)


# --- Content root and blocks --------------------------------------------------------------------

def _content_root(elems: str, toks: str, names: str) -> str:
    """First element in document order of the best selector; then body; null for the document."""
    keys = sorted({s[1:] for s in CONTENT_SELECTORS if s[0] in ".#"})
    marked = f"""filter({elems}, e -> {toks}[e.pos] RLIKE '{"|".join(keys)}')"""
    described = f"""transform({marked}, e -> named_struct('element', e,
        'marks', {_attributes(f'{toks}[e.pos]', ["class", "id"], names)}))"""

    def first(selector: str) -> str:
        key = selector[1:]
        if selector.startswith("."):
            return f"get(filter(marked, m -> array_contains(split({_collapsed('m.marks[0]')}, ' '), '{key}')), 0).element"
        if selector.startswith("#"):
            return f"get(filter(marked, m -> m.marks[1] = '{key}'), 0).element"
        return f"get(filter({elems}, e -> e.tag = '{selector}'), 0)"

    return _let("marked", described, f"coalesce({', '.join(first(s) for s in [*CONTENT_SELECTORS, 'body'])})")


def _covered(spans: str, position: str) -> str:
    return f"exists({spans}, sp -> {position} > sp.pos AND {position} < sp.end_pos)"


def _text_or_null(toks: str) -> str:
    return f"transform({toks}, t -> if({_is_markup('t')}, NULL, t))"


def _visible_texts(elems: str, toks: str) -> str:
    """Per token position its text; null for markup, and where a container keeps its text."""
    masked = f"transform(plain, (t, i) -> if({_covered('hidden', 'i')}, NULL, t))"
    hidden = f"filter({elems}, h -> {_is_in('h.tag', OWN_TEXT_TAGS)})"
    return _let("plain", _text_or_null(toks), _let("hidden", hidden, f"if(size(hidden) = 0, plain, {masked})"))


def _element_text(element: str, texts: str, toks: str, names: str) -> str:
    """Strings inside an element, joined with spaces, entities resolved, white space collapsed."""
    def inside(array: str) -> str:
        return f"slice({array}, {element}.pos + 2, greatest({element}.end_pos - {element}.pos - 1, 0))"

    own = _text_or_null(inside(toks))
    chosen = f"if({_is_in(f'{element}.tag', OWN_TEXT_TAGS)}, {own}, {inside(texts)})"
    return _collapsed(_decoded(f"array_join({chosen}, ' ')", names))


def _is_leaf(element: str, root: str, elems: str, prune_skipped: bool) -> str:
    """A block as far as structure tells: strictly below the root, not a skipped tag, no language
    scope, no direct child that is not inline."""
    below = f"""if({root} IS NULL, NOT {_is_in(f'{element}.tag', HEAD_ONLY_TAGS)},
        {element}.pos > {root}.pos AND {element}.pos < {root}.end_pos)"""
    leaf = f"""({below} AND NOT {element}.scoped AND NOT {element}.block_child
        AND NOT {_is_in(f'{element}.tag', SKIP_TAGS)})"""
    if not prune_skipped:
        return leaf
    skipped = f"filter({elems}, k -> {_is_in('k.tag', SKIP_TAGS)})"
    return f"({leaf} AND NOT {_covered(skipped, f'{element}.pos')})"


def _described(elements: str, toks: str, names: str, more: str) -> str:
    """Add the class list and the id to structs that have a position and a tag."""
    marks = _attributes(f"{toks}[b.pos]", ["class", "id"], names)
    return f"""transform({elements}, b -> {_let('marks', marks, f"""named_struct({more}'tag', b.tag,
        'classes', coalesce({_collapsed('marks[0]')}, ''), 'id', coalesce(marks[1], ''))""")})"""


def _blocks(elems: str, toks: str, names: str, min_length: int, prune_skipped: bool) -> str:
    leaves = f"filter({elems}, e -> {_is_leaf('e', 'root', elems, prune_skipped)})"
    made = f"""transform({leaves}, e -> named_struct(
        'text', {_element_text('e', 'texts', toks, names)}, 'tag', e.tag, 'pos', e.pos))"""
    long_enough = f"filter({made}, b -> char_length(b.text) >= {int(min_length)})"
    described = _described(long_enough, toks, names, "'text', b.text, ")
    return _let("root", _content_root(elems, toks, names),
                _let("texts", _visible_texts(elems, toks), described))


# --- Columns ------------------------------------------------------------------------------------

def _with_names(body: str) -> str:
    return _let("names", _entity_map(), body)


def _with_tree(html: str, body: str) -> Column:
    return F.expr(_with_names(_let("toks", _tokens(html), _let(
        "elems", _elements("toks", "names"), body))))


def tokens(html: str) -> Column:
    """Array of ``(kind, tag, token)``, in document order."""
    tagged = _let("tag", f"if({_is_markup('t')}, {_tag_name('t')}, '')",
                  f"named_struct('kind', {_kind('t', 'tag')}, 'tag', tag, 'token', t)")
    return F.expr(f"transform({_tokens(html)}, t -> {tagged})")


def page_language(html: str) -> Column:
    """Primary subtag of the first ``<html>``; null if undeclared, '' if declared as blank."""
    return F.expr(_with_names(_let("toks", _tokens(html), _page_language("toks", "names"))))


def elements(html: str) -> Column:
    """Array of ``(pos, end_pos, parent_pos, depth, tag, scoped, block_child)``.

    Positions are token indexes; ``scoped`` tells whether the element or an ancestor below
    ``<html>`` carries a language, ``block_child`` whether a direct child is not inline.
    """
    return _with_tree(html, "elems")


def element_attributes(html: str) -> Column:
    """Array of ``(pos, tag, classes, id)`` for every element."""
    return _with_tree(html, _described("elems", "toks", "names", "'pos', b.pos, "))


def content_root(html: str) -> Column:
    """The element whose descendants are audited; null stands for the whole document."""
    return _with_tree(html, _content_root("elems", "toks", "names"))


def element_texts(html: str) -> Column:
    """Array of ``(pos, tag, text)`` for every element."""
    text = _element_text("e", "texts", "toks", "names")
    return _with_tree(html, _let("texts", _visible_texts("elems", "toks"), f"""transform(elems,
        e -> named_struct('pos', e.pos, 'tag', e.tag, 'text', {text}))"""))


def parsed_page(html: str, min_length: int, prune_skipped: bool = False) -> Column:
    """``(declared_lang, blocks)`` of a page; a block is ``(text, tag, classes, id)``."""
    return _with_tree(html, f"""named_struct('declared_lang', {_page_language('toks', 'names')},
        'blocks', {_blocks('elems', 'toks', 'names', min_length, prune_skipped)})""")
