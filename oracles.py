"""DuckDB statements that compute the registered queries another way.

They share fixed values and the tag lists with the library, not its method: the element tree is
walked by a recursive query one tag at a time over all pages, scopes and texts come from interval
joins, and trigrams from distinct words.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from derived_inputs import REWRITES, SITEMAP_BASE
from glossaudit import fixed_values as fixed
from glossaudit.functions import html as tags

WS = fixed.WHITESPACE
BLANK = r" \t\r\n\f"
TOKEN = (
    r"(?is)(<!--.*?(?:-->|\z)"
    rf"|<script\b.*?(?:</script[{BLANK}]*>|\z)|<style\b.*?(?:</style[{BLANK}]*>|\z)"
    rf"|</?[a-zA-Z](?:[^>=]+|=[{BLANK}]*\"[^\"]*\"|=[{BLANK}]*''[^'']*''|=)*>"
    r"|<[!?/][^>]*>|(?:[^<]+|<+[^a-zA-Z/!?<])+|<)"
)
TAG = rf"^</?([a-zA-Z][^{BLANK}/>]*)"
ATTRIBUTE = (
    rf"[^{BLANK}\"''>/=]+(?:[{BLANK}]*=[{BLANK}]*(?:\"[^\"]*\"|''[^'']*''|[^{BLANK}\"''>][^{BLANK}>]*))?"
)


def quoted(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{WS}]+', ' ', 'g'), ' ')"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def entity_map() -> str:
    table = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
    table |= {f"&{n}": c for n, c in html5.items() if not n.endswith(";") and n in name2codepoint}
    return "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in table.items()) + "}"


def decoded(text: str) -> str:
    code = "try_cast(CASE WHEN p[3] IN ('x', 'X') THEN '0x' || rtrim(p[4:], ';') ELSE rtrim(p[3:], ';') END AS BIGINT)"
    return f"""CASE WHEN contains({text}, '&') THEN array_to_string(list_transform(
        regexp_extract_all({text}, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&'),
        lambda p: CASE WHEN p[1:2] = '&#' AND length(p) > 2 THEN
            CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343
                 THEN chr({code}::INTEGER) ELSE chr(65533) END
          WHEN p[1] = '&' THEN coalesce(m[p], p) ELSE p END), '') ELSE {text} END"""


def attribute(token: str, name: str) -> str:
    pairs = f"regexp_extract_all(regexp_replace({token}, '{TAG}', ''), '{ATTRIBUTE}')"
    pair = f"list_filter({pairs}, lambda a: lower(regexp_extract(a, '^[^{BLANK}=]+')) = '{name}')[1]"
    value = f"regexp_replace({pair}, '^[^=]*(=[{BLANK}]*)?', '')"
    return decoded(f"regexp_replace({value}, '^\"|\"$|^''|''$', '', 'g')")


def declared(token: str) -> str:
    return f"coalesce(nullif({attribute(token, 'lang')}, ''), nullif({attribute(token, 'xml:lang')}, ''))"


# --- Pages --------------------------------------------------------------------------------------

ENTITIES = ("entities", f"SELECT {entity_map()} AS m")
PLAIN = ("input", "SELECT page_id, url, html FROM pages WHERE html <> ''")


def _rewritten() -> tuple[str, str]:
    cases = []
    for lang, steps in REWRITES.items():
        changed = "html"
        for what, by in steps:
            changed = f"replace({changed}, {literal(what)}, {literal(by)})"
        cases.append(f"""WHEN contains(html, '<html lang="{lang}">') THEN {changed}""")
    return "input", f"SELECT page_id, url, CASE {' '.join(cases)} ELSE html END AS html FROM pages WHERE html <> ''"


REWRITTEN = _rewritten()
# Bytes that are not UTF-8 behind the first <p>, or at the end: each such run is one replacement character.
FROM_BYTES = ("input", """SELECT page_id, url, html[:n] || CASE WHEN page_id % 4 = 0 THEN '' ELSE chr(65533) END || html[n + 1:] AS html
    FROM (SELECT page_id, url, html, CASE WHEN contains(html, '<p>') THEN instr(html, '<p>') + 2 ELSE length(html) END AS n
    FROM pages WHERE html <> '')""")

TOKENS = [
    ("token_lists", f"SELECT page_id, regexp_extract_all(html, '{TOKEN}', 1) AS l FROM input"),
    ("raw_tokens", "SELECT page_id, unnest(l) AS token, unnest(range(len(l)))::INTEGER AS pos FROM token_lists"),
    ("named_tokens", f"""SELECT page_id, pos, token, CASE WHEN regexp_matches(token, '^<(/?[a-zA-Z]|[!?/][^>]*>|!--)')
        THEN lower(regexp_extract(token, '{TAG}', 1)) END AS name FROM raw_tokens"""),
    ("tokens", f"""SELECT page_id, pos, token, coalesce(name, '') AS tag, CASE WHEN name IS NULL THEN 'text'
        WHEN name = '' THEN 'other' WHEN token[1:2] = '</' THEN 'close'
        WHEN name IN {quoted(tags.RAW_TAGS)} THEN 'raw' WHEN name IN {quoted(tags.VOID_TAGS)} THEN 'void'
        WHEN token[-2:] = '/>' AND NOT regexp_matches(token, '=[{BLANK}]*[^{BLANK}"''>][^{BLANK}>]*/>$') THEN 'void'
        ELSE 'open' END AS kind FROM named_tokens"""),
]

LANGS = [
    ENTITIES,
    ("html_tags", """SELECT page_id, arg_min(token, pos) AS token FROM tokens
        WHERE tag = 'html' AND kind <> 'close' GROUP BY page_id"""),
    ("page_langs", f"""SELECT i.page_id, split_part(lower({stripped(declared('h.token'))}), '-', 1) AS declared_lang
        FROM input i LEFT JOIN html_tags h USING (page_id) CROSS JOIN entities"""),
]

NOT_INLINE = f"NOT IN {quoted(fixed.INLINE_TAGS)}"


def _nearest(targets: str, barrier: str) -> str:
    """Index (outermost first) of the innermost open target, null if a barrier is further in."""
    hit = f"list_max(list_filter(range(1, len(w.stack) + 1), lambda i: w.stack[i].tag {targets}))"
    stop = f"list_max(list_filter(range(1, len(w.stack) + 1), lambda i: w.stack[i].tag {barrier}))"
    return f"CASE WHEN coalesce({stop}, 0) <= {hit} THEN {hit} END"


def _kept() -> str:
    scope, table = tags.SCOPE, tags.TABLE_SCOPE
    not_table = f"e.tag NOT IN {quoted(tags.TABLE_TAGS)}"
    end = f"""CASE WHEN e.tag {NOT_INLINE} AND e.tag = 'li' THEN {_nearest("= 'li'", f"IN {quoted(scope + ['ol', 'ul'])}")}
        WHEN e.tag {NOT_INLINE} AND {not_table} THEN {_nearest('= e.tag', f'IN {quoted(scope)}')}
        WHEN e.tag {NOT_INLINE} THEN {_nearest('= e.tag', f'IN {quoted(table)}')}
        ELSE {_nearest('= e.tag', NOT_INLINE)} END"""
    lists = f"IN {quoted(tags.LIST_SCOPE)}"
    start = f"""CASE e.tag WHEN 'li' THEN {_nearest("= 'li'", lists)}
        WHEN 'dd' THEN {_nearest("IN ('dd', 'dt')", lists)} WHEN 'dt' THEN {_nearest("IN ('dd', 'dt')", lists)}
        WHEN 'a' THEN {_nearest("= 'a'", NOT_INLINE)}
        WHEN 'option' THEN {_nearest("= 'option'", "IN ('select', 'optgroup')")}
        WHEN 'optgroup' THEN coalesce({_nearest("= 'optgroup'", "= 'select'")}, {_nearest("= 'option'", "= 'select'")})
        WHEN 'td' THEN {_nearest("IN ('td', 'th')", f"IN {quoted(table + ['tr'])}")}
        WHEN 'th' THEN {_nearest("IN ('td', 'th')", f"IN {quoted(table + ['tr'])}")}
        WHEN 'tr' THEN {_nearest("= 'tr'", f"IN {quoted(table + tags.TABLE_SECTIONS)}")}
        ELSE CASE WHEN e.tag IN {quoted(tags.TABLE_SECTIONS)} THEN
            {_nearest(f"IN {quoted(tags.TABLE_SECTIONS)}", f"IN {quoted(table)}")} END END"""
    paragraph = f"""CASE WHEN e.tag IN {quoted(tags.P_CLOSERS)} THEN
        {_nearest("= 'p'", f"IN {quoted(scope + ['button'])}")} END"""
    closes = f"CASE WHEN e.kind = 'close' THEN {end} ELSE least({start}, {paragraph}) END"
    return f"coalesce({closes} - 1, len(w.stack))"


STACK = "STRUCT(tag VARCHAR, pos INTEGER)[]"
TREE = [
    ENTITIES,
    ("steps", """SELECT page_id, pos, tag, kind, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n
        FROM tokens WHERE kind IN ('open', 'close', 'void', 'raw')"""),
    ("walk", f"""SELECT page_id, 0::BIGINT AS n, 0 AS pos, '' AS tag, '' AS kind, 0::BIGINT AS kept,
            []::{STACK} AS stack, []::{STACK} AS ended FROM input
        UNION ALL
        SELECT page_id, n, pos, tag, kind, kept,
            CASE WHEN kind = 'open' THEN list_append(before[1:kept], {{'tag': tag, 'pos': pos}}) ELSE before[1:kept] END,
            before[kept + 1:]
        FROM (SELECT e.page_id, e.n, e.pos, e.tag, CASE WHEN dup THEN 'skip' ELSE e.kind END AS kind, e.stack AS before,
                CASE WHEN dup THEN len(e.stack) ELSE e.kept END AS kept
            FROM (SELECT e.*, w.stack, {_kept()} AS kept, e.kind <> 'close' AND e.tag IN {quoted(tags.SINGLETONS)}
                    AND list_contains(list_transform(w.stack, lambda s: s.tag), e.tag) AS dup
                FROM walk w JOIN steps e ON e.page_id = w.page_id AND e.n = w.n + 1) e) x"""),
    ("ends", f"""SELECT page_id, unnest(ended).pos AS start_pos, pos AS end_pos FROM walk WHERE len(ended) > 0
        UNION ALL SELECT page_id, pos, pos FROM walk WHERE kind IN ('void', 'raw')
        UNION ALL SELECT page_id, unnest(stack).pos, len(l)::INTEGER FROM
            (SELECT page_id, arg_max(stack, n) AS stack FROM walk GROUP BY page_id) JOIN token_lists USING (page_id)"""),
    ("starts", """SELECT page_id, pos, tag, kept::INTEGER + 1 AS depth,
            CASE WHEN kind = 'open' THEN stack[-2].pos ELSE stack[-1].pos END AS parent_pos
        FROM walk WHERE kind IN ('open', 'void', 'raw')"""),
    ("elements", """SELECT s.page_id, s.pos, e.end_pos, s.depth, s.parent_pos, s.tag
        FROM starts s JOIN ends e ON e.page_id = s.page_id AND e.start_pos = s.pos"""),
]

ATTRIBUTES = [
    ("attributes", f"""SELECT e.page_id, e.pos, e.tag, coalesce({collapsed(attribute('t.token', 'class'))}, '') AS classes,
            coalesce({attribute('t.token', 'id')}, '') AS id,
            e.tag <> 'html' AND {declared('t.token')} IS NOT NULL AS has_lang
        FROM elements e JOIN tokens t ON t.page_id = e.page_id AND t.pos = e.pos CROSS JOIN entities"""),
]

SCOPES = [
    ("marked", """SELECT e.page_id, e.pos, e.end_pos FROM elements e JOIN attributes a
        ON a.page_id = e.page_id AND a.pos = e.pos WHERE a.has_lang"""),
    ("scopes", """SELECT e.page_id, e.pos, e.tag, EXISTS (SELECT 1 FROM marked m WHERE m.page_id = e.page_id
            AND e.pos >= m.pos AND e.pos < greatest(m.end_pos, m.pos + 1)) AS scoped FROM elements e"""),
]

ROOTS = [
    ("ranked", """SELECT e.*, CASE WHEN e.tag = 'main' THEN 1 WHEN e.tag = 'article' THEN 2
            WHEN list_contains(string_split(a.classes, ' '), 'content') THEN 3 WHEN a.id = 'content' THEN 4
            WHEN e.tag = 'body' THEN 5 END AS priority
        FROM elements e JOIN attributes a ON a.page_id = e.page_id AND a.pos = e.pos"""),
    ("roots", """SELECT i.page_id, r.tag AS root_tag, r.pos AS root_pos, r.end_pos AS root_end FROM input i
        LEFT JOIN (SELECT * FROM ranked WHERE priority IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority, pos) = 1) r USING (page_id)"""),
]

TEXTS = [
    ("texts", f"""SELECT e.page_id, e.pos, e.tag, {collapsed(decoded("coalesce(j.joined, '')"))} AS text
        FROM elements e LEFT JOIN (SELECT e.page_id, e.pos, string_agg(t.token, ' ' ORDER BY t.pos) AS joined
            FROM elements e JOIN tokens t ON t.page_id = e.page_id AND t.pos > e.pos AND t.pos < e.end_pos
            WHERE t.kind = 'text' GROUP BY ALL) j ON j.page_id = e.page_id AND j.pos = e.pos
        CROSS JOIN entities"""),
]


def block_ctes(min_length: int = fixed.DEFAULT_MIN_LENGTH) -> list[tuple[str, str]]:
    return TOKENS + LANGS + TREE + ATTRIBUTES + SCOPES + ROOTS + TEXTS + [
        ("blocks", f"""SELECT e.page_id, i.url, g.declared_lang,
                (row_number() OVER (PARTITION BY e.page_id ORDER BY e.pos) - 1)::INTEGER AS idx,
                x.text, e.tag, a.classes, a.id
            FROM elements e JOIN input i USING (page_id) JOIN page_langs g USING (page_id)
            JOIN roots r ON r.page_id = e.page_id JOIN texts x ON x.page_id = e.page_id AND x.pos = e.pos
            JOIN attributes a ON a.page_id = e.page_id AND a.pos = e.pos
            JOIN scopes s ON s.page_id = e.page_id AND s.pos = e.pos
            WHERE CASE WHEN r.root_pos IS NULL THEN e.tag NOT IN {quoted(tags.HEAD_ONLY_TAGS)}
                    ELSE e.pos > r.root_pos AND e.pos < r.root_end END
              AND e.tag NOT IN {quoted(fixed.SKIP_TAGS)} AND NOT s.scoped AND length(x.text) >= {min_length}
              AND NOT EXISTS (SELECT 1 FROM elements c WHERE c.page_id = e.page_id AND c.parent_pos = e.pos
                    AND c.tag {NOT_INLINE})"""),
    ]


# --- Text functions -----------------------------------------------------------------------------

def normalized(text: str) -> str:
    odd = fixed.SINGLE_QUOTES + fixed.DOUBLE_QUOTES + fixed.DASHES + fixed.NO_BREAK_SPACE
    return f"""replace(translate({text}, '{odd}', '''''''''""" + '""""' + f"""-- '), '{fixed.ELLIPSIS}', '...')"""


def snippet(text: str) -> str:
    n = fixed.SNIPPET_LENGTH
    return f"{text}[1:{n}] || CASE WHEN length({text}) > {n} THEN '...' ELSE '' END"


def element(tag: str, classes: str, id_: str) -> str:
    return (f"""{tag} || CASE WHEN {classes} <> '' THEN ' class="' || {classes} || '"' ELSE '' END"""
            f""" || CASE WHEN {id_} <> '' THEN ' id="' || {id_} || '"' ELSE '' END""")


# --- Model and detection ------------------------------------------------------------------------

LETTERS = r"[\p{L}\p{M}]+"
MODEL = [
    ("train_words", f"""SELECT lang, word, count(*) AS n FROM (SELECT lang,
        unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS word FROM documents) GROUP BY ALL"""),
    ("train_grams", """SELECT lang, gram, sum(n)::BIGINT AS n FROM (SELECT lang, n,
        unnest(list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram
        FROM train_words) GROUP BY ALL"""),
    ("totals", "SELECT lang, sum(n)::BIGINT AS total FROM train_grams GROUP BY lang"),
    ("vocabulary", "SELECT DISTINCT gram FROM train_grams"),
    ("model", """SELECT v.gram, t.lang, round(ln((coalesce(g.n, 0) + 1)::DOUBLE
            / (t.total + (SELECT count(*) FROM vocabulary))::DOUBLE) * 1000000)::BIGINT AS lp
        FROM vocabulary v CROSS JOIN totals t LEFT JOIN train_grams g ON g.gram = v.gram AND g.lang = t.lang"""),
]


def detection_ctes(source: str, keys: str, temperature: int = 1) -> list[tuple[str, str]]:
    """``detected``: the rows of ``source`` with lang and confidence; ``keys`` identify a row."""
    using = f"USING ({keys})"
    return MODEL + [
        ("row_words", f"""SELECT {keys}, word, count(*) AS n FROM (SELECT {keys}, unnest(regexp_extract_all(
            lower({normalized('text')}), '{LETTERS}')) AS word FROM {source}) GROUP BY ALL"""),
        ("word_scores", """SELECT word, lang, sum(lp) AS score FROM (SELECT word,
            unnest(list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram
            FROM (SELECT DISTINCT word FROM row_words)) JOIN model USING (gram) GROUP BY ALL"""),
        ("scores", f"""SELECT {keys}, lang, sum(n * score)::BIGINT AS score
            FROM row_words JOIN word_scores USING (word) GROUP BY ALL"""),
        ("tops", f"""SELECT {keys}, arg_max(lang, (score, lang_rank)) AS lang,
                1.0::DOUBLE / sum(exp((score - best)::DOUBLE / {1000000 * temperature})) AS confidence
            FROM (SELECT *, max(score) OVER (PARTITION BY {keys}) AS best,
                -row_number() OVER (PARTITION BY {keys} ORDER BY lang) AS lang_rank FROM scores) GROUP BY {keys}"""),
        ("detected", f"""SELECT s.*, t.lang AS detected, coalesce(t.confidence, 0.0)::DOUBLE AS confidence
            FROM {source} s LEFT JOIN tops t {using}"""),
    ]


def calibration_ctes() -> list[tuple[str, str]]:
    """``fitted`` (temperature): trained on three fifths of the documents, fitted to the lines of a fourth; ``judged``:
    the last fifth's lines, detected at it."""
    learnt = [("learnt", "SELECT * FROM documents WHERE doc_id % 5 >= 2"),
              *((n, q.replace("FROM documents", "FROM learnt")) for n, q in MODEL)]
    held = ("held", f"""SELECT doc_id, lang AS label, nth, text FROM (SELECT doc_id, lang, unnest(range(len(l))) AS nth,
        unnest(l) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 5 < 2))
        WHERE length(text) >= {fixed.DEFAULT_MIN_LENGTH}""")
    scores = [c for c in detection_ctes("held", "doc_id, nth") if c[0] in ("row_words", "word_scores", "scores")]
    return [*learnt, held, *scores,
        ("bests", "SELECT *, max(score) OVER (PARTITION BY doc_id, nth) AS best FROM scores"),
        ("grid", "SELECT pow(2.0::DOUBLE, k / 2.0::DOUBLE) AS t FROM (SELECT unnest(range(21)) AS k)"),
        ("losses", """SELECT t, doc_id, nth, ln(sum(exp((score - best)::DOUBLE / (1000000 * t))))
                - max(CASE WHEN lang = label THEN (score - best)::DOUBLE / (1000000 * t) END) AS loss
            FROM bests JOIN held USING (doc_id, nth) CROSS JOIN grid WHERE doc_id % 5 = 0 GROUP BY t, doc_id, nth"""),
        ("fitted", "SELECT arg_min(t, total) AS temperature FROM (SELECT t, sum(loss) AS total FROM losses GROUP BY t)"),
        ("judged", """SELECT doc_id, nth, label, arg_max(lang, (score, lang_rank)) AS detected,
                1.0::DOUBLE / sum(exp((score - best)::DOUBLE / (1000000 * temperature))) AS confidence
            FROM (SELECT *, -row_number() OVER (PARTITION BY doc_id, nth ORDER BY lang) AS lang_rank FROM bests)
            JOIN held USING (doc_id, nth) CROSS JOIN fitted WHERE doc_id % 5 = 1 GROUP BY doc_id, nth, label""")]


def finding_ctes(page: str, idx: str) -> list[tuple[str, str]]:
    """``issues`` from ``detected`` (page, idx, url, text, tag, classes, id) and ``declarations``."""
    return [
        ("sure", f"SELECT * FROM detected WHERE detected IS NOT NULL AND confidence >= {fixed.DEFAULT_CONFIDENCE}"),
        ("dominant", f"""SELECT {page}, detected AS dominant_lang, n AS n_blocks FROM (SELECT {page}, detected,
                count(*) AS n, min({idx}) AS first_seen FROM sure GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY {page} ORDER BY n DESC, first_seen) = 1"""),
        ("issues", f"""SELECT {page}, 0::BIGINT AS seq, l.url, l.declared_lang, d.dominant_lang AS detected_lang,
                'WU1' AS issue_type, '' AS snippet, 'html' AS element,
                'Change <html lang="' || l.declared_lang || '"> to <html lang="' || d.dominant_lang || '">' AS suggested_fix
            FROM declarations l JOIN dominant d USING ({page})
            WHERE l.declared_lang <> '' AND l.declared_lang <> d.dominant_lang
            UNION ALL
            SELECT {page}, s.{idx}::BIGINT + 1, s.url, d.dominant_lang, s.detected, 'WU2', {snippet('s.text')},
                {element('s.tag', 's.classes', 's.id')}, 'Add lang="' || s.detected || '" to the element'
            FROM sure s JOIN dominant d USING ({page}) WHERE s.detected <> d.dominant_lang"""),
    ]


def page_ctes(ignore: bool, temperature: int = 1) -> list[tuple[str, str]]:
    """From ``input`` to ``issues`` for HTML pages."""
    kept = [("kept", "SELECT * FROM blocks" + (f""" WHERE lower({stripped('text')}) NOT IN
        (SELECT phrase FROM phrases)""" if ignore else ""))]
    declarations = [("declarations", "SELECT page_id, url, declared_lang FROM input JOIN page_langs USING (page_id)")]
    return (([LINES, PHRASES] if ignore else []) + block_ctes() + kept
            + detection_ctes("kept", "page_id, idx", temperature)
            + declarations + finding_ctes("page_id", "idx"))


LINES = ("lines", "SELECT unnest(string_split(text, chr(10))) AS line FROM documents")
PHRASES = ("phrases", f"""SELECT DISTINCT lower({stripped('line')}) AS phrase FROM
    (SELECT line FROM lines GROUP BY line HAVING count(*) >= 5) WHERE {stripped('line')} <> ''""")
ALL_PHRASES = ("phrases", f"""SELECT DISTINCT lower({stripped('line')}) AS phrase FROM lines
    WHERE {stripped('line')} <> ''""")


def text_ctes(blocks: str, declarations: str) -> list[tuple[str, str]]:
    return [
        ("raw_blocks", blocks),
        ("blocks", f"""SELECT page, idx, page AS url, {collapsed('text')} AS text, tag, classes, id FROM raw_blocks
            WHERE length({collapsed('text')}) >= {fixed.DEFAULT_MIN_LENGTH}"""),
        ("declarations", declarations),
    ] + detection_ctes("blocks", "page, idx") + finding_ctes("page", "idx")


DOCUMENT_BLOCKS = text_ctes(
    """SELECT source AS page, doc_id AS idx, text, 'document' AS tag, '' AS classes, doc_id::VARCHAR AS id FROM documents""",
    "SELECT source AS page, source AS url, arg_min(lang, doc_id) AS declared_lang FROM documents GROUP BY source")
LINE_BLOCKS = text_ctes(
    """SELECT doc_id::VARCHAR AS page, unnest(range(len(l))) AS idx, unnest(l) AS text, 'line' AS tag, '' AS classes,
        '' AS id FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "SELECT doc_id::VARCHAR AS page, doc_id::VARCHAR AS url, lang AS declared_lang FROM documents")
TURN_BLOCKS = text_ctes(
    """SELECT conv_id::VARCHAR AS page, turn AS idx, text, 'turn' AS tag, role AS classes, '' AS id FROM conversations""",
    "SELECT DISTINCT conv_id::VARCHAR AS page, conv_id::VARCHAR AS url, NULL::VARCHAR AS declared_lang FROM conversations")


QUOTING_BLOCKS = text_ctes(
    """SELECT conv_id::VARCHAR AS page, turn AS idx, text, 'turn' AS tag, role AS classes, '' AS id FROM (
        FROM conversations UNION ALL SELECT doc_id % (SELECT count(DISTINCT conv_id) FROM conversations), 1000 + doc_id, 'quote', text
        FROM documents)""",
    "SELECT DISTINCT conv_id::VARCHAR AS page, conv_id::VARCHAR AS url, NULL::VARCHAR AS declared_lang FROM conversations")

# The URL list of the site: some URLs twice, some that were never landed.
LISTED = ("listed", """SELECT row_number() OVER (ORDER BY page_id, copy) - 1 AS ord, url FROM (
    SELECT page_id, 0 AS copy, url FROM pages
    UNION ALL SELECT page_id, 1, CASE WHEN page_id % 7 = 3 THEN url || '/gone' ELSE url END FROM pages WHERE page_id % 7 IN (0, 3))""")


def scan_input(offset: int, limit: int) -> list[tuple[str, str]]:
    return [LISTED, ("rewritten", REWRITTEN[1]), ("input", f"""SELECT l.ord AS page_id, l.url, r.html FROM listed l
        JOIN rewritten r USING (url) WHERE l.ord >= {offset} AND l.ord < {offset + limit}""")]


STATUS = "(CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 404 ELSE 200 END)::INTEGER"


def safe(cell: str) -> str:
    return f"CASE WHEN {cell}[1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN {literal(chr(39))} || {cell} ELSE {cell} END"


# --- Statements ---------------------------------------------------------------------------------

def statement(ctes: list[tuple[str, str]], select: str) -> str:
    seen: dict[str, str] = {}
    for name, body in ctes:
        seen.setdefault(name, body)
    once = {name: "" if name == "walk" else "MATERIALIZED " for name in seen}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {once[n]}({b})" for n, b in seen.items()) + "\n" + select


ISSUES = "seq, url, declared_lang, detected_lang, issue_type, snippet, element, suggested_fix"
REPORT_META = """'{sitemap}' AS sitemap_url, (SELECT count(*) FROM pages) AS total_urls,
    (SELECT count(DISTINCT url) FROM issues) AS flagged_urls, '{time}' AS scan_time"""
SITEMAP_TABLES = [
    ("size", "SELECT greatest(2, ceil(pow(count(*), 1.0 / 3)))::BIGINT AS k FROM pages"),
    ("leaves", f"""SELECT page_id // k AS file, (page_id % k)::INTEGER AS ord, url AS loc,
        '{SITEMAP_BASE}/leaf-' || (page_id // k) || '.xml' AS sitemap_url FROM pages, size"""),
    ("parts", f"""SELECT file // k AS file, (file % k)::INTEGER AS ord, sitemap_url AS loc,
        '{SITEMAP_BASE}/part-' || (file // k) || '.xml' AS sitemap_url
        FROM (SELECT DISTINCT file, sitemap_url FROM leaves), size"""),
    ("tops", f"""SELECT file // k AS file, (file % k)::INTEGER AS ord, sitemap_url AS loc,
        '{SITEMAP_BASE}/index-' || (file // k) || '.xml' AS sitemap_url
        FROM (SELECT DISTINCT file, sitemap_url FROM parts), size"""),
]


def oracle_statements(params: dict) -> dict[str, str]:
    """Statement per query name. ``params`` holds the arguments the queries use, by name."""
    plain_blocks, odd_blocks = [PLAIN, *block_ctes()], [REWRITTEN, *block_ctes()]
    plain, odd = [PLAIN, *TOKENS], [REWRITTEN, *TOKENS]
    scanned = [*scan_input(params["offset"], params["limit"]), *page_ctes(ignore=False)]
    odd_plain = [REWRITTEN, *page_ctes(ignore=False)]
    plain_audit, odd_audit = [PLAIN, *page_ctes(ignore=False)], [REWRITTEN, *page_ctes(ignore=True)]
    audit_select = f"SELECT page_id, {ISSUES} FROM issues"
    start, count, size = params["offset"], params["limit"], params["batch_size"]
    report = REPORT_META.format(sitemap=params["sitemap_url"], time=params["scan_time"])
    scope = "SELECT page_id, pos, tag, scoped FROM scopes"
    root = "SELECT page_id, root_tag, root_pos, root_end FROM roots"
    block = "SELECT page_id, url, declared_lang, idx, text, tag, classes, id FROM blocks"
    return {
        # sources
        "usable_pages": "SELECT page_id, url, 200 AS status, length(html)::INTEGER AS html_chars FROM pages WHERE html <> ''",
        "usable_pages_by_status": f"""SELECT page_id, url, {STATUS} AS status, length(html)::INTEGER AS html_chars FROM pages
            WHERE {STATUS} <> 0 AND page_id % 5 <> 2 AND html <> ''""",
        "usable_pages_strict": f"""SELECT page_id, url, {STATUS} AS status, length(html)::INTEGER AS html_chars FROM pages
            WHERE {STATUS} = 200 AND page_id % 5 <> 2 AND html <> ''""",
        "sitemap_entries": statement(SITEMAP_TABLES, """SELECT sitemap_url, 'urlset' AS kind, ord, loc FROM leaves
            UNION ALL SELECT sitemap_url, 'sitemapindex', ord, loc FROM parts
            UNION ALL SELECT sitemap_url, 'sitemapindex', ord, loc FROM tops"""),
        "resolved_urls": "SELECT row_number() OVER (ORDER BY page_id) - 1 AS ord, url FROM pages",
        "url_count": "SELECT count(url) AS n_urls FROM pages",
        "ignore_phrases": statement([LINES, ALL_PHRASES], "SELECT phrase FROM phrases"),
        # slices and batches
        "url_slice": f"""SELECT ord, url FROM (SELECT row_number() OVER (ORDER BY page_id) - 1 AS ord, url FROM pages)
            WHERE ord >= {start} AND ord < {start + count}""",
        "url_batches": f"""SELECT page_id // {size} AS batch_id, min(page_id) AS first_ord, max(page_id) AS last_ord,
            count(*) AS n_urls FROM pages GROUP BY 1""",
        # pages
        "html_tokens": statement(plain, "SELECT page_id, pos, kind, tag, token FROM tokens"),
        "html_elements": statement(plain + TREE, "SELECT page_id, pos, end_pos, depth, parent_pos, tag FROM elements"),
        "html_elements_rewritten": statement(
            odd + TREE, "SELECT page_id, pos, end_pos, depth, parent_pos, tag FROM elements"),
        "page_declared_lang": statement(plain + LANGS, "SELECT page_id, declared_lang FROM page_langs"),
        "page_declared_lang_rewritten": statement(odd + LANGS, "SELECT page_id, declared_lang FROM page_langs"),
        "content_root": statement(plain + TREE + ATTRIBUTES + ROOTS, root),
        "content_root_rewritten": statement(odd + TREE + ATTRIBUTES + ROOTS, root),
        "lang_scope": statement(plain + TREE + ATTRIBUTES + SCOPES, scope),
        "lang_scope_rewritten": statement(odd + TREE + ATTRIBUTES + SCOPES, scope),
        "element_text": statement(plain + TREE + TEXTS, "SELECT page_id, pos, tag, text FROM texts"),
        "text_blocks": statement(plain_blocks, block),
        "text_blocks_rewritten": statement(odd_blocks, block),
        # text functions
        "normalize_text": f"SELECT doc_id, replace({normalized('text')}, chr(10), ' ') AS normalized FROM documents",
        "snippets": f"SELECT doc_id, {snippet('text')} AS snippet FROM documents",
        "element_descriptor": statement(
            odd + TREE + ATTRIBUTES, f"SELECT page_id, pos, {element('tag', 'classes', 'id')} AS element FROM attributes"),
        "csv_safe": f"""SELECT cell, CASE WHEN cell[1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN {literal("'")} || cell
            ELSE cell END AS safe, n FROM (SELECT cell, count(*) AS n FROM (
                SELECT unnest(regexp_split_to_array(text, ' ')) AS cell FROM documents
                UNION ALL SELECT unnest(regexp_split_to_array(text, '(?i)[a-z0-9]+')) FROM conversations) GROUP BY cell)""",
        "blank_guard": statement([LINES], f"""SELECT line AS value, count(*) AS n, {stripped('line')} = '' AS blank
            FROM lines GROUP BY line"""),
        "clean_label": "SELECT doc_id, regexp_extract(lang, '^[^_]*') AS label FROM documents",
        "timestamp_name": "SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') AS name FROM events",
        "is_remote": "SELECT page_id, url[1:7] = 'http://' OR url[1:8] = 'https://' AS remote, false AS local_remote FROM pages",
        "issues_json": statement(DOCUMENT_BLOCKS, """SELECT replace(to_json({'page': page, 'seq': seq, 'url': url,
            'declared_lang': declared_lang, 'detected_lang': detected_lang, 'issue_type': issue_type, 'snippet': snippet,
            'element': element, 'suggested_fix': suggested_fix})::VARCHAR, '</', '<\\/') AS json FROM issues"""),
        # detection
        "lang_model": statement(MODEL, "SELECT gram, lang, lp FROM model"),
        "detect_language": statement(
            detection_ctes("documents", "doc_id"),
            "SELECT doc_id, detected AS lang, round(confidence, 4) AS confidence FROM detected"),
        "ignored_blocks": statement(plain_blocks + [LINES, PHRASES], f"""SELECT page_id, idx, text FROM blocks
            WHERE lower({stripped('text')}) IN (SELECT phrase FROM phrases)"""),
        "confident_blocks": statement(
            plain_audit, "SELECT page_id, idx, detected AS lang, round(confidence, 4) AS confidence FROM sure"),
        "confident_blocks_flat": statement(
            [PLAIN, *page_ctes(ignore=False, temperature=params["temperature"])],
            "SELECT page_id, idx, detected AS lang, round(confidence, 4) AS confidence FROM sure"),
        "confidence_calibration": statement(calibration_ctes(), """SELECT (SELECT temperature FROM fitted) AS temperature,
            least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(confidence), 4) AS confidence,
            round(avg(CASE WHEN detected = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy FROM judged GROUP BY 2"""),
        "confident_blocks_calibrated": statement(
            [PLAIN, *block_ctes(), *calibration_ctes(), *((n, q) for n, q in (
                ("block_words", f"""SELECT page_id, idx, word, count(*) AS n FROM (SELECT page_id, idx, unnest(regexp_extract_all(
                    lower({normalized('text')}), '{LETTERS}')) AS word FROM blocks) GROUP BY ALL"""),
                ("block_word_scores", """SELECT word, lang, sum(lp) AS score FROM (SELECT word, unnest(list_transform(
                    range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram
                    FROM (SELECT DISTINCT word FROM block_words)) JOIN model USING (gram) GROUP BY ALL"""),
                ("block_scores", """SELECT page_id, idx, lang, sum(n * score)::BIGINT AS score FROM block_words
                    JOIN block_word_scores USING (word) GROUP BY ALL"""),
                ("block_tops", """SELECT page_id, idx, arg_max(lang, (score, lang_rank)) AS lang,
                    1.0::DOUBLE / sum(exp((score - best)::DOUBLE / (1000000 * (SELECT temperature FROM fitted)))) AS confidence
                    FROM (SELECT *, max(score) OVER (PARTITION BY page_id, idx) AS best,
                        -row_number() OVER (PARTITION BY page_id, idx ORDER BY lang) AS lang_rank FROM block_scores)
                    GROUP BY page_id, idx""")))],
            f"""SELECT page_id, idx, lang, round(confidence, 4) AS confidence FROM block_tops
            WHERE confidence >= {fixed.DEFAULT_CONFIDENCE}"""),
        # findings
        "dominant_language": statement(plain_audit, "SELECT page_id, dominant_lang, n_blocks FROM dominant"),
        "dominant_language_lines": statement(LINE_BLOCKS, "SELECT page, dominant_lang, n_blocks FROM dominant"),
        "wu1_page_mismatch": statement(odd_audit, f"SELECT page_id, {ISSUES} FROM issues WHERE issue_type = 'WU1'"),
        "wu2_part_mismatch": statement(odd_audit, f"SELECT page_id, {ISSUES} FROM issues WHERE issue_type = 'WU2'"),
        "page_issues": statement(odd_audit, audit_select),
        "audit": statement(plain_audit, audit_select),
        "audit_documents": statement(DOCUMENT_BLOCKS, f"SELECT page, {ISSUES} FROM issues"),
        "audit_lines": statement(LINE_BLOCKS, f"SELECT page, {ISSUES} FROM issues"),
        "audit_conversations": statement(TURN_BLOCKS, f"SELECT page, {ISSUES} FROM issues"),
        "audit_quoting_conversations": statement(QUOTING_BLOCKS, f"SELECT page, {ISSUES} FROM issues"),
        "sitemap_audit": statement(scanned, audit_select),
        "sitemap_scan_summary": statement(scanned, f"""SELECT (SELECT count(*) FROM listed WHERE ord >= {start}
            AND ord < {start + count}) AS total_urls, count(DISTINCT url) AS flagged_urls, count(*) AS total_issues FROM issues"""),
        "scan_summary": statement(odd_audit, """SELECT (SELECT count(*) FROM pages) AS total_urls,
            count(DISTINCT url) AS flagged_urls, count(*) AS total_issues FROM issues"""),
        "report_rows": statement(odd_audit, f"""SELECT {report}, url, declared_lang, detected_lang, issue_type,
            snippet, element, suggested_fix FROM issues"""),
        "report_search": statement(odd_audit, f"""SELECT {report}, url, declared_lang, detected_lang, issue_type,
            snippet, element, suggested_fix FROM issues WHERE contains(lower(concat_ws(chr(10), '{params["sitemap_url"]}',
            '{params["scan_time"]}', url, declared_lang, detected_lang, issue_type, snippet, element, suggested_fix)),
            '{params["search"]}')"""),
        "csv_report": statement(odd_audit, f"""SELECT {report}, {safe('url')} AS url, {safe('declared_lang')} AS declared_lang,
            {safe('detected_lang')} AS detected_lang, issue_type, {safe('snippet')} AS snippet, {safe('element')} AS element,
            suggested_fix FROM issues"""),
        "csv_report_in_order": statement(odd_audit, f"""SELECT row_number() OVER (ORDER BY page_id, seq) - 1 AS line, {report},
            {safe('url')} AS url, {safe('declared_lang')} AS declared_lang, {safe('detected_lang')} AS detected_lang, issue_type,
            {safe('snippet')} AS snippet, {safe('element')} AS element, suggested_fix FROM issues"""),
        "sitemap_audit_whole": statement([*scan_input(0, 1 << 40), *page_ctes(ignore=False)], audit_select),
        "text_blocks_from_bytes": statement([FROM_BYTES, *plain_blocks[1:]], block),
        "audit_from_bytes": statement([FROM_BYTES, *page_ctes(ignore=False)], audit_select),
        "ignore_phrases_from_file": statement([LINES, ALL_PHRASES], "SELECT phrase FROM phrases"),
        "batched_audit_after_changes": statement(odd_plain, audit_select),
        "incremental_audit_landed_again": statement(odd_plain, audit_select),
        "json_feed_scan": statement(odd_audit, f"""SELECT to_json({{'sitemap_url': sitemap_url, 'total_urls': total_urls,
            'flagged_urls': flagged_urls, 'scan_time': scan_time}})::VARCHAR AS json FROM (SELECT {report})"""),
        "batched_audit_in_steps": statement(odd_plain, audit_select),
        "incremental_audit_rewritten": statement(odd_plain, audit_select),
        # resumable and incremental: the findings of the plain audit, however they are cut up
        "batched_audit": statement(plain_audit, audit_select),
        "incremental_audit": statement(plain_audit, audit_select),
    }
