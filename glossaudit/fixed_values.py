"""These lists, defaults and formats decide results and must not be tuned."""

# --- Content root: selectors in order of priority ------------------------------------------
CONTENT_SELECTORS = ["main", "article", ".content", "#content"]

# --- Tags that are never blocks themselves -------------------------------------------------
SKIP_TAGS = ["script", "style", "nav", "header", "footer"]

# --- Children with these tags do not stop their parent from being a block -------------------
INLINE_TAGS = [
    "span", "a", "strong", "em", "b", "i", "small", "mark", "del", "ins",
    "sub", "sup", "code", "abbr", "dfn", "time", "q", "cite", "br", "wbr",
    "img", "picture", "source", "video", "audio", "label", "figcaption",
]

# --- Typographic characters and what they become before detection --------------------------
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"  # -> apostrophe
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"  # -> straight double quote
DASHES = "\u2013\u2014"  # -> hyphen
ELLIPSIS = "\u2026"  # -> three full stops
NO_BREAK_SPACE = "\u00a0"  # -> space

# --- First characters that make a spreadsheet cell a formula --------------------------------
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r"]

# --- Defaults -------------------------------------------------------------------------------
DEFAULT_CONFIDENCE = 0.7
DEFAULT_MIN_LENGTH = 20
DEFAULT_BATCH_SIZE = 250
SNIPPET_LENGTH = 200
MAX_SITEMAP_DEPTH = 5
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
TIMESTAMP_FORMAT = "yyyy-MM-dd_HHmmss"
REMOTE_PREFIXES = ["http://", "https://"]

# --- Report columns, in order ---------------------------------------------------------------
REPORT_COLUMNS = [
    "sitemap_url", "total_urls", "flagged_urls", "scan_time", "url", "declared_lang",
    "detected_lang", "issue_type", "snippet", "element", "suggested_fix",
]

# --- Characters that count as white space in text (the Unicode set, not only ASCII) ---------
WHITESPACE = (
    "\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
    "\\x{202f}\\x{205f}\\x{3000}"
)
