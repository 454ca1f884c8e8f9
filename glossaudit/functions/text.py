"""Text functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaudit.fixed_values import (
    DASHES, DOUBLE_QUOTES, ELLIPSIS, FORMULA_STARTS, NO_BREAK_SPACE, REMOTE_PREFIXES,
    SINGLE_QUOTES, SNIPPET_LENGTH, TIMESTAMP_FORMAT,
)

# WHITESPACE for Java, which is asked for every character of every text: the first 256 are single characters, that is one
# table, and only what lies between U+1680 and U+3000 is compared with the others.
SPACES = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
TYPOGRAPHIC = r"[\xa0\x{2013}-\x{2026}]"  # all that normalize_text maps, and some more


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends (the built-in ``trim`` only knows the space)."""
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def collapse_whitespace(text: Column) -> Column:
    """Every run of Unicode white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def normalize_text(text: Column) -> Column:
    """Replace typographic quotes, dashes, ellipsis and no-break space by ASCII."""
    singles = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + NO_BREAK_SPACE
    ascii_ = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " "
    mapped = F.replace(F.translate(text, singles, ascii_), F.lit(ELLIPSIS), F.lit("..."))
    return F.when(text.rlike(TYPOGRAPHIC), mapped).otherwise(text)  # most texts hold none


def flatten_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def ignore_key(text: Column) -> Column:
    """The form in which a block is compared with the ignore phrases (no typographic mapping)."""
    return F.lower(strip(text))


def clean_label(label: Column) -> Column:
    """``__label__zh_Hans`` -> ``zh``: classifier label to plain language code."""
    return F.substring_index(F.replace(label, F.lit("__label__"), F.lit("")), "_", 1)


def snippet(text: Column) -> Column:
    """The first 200 characters, with an ellipsis only if something was cut."""
    cut = F.when(F.char_length(text) > SNIPPET_LENGTH, "...").otherwise("")
    return F.concat(F.substring(text, 1, SNIPPET_LENGTH), cut)


def element_descriptor(tag: Column, classes: Column, element_id: Column) -> Column:
    """``p class="lead" id="intro"``; empty parts are left out."""
    def part(name: str, value: Column) -> Column:
        shown = F.concat(F.lit(f' {name}="'), value, F.lit('"'))
        return F.when(value != "", shown).otherwise("")

    return F.concat(tag, part("class", classes), part("id", element_id))


def page_fix(declared: Column, detected: Column) -> Column:
    return F.format_string('Change <html lang="%s"> to <html lang="%s">', declared, detected)


def part_fix(detected: Column) -> Column:
    return F.format_string('Add lang="%s" to the element', detected)


def csv_safe(value: Column) -> Column:
    """Prefix an apostrophe where a spreadsheet would read the cell as a formula."""
    risky = F.substring(value, 1, 1).isin(FORMULA_STARTS)
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def json_for_script(row: Column) -> Column:
    """A row as JSON that can be embedded in a script element."""
    return F.replace(F.to_json(row, {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/"))


def timestamp_name(ts: Column) -> Column:
    return F.date_format(ts, TIMESTAMP_FORMAT)


def is_remote(source: Column) -> Column:
    http, https = (F.startswith(source, F.lit(prefix)) for prefix in REMOTE_PREFIXES)
    return http | https


PIECE = 254
NO_GRAM = "  "  # stands for a text without letters; no trigram looks like that


def letters(text: Column) -> Column:
    """The lower-cased words of a text, made of letters and marks alone, with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def explode_trigrams(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, gram): the character trigrams of the lower-cased words, each between two spaces.

    Words are cut into pieces that overlap by two characters before the trigrams are cut out of
    the pieces: nearly all words are one piece, and a run of a million letters stays cheap. All
    three steps are generated code. A text without letters gives one row with ``NO_GRAM``.
    """
    words = F.split(letters(F.col(text)), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)), F.lit(PIECE))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    positions = F.sequence(F.lit(1), F.greatest(F.length("piece") - 2, F.lit(1)))
    return (
        rows.select(*keys, F.explode(F.coalesce(words, F.array(F.lit("")))).alias("word"))
        .select(*keys, "word", F.explode(starts).alias("start"))
        .select(*keys, F.substring(padded, F.col("start"), F.lit(PIECE + 2)).alias("piece"))
        .select(*keys, "piece", F.explode(positions).alias("at"))
        .select(*keys, F.substring("piece", F.col("at"), F.lit(3)).alias("gram"))
    )


def decode_xml_entities(text: Column) -> Column:
    """Resolve the character references every XML document may use."""
    pieces = F.regexp_extract_all(text, F.lit("(&#[xX]?[0-9a-fA-F]+;|&[a-z]+;|[^&]+|&)"), F.lit(1))
    named = F.create_map(*[F.lit(x) for x in ("&lt;", "<", "&gt;", ">", "&quot;", '"', "&apos;", "'", "&amp;", "&")])

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, "([0-9a-fA-F]+);$", 1)
        code = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
        character = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.when(F.startswith(p, F.lit("&#")), character).otherwise(F.coalesce(F.try_element_at(named, p), p))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)
