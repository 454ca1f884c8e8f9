"""Personal data in texts, also where it is disguised, as spans of the source text.

Plain patterns find the base spans. For texts in which they change something, rewriting steps make a normal form:
characters by a table (homoglyphs, full-width forms, other decimal digits, dashes, zero-width characters), then
spelled digits and ``at`` / ``dot`` words. Each character of the normal form keeps its source range, so what the same
patterns find there is mapped back to the source. Spans that overlap a base span of their kind are not added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored forms of the same languages: linear on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at) if start < at else None
        done = tail.end() if tail else at + 1
        if tail:
            yield start, done
        at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def find_plain(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping spans of each kind; matches that fail their check are dropped."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if _DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# --- Normal form ---------------------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter (fixed values).
LOOKALIKES = dict(zip(
    "авгеѕіјкмнорстухԁһӏԛԝАВЕЅІЈКМНОРСТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abresijkmhopctyxdhlqwABESIJKMHOPCTYXaeikvoptuxABEZHIKMNOPTYX", strict=True))
DASHES = "‐‑‒–—−﹣"
DOTS = "․。｡⸱"
ZERO_WIDTH = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
               "eight": "8", "nine": "9"}


def _character_table() -> dict[int, str]:
    table = {ord(a): b for a, b in LOOKALIKES.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0xFE6B: "@", 0xA0: " ", 0x202F: " "}
    table |= {ord(c): "-" for c in DASHES} | {ord(c): "." for c in DOTS} | {ord(c): "" for c in ZERO_WIDTH}
    for c in range(0x80, 0x20000):
        if unicodedata.category(chr(c)) == "Nd" and c not in table:
            table[c] = str(unicodedata.decimal(chr(c)))
    return table


CHARACTERS = _character_table()
_STRANGE = frozenset(map(chr, CHARACTERS))
_WORD = "|".join(DIGIT_WORDS)
_LABEL = r"[A-Za-z0-9-]+"
_AT = r"(?:\s{0,4}[\[({<]\s{0,4}(?:at|@)\s{0,4}[\])}>]\s{0,4})"
_DOT = r"(?:\s{0,4}[\[({<]\s{0,4}(?:dot|\.)\s{0,4}[\])}>]\s{0,4}|\s{1,4}dot\s{1,4})"
#: An address with a bracketed at, or with a bare one if a dot after it is disguised too.
_ADDRESS = re.compile(
    rf"(?i)(?<=[a-z0-9._%+-])(?:(?P<at1>{_AT})(?={_LABEL}(?:(?:{_DOT}|\.){_LABEL})*(?:{_DOT}|\.)[a-z]{{2,}}(?![a-z]))"
    rf"|(?P<at2>\s{{1,4}}at\s{{1,4}}|@)(?={_LABEL}(?:(?:{_DOT}|\.){_LABEL})*{_DOT}[a-z]{{2,}}(?![a-z])))")
_DOMAIN_REST = re.compile(rf"(?i){_LABEL}|(?P<dot>{_DOT})|\.(?={_LABEL})")
_NUMBER = re.compile(
    rf"(?i)(?:(?<![a-z])plus\s{{1,4}})?(?<![a-z0-9])(?:{_WORD}|[0-9]+)(?:(?:[\x20-]+|{_DOT}|\.)(?:{_WORD}|[0-9]+)(?![a-z])){{3,}}")
_NUMBER_PART = re.compile(rf"(?i)(?P<plus>plus\s{{1,4}})|(?P<word>{_WORD})|(?P<dot>{_DOT})|(?P<gap>[\x20-]+)|[0-9.]+")


class Normal:
    """A text under rewriting: pieces of the new text, each with its source range."""

    def __init__(self, text: str):
        self.text = text
        self.at = list(range(len(text) + 1))  # source start of each character, and the end of the text
        self.end = list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ranges, in order; each new character stands for the whole range."""
        text, at, end, changed, last = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[last:a] + new)
            at += self.at[last:a] + [self.at[a]] * len(new)
            end += self.end[last:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[last:a] + [True] * len(new)
            last = b
        self.text, self.at, self.end, self.changed = "".join(text), at + self.at[-1:], end, changed


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    edits, done = [], 0
    for m in _ADDRESS.finditer(text):
        if m.start() < done:
            continue
        edits.append((m.start(), m.end(), "@"))
        done = m.end()
        while (part := _DOMAIN_REST.match(text, done)) and part.end() > done:
            if part["dot"]:
                edits.append((part.start(), part.end(), "."))
            done = part.end()
    return edits


def _number_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _NUMBER.finditer(text):
        parts = [p for p in _NUMBER_PART.finditer(text, m.start(), m.end())]
        if not any(p["word"] or p["dot"] for p in parts):  # what the kinds check decides about the rest
            continue
        for i, p in enumerate(parts):
            if p["plus"]:
                edits.append((p.start(), p.end(), "+"))
            elif p["word"]:
                edits.append((p.start(), p.end(), DIGIT_WORDS[p["word"].lower()]))
            elif p["dot"]:
                edits.append((p.start(), p.end(), "."))
            elif p["gap"]:
                spelled = parts[i - 1]["word"] and i + 1 < len(parts) and parts[i + 1]["word"]
                edits.append((p.start(), p.end(), "" if spelled else " "))
    return edits


def _character_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or _STRANGE.isdisjoint(text):
        return []
    return [(i, i + 1, CHARACTERS[ord(c)]) for i, c in enumerate(text) if c in _STRANGE]


def _with_free(taken: list[Span], spans: list[Span]) -> list[Span]:
    """``taken`` (sorted) and those of ``spans`` that overlap none of it."""
    starts = [a for a, _ in taken]
    free = []
    for a, b in spans:
        i = bisect_right(starts, a)
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(starts) or b <= starts[i]):
            free.append((a, b))
    return sorted(taken + free)


def find_disguised(text: str) -> dict[str, list[Span]]:
    """Source spans that the patterns find in the normal form and that hold something rewritten.

    What they find after an earlier step counts too, where no later span overlaps: a spelled digit beside a card
    number must not hide it.
    """
    normal, after = None, []
    for step in (_character_edits, _number_edits, _address_edits):
        if edits := step(normal.text if normal else text):
            normal = normal or Normal(text)
            normal.rewrite(edits)
            after.append({kind: [(normal.at[a], normal.end[b - 1]) for a, b in spans
                                 if any(normal.changed[a:b]) or normal.end[b - 1] - normal.at[a] != b - a]
                          for kind, spans in find_plain(normal.text).items()})
    found: dict[str, list[Span]] = {}
    for spans in reversed(after):
        found = {kind: _with_free(found.get(kind, []), spans[kind]) for kind in KINDS}
    return found


def find_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind; a null text has none."""
    text = text or ""
    base = find_plain(text)
    hidden = find_disguised(text)
    return base, {kind: _with_free(spans, hidden.get(kind, [])) for kind, spans in base.items()}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go as one."""
    out, last, pending = [], 0, None
    for a, b, kind in sorted((a, b, kind) for kind, own in spans.items() for a, b in own) + [(1 << 62, 1 << 62, "")]:
        if pending and a < pending[1]:
            pending = pending[0], max(b, pending[1]), pending[2]
            continue
        if pending:
            out += [text[last:pending[0]], f"<{pending[2].upper()}>"]
            last = pending[1]
        pending = a, b, kind
    return "".join(out) + text[last:]


def detect_pii(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, all spans.

    Reads doc_id and text only, whatever else the table has. Null and empty texts have no spans; repeated rows are
    judged alone. Spans are code points, end exclusive, in the order of KINDS, then by start. Within a kind spans
    are disjoint; those of two kinds may overlap. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {kind: [] for kind in KINDS}
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text)
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0)} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}
                | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact_pii(documents: DataFrame) -> DataFrame:
    """``documents`` with every span in text replaced and n_chars, if there, counted anew.

    A null text stays null. Other columns pass through as they are.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redacted(t, find_spans(t)[1]) for t in batch.column(names.index("text")).to_pylist()]
            yield batch.set_column(names.index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    cleaned = documents.mapInArrow(run, documents.schema)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(
            F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cleaned
