import hashlib
import re

import pytest

from glossaudit.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sums(digits):
    return sum(int(c) for i, d in enumerate(digits[::-1]) for c in str(int(d) * (1 + i % 2))) % 10 == 0


def plain(text):
    found = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and sums(digits or "1"), "phone": 8 <= len(digits) <= 15}[kind]
            spans += [m.span()] * good
        found[kind] = spans
    return found


TEXTS = ["", "a@b.c", "a@b", "x@y@z.com.", "..@-.-", "é.a%b@c-d.e.f", "a@b.c@d.e", "@a.b c@ d", "1.2.3.4", "1.2.3.4.5.6.7.8",
         "256.1.1.1 0255.1.1.1", "12.34.56", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111 1111 1111",
         "0000000000000000000", "tel +1 (456) 555-2186, +12 34", "+1+2 345 678 90", "++49 30 1234567-", "+1(((2", "1" * 5000,
         "a" * 5000 + "@" + "b" * 5000 + ".c", "+" * 3000, "1." * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.find_plain(text) == plain(text)


def test_base_spans_on_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in pii.detect_pii(rows).collect():
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in base[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("write john.doe at mail dot example dot com now", "email", "john.doe at mail dot example dot com"),
    ("x jane (at) foo.org y", "email", "jane (at) foo.org"), ("bob[at]bar[dot]de.", "email", "bob[at]bar[dot]de"),
    ("аdmin@exаmple.com", "email", "аdmin@exаmple.com"), ("a＠b．com", "email", "a＠b．com"),
    ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
    ("ip one nine two dot one six eight dot one dot two x", "ip", "one nine two dot one six eight dot one dot two"),
    ("call plus one five five five one two three four five six seven ok", "phone",
     "plus one five five five one two three four five six seven"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"), ("tel ＋1 (456) 555-2186", "phone", "＋1 (456) 555-2186")])
def test_disguised_data_is_mapped_back(text, kind, hidden):
    base, every = pii.find_spans(text)
    assert base[kind] == [] and [text[a:b] for a, b in every[kind]] == [hidden]
    assert pii.redacted(text, every) == text.replace(hidden, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["look at example.com", "we met at noon. dot dot", "one two, three", "at home (at) night", "é à ü"])
def test_ordinary_text_is_left_alone(text):
    assert not any(pii.find_spans(text)[1].values())


def test_overlaps_go_as_one():
    assert pii.redacted("ab cdefg h", {"card": [(3, 6)], "phone": [(5, 8)], "ip": [(0, 2)]}) == "<IP> <CARD> h"


def test_table_with_nulls_and_other_columns(spark):
    rows = [(1, "mail a@b.cd", 11, "x"), (1, "mail a@b.cd", 11, "x"), (2, None, None, None), (None, "", 0, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted(map(tuple, pii.detect_pii(table).select("doc_id", "n_email", "spans").collect()), key=str)
    assert got == sorted([(1, 1, "email:5:11"), (1, 1, "email:5:11"), (2, 0, ""), (None, 0, "")], key=str)
    clean = pii.redact_pii(table)
    assert clean.columns == table.columns
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(
        [(1, "mail <EMAIL>", 12, "x")] * 2 + [(2, None, None, None), (None, "", 0, "y")], key=str)
    assert pii.detect_pii(table.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("mail john@example[.]com now", "email", "john@example[.]com"), ("x jane (@) foo.org y", "email", "jane (@) foo.org"),
    ("x jane [@] foo[.]org y", "email", "jane [@] foo[.]org"), ("host 192 dot 168 dot 0 dot 1, up", "ip", "192 dot 168 dot 0 dot 1"),
    ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"), ("at 10.0(dot)0.7 it", "ip", "10.0(dot)0.7"),
    ("five.five.five.five", "ip", "five.five.five.five"), ("tel +1 555 one two three 4567 ok", "phone", "+1 555 one two three 4567"),
    ("pay 4111 1111 1111 111 one today", "card", "4111 1111 1111 111 one")])
def test_disguise_is_found_without_other_signs_in_the_text(text, kind, hidden):
    base, every = pii.find_spans(text)
    assert not base[kind] and [text[a:b] for a, b in every[kind]] == [hidden]
    padded = text + " ...   dot ."
    assert pii.find_spans(padded)[1][kind] == every[kind]
    assert hidden not in pii.redacted(text, every)


@pytest.mark.parametrize("text", ["one of two or 3 plus 4", "1.5 2.5 3.5 4 five", "192 dot 168 dot 0 dot 999", "one two three four five",
                                  "see [.] and (@) there", "items 1 - 2 - 3 - four", "version 1 2 3 dot 4"])
def test_numbers_and_signs_that_are_no_personal_data_stay(text):
    assert not any(pii.find_spans(text)[1].values())


def test_spelled_digit_beside_a_disguised_number_does_not_hide_it():
    text = "pay one ４１１１ 1111 1111 1111 or 4111 1111 1111 111 one"
    assert [text[a:b] for a, b in pii.find_spans(text)[1]["card"]] == ["４１１１ 1111 1111 1111", "4111 1111 1111 111 one"]
