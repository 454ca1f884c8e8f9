import random

import numpy as np
from pyspark.sql import functions as F

from glossaudit.llm import substring_dedup as dedup
from glossaudit.llm.words import Hasher


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlué") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_passages_are_found_whatever_stands_before_them(spark):
    r = random.Random(8)
    passage = prose(r, 60)
    rows = [(i, prose(r, r.randint(5, 300))) for i in range(200)]
    planted = set()
    for i in range(0, 200, 10):
        head = rows[i][1]
        rows[i] = (i, head[:len(head) // 2] + passage + head[len(head) // 2:])
        planted.add(i)
    rows += [(300, None), (301, ""), (302, "x"), (303, "y" * 100_000), (None, passage), (304, rows[3][1]), (305, rows[3][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "run": F.lit(2), "d1": F.lit("x")})
    got = dedup.repeated_spans(table).collect()
    texts = dict(rows)
    for x in got:
        if x.doc_id != 303:
            assert texts[x.doc_id].encode()[x.start:x.end].strip() in (passage if x.doc_id in planted else texts[3]).encode()
    assert {x.doc_id for x in got} - {303} == planted | {3, 304, 305}
    assert {x.doc_id for x in got if x.kept} >= {0, 3} and all(x.original in (0, 3) for x in got if x.doc_id != 303)
    assert dedup.repeated_spans(table.limit(0)).count() == 0


def starts_of(*texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    return dedup.chunk_starts(Hasher(lower=False), np.frombuffer(b"".join(data), np.uint8), offsets).tolist()


def test_an_insertion_moves_no_cut_beyond_the_units_around_it():
    r = random.Random(2)
    words = prose(r, 3000).split(" ")
    text = " ".join(words)
    size = len(text.encode())
    starts = starts_of(text)
    assert starts[0] == 0 and starts[-1] < size and 300 < len(starts) < 600
    for at in (0, 1, 700, 2999):
        changed = " ".join([*words[:at], "some words put in", *words[at:]])
        more = len("some words put in ".encode())
        moved = starts_of(changed)
        reach = [len(" ".join(words[:max(0, at - 8)]).encode()), len(" ".join(words[:at + 8]).encode())]
        assert {s for s in starts if 0 < s < reach[0]} == {s for s in moved if 0 < s < reach[0]}
        assert {s + more for s in starts if s > reach[1]} == {s for s in moved if s > reach[1] + more}


def test_cuts_are_those_of_a_plain_search():
    r = random.Random(3)
    texts = [" ".join(r.choice(["ab", "c", "déf", "中文", "x" * 40, " ", "g\n"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    alone, at = [], 0
    for text in texts:
        alone += [at + s for s in starts_of(text)]
        at += len(text.encode())
    assert starts_of(*texts) == alone
    for text in texts:  # the least within RADIUS units, found one by one
        data = np.frombuffer(text.encode(), np.uint8)
        hasher = Hasher(lower=False)
        _, starts, ends = hasher.words(data, np.array([0, len(data)]))
        units = dedup.unit_starts(data, starts, ends).tolist()
        own = [int(hasher.stems(np.array([a]), np.array([b]))[0]) >> 32 for a, b in zip(units, [*units[1:], len(data)])]
        rolled = [((own[i - 1] << 16 if i else 0) + h) % (1 << 32) for i, h in enumerate(own)]
        expected, last = [0] if len(data) else [], -dedup.RADIUS - 1
        for i, h in enumerate(rolled):
            if h == min(rolled[max(0, i - dedup.RADIUS):i + dedup.RADIUS + 1]) and i - last > dedup.RADIUS:
                expected.append(units[i])
                last = i
        assert starts_of(text) == sorted(set(expected))


def test_every_shared_passage_is_that_of_a_plain_comparison(spark):
    r = random.Random(35)
    common = [prose(r, n) for n in (51, 55, 70, 120, 400)]
    rows = [(i, " | ".join([str(i) * 3, prose(r, r.randint(1, 60)), *r.sample(common, r.randint(0, 2)), prose(r, r.randint(1, 60)), str(i) * 4]))
            for i in range(40)]
    texts = {i: t.encode() for i, t in rows}
    expected = {i: set() for i in texts}
    for i, text in texts.items():  # bytes in a passage of over 50 words that another text holds too
        for passage in common:
            own = passage.encode()
            if own in text and any(own in t for j, t in texts.items() if j != i):
                expected[i] |= set(range(text.index(own), text.index(own) + len(own)))
    covered = {i: set() for i in texts}
    for x in dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered[x.doc_id] |= set(range(x.start, x.end))
    for i in texts:
        assert expected[i] <= covered[i] and len(covered[i] - expected[i]) <= 12, i


def test_a_passage_of_51_short_words_in_two_texts_is_found_to_its_ends(spark):
    r = random.Random(31)
    rows, passages = [], {}
    for i in range(0, 600, 2):
        passage = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 1 + i % 8))) for _ in range(51))
        for j, mark in ((i, "<>"), (i + 1, "[]")):
            head, tail = (prose(r, r.randint(0, 40)) for _ in range(2))
            rows.append((j, head + mark[0] + passage + mark[1] + tail))
            passages[j] = (len((head + mark[0]).encode()), len((head + mark[0] + passage).encode()))
    got = dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.start, x.end) for x in got} == passages and len(got) == len(passages)
    assert all(x.kept == (x.doc_id % 2 == 0) and x.original == x.doc_id // 2 * 2 for x in got)


def test_a_phrase_in_many_texts_does_not_hide_a_longer_passage(spark):
    r = random.Random(32)
    passage = prose(r, 51)
    middle = passage[100:180]
    rows = [(i, prose(r, 30) + middle + prose(r, 30)) for i in range(40)]
    rows += [(50, prose(r, 30) + "<" + passage + ">" + prose(r, 30)), (51, prose(r, 3) + "[" + passage + "]")]
    texts = {i: t.encode() for i, t in rows}
    got = dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {i: set() for i in texts}
    for x in got:
        covered[x.doc_id] |= set(range(x.start, x.end))
    for i in (50, 51):
        a = texts[i].index(passage.encode())
        assert covered[i] == set(range(a, a + len(passage.encode())))


def test_repeated_and_null_ids_are_texts_of_their_own(spark):
    r = random.Random(33)
    one, two, three = (prose(r, 60) for _ in range(3))
    whole = prose(r, 80)
    rows = [(7, prose(r, 50) + " " + one + " " + prose(r, 50)), (7, prose(r, 3) + " " + one + " " + prose(r, 80)), (8, whole), (8, whole),
            (9, prose(r, 20) + "\n" + two + "\n" + prose(r, 20)), (None, prose(r, 5) + "\t" + two + "\t"), (None, three), (None, three)]
    got = dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = {7: len(one.encode()), 8: len(whole.encode()), 9: len(two.encode())}
    assert sorted((x.doc_id, x.kept, x.original) for x in got) == [(7, False, 7), (7, True, 7), (8, False, 8), (8, True, 8), (9, True, 9)]
    assert all(0 <= x.end - x.start - size[x.doc_id] <= 2 for x in got)


def test_spans_in_scripts_without_blanks_end_between_characters(spark):
    r = random.Random(34)
    text = lambda n: "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n))
    shared = text(60)
    rows = [(i, text(r.randint(0, 90)) + shared + text(r.randint(0, 90))) for i in range(2)]
    got = dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: rows[x.doc_id][1].encode()[x.start:x.end].decode() for x in got} == {0: shared, 1: shared}
