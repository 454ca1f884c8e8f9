import hashlib
import random

from pyspark.sql import functions as F

from glossaudit.llm import fingerprints as fp
from glossaudit.llm.stages import Stages


def rows():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcé") for _ in range(3))
    out = [(i * 3, " ".join(word() for _ in range(r.choice([0, 1, 3, 4, 5, 11, 12, 60, 200])))) for i in range(90)]
    out += [(5, None), (7, ""), (8, " \n "), (10, "same text twice over and over"), (10, "same text twice over and over"),
            (11, "same text twice over and over"), (13, "z " * 20_000), (14, "one")]
    return out


def test_minimum_of_each_window_with_rightmost_ties(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    h = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    grams = F.transform(F.filter(F.sequence(F.lit(0), F.size(h)), lambda i: i <= F.size(h) - fp.K),
                        lambda i: F.shiftright(F.xxhash64(*(F.get(h, i + j) for j in range(fp.K))), fp.PLACE_BITS))
    short = docs.where("length(text) < 2000 OR text IS NULL")
    got = short.select(fp.positions(fp.winnow(F.col("text"))).alias("f"), grams.alias("g"), F.size(h).alias("n")).collect()
    for r in got:
        if r.n < fp.K:
            assert len(r.f) == min(r.n, 1)
            continue
        want = []
        for a in range(max(1, len(r.g) - fp.WINDOW + 1)):
            window = r.g[a:a + fp.WINDOW]
            place = max(a + j for j, x in enumerate(window) if x == min(window))
            if (min(window), place) not in want:
                want.append((min(window), place))
        assert [(x.hash, x.pos) for x in r.f] == want


def edited(own, after):
    half = len(own) // 2
    return own[:len(own) - half] + after[:half]


def order(table):
    return sorted(((i, t or "") for i, t in table), key=lambda x: (-x[0] if x[0] is not None else 1 << 70, x[1]))


def test_edited_texts_and_likeness(spark, monkeypatch):
    table = rows() + [(None, "no id at all here"), (None, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({"range": F.lit(1), "own": F.lit("x"), "sent": F.lit(0)})
    ordered = order(table)
    want = []
    for (i, own), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text = edited(own, after)
        want.append((i, len(own), hashlib.sha256(text.encode()).hexdigest()))
    for in_range, most in ((512, 4096), (8, 4096), (4, 5)):
        monkeypatch.setattr(fp, "ROWS_IN_RANGE", in_range)
        monkeypatch.setattr(fp, "RANGES_MOST", most)
        got = fp.edited_fingerprints(docs).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    sets = lambda s: {x.split(":")[0] for x in s.split(",") if x}
    for r in got:
        a, b = sets(r.fingerprint), sets(r.edited_fingerprint)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in got if r.doc_id in (10, 11)}) == 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[11].near_next == 1.0 and by_id[14].near_next == 0.0


def test_empty_and_single_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.edited_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    r = fp.edited_fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(edited("a b c d", "a b c d").encode()).hexdigest()
    assert r.near_next == 1.0
    assert "Python" not in fp.fingerprint_documents(one)._jdf.queryExecution().toString()
    assert fp.with_next(one, F.lit(1), Stages(spark, "test")).first().next_text == "a b c d"


def test_texts_without_blanks_are_wound_too(spark):
    """Half of a text kept, in scripts that have no blanks and in words without end."""
    r = random.Random(6)
    for draw in (lambda: chr(r.randint(0x4E00, 0x9FFF)), lambda: chr(r.randint(0x0E01, 0x0E2E)), lambda: r.choice("abcdefghij")):
        table = [(i, "".join(draw() for _ in range(400))) for i in range(3)]
        for x in fp.edited_fingerprints(spark.createDataFrame(table, "doc_id long, text string")).collect():
            assert x.near_edited > 0.1 and x.near_next == 0.0
    shifted = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300))
    both = spark.createDataFrame([(shifted, "新" + shifted[:150])], "a string, b string").select(
        fp.likeness(fp.hashes(fp.winnow(F.col("a"))), fp.hashes(fp.winnow(F.col("b"))))).first()[0]
    assert both > 0.3
    words = spark.createDataFrame([("ab 中文 " + "x" * 35,)], "t string").select(fp.words_of(F.col("t"))).first()[0]
    assert words == ["ab", "中", "文", "x" * 16, "x" * 16, "x" * 3]
