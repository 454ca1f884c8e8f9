import random
import re

from pyspark.sql import functions as F

from glossaudit.llm import quality_rules as rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {j for own in places.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def prose(r, n):
    out = []
    for i in range(n):
        word = "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9)))
        out.append(word + r.choice(["", "", "", "", "", ",", ".", ".\n"]))
    return " ".join(out).capitalize()


def table(spark):
    r = random.Random(5)
    rows = [(i, prose(r, r.randint(12, 300)), "en", "big" if i % 3 else "other") for i in range(400)]
    rows += [(1000 + i, " ".join("".join(r.choice("QXZ") for _ in range(9)) + "!!" for _ in range(60)), "en", "big") for i in range(20)]
    rows += [(1100 + i, " | ".join(prose(r, 40).split()), "en", "other") for i in range(20)]
    rows += [(1200, None, "en", "big"), (1201, "", None, None), (1202, " \n\t ", "en", None),
             (1203, "a b c d e " * 40, "en", "big"), (1204, "a b c d e a b c d e a b c d", "fr", "big"),
             (1205, "one line of text here\n" * 9 + "x", "en", "big"), (1206, "x" * 200_000 + " y" * 30_000, "en", "big"),
             (1207, prose(r, 60), "xx", "lonely"), (1208, prose(r, 60), None, None), (1208, prose(r, 61), None, None),
             (None, prose(r, 50), "en", "big"), (1209, "a\x0bb\x0cc\rd e f g é ü ß a\x0bb\x0cc\rd e f g", "en", "big"),
             (1210, "\n\n# * $ % & | < >\n\n# * $ % & | < >\n", "en", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_counts_and_outliers(spark):
    docs = table(spark).withColumns({"n_words": F.lit("x"), "kept": F.lit(None).cast("int"), "grp": F.lit(3)}).cache()
    texts = sorted((r.doc_id or -1, counts(r.text)) for r in docs.collect())
    got = rules.quality_rules(docs).collect()
    assert sorted((r.doc_id or -1, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
                  for r in got) == texts
    assert not any(r.kept for r in got if r.base_failed)
    plain = [r for r in got if r.doc_id is None or r.doc_id < 1000]
    junk = [r for r in got if r.doc_id and 1000 <= r.doc_id < 1200]
    assert all(r.kept for r in plain) and not any(r.kept for r in junk)
    kept = rules.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_too_few_texts_are_kept_without_an_estimate(spark):
    rows = [(1, "one two three four five six seven eight nine ten", "en", "a"), (2, "few", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id, r.kept, r.distance) for r in rules.quality_rules(docs).collect()) == [
        (1, True, None), (2, False, None)]
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_counts_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: counts(r.text) for r in docs.collect()}
    for r in rules.quality_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]


def test_no_python_on_the_main_path(spark):
    plan = rules.text_statistics(table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
