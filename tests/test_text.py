import datetime
import json

from pyspark.sql import functions as F

from glossaudit import fixed_values
from glossaudit.functions import text
from glossaudit.operators import findings, report
from glossaudit.sources import phrases


def apply(spark, function, values, schema="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {schema}").select("i", function(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def test_typographic_characters(spark):
    values = ["World’s Best Bank", "“Hello”", "Hello—World", "a…b c–‚‛‘„‟"]
    assert apply(spark, text.normalize_text, values) == [
        "World's Best Bank", '"Hello"', "Hello-World", "a...b c-'''\"\""]


def test_snippet_counts_characters(spark):
    values = ["x" * 199, "x" * 200, "x" * 201, "\U0001F600" * 201]
    assert apply(spark, text.snippet, values) == ["x" * 199, "x" * 200, "x" * 200 + "...", "\U0001F600" * 200 + "..."]


def test_csv_guard(spark):
    values = ["=cmd|'/C calc'!A0", "+1+1", "-123", "@SUM(A1)", "\tx", "\rx", "Hello world", "a-b", "", None]
    assert apply(spark, text.csv_safe, values) == [
        "'=cmd|'/C calc'!A0", "'+1+1", "'-123", "'@SUM(A1)", "'\tx", "'\rx", "Hello world", "a-b", "", None]
    rows = spark.createDataFrame([(-42, None, "-1")], "n int, s string, t string")
    assert tuple(report.csv_safe_columns(rows).first()) == (-42, None, "'-1")


def test_ignore_list(spark, tmp_path):
    file = tmp_path / "ignore_phrases.txt"
    file.write_text("phrase one\n  Phrase TWO \n\n \nphrase one\n liberté \nworld's best bank\n", encoding="utf-8")
    loaded = phrases.load_ignore_phrases(spark, str(file))
    assert {r.phrase for r in loaded.collect()} == {"phrase one", "phrase two", "liberté", "world's best bank"}
    assert phrases.load_ignore_phrases(spark, str(tmp_path / "none.txt")).count() == 0
    values = ["World's Best Bank", "Something else", "World’s best bank", "the world's best bank", " PHRASE two "]
    blocks = spark.createDataFrame([(v,) for v in values], "text string")
    kept = {r.text for r in findings.drop_ignored(blocks, loaded).collect()}
    assert kept == {"Something else", "World’s best bank", "the world's best bank"}
    assert {r.text for r in findings.only_ignored(blocks, loaded).collect()} == set(values) - kept


def test_element_and_fixes(spark):
    row = spark.range(1).select(
        text.element_descriptor(F.lit("p"), F.lit("a b"), F.lit("x")).alias("full"),
        text.element_descriptor(F.lit("p"), F.lit(""), F.lit("")).alias("bare"),
        text.page_fix(F.lit("fr"), F.lit("en")).alias("page"), text.part_fix(F.lit("de")).alias("part")).first()
    assert tuple(row) == ('p class="a b" id="x"', "p", 'Change <html lang="fr"> to <html lang="en">',
                          'Add lang="de" to the element')


def test_labels_sources_and_blank(spark):
    assert apply(spark, text.clean_label, ["__label__en", "__label__zh_Hans", "fr"]) == ["en", "zh", "fr"]
    assert apply(spark, text.is_remote, ["http://x", "https://x", "./x.xml", "ftp://x"]) == [True, True, False, False]
    assert apply(spark, text.is_blank, [None, "", "  \n", "x"]) == [True, True, True, False]
    assert apply(spark, text.flatten_newlines, ["a\nb"]) == ["a b"]


def test_json_is_safe_in_a_script(spark):
    rows = spark.createDataFrame([("</script>é\"", None)], "snippet string, x string")
    line = report.issues_json(rows).first().json
    assert "</" not in line and "é" in line
    assert json.loads(line) == {"snippet": "</script>é\"", "x": None}


def test_timestamp_name(spark):
    moment = datetime.datetime(2024, 5, 6, 7, 8, 9)
    assert report.scan_stamp(spark, moment) == ("2024-05-06T07:08:09", "2024-05-06_070809")


def test_trigrams_of_short_and_very_long_words(spark):
    letters = "".join(chr(97 + i * i % 26) for i in range(2000))
    values = ["The cat, a DOG!", letters, "123 !", "", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = {}
    for r in text.explode_trigrams(df, "t", "i").collect():
        got.setdefault(r.i, []).append(r.gram)

    def grams(words):
        return sorted(f" {w} "[k:k + 3] for w in words for k in range(len(w)))

    assert sorted(got[0]) == grams(["the", "cat", "a", "dog"])
    assert sorted(got[1]) == grams([letters])
    assert got[2] == got[3] == got[4] == [text.NO_GRAM]


def test_white_space_is_the_same_set_in_fewer_comparisons(spark):
    every = spark.range(1, 0x3101).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"), "id")
    found = every.where(F.col("c").rlike(f"^{text.SPACES}$") != F.col("c").rlike(f"^[{fixed_values.WHITESPACE}]$"))
    assert found.count() == 0 and every.where(F.col("c").rlike(f"^{text.SPACES}$")).count() == 29


def test_typographic_characters_are_all_looked_for(spark):
    mapped = (fixed_values.SINGLE_QUOTES + fixed_values.DOUBLE_QUOTES + fixed_values.DASHES + fixed_values.ELLIPSIS
              + fixed_values.NO_BREAK_SPACE)
    assert all(set(c) <= set("'\"-. ") for c in apply(spark, text.normalize_text, [*mapped]))
    assert apply(spark, text.normalize_text, ["plain", "", None, "\u2020"]) == ["plain", "", None, "\u2020"]
