import pytest
from pyspark.sql import functions as F

from glossaudit.functions.text import explode_trigrams
from glossaudit.operators import findings, langid
from glossaudit.params import AuditParams
from glossaudit.plans import audit as audits

EN = "this is a long paragraph of english text that should be easy to recognise"
DE = "dies ist ein langer absatz mit deutschem text der leicht zu erkennen sein sollte"
FR = "ceci est un long paragraphe de texte qui devrait être facile à reconnaître"


def detections(spark, rows):
    """rows: page, idx, lang, confidence, declared."""
    df = spark.createDataFrame(rows, "page_id long, idx int, lang string, confidence double, declared_lang string")
    return df.withColumns({
        "url": F.concat(F.lit("u"), F.col("page_id")), "snippet": F.concat(F.lit("s"), F.col("idx")),
        "element": F.lit("p")})


ROWS = [
    (1, 0, "de", 0.9, "fr"), (1, 1, "en", 0.9, "fr"), (1, 2, "en", 0.7, "fr"),  # en wins; WU1 + WU2
    (2, 0, "de", 0.8, None), (2, 1, "en", 0.8, None), (2, 2, "en", 0.69, None),  # tie: first seen wins, no WU1
    (3, 3, "en", 0.8, ""), (3, 9, "de", 0.8, ""), (3, 10, "de", 0.8, ""),  # blank declaration: no WU1
    (4, 0, "en", 0.1, "de"), (4, 1, None, 0.0, "de"),  # nothing confident: no finding
    (5, 0, "en", 1.0, "en"), (5, 1, "en", 1.0, "en"),  # fine
    (6, 5, "fr", 0.9, "de"), (6, 2, "de", 0.9, "de"), (6, 7, "en", 0.9, "de"),  # three-way tie
]


def in_pages(sure):
    rows = sure.withColumn("row", F.monotonically_increasing_id()).cache()
    found = findings.findings_in_pages(rows.select("page_id", "idx", "row", "lang"), rows.select("row", "declared_lang"))
    return findings.described_findings(found, rows.select("row", "url", "snippet", "element"))


def test_rules(spark):
    sure = findings.confident(detections(spark, ROWS))
    dominant = {r.page_id: (r.dominant_lang, r.n_blocks) for r in findings.dominant_language(sure).collect()}
    assert dominant == {1: ("en", 2), 2: ("de", 1), 3: ("de", 2), 5: ("en", 2), 6: ("de", 1)}
    issues = in_pages(sure).orderBy("page_id", "seq").collect()
    got = [(r.page_id, r.seq, r.issue_type, r.declared_lang, r.detected_lang, r.snippet, r.element) for r in issues]
    assert got == [
        (1, 0, "WU1", "fr", "en", "", "html"), (1, 1, "WU2", "en", "de", "s0", "p"),
        (2, 2, "WU2", "de", "en", "s1", "p"), (3, 4, "WU2", "de", "en", "s3", "p"),
        (6, 6, "WU2", "de", "fr", "s5", "p"), (6, 8, "WU2", "de", "en", "s7", "p"),
    ]
    assert issues[0].suggested_fix == 'Change <html lang="fr"> to <html lang="en">'
    assert issues[1].suggested_fix == 'Add lang="de" to the element'


def test_join_and_window_agree(spark):
    sure = findings.confident(detections(spark, ROWS))
    declared = detections(spark, ROWS).select("page_id", "url", "declared_lang").distinct()
    one = in_pages(sure)
    other = findings.findings_by_join(sure.drop("declared_lang"), declared, "page_id").select(*one.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_summary_counts_distinct_urls(spark):
    urls = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "url string")
    issues = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    assert tuple(findings.scan_summary(urls, issues).first()) == (4, 2, 3)
    assert tuple(findings.scan_summary(urls, issues.where("false")).first()) == (4, 0, 0)


def test_audit_of_pages(make_pages, model, spark):
    body = f"<p>{EN}</p><p>{EN} again</p>"
    pages = make_pages(
        f"<html lang=fr><body>{body}<p class='q r' id=x>{DE}</p></body></html>",
        f"<html><body>{body}<p lang=de>{DE}</p></body></html>",
        f"<html lang=fr><body>{body}</body></html>", "", f"<html lang=de><body>{body}</body></html>",
        f"<html lang=de><body>{body}</body></html>", f"<html lang=en><body><p>{EN}</p><p>1234567890 1234567890</p></body></html>",
        status={2: 0, 4: 404}, urls={5: "https://example.org/4"})
    rows = audits.audit(pages, model).orderBy("page_id", "seq").collect()
    assert [(r.page_id, r.issue_type, r.declared_lang, r.detected_lang, r.element) for r in rows] == [
        (0, "WU1", "fr", "en", "html"), (0, "WU2", "en", "de", 'p class="q r" id="x"'),
        (4, "WU1", "de", "en", "html"), (5, "WU1", "de", "en", "html")]
    assert rows[1].snippet == DE
    strict = audits.audit(pages, model, params=AuditParams(strict=True))
    assert {r.page_id for r in strict.collect()} == {0, 5}
    phrases = spark.createDataFrame([(DE,)], "phrase string")
    assert [r.issue_type for r in audits.audit(pages, model, phrases).where("page_id = 0").collect()] == ["WU1"]
    assert audits.audit(pages, model, params=AuditParams(confidence=1.01)).count() == 0


def test_detection(spark, model, monkeypatch):
    rows = [(0, EN), (1, DE), (2, FR), (3, "12345 !!"), (4, ""), (5, None), (6, "日本語")]
    texts = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.lang, r.confidence) for r in langid.detect_language(texts, model).collect()}
    assert [got[i][0] for i in range(3)] == ["en", "de", "fr"] and min(got[i][1] for i in range(3)) > 0.7
    assert [got[i] for i in range(3, 7)] == [(None, 0.0)] * 4
    monkeypatch.setattr("glossaudit.storage.BROADCAST_LIMIT_BYTES", 0)
    assert not model.broadcastable
    shuffled = {r.id: (r.lang, r.confidence) for r in langid.detect_language(texts, model).collect()}
    assert shuffled == got
    monkeypatch.setattr("glossaudit.storage.BROADCAST_LIMIT_BYTES", 88 * 40)  # room for some grams
    assert not model.broadcastable and 0 < model.hot().count() <= 40
    assert {r.id: (r.lang, r.confidence) for r in langid.detect_language(texts, model).collect()} == got
    flat = {r.id: r.confidence for r in langid.detect_language(texts, model, temperature=100.0).collect()}
    assert flat[0] < got[0][1]


def test_frequent_grams_do_not_meet_in_one_task(spark, monkeypatch):
    """Texts that all hold the same frequent grams, with a model that may not be broadcast as a whole."""
    model = langid.train(spark.createDataFrame([("en", EN)] * 20 + [("de", DE)], "lang string, text string"))
    texts = spark.range(400).select("id", F.concat(F.lit(EN + " "), F.hex("id")).alias("text"))
    monkeypatch.setattr("glossaudit.storage.BROADCAST_LIMIT_BYTES", 80 * (model.n_grams - 1))
    assert not model.broadcastable
    kept, dealt = langid.staged, []
    monkeypatch.setattr(langid, "staged", lambda df, name: dealt.append(kept(df, name)) or dealt[-1])
    scores = langid.language_scores(texts, model, "id")
    assert {r.lang for r in scores.collect()} == {"en"}
    per_gram = [r["count"] for r in dealt[0].where("rare IS NOT NULL").groupBy("rare").count().collect()]
    whole = explode_trigrams(texts, "text", "id").select("id", "gram").distinct().groupBy("gram").count()
    assert whole.agg(F.max("count")).first()[0] == 400  # what one task would have got
    assert max(per_gram) < 100 and sum(per_gram) < 0.2 * whole.agg(F.sum("count")).first()[0]


def test_model_table(spark):
    rows = [("en", "ab"), ("en", "ab a"), ("de", "b"), (None, "zzz")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    import math
    counts = {"en": {" ab": 2, "ab ": 2, " a ": 1}, "de": {" b ": 1}}
    grams = {g for c in counts.values() for g in c}
    expected = {
        (g, lang, round(math.log((c.get(g, 0) + 1) / (sum(c.values()) + len(grams))) * 1_000_000))
        for lang, c in counts.items() for g in grams}
    assert {tuple(r) for r in model.as_table().collect()} == expected


def test_hot_group_of_texts(spark, model):
    texts = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("page"), F.col("id").alias("idx"),
        F.when(F.col("id") % 10 == 0, DE).otherwise(EN).alias("text"),
        F.lit("t").alias("tag"), F.lit("").alias("classes"), F.lit("").alias("id"))
    declared = spark.createDataFrame([("small", "en"), ("hot", "fr")], "page string, declared_lang string")
    rows = audits.audit_texts(texts, declared, model).groupBy("page", "issue_type").count().collect()
    assert {tuple(r) for r in rows} == {("small", "WU2", 20), ("hot", "WU2", 40), ("hot", "WU1", 1)}


@pytest.mark.parametrize("threshold, kept", [(0.7, 2), (0.70001, 1)])
def test_threshold_is_inclusive(spark, threshold, kept):
    rows = [(1, 0, "en", 0.7, None), (1, 1, "en", 0.8, None), (1, 2, None, 0.9, None), (1, 3, "en", 0.6, None)]
    assert findings.confident(detections(spark, rows), threshold).count() == kept


def test_rows_are_never_merged(spark, model):
    one = spark.createDataFrame([("the quick brown fox",), ("the quick brown fox",), (None,)], "text string")
    assert langid.detect_language(one, model).count() == 3
    same_id = spark.createDataFrame([(1, "the quick brown fox"), (1, "der schnelle braune fuchs")], "id int, text string")
    assert sorted(r.lang for r in langid.detect_language(same_id, model).collect()) == ["de", "en"]


def test_only_numbers_go_through_the_aggregation(spark, model):
    wide = spark.createDataFrame([(1, "x" * 300, "the quick brown fox")], "id int, snippet string, text string")
    plan = langid.language_scores(langid.numbered(wide), model, "row")._jdf.queryExecution().executedPlan().toString()
    assert "snippet" not in plan.split("ReadSchema")[1]


def test_too_many_labels_raise(spark):
    rows = spark.range(9).selectExpr("concat('l', id) AS lang", "'some text' AS text")
    with pytest.raises(ValueError):
        langid.train(rows, most_languages=8)
    assert len(langid.train(rows, most_languages=9).languages) == 9


def test_temperature_is_the_likeliest_one(spark, model):
    """Against a plain computation from the scores; short texts of a fair share of wrong labels need a high one."""
    import math

    texts = [("en", EN[i:i + 14]) for i in range(40)] + [("de", DE[i:i + 14]) for i in range(40)] + [("fr", EN[:12])] * 9 + [("xx", EN), ("en", "1 2")]
    rows = langid.numbered(spark.createDataFrame(texts, "lang string, text string"))
    sums = [(r.lang, [r.s0, r.s1, r.s2]) for r in langid.score_sums(rows, model, "row").join(rows, "row").collect() if r.s0 is not None]

    def loss(t):
        total = 0.0
        for label, s in sums:
            if label in model.languages:
                own = s[model.languages.index(label)]
                total += math.log(sum(math.exp((x - own) / (langid.SCALE * t)) for x in s))
        return total

    fitted = langid.calibrated(model, rows)
    assert fitted.temperature == min(langid.TEMPERATURES, key=loss) > 1
    told = langid.detect_language(rows.withColumnRenamed("lang", "label").where("label <> 'xx'").drop("row"), fitted)
    raw = langid.detect_language(rows.withColumnRenamed("lang", "label").where("label <> 'xx'").drop("row"), model)
    bins = langid.calibration(told)
    assert langid.calibration_error(bins) < langid.calibration_error(langid.calibration(raw))
    assert bins.agg(F.sum("n")).first()[0] == told.where("lang IS NOT NULL").count()
    assert langid.calibrated(model, rows.limit(0)).temperature == model.temperature


ODD_WORDS = ["", "a", "ab a", "x" * 700, "Straße ça va", "日本語 ab", "𝒜𝒷 c", "é́a", "12 !!", "don't stop", " lead and trail ", "İI"]


@pytest.mark.parametrize("at_once", [1 << 20, 5])
def test_trigrams_in_batches_are_those_of_a_row_each(spark, monkeypatch, at_once):
    from collections import Counter

    from glossaudit.functions import text, trigrams

    monkeypatch.setattr(trigrams, "AT_ONCE", at_once)
    rows = spark.createDataFrame(list(enumerate(ODD_WORDS)), "i int, t string")
    expected = Counter((r.i, r.gram) for r in explode_trigrams(rows, "t", "i").collect() if r.gram != text.NO_GRAM)
    clean = [r[0] for r in rows.orderBy("i").select(text.letters(F.col("t"))).collect()]
    found = Counter(
        (int(i), gram) for which, keys in trigrams.trigrams(clean) for i, gram in zip(which, trigrams.unpacked(keys)))
    assert found == expected
    whole = Counter()
    for (_, gram), n in expected.items():
        whole[gram] += n
    keys, times = trigrams.trigram_counts(clean)
    assert dict(zip(trigrams.unpacked(keys), times.tolist())) == whole
    assert trigrams.packed(trigrams.unpacked(keys)).tolist() == keys.tolist() == sorted(keys.tolist())


def test_scores_are_summed_where_the_text_is(spark, model):
    """No row for each trigram and no shuffle; before, each trigram was a row that was joined and summed."""
    rows = langid.numbered(spark.createDataFrame([(t,) for t in [*ODD_WORDS, EN, DE, FR, None]], "text string"))
    scored = langid.score_sums(rows, model, "row")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    names = [f"s{i}" for i in range(3)]
    hits = explode_trigrams(rows, "text", "row").join(model.grams, "gram", "left")
    plain = hits.groupBy("row").agg(*(F.sum(F.get("lp", F.lit(i))).alias(n) for i, n in enumerate(names)))
    assert sorted(map(tuple, scored.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_training_counts_where_the_text_is(spark):
    """Equal to counts of one row for each trigram; the table is shuffled only as counts."""
    rows = spark.createDataFrame([(lang, t) for lang in ("en", "de_AT", None) for t in [*ODD_WORDS, EN, DE, None]] + [("xx", "1")],
                                 "lang string, text string")
    model = langid.train(rows)
    known = rows.where("lang IS NOT NULL").select(F.expr("substring_index(lang, '_', 1) AS lang"), "text")
    grams = explode_trigrams(known, "text", "lang").where("gram <> '  '")
    assert model.languages == ("de", "en", "xx")
    assert {tuple(r) for r in model.grams.select("gram", "n").collect()} == {tuple(r) for r in grams.groupBy("gram").count().collect()}
    v = grams.select("gram").distinct().count()
    sizes = {r["lang"]: r["count"] for r in grams.groupBy("lang").count().collect()}
    import math
    per = {(r["gram"], r["lang"]): r["count"] for r in grams.groupBy("gram", "lang").count().collect()}
    for gram, lang, lp in model.as_table().collect():
        assert lp == round(math.log((per.get((gram, lang), 0) + 1) / (sizes.get(lang, 0) + v)) * 1_000_000)


@pytest.mark.parametrize("at_once", [1 << 20, 5])
def test_trigrams_are_looked_up_where_characters_are_few(spark, model, monkeypatch, at_once):
    """A table gives the sums and counts that searching and sorting give."""
    from glossaudit.functions import text, trigrams

    monkeypatch.setattr(trigrams, "AT_ONCE", at_once)
    rows = spark.createDataFrame(list(enumerate([*ODD_WORDS, EN * 3, DE, FR, "日本語 ab " + EN])), "i int, t string")
    clean = [r[0] for r in rows.orderBy("i").select(text.letters(F.col("t"))).collect()]
    known, scores = model.sent.value
    assert trigrams.table_of(known) is not None
    hits, sums = trigrams.summed_scores(clean, known, scores)
    monkeypatch.setattr(trigrams, "MOST_PLACES", 0)
    assert trigrams.table_of(known) is None
    searched = trigrams.summed_scores(clean, known, scores)
    assert (hits == searched[0]).all() and (sums == searched[1]).all() and hits.sum() > 300
    long = [EN * 2_000]  # many characters, few different ones
    keys, times = trigrams.trigram_counts(long)
    found = [key for _, part in trigrams.trigrams(long) for key in part.tolist()]
    assert dict(zip(keys.tolist(), times.tolist())) == {key: found.count(key) for key in set(found)} and sorted(keys) == keys.tolist()
