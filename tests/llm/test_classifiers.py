import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossaudit.llm import quality_classifier, toxicity
from glossaudit.llm.labelled import labelled_sample, remainder

DATA = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def held_out(scores, labels, label, folds, held, threshold):
    rows = scores.join(labels, "doc_id").where((remainder(F.col("doc_id"), folds) == held) & F.col(label).isNotNull())
    return [(r[label], r.score >= threshold) for r in rows.select(label, "score").collect()]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    model = toxicity.train_toxicity(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    assert 0 < np.count_nonzero(model[0]) < 20_000  # sparse
    told = held_out(toxicity.score_toxicity(docs, model), labels, "toxic", 3, 1, toxicity.THRESHOLD)
    hits = sum(a == 1 and b for a, b in told)
    assert hits / sum(a for a, _ in told) > 0.7 and hits / sum(b for _, b in told) > 0.9


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    model = quality_classifier.train_quality(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    told = held_out(quality_classifier.score_quality(docs, model), labels, "quality", 5, 0, quality_classifier.THRESHOLD)
    assert np.mean([a == b for a, b in told]) > 0.98


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x" * 300_000), (5, "word " * 60_000), (6, "same"), (6, "same"), (None, "a b")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(5)})


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_odd_texts_and_labels(spark, odd, kind):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (5, 0, 0), (6, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    train, score = {"toxicity": (toxicity.train_toxicity, toxicity.score_toxicity),
                    "quality": (quality_classifier.train_quality, quality_classifier.score_quality)}[kind]
    for model in (train(odd, labels, F.lit(True)), train(odd, labels, F.lit(False)), train(odd, labels.limit(0), F.lit(True))):
        got = score(odd, model).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in got if r.doc_id == 6}) == 1
        assert score(odd.limit(0), model).count() == 0


def test_sample_is_bounded_and_reruns_agree(spark, odd):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    first = labelled_sample(odd, labels, "quality", F.lit(True), 3)
    assert first.count() == 3
    assert sorted(r.doc_id for r in first.collect()) == sorted(
        r.doc_id for r in labelled_sample(odd.repartition(3), labels, "quality", F.lit(True), 3).collect())


def test_ftrl_finds_the_one_word_that_matters():
    r = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        labels.append(i % 4 == 0)
        words = ["".join(r.choice("aeioubcd") for _ in range(5)) for _ in range(20)] + ["vile"] * labels[-1]
        r.shuffle(words)
        texts.append(" ".join(words))
    hasher = toxicity.Hasher(separators=toxicity.SEPARATORS)
    examples = []
    for found, rows, n in toxicity.features(hasher, pa.array(texts)):
        examples += [np.unique(found[rows == i]) for i in range(n)]
    weights, bias = toxicity.ftrl(list(zip(examples, map(int, labels))))
    vile = np.concatenate([f for f, _, _ in toxicity.features(hasher, pa.array(["vile"]))])
    assert weights[vile[0]] == weights.max() > 1 and bias < 0


def test_features_pair_neighbours_and_skips_within_a_text():
    hasher = toxicity.Hasher(separators=toxicity.SEPARATORS)
    (found, rows, n), = toxicity.features(hasher, pa.array(["a b c", "d", None, "a-b, c"]))
    assert n == 4 and np.bincount(rows, minlength=4).tolist() == [6, 1, 0, 6]
    assert sorted(found[rows == 0]) == sorted(found[rows == 3])


def test_blocked_products_find_the_nearest(spark):
    docs, labels = tables(spark)
    model = quality_classifier.train_quality(docs, labels, F.lit(True), 300)
    idf, basis, vectors, known = model
    rows = docs.orderBy("doc_id").limit(600).select("doc_id", "text").collect()
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs.where("doc_id < 600"), model).collect()}
    hashers = quality_classifier.Hasher(), quality_classifier.Hasher(lower=False)
    for r in rows[:200]:
        counts, = quality_classifier.shape_counts(*hashers, pa.array([r.text]))
        own = quality_classifier.unit(quality_classifier.weighted(counts, idf) @ basis)[0]
        cosine = np.round(vectors @ own, 5)
        best = sorted(range(len(known)), key=lambda i: (-cosine[i], i))[:quality_classifier.NEIGHBOURS]
        weight = np.maximum(cosine[best], 1e-6)
        assert abs((weight * known[best]).sum() / weight.sum() - got[r.doc_id]) < 0.02


def test_ftrl_equals_a_plain_loop():
    r = random.Random(4)
    examples = [(np.array(sorted(r.sample(range(40), r.randrange(1, 9)))), int(r.random() < 0.4)) for _ in range(300)]
    z, n, bias_z, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    def bias():
        return -bias_z / ((toxicity.BETA + math.sqrt(bias_n)) / toxicity.ALPHA)

    for _ in range(toxicity.PASSES):
        for own, label in examples:
            w = {i: weight(i) for i in own.tolist()}
            b = bias() if bias_n else 0.0
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - label
            for i, old in w.items():
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - step * old
                n[i] = n.get(i, 0.0) + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / toxicity.ALPHA * b
            bias_n += g * g
    weights, told = toxicity.ftrl(examples)
    assert abs(told - bias()) < 1e-9
    assert all(abs(weights[i] - weight(i)) < 1e-9 for i in range(40)) and not weights[40:].any()
    assert any(weights[:40]) and not all(weights[:40])


def test_quality_that_shows_in_wording_alone(spark):
    """All words have the same shape, so only the words themselves tell the two kinds apart."""
    r = random.Random(2)
    kinds = ["buy cheap offer now click sale win prize".split(), "river study method result theory model proof data".split()]
    common = "and the of with from that this".split()
    rows = [(i, " ".join(r.choice(kinds[i % 2] + common) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    model = quality_classifier.train_quality(docs, labels, F.col("doc_id") < 200)
    told = {x.doc_id: x.score for x in quality_classifier.score_quality(docs, model).collect()}
    assert np.mean([(told[i] >= 0.5) == (i % 2 == 1) for i in range(200, 400)]) > 0.97
