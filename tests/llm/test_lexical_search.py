import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from glossaudit.llm import lexical_search as search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Scores every document for every item."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    total, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * total // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms_of(text)) if c[t])
            if score:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, rank, i, -minus) for rank, (minus, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=str)


def found(spark, docs, items, **more):
    got = search.lexical_search(
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int"), **more)
    return sorted(map(tuple, got.collect()), key=str)


def sample(seed):
    draw = random.Random(seed)
    words = [f"w{int(1000 * draw.random() ** 4)}" for _ in range(3000)] + ["the"] * 3000 + ["Über", "Z9", "日本"]
    text = lambda n: draw.choice([" ", "-", "_ "]).join(draw.choice(words) for _ in range(n))
    docs = [(draw.choice([None, *range(300)]), text(draw.choice([1, 5, 60, 200]))) for _ in range(400)]
    docs += docs[:20] + [(7, None), (8, ""), (None, " .,!"), (9, "ÜBER über \x80 a" * 3)]
    return docs, [(draw.choice([None, 3, i]), text(draw.choice([1, 2, 30]))) for i in range(40)] + [(90, None), (91, " - "), (92, "absent")]


@pytest.mark.parametrize("block, pairs", [(8192, 10 ** 6), (16, 200)])
def test_against_scoring_every_document(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", pairs)
    docs, items = sample(5)
    assert found(spark, docs, items) == brute(docs, items)


def test_equal_scores_by_id(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(0, "other")]
    assert found(spark, docs, [(1, "words")]) == brute(docs, [(1, "words")])
    assert [r[2] for r in sorted(found(spark, docs, [(1, "words")], k=3), key=lambda r: r[1])] == [1, 2, 3]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []


def test_accumulators_are_limited_and_survivors_exact():
    """A rare term decides; documents that hold frequent terms alone get no accumulator, and no result is lost."""
    n, draw = 2000, np.random.default_rng(1)
    tf = np.zeros((4, n), np.int64)
    tf[0, ::90] = 3
    tf[1, ::40], tf[2, 7:], tf[3, :] = 1, 2, draw.integers(1, 5, n)
    weights, m = np.array([5000, 3000, 20, 5]), draw.integers(10, 300, n)
    pairs = np.concatenate([np.repeat(t * n + np.arange(n), tf[t]) for t in range(4)])
    postings = search.Postings(pairs, n, 4, m, weights)
    whole = (weights[:, None] * np.where(tf > 0, 10 ** 9 * tf // np.maximum(1000 * tf + 8 * m, 1), 0)).sum(axis=0)
    docs, scores, made = search.best_of_block(postings, np.arange(4), n, 10, 0)
    assert made < 100 and (scores == whole[docs]).all()
    assert set(np.argsort(-whole, kind="stable")[:10]) <= set(docs.tolist())
    assert search.best_of_block(postings, np.arange(4), n, 10, int(postings.most.sum()) + 1)[2] == 0


def test_length_factors_beyond_64_bits():
    n = np.array([0, 3, 10 ** 9])
    assert search.length_factors(n, 10 ** 11, 10 ** 14).tolist() == [10 + 90 * int(x) * 10 ** 11 // 10 ** 14 for x in n]
