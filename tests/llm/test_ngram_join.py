import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossaudit.llm import ngram_join as join
from glossaudit.llm.components import components
from glossaudit.llm.stages import Stages


def brute_force(rows):
    sets, parent = {}, {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def texts(seed, long):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows, bases = [], []
    for _ in range(12):
        bases.append([word() for _ in range(r.randint(5, 30 if not long else 220))])
    for base in bases:
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                at = r.randrange(len(copy))
                copy[at:at + r.choice([0, 1])] = [word()]
            if r.random() < 0.1:
                copy = copy[:max(1, int(len(copy) * 0.9))]
            if long and r.random() < 0.3:
                copy += passage
            rows.append(" ".join(copy) if r.random() < 0.7 else "\n ".join(copy).upper().replace("É", "é"))
    rows += [None, "", " \n ", "one", "one", "One two", "one two three four", " ".join(passage), "x" * 300_000]
    r.shuffle(rows)
    return [(i * 7 + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "long"), [(1, False), (2, True)])
def test_agrees_with_all_pairs(spark, seed, long, monkeypatch):
    monkeypatch.setattr(join, "HOT_FROM", 3)
    rows = texts(seed, long)
    # Columns that clash with the operator's own are not touched.
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n": F.lit(1), "component_id": F.lit(None).cast("string"), "token": F.lit("x"), "cost": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.ngram_join(table).collect()}
    assert got == brute_force(rows)
    assert len({c for _, c in got.values()}) < len(got)


def test_boundary_weighs_subsets_against_lists():
    few, many = {n: (10, 10) for n in range(1, 25)}, {n: (10, 10_000_000) for n in range(1, 25)}
    assert join.light_boundary({}) == 1
    assert join.light_boundary(few) < join.light_boundary(many)
    assert join.subset_count(4) == 2 and join.overlap(9, 9) == 8 and list(join.partners(5)) == [4, 5, 6]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert join.ngram_join(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "p q r s t"), (None, None)]
    got = join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    random.Random(4).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "test")).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.component].add(r.id)
    assert dict(groups) == {0: set(range(41)), 100: set(range(100, 130))}
