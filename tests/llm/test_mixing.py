from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaudit.llm import mixing


def test_targets_stop_at_three_times_the_size():
    assert mixing.capped_targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert mixing.capped_targets([1000, 100, 10], [1, 2, 3]) == [780.0, 300.0, 30.0]
    assert mixing.capped_targets([0, 7], [1, 2]) == [0.0, 7.0] and mixing.capped_targets([], []) == []
    sizes, weights = [5, 900, 40, 3, 700], [1, 2, 3, 1, 2]
    got = mixing.capped_targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * n for t, n in zip(got, sizes))
    free = [t / w for t, n, w in zip(got, sizes, weights) if t < 3 * n]
    assert max(free) == pytest.approx(min(free))


def test_tree_deals_every_block_once():
    blocks = np.array([7, 0, 123, 4000, 1])
    quotas = mixing.splitting_tree(blocks, 13, 1)
    assert quotas.sum(axis=0).tolist() == blocks.tolist() and quotas.min() >= 0
    assert np.ptp(quotas.sum(axis=1)) <= 4  # rounding at each of four levels
    assert (quotas == mixing.splitting_tree(blocks, 13, 1)).all() and (quotas != mixing.splitting_tree(blocks, 13, 2)).any()
    assert mixing.splitting_tree(np.array([], int), 4, 1).shape == (4, 0)
    means = np.mean([mixing.splitting_tree(np.array([300, 700]), 10, s) for s in range(40)], axis=0)
    assert np.allclose(means[:, 0], 30, atol=4)


def rows():
    out = [(i, "word " * (1 + i * 7 % 90), "abc"[i % 3] if i % 2 else "a") for i in range(600)]
    return out + [(700, None, "a"), (701, "", None), (702, "x y", None), (703, "x", "zero"), (704, " \n", "none"),
                  (705, "w " * 9000, "b"), (705, "w " * 9000, "b"), (None, "q r s", "c")]


def test_mix_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumns(
        {"rank": F.lit(1), "size": F.lit("x"), "passes": F.lit(9), "place": F.lit(None).cast("int")})
    got = mixing.mix_sources(docs, shards=5).collect()
    assert len(got) == len(rows())
    source = defaultdict(set)
    for i, _, s in rows():
        source[i].add(s)
    taken, target, sizes, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in got:
        s = next(iter(source[r.doc_id]))
        taken[s] += r.taken
        sizes[s] += r.size
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken == r.size * r.passes <= 3 * r.size and len(r.shards) == r.passes and all(0 <= x < 5 for x in r.shards)
    assert {s: r.source_size for r in got for s in source[r.doc_id]} == dict(sizes)
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = mixing.capped_targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])
    assert [target[s] for s in order] == want
    for s in order:
        assert abs(taken[s] - target[s]) <= (2 if s == "b" else 1) * largest[s]  # b holds one text twice under one id
    assert sorted(map(str, mixing.mix_sources(docs.repartition(7), shards=5).collect())) == sorted(map(str, got))
    mixed = mixing.take_mix(docs, shards=5)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.passes for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).count() == 0 and mixing.take_mix(docs).count() == 0


@pytest.mark.parametrize("slice_words", [mixing.SLICE_WORDS, 2000])
def test_rows_come_by_shard_and_shuffled(spark, monkeypatch, slice_words):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    monkeypatch.setattr(mixing, "SLICE_WORDS", slice_words)
    some = [r for r in rows() if r[0] != 705] + [(None, f"null {i}", "zero") for i in range(5)]
    docs = spark.createDataFrame(some, "doc_id long, text string, source string")
    want = sorted((s, p, r.doc_id) for r in mixing.mix_sources(docs, shards=5).collect()
                  for s, p in zip(r.shards, r.places, strict=True))
    dealt = mixing.take_shards(docs, shards=5)
    assert (dealt.rdd.getNumPartitions() > 5) == (slice_words == 2000)
    got = [(r.shard, r.place, r.document.doc_id) for r in dealt.collect()]
    assert got == want  # in this order
    assert [r.doc_id for r in mixing.take_mix(docs.repartition(7), shards=5).collect()] == [i for _, _, i in got]
    for shard in range(5):
        ids = [i for s, _, i in got if s == shard and i is not None]
        twice = len(ids) - len(set(ids))
        assert sum(a == b for a, b in zip(ids, ids[1:])) <= max(2, twice // 10)
        rises = sum(a < b for a, b in zip(ids, ids[1:])) / (len(ids) - 1)
        assert 0.4 < rises < 0.6
    assert len({p for s, p, _ in got}) == len(got)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rows_without_ids_of_their_own_meet_the_targets(spark, doc_id):
    rows = [(doc_id, f"words of row {i}" + " more" * (i % 3), f"s{i % 3}") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target) <= 6
