"""N-gram Jaccard join, size-aware: heavy sets scan inverted lists, light sets enumerate subsets.

Two texts link when their sets of word shingles have a Jaccard similarity of at least ``num / den``.

* Equal sets are one class from the start; only one set of each class takes part.
* Light sets (fewer shingles than the boundary) list all their subsets of the overlap that a partner of each
  possible size needs. Sets that share such a subset link, without further check.
* Heavy sets are joined with all sets through inverted lists over a prefix of each set, in an order that puts
  frequent shingles last. A pair is looked at in the list of its first common shingle only, where sizes and
  positions still allow the overlap, and its sets are then intersected in full.
* The boundary is where the counted cost of subsets and of list entries is least.
* A list is first compared with one member; later only members of different components are compared. So large
  groups of near copies cost a comparison for each member, not for each pair, and no link that joins two
  components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaudit.llm.components import components
from glossaudit.llm.stages import Stages
from glossaudit.llm.words import Hasher, mix, word_sets
from glossaudit.storage import planned_bytes, small_enough

NUM, DEN = 80, 100
LIGHT_MOST = 24  # the boundary is looked for up to this size; beyond it subsets always cost more
HOT_KEYS = 1_000_000  # so many frequent shingles are sent to all tasks at most: 12 bytes each
HOT_FROM = 8  # shingles in fewer texts are never counted as frequent
FLUSH = 1 << 22


def overlap(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """Smallest common count for which sets of sizes a and b link."""
    return -(-num * (a + b) // (num + den))


def partners(a: int, num: int = NUM, den: int = DEN) -> range:
    return range(-(-num * a // den), den * a // num + 1)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def _bucket_bits(texts: DataFrame) -> int:
    """Enough buckets for each to hold a few MB of shingles; as many more as the table is larger."""
    return max(7, min(16, (planned_bytes(texts) >> 23).bit_length()))


def frequent_shingles(texts: DataFrame, k: int, stages: Stages) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of the most frequent shingles over all texts, HOT_KEYS at most.

    A key is the top bits of a hash; shingles with equal keys count together, which can only change the
    order of the lists, not the result. Each task sorts its shingles and sends them by bucket as packed
    arrays of distinct keys and of their counts.
    """
    bits = _bucket_bits(texts)
    key_shift, low = np.uint64(64 - bits - 32), np.uint64(0xFFFFFFFF)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, count = Hasher(), [], 0

        def out():
            every = np.concatenate(held)
            held.clear()  # what follows works in place: a worker keeps the memory it once needed
            every >>= key_shift
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            n = np.diff(np.append(first, len(every)))
            keys = every[first]
            del every, first
            cuts = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            parts = [((keys[a:b] & low).astype(np.uint32), n[a:b]) for _, a, b in rows]
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([i for i, _, _ in rows], pa.int32()),
                "once": pa.array([x[c == 1].tobytes() for x, c in parts], pa.binary()),
                "more": pa.array([x[c > 1].tobytes() for x, c in parts], pa.binary()),
                "counts": pa.array([c[c > 1].astype(np.uint32).tobytes() for x, c in parts], pa.binary())})

        for batch in batches:
            for _, own in word_sets(hasher, batch.column(0), k):
                held.append(own)
                count += len(own)
                if count >= FLUSH:
                    yield out()
                    count = 0
        if count:
            yield out()

    def summed(table: pa.Table) -> pa.Table:
        def column(name):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint32)

        once, more, counts = column("once"), column("more"), column("counts")
        keys = np.concatenate([once, more])
        order = np.argsort(keys, kind="stable")
        n = np.concatenate([np.ones(len(once), np.int64), counts.astype(np.int64)])[order]
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        total = np.add.reduceat(n, first) if len(first) else n
        keep = total >= HOT_FROM
        bucket = int(table.column("bucket")[0].as_py())
        key = (bucket << 32) | keys[first[keep]].astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "n": pa.array(total[keep], pa.int64())})

    sent = texts.select("text").mapInArrow(packed, "bucket int, once binary, more binary, counts binary")
    hot = stages.keep(sent.groupBy("bucket").applyInArrow(summed, "key long, n long"), "hot")
    classes = hot.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()
    least, room = 1 << 62, HOT_KEYS
    for row in classes:  # at most 63
        room -= row["count"]
        if room < 0:
            break
        least = 1 << row["size"]
    found = hot.where(F.col("n") >= least).toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.uint64), n[order].astype(np.int32)


def _ordered_sets(texts: DataFrame, k: int, stages: Stages) -> DataFrame:
    """doc_id, n, set digest (d1, d2), prefix in list order, cost of its lists, all shingles of small sets."""
    keys, counts = frequent_shingles(texts, k, stages)
    shift = np.uint64(64 - _bucket_bits(texts) - 32)
    sent = texts.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_n = sent.value
        hasher = Hasher()
        for batch in batches:
            sizes, first, second, costs, prefixes, small = [], [], [], [], [], []
            for _, own in word_sets(hasher, batch.column(1), k):
                n = len(own)
                sizes.append(n)
                first.append(int(mix(own).sum().view(np.int64)) if n else 0)
                second.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if n else 0)
                width = prefix_length(n) if n else 0
                if n and len(hot_keys):
                    at = np.searchsorted(hot_keys, own >> shift)
                    at[at == len(hot_keys)] = 0
                    found = np.where(hot_keys[at] == own >> shift, hot_n[at], 0)
                    order = np.argsort(found, kind="stable")[:width] if found.any() else slice(0, width)
                    prefix, cost = own[order], int(np.maximum(found[order], 1).sum())
                else:
                    prefix, cost = own[:width], width
                costs.append(cost)
                prefixes.append(prefix.view(np.int64))
                small.append(own.view(np.int64) if n <= LIGHT_MOST else own[:0].view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()),
                "d1": pa.array(first, pa.int64()), "d2": pa.array(second, pa.int64()),
                "cost": pa.array(costs, pa.int64()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())), "small": pa.array(small, pa.list_(pa.int64()))})

    schema = "doc_id long, n long, d1 long, d2 long, cost long, prefix array<long>, small array<long>"
    return stages.keep(texts.select("doc_id", "text").mapInArrow(run, schema), "sets")


def subset_count(a: int) -> int:
    return sum(comb(a, overlap(a, b)) for b in partners(a) if overlap(a, b) <= min(a, b))


def light_boundary(sizes: dict[int, tuple[int, int]]) -> int:
    """The size below which sets enumerate subsets, by least cost; ``sizes``: n -> (sets, list entries).

    Sets from 4/5 of the boundary on pay for lists too, as they can link with heavy sets.
    """
    def cost(x: int) -> int:
        subsets = sum(c * subset_count(n) for n, (c, _) in sizes.items() if n < x)
        return subsets + sum(entries for n, (_, entries) in sizes.items() if DEN * n >= NUM * x)
    return min(range(1, LIGHT_MOST + 2), key=lambda x: (cost(x), x))


def _light_edges(reps: DataFrame, below: int) -> DataFrame:
    """Edges between sets of fewer than ``below`` shingles, through shared subsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lows, highs, k1, k2, sizes = [], [], [], [], [], []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, own = len(own), np.array(own, np.int64).view(np.uint64)
                x, y = mix(own), mix(own ^ np.uint64(0x5851F42D4C957F2D))
                for size in {overlap(a, b) for b in partners(a)}:
                    if size > a:
                        continue
                    chosen = np.array(list(combinations(range(a), size)), np.int64).reshape(-1, size)
                    s1, s2 = x[chosen].sum(axis=1).view(np.int64), y[chosen].sum(axis=1).view(np.int64)
                    for b in partners(a):
                        if overlap(a, b) == size and size <= b:
                            ids += [doc] * len(s1)
                            sizes += [a] * len(s1)
                            lows += [min(a, b)] * len(s1)
                            highs += [max(a, b)] * len(s1)
                            k1.append(s1)
                            k2.append(s2)
            if ids:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()),
                    "low": pa.array(lows, pa.int64()), "high": pa.array(highs, pa.int64()),
                    "k1": pa.array(np.concatenate(k1), pa.int64()), "k2": pa.array(np.concatenate(k2), pa.int64())})

    key = ["low", "high", "k1", "k2"]
    rows = reps.where(F.col("n") < below).select("doc_id", "small").mapInArrow(
        run, "doc_id long, n long, low long, high long, k1 long, k2 long")
    ends = rows.groupBy(key).agg(
        F.min(F.when(F.col("n") == F.col("low"), F.col("doc_id"))).alias("low_end"),
        F.min(F.when(F.col("n") == F.col("high"), F.col("doc_id"))).alias("high_end"),
        F.count("*").alias("members")).where("members > 1 AND low_end IS NOT NULL AND high_end IS NOT NULL")
    linked = rows.join(ends, key)
    other = F.when(F.col("n") == F.col("low"), F.col("high_end")).otherwise(F.col("low_end"))
    return linked.select(F.col("doc_id").alias("a"), other.alias("b")).where("a <> b").distinct()


def _may_link(a: str, b: str):
    """The rest of both sets from this shingle on still holds the overlap that their sizes need."""
    both, rest = F.col(f"{a}.n") + F.col(f"{b}.n"), "n - {0}.pos"
    need = F.lit(NUM) * both
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (F.lit(NUM + DEN) * rest) >= need


def _verified(pairs: DataFrame, texts: DataFrame, k: int, stages: Stages) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Texts are read again for the ids in pairs only."""
    pairs = stages.keep(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    count = stages.keep(ids, "ids")
    wanted = F.broadcast(count) if small_enough(count.count(), 16) else count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            own = [s.view(np.int64) for _, s in word_sets(hasher, batch.column(1), k)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "own": pa.array(own, pa.list_(pa.int64()))})

    sets = stages.keep(texts.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(
        run, "id long, own array<long>"), "wanted")
    first, second = sets.toDF("a", "own_a"), sets.toDF("b", "own_b")
    whole = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("own_a", "own_b"))
    linked = F.lit(DEN + NUM) * common >= F.lit(NUM) * (F.size("own_a") + F.size("own_b"))
    return stages.keep(whole.where(linked).select("a", "b"), "links")


def ngram_join(documents: DataFrame, k: int = 5, stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id.

    ``documents`` needs doc_id (long, unique and not null) and text; other columns, whatever their names,
    are not read. class_id is the smallest doc_id with the same set, component_id the smallest reachable by
    links. Null, empty and blank texts have 0 shingles and are linked with nothing. Texts with fewer than k words
    have one shingle, the whole sequence. An empty table gives no rows. Runs its steps when called.
    """
    stages = stages or Stages(documents.sparkSession, "ngram-join")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sets = _ordered_sets(texts, k, stages)
    classes = stages.keep(sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    ids = classes.select(F.col("class_id").alias("doc_id"))
    reps = stages.keep(sets.drop("d1", "d2").join(ids, "doc_id", "left_semi"), "reps")

    counted = reps.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("c"), F.sum("cost").alias("e"))
    boundary = light_boundary({r["n"]: (r["c"], r["e"]) for r in counted.collect()})

    heavy = reps.where(F.lit(DEN) * F.col("n") >= F.lit(NUM * boundary))
    rows = heavy.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    rows = rows.repartition(F.col("token"))
    lists = rows.groupBy("token").agg(F.min(F.struct("doc_id", "n", "pos")).alias("hub"), F.count("*").alias("size"))
    lists = stages.keep(rows.join(lists.where("size > 1"), "token"), "lists")

    near = lists.alias("m").where("doc_id <> hub.doc_id").where(_may_link("m", "hub"))
    hubs = near.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = _verified(hubs, texts, k, stages).unionByName(_light_edges(reps, boundary))
    edges = stages.keep(edges, "first")
    stages.drop("hot", "reps", "pairs", "ids", "wanted", "links")
    grouped = components(edges, stages)

    placed = lists.drop("hub", "size").join(grouped.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    placed = stages.keep(placed.withColumn("component", F.coalesce("component", "doc_id")), "placed")
    stages.drop("lists", "edges")
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = stages.keep(mixed.where("lo <> hi").select("token"), "mixed")
    left = placed.join(mixed, "token", "left_semi").withColumn(
        "band", F.floor(F.log("n") / F.log(F.lit(DEN / NUM)) + 1e-9))
    left = stages.keep(left, "left")
    stages.drop("placed", "mixed")
    # Partners differ by one size band at most, so each row is looked up in its own band and the one above.
    up = left.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    pairs = left.alias("x").join(up.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
                                 & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y"))
    pairs = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
    more = _verified(pairs.distinct(), texts, k, stages)
    stages.drop("left", "pairs", "ids", "wanted")
    final = components(edges.unionByName(more), stages)

    named = classes.join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
    named = stages.keep(named.withColumn("component_id", F.coalesce("component", "class_id")).drop("component"), "named")
    stages.drop(*(t for t in stages.paths if t not in ("sets", "named")))
    members = sets.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
                          F.coalesce("component_id", "doc_id").alias("component_id"))
