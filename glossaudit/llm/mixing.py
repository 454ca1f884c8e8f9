"""Mixing sources to target weights by whole passes and a splitting tree over blocks.

Each source takes its target number of words: every document for as many passes as fit, and in one more pass a part
of its blocks. A block is a share of a source by the hash of its documents, so blocks are random and disjoint. The
block list of each source, pass by pass, is dealt to the output shards: a tree halves the shards, and at each node
the left half's share of every source is drawn from the multivariate hypergeometric distribution, so each shard
gets an exact quota of every source and all quotas sum to the blocks there are. Within a shard documents are
ordered by a hash that differs for each time a document is taken. All draws depend on the seed only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaudit.llm.stages import Stages
from glossaudit.storage import broadcast_if_small

CAP = 3
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 65_536
BLOCKS_MOST = 4_096  # of a source; then blocks get larger
SHARDS = 64
SLICE_WORDS = 8_000_000  # a shard with more is sorted in slices of its order, one partition each
SPACES = r"\x20\x09-\x0D"


def capped_targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[float]:
    """Share out the sum of sizes by weight; none above cap times its size, the excess shared again by weight."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free = {i for i, n in enumerate(sizes) if n > 0}
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if total * weights[i] / weight >= cap * sizes[i]}
        if not full:
            for i in free:
                target[i] = total * weights[i] / weight
            break
        for i in full:
            target[i] = float(cap * sizes[i])
        total -= sum(target[i] for i in full)
        free -= full
    return target


def splitting_tree(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas (shard, source) that sum to ``blocks`` (by source); shards get equal numbers, give or take one."""
    quotas = np.zeros((shards, len(blocks)), np.int64)

    def split(counts: np.ndarray, low: int, high: int, path: int) -> None:
        if high - low == 1:
            quotas[low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        generator = np.random.Generator(np.random.PCG64([seed, path]))
        want, rest = total * (middle - low) // (high - low), total
        left = np.zeros_like(counts)
        for i, n in enumerate(counts.tolist()):  # one hypergeometric draw after another is the multivariate one
            rest -= n
            left[i] = generator.hypergeometric(n, rest, want) if 0 < want else 0
            want -= int(left[i])
        split(left, low, middle, 2 * path)
        split(counts - left, middle, high, 2 * path + 1)

    split(blocks.astype(np.int64), 0, shards, 1)
    return quotas


def source_targets(per_source: pd.DataFrame) -> pd.DataFrame:
    """Adds target, full passes, part (words of one more pass) and blocks; sources by code point, null last."""
    table = per_source.sort_values("rank").reset_index(drop=True)
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(table))]
    sizes = [int(n) for n in table["source_size"]]
    table["target"] = capped_targets(sizes, weights)
    table["passes"] = [min(CAP, int(t // n)) if n else 0 for t, n in zip(table["target"], sizes)]
    table["part"] = [max(0.0, t - p * n) for t, p, n in zip(table["target"], table["passes"], sizes)]
    table["blocks"] = [max(1, min(BLOCKS_MOST, -(-n // BLOCK_WORDS))) for n in sizes]
    return table


def _words() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACES}]+")).cast("long")


def _rank(source: Column) -> Column:
    """Sorts as the code points do, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.hex(F.encode(source, "UTF-8"))), F.lit("1"))


def _place(seed: int) -> Column:
    """By id and text: rows without an id, or with the same one, have places of their own unless their texts are equal."""
    return F.xxhash64(F.lit(seed), "doc_id", "m_print").bitwiseAND((1 << 53) - 1)


def _block(place: Column, blocks: Column) -> Column:
    """By the top bits of the hash, so that blocks follow each other as the places do."""
    return F.floor(place / F.lit(float(1 << 53)) * blocks)


def _print(text: Column) -> Column:
    """Tells rows without an id, or with the same one, apart."""
    return F.xxhash64(text)


def _order(shard: Column, turn: Column, seed: int) -> Column:
    """Where a row stands in its shard, from 0 to 2 ** 53; another place for each turn."""
    return F.xxhash64(F.lit(seed + 2), shard, turn, F.col("doc_id"), F.col("m_print")).bitwiseAND((1 << 53) - 1)


def _sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("source").alias("m_source"), _words().alias("size"), _print(F.col("text")).alias("m_print"))


def _decided(sized: DataFrame, seed: int, shards: int, stages: Stages) -> DataFrame:
    """(rank, block, source_size, target, passes, whole, last, homes): what the mix takes of each block.

    ``sized``: doc_id, m_source, size; a written table.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("m_source").agg(F.sum("size").alias("source_size"))
    totals = stages.keep(totals.select("m_source", "source_size", _rank(F.col("m_source")).alias("rank")), "totals")
    plan = source_targets(totals.toPandas())
    schema = "rank string, source_size long, target double, passes long, part double, blocks long"
    per_source = spark.createDataFrame(plan[schema.replace(" string", "").replace(" long", "").replace(
        " double", "").split(", ")], schema) if len(plan) else spark.createDataFrame([], schema)

    placed = sized.withColumns({"rank": _rank(F.col("m_source")), "place": _place(seed)})
    placed = placed.join(broadcast_if_small(per_source, 200), "rank").withColumn("block", _block(F.col("place"), F.col("blocks")))
    placed = stages.keep(placed.select("rank", "place", "block", "part", "size"), "placed")

    sums = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"))  # BLOCKS_MOST rows a source at most
    order = Window.partitionBy("rank").orderBy("block")
    sums = sums.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = stages.keep(sums.withColumn("before", F.coalesce("before", F.lit(0))).join(per_source, "rank").select(
        "rank", "block", "words", "before", (F.col("before") + F.col("words") <= F.col("part")).alias("whole"),
        ((F.col("before") < F.col("part")) & (F.col("before") + F.col("words") > F.col("part"))).alias("cut")), "blocks")

    # The one block of each source in which the part ends: its documents up to the nearest total.
    edge = placed.join(broadcast_if_small(blocks.where("cut").select("rank", "block", "before"), 100), ["rank", "block"])
    edge = edge.groupBy("rank", "block", "before", "part", "place").agg(F.sum("size").alias("size"))
    within = Window.partitionBy("rank", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    edge = edge.withColumn("ahead", ahead).where("size > 0 AND ahead + size / 2 <= part")
    last = edge.groupBy("rank", "block").agg(F.max("place").alias("last"))

    # Every time a block is taken it is one entry of its source's list, in the order of a hash.
    dealt = blocks.join(per_source.select("rank", "passes"), "rank").withColumn(
        "times", F.col("passes") + F.when(F.col("whole") | F.col("cut"), 1).otherwise(0)).where("times > 0")
    dealt = dealt.select("rank", "block", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn"))
    shuffled = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block", "turn"), "block", "turn")
    dealt = stages.keep(dealt.withColumn("nth", F.row_number().over(shuffled)), "dealt")
    counts = dealt.groupBy("rank").count().orderBy("rank").toPandas()
    quotas = splitting_tree(counts["count"].to_numpy(np.int64), shards, seed)
    ends = [(r, [int(x) for x in np.cumsum(quotas[:, i])]) for i, r in enumerate(counts["rank"])]
    ends = spark.createDataFrame(ends, "rank string, ends array<long>")
    shard = F.size(F.filter("ends", lambda e: e < F.col("nth")))
    homes = dealt.join(broadcast_if_small(ends, 1000), "rank").groupBy("rank", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", shard.alias("shard")))), lambda x: x.shard).alias("homes"))
    chosen = blocks.select("rank", "block", "whole").join(last, ["rank", "block"], "left").join(homes, ["rank", "block"], "left")
    return stages.keep(chosen.join(per_source.select("rank", "blocks", "source_size", "target", "passes"), "rank"), "chosen")


def _apply(rows: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with doc_id and m_source) and what is taken of each: a look-up in small tables, nothing is moved."""
    per_source = broadcast_if_small(chosen.select("rank", "blocks").distinct(), 100)
    placed = rows.withColumns({"rank": _rank(F.col("m_source")), "place": _place(seed)}).join(
        per_source, "rank").withColumn("block", _block(F.col("place"), F.col("blocks")))
    result = placed.join(broadcast_if_small(chosen.drop("blocks"), 300), ["rank", "block"])
    more = F.col("whole") | F.coalesce(F.col("place") <= F.col("last"), F.lit(False))
    passes = F.least(F.col("passes") + F.when(more, 1).otherwise(0), F.lit(CAP))
    result = result.withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(0).cast("long"))
    return result.withColumn("shards", F.slice(
        F.coalesce("homes", F.array().cast("array<int>")), F.lit(1), F.col("passes").cast("int")))


def mix_sources(documents: DataFrame, seed: int = 7, shards: int = SHARDS, stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes, shards, places.

    ``passes`` counts how often the mix takes the document, ``shards`` (array) holds the output shard of each time,
    ``places`` (array) the number by which it is ordered within that shard. ``documents`` needs doc_id, text and source; no other column is read,
    whatever its name. A null text or one without words has size 0 and takes part with it. Null is a source of its
    own. Rows with the same id and text are judged alike: where the part of a last pass ends among them, all of them
    are in or out. An empty table gives no rows. The table with a row for each source passes through the driver. Runs
    its steps when called.
    """
    stages = stages or Stages(documents.sparkSession, "mixing")
    sized = stages.keep(_sized(documents), "sized")
    result = _apply(sized, _decided(sized, seed, shards, stages), seed)
    places = F.transform("shards", lambda shard, turn: _order(shard, turn, seed))
    return result.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes",
                         "shards", places.alias("places"))


def _dealt_rows(documents: DataFrame, seed: int, shards: int, stages: Stages | None) -> DataFrame:
    """(shard, place, carried_0, ...): shard after shard, each in order; a shard is one partition or several in turn."""
    stages = stages or Stages(documents.sparkSession, "mixing")
    sized = stages.keep(_sized(documents), "sized")
    words = sized.agg(F.sum("size")).first()[0] or 0  # the mix takes about as many
    slices = max(1, -(-words // (shards * SLICE_WORDS)))
    rows = documents.select("doc_id", F.col("source").alias("m_source"), _print(F.col("text")).alias("m_print"), *(
        documents[c].alias(f"carried_{i}") for i, c in enumerate(documents.columns)))
    carried = [f"carried_{i}" for i in range(len(documents.columns))]
    taken = _apply(rows, _decided(sized, seed, shards, stages), seed).select(
        "doc_id", "m_print", *carried, F.posexplode("shards").alias("turn", "shard"))
    taken = taken.select("shard", _order(F.col("shard"), F.col("turn"), seed).alias("place"), *carried)
    home = (F.col("shard") * slices + F.floor(F.col("place") / F.lit(float(1 << 53)) * slices)).cast("int")
    return taken.repartitionById(shards * slices, home).sortWithinPartitions("place")


def take_mix(documents: DataFrame, seed: int = 7, shards: int = SHARDS, stages: Stages | None = None) -> DataFrame:
    """The rows of ``documents``, each as often as :func:`mix_sources` takes it, with all their columns.

    Rows come shard by shard, shuffled within. Equal rows with the same id have the same places.
    """
    dealt = _dealt_rows(documents, seed, shards, stages)
    return dealt.select(*(F.col(f"carried_{i}").alias(c) for i, c in enumerate(documents.columns)))


def take_shards(documents: DataFrame, seed: int = 7, shards: int = SHARDS, stages: Stages | None = None) -> DataFrame:
    """(shard, place, document): what :func:`take_mix` gives, with the shard and the place in it; document is a struct."""
    dealt = _dealt_rows(documents, seed, shards, stages)
    return dealt.select("shard", "place", F.struct(*(
        F.col(f"carried_{i}").alias(c) for i, c in enumerate(documents.columns))).alias("document"))
