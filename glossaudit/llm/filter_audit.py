"""Filter interaction audit: what five filters remove in each of their 120 orders, from difference arrays over Lehmer ranks.

A document's failed filters are a mask. In which orders a mask goes at a given step depends on the beginning of the
order only: filters that it passes, then one that it fails. All orders with one beginning are neighbours in
lexicographic order, so they are an interval of Lehmer ranks. Documents are counted by part and mask; each mask adds its
count where an interval of a step begins and takes it off behind its end, and sums along the 120 ranks give what each
order removes at each step. No document is looked at more than once, and nothing grows with the number of orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaudit.llm.stages import Stages
from glossaudit.storage import broadcast_if_small

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
MARKS = "[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")


def lehmer_rank(order: str, filters: str = FILTERS) -> int:
    """Place of an order among all orders of ``filters``, from 0."""
    rank, left = 0, list(filters)
    for letter in order:
        at = left.index(letter)
        left.pop(at)
        rank += at * factorial(len(left))
    return rank


def removal_intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, low, high): the orders of ranks low to high - 1 remove documents of this mask at this step.

    Bit i of a mask stands for the filter i. Intervals of a mask and a step do not touch each other.
    """
    found = []
    for mask in range(1, 1 << len(filters)):
        fails = [f for i, f in enumerate(filters) if mask >> i & 1]
        passes = [f for f in filters if f not in fails]
        for step in range(1, len(passes) + 2):
            merged: list[list[int]] = []
            beginnings = ["".join((*before, f)) for before in permutations(passes, step - 1) for f in fails]
            for low in sorted(lehmer_rank(b + "".join(f for f in filters if f not in b), filters) for b in beginnings):
                high = low + factorial(len(filters) - step)
                if merged and merged[-1][1] == low:
                    merged[-1][1] = high
                else:
                    merged.append([low, high])
            found += [(mask, step, low, high) for low, high in merged]
    return found


def failed_by_text(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    counted = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))

    def bit(condition: Column, filter_: str) -> Column:
        return F.when(condition, 1 << FILTERS.index(filter_)).otherwise(0)

    few = lambda c: bit(c.n < MIN_WORDS, "A") + bit(100 * c.distinct < DISTINCT_PERCENT * c.n, "B")
    by_words = F.aggregate(F.array(counted), F.lit(0), lambda total, c: total + few(c))  # the words are cut once
    return by_words + bit(100 * upper.cast("long") > UPPER_PERCENT * F.length(text).cast("long"), "C") + bit(text.rlike(MARKS), "D")


def _labelled(rows: DataFrame, labels: DataFrame, stages: Stages) -> DataFrame:
    """Rows with good and toxic; an id with several labels has what any of them says."""
    says = lambda label: F.max(F.when(F.col(label) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        says("quality").alias("good"), says("toxic").alias("toxic")).where("good = 1 OR toxic = 1")
    known = broadcast_if_small(stages.keep(known, "labels"), 32)
    named = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    return named.unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def mask_counts(documents: DataFrame, labels: DataFrame, stages: Stages) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters; at most 32 rows for each part.

    A group of equal texts is summed by part and label before it is dealt by its digest, so what meets in one task are
    a few rows for each part, however many copies there are.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("whole"))
    rows = stages.keep(rows.select("doc_id", "part", F.xxhash64("whole").alias("h1"), F.xxhash64(F.lit(17), "whole").alias("h2"),
                                   failed_by_text(F.col("whole")).alias("mask")), "rows")
    units = _labelled(rows, labels, stages).groupBy("doc_id", "part", "h1", "h2", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    copies = units.groupBy("h1", "h2", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_nameless"))
    first = F.min("least").over(Window.partitionBy("h1", "h2"))
    alone = F.col("n_nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    copies = copies.withColumn("first", first).withColumn("alone", alone).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), F.col("alone").alias("n")),
            F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))).alias("x"))
    counted = copies.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))
    return stages.keep(counted.where("n > 0"), "counts")


def order_totals(counts: DataFrame) -> DataFrame:
    """The audit of (part, mask, n, good, toxic): one row for each part, order and step."""
    spark = counts.sparkSession
    orders = ["".join(p) for p in permutations(FILTERS)]
    intervals = spark.createDataFrame(removal_intervals(), "mask int, step int, low int, high int")
    ends = counts.join(F.broadcast(intervals), "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("low").alias("rank"), *COUNTS),
        F.struct(F.col("high").alias("rank"), *((-F.col(c)).alias(c) for c in COUNTS)))).alias("x"))
    steps = ends.groupBy("part", "step", F.col("x.rank").alias("rank")).agg(*(F.sum(f"x.{c}").alias(c) for c in COUNTS))

    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    per_part = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.create_map(*(x for f, b in bits.items() for x in (
            F.lit(f), F.sum(F.when(F.col("mask").bitwiseAND(b) != 0, F.col("n")).otherwise(0))))).alias("fails"),
        F.create_map(*(x for f, b in bits.items() for x in (
            F.lit(f), F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0))))).alias("alone"))
    grid = per_part.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))).withColumn(
        "rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    totals = grid.join(steps, ["part", "step", "rank"], "left").fillna(0, COUNTS).select(
        "part", "step", "rank", "total", "fails", "alone", *(F.sum(c).over(along).alias(c) for c in COUNTS))
    order = F.get(F.array(*(F.lit(o) for o in orders)), F.col("rank"))
    totals = totals.withColumn("filter_order", order).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return totals.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (F.try_element_at("fails", "filter") - F.col("n")).alias("redundant"), F.try_element_at("alone", "filter").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"))


def filter_audit(documents: DataFrame, labels: DataFrame, stages: Stages | None = None) -> DataFrame:
    """One row per part (lang; null is ''), filter_order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    ``documents`` needs doc_id, text and lang, ``labels`` doc_id, quality and toxic; no other column is read, whatever
    its name. A null text is empty: it has no words and fails A alone, and E too if a smaller id has such a text. Of equal
    texts all rows of the smallest id pass E. Rows without an id pass E, make no other row fail it, and have no label.
    Rows count as often as they come. An empty table gives no rows. Texts are compared by two 64-bit hashes. Runs its steps when called.
    """
    return order_totals(mask_counts(documents, labels, stages or Stages(documents.sparkSession, "filter-audit")))
