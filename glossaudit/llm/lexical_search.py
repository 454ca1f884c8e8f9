"""Ranked lexical search, accumulator-limited and term at a time, over blocks of documents.

Documents are scored where they are read. A task makes the postings of the query terms for a block of documents and works
through each query's terms, the rarest of the table first. A document gets an accumulator when one of its terms comes
up. As soon as what the remaining terms can add at most is less than the k-th best score so far, no document without an
accumulator can still get into the results: no more accumulators are made, and the remaining terms only update those
there are, exactly. The k best of earlier blocks of the task count for the k-th best score too. A task sends the k best
of each query; the k best of all are chosen in two steps, so that one query is not one task's work.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaudit.llm.stages import Stages
from glossaudit.llm.words import Hasher, word_bounds

#: ASCII bytes that are neither digits nor letters
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
TOP = 10
PAIRS_AT_ONCE = 1_000_000  # terms of queries that are sent to all tasks at once: 16 bytes each; more make more passes
BLOCK_DOCS = 8_192  # documents whose postings are in memory together
SALTS = 64
UNIT = 1_000_000_000


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document; beyond 64 bits by whole numbers of any size."""
    if len(lengths) and 90 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 10 + 90 * lengths * n_docs // max(n_terms, 1)


def _query_terms(items: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of each item, as hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(separators=SEPARATORS)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, data, offsets in hasher.blocks(batch.column(1)):
                hashed, starts, _ = hasher.words(data, offsets)
                bounds = word_bounds(starts, offsets)
                own = [np.unique(hashed[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array(np.repeat(ids[row:row + len(own)], [len(o) for o in own]), pa.int64()),
                    "term": pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())})

    return items.select("item", "text").mapInArrow(run, "item long, term long")


def _known(hashed: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``hashed`` are among the sorted ``terms``, their indexes)."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(terms, hashed)
    at[at == len(terms)] = 0
    hit = np.flatnonzero(terms[at] == hashed)
    return hit, at[hit]


def _counted(texts: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """N, L and the document counts of ``terms`` (sorted), summed over all tasks."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, hasher = sent.value, Hasher(separators=SEPARATORS)
        found, docs, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for _, _, data, offsets in hasher.blocks(batch.column(0)):
                hashed, starts, _ = hasher.words(data, offsets)
                bounds = word_bounds(starts, offsets)
                docs, total = docs + int((np.diff(bounds) > 0).sum()), total + len(hashed)
                if len(hashed) and len(terms):
                    hit, at = _known(hashed, terms)
                    own = np.searchsorted(bounds, hit, "right") - 1
                    pairs = np.unique(own * len(terms) + at)
                    found += np.bincount(pairs % len(terms), minlength=len(terms))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({
            "at": pa.array(np.concatenate([[-2, -1], held]), pa.int64()),
            "n": pa.array(np.concatenate([[docs, total], found[held]]), pa.int64())})

    rows = texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(rows.column("at").to_pylist(), rows.column("n").to_pylist()))  # a row for each query term at most
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(len(terms))], np.int64)


class Postings:
    """For each term of a block of documents: who holds it, and what it adds to their score."""

    def __init__(self, pairs: np.ndarray, n_docs: int, n_all_terms: int, m: np.ndarray, weights: np.ndarray):
        """``pairs``: term * n_docs + document of each occurrence."""
        keys, tf = np.unique(pairs, return_counts=True)
        term, self.docs = keys // n_docs, keys % n_docs
        self.adds = weights[term] * (UNIT * tf.astype(np.int64) // (1000 * tf + 8 * m[self.docs]))
        self.starts = np.searchsorted(term, np.arange(n_all_terms + 1))
        self.most = np.zeros(n_all_terms, np.int64)
        if len(term):
            held = np.unique(term)
            self.most[held] = np.maximum.reduceat(self.adds, self.starts[held])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.docs[a:b], self.adds[a:b]


def best_of_block(postings: Postings, terms: np.ndarray, n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, number of accumulators): all that can be among the k best.

    ``terms``: the query's terms, the rarest first. ``floor``: the k-th best score of other documents, 0 if there are fewer.
    """
    terms = [t for t in terms.tolist() if postings.most[t]]
    if not terms:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    most = postings.most[terms]
    remaining = np.cumsum(most[::-1])[::-1]  # what this term and those after it can add at most
    sums, kth, at = np.zeros(n_docs, np.int64), floor, 0
    while at < len(terms) and remaining[at] >= kth:
        docs, adds = postings.of(terms[at])
        sums[docs] += adds
        at += 1
        if at < len(terms) and kth <= remaining[at] < sums.max() and n_docs >= k:
            kth = max(kth, int(np.partition(sums, n_docs - k)[n_docs - k]))
    survivors = np.flatnonzero(sums)
    scores = sums[survivors]
    for term in terms[at:]:
        docs, adds = postings.of(term)
        here = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
        scores += np.where(docs[here] == survivors, adds[here], 0)
    return survivors, scores, len(survivors)


def _scored(texts: DataFrame, items: list[tuple[int, np.ndarray]], terms: np.ndarray, weights: np.ndarray,
            n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item in each task. ``items``: item and its terms' indexes, rarest first."""
    sent = texts.sparkSession.sparkContext.broadcast((items, terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights = sent.value
        hasher = Hasher(separators=SEPARATORS)
        best: list[list[tuple]] = [[] for _ in items]  # heaps of (score, nameless, -doc_id): the worst comes first

        def work(ids: list, lengths: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
            n = len(ids)
            if not n:
                return
            m = length_factors(np.concatenate(lengths), n_docs, n_terms)
            keys = np.concatenate([at * n + own for own, at in pairs]) if pairs else np.zeros(0, np.int64)
            postings = Postings(keys, n, len(terms), m, weights)
            for heap, (_, own) in zip(best, items):
                floor = heap[0][0] if len(heap) == k else 0
                docs, scores, _ = best_of_block(postings, own, n, k, floor)
                for i in np.flatnonzero(scores >= max(floor, 1, _kth(scores, k))).tolist():
                    doc = ids[docs[i]]
                    row = (int(scores[i]), doc is not None, -(doc or 0))
                    if len(heap) < k:
                        heapq.heappush(heap, row)
                    elif row > heap[0]:
                        heapq.heapreplace(heap, row)

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(low, BLOCK_DOCS)
                lengths, pairs = [], []
                for row, _, data, offsets in hasher.blocks(part.column(1)):
                    hashed, starts, _ = hasher.words(data, offsets)
                    bounds = word_bounds(starts, offsets)
                    lengths.append(np.diff(bounds))
                    if len(hashed):
                        hit, at = _known(hashed, terms)
                        pairs.append((np.searchsorted(bounds, hit, "right") - 1 + row, at))
                work(part.column(0).to_pylist(), lengths, pairs)
        rows = [(item, -minus if named else None, score) for (item, _), heap in zip(items, best) for score, named, minus in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3,
                                         names=["item", "doc_id", "score"])

    return texts.mapInArrow(run, "item long, doc_id long, score long")


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else 0


def _ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(documents: DataFrame, queries: DataFrame, k: int = TOP, stages: Stages | None = None) -> DataFrame:
    """The k best documents of each query with a score above 0: item_id, rank, doc_id, score; fewer if there are fewer.

    ``documents`` needs doc_id and text, ``queries`` item_id and text; no other column is read, whatever its name. Null and
    empty texts have no terms: such a document is never found and does not count, such a query has no rows. Each row of
    ``documents`` is a document of its own and each row of ``queries`` a query of its own, whatever their ids; rows
    without an id rank last among equal scores. An empty table gives no rows. Terms are compared by 64-bit hashes. Queries
    are taken in as many passes over the documents as their terms need (PAIRS_AT_ONCE). Runs its steps when called.
    """
    stages = stages or Stages(documents.sparkSession, "lexical-search")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = stages.keep(queries.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")), "items")
    wanted = stages.keep(_query_terms(items), "terms")
    passes, found = max(1, -(-wanted.count() // PAIRS_AT_ONCE)), []
    for nth in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == nth).orderBy("item", "term").toArrow()
        item, term = part.column("item").to_numpy(), part.column("term").to_numpy().view(np.uint64)
        terms = np.unique(term)
        n_docs, n_terms, df = _counted(texts, terms)
        weights = np.array([term_weight(n_docs, int(n)) for n in df], np.int64)
        at, order = np.searchsorted(terms, term), np.zeros(0, np.int64)
        order = np.lexsort((at, df[at], item))
        groups = np.split(at[order], np.flatnonzero(np.diff(item[order])) + 1) if len(item) else []
        scored = _scored(texts, list(zip(np.unique(item).tolist(), groups)), terms, weights, n_docs, n_terms, k)
        found.append(stages.keep(scored, f"scored-{nth}"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    best = _ranked(best.withColumn("salt", F.spark_partition_id() % SALTS), k, "item", "salt").drop("rank", "salt")
    best = _ranked(best, k, "item")
    return best.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
