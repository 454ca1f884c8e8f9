"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of their stems (first bytes), of pairs of neighbours, and of
pairs with one word between.
The sample of labelled texts is split over tasks; each learns a model with a rate per coordinate and L1 shrinkage,
and the models are averaged. What is left of the weights is one small array that all tasks get.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaudit.llm.labelled import labelled_sample
from glossaudit.llm.stages import Stages
from glossaudit.llm.words import STEP, Hasher, mix, word_bounds

BITS = 20
SAMPLE = 24_576  # labelled texts to learn from at most
ROWS_IN_SHARD = 6_144  # texts that one task learns from
PASSES = 8
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.0
THRESHOLD = 0.7
STEMS = (4, 5, 6)
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())


def features(hasher: Hasher, column) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(feature numbers, row of each, rows) for each block of texts; a text's features may repeat."""
    shift = np.uint64(64 - BITS)
    for row, end, data, offsets in hasher.blocks(column):
        words, starts, ends = hasher.words(data, offsets)
        rows = np.repeat(np.arange(end - row), np.diff(word_bounds(starts, offsets)))
        found, owners = [words >> shift], [rows]
        for size in STEMS:
            long = ends - starts > size
            if long.any():
                found.append((hasher.stems(starts[long], starts[long] + size) + np.uint64(size)) >> shift)
                owners.append(rows[long])
        for gap in (1, 2):
            if len(words) > gap:
                same = rows[gap:] == rows[:-gap]
                pairs = mix(words[:-gap] * STEP + words[gap:] + np.uint64(gap))
                found.append(pairs[same] >> shift)
                owners.append(rows[gap:][same])
        yield np.concatenate(found).astype(np.int64), np.concatenate(owners), end - row


def ftrl(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """(weights, bias) from (distinct features, label) pairs, taken in order PASSES times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z, bias_n, bias = 0.0, 0.0, 0.0
    for _ in range(PASSES):
        for own, label in examples:
            zs, ns = z[own], n[own]
            w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            score = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = score - label
            z[own] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[own] = ns + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    weights = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return weights, bias


def train_toxicity(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(weights, bias) learnt from at most ``sample`` rows of ``labels`` for which ``learn`` holds.

    Without labelled rows all weights are 0. The driver gets the weights that are not 0: fewer than 2 ** BITS.
    """
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(separators=SEPARATORS)
        for batch in batches:
            own = []
            for found, rows, n in features(hasher, batch.column("text")):
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(n + 1))
                own += [np.unique(found[order[a:b]]).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"), "own": pa.array(own, pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        label = table.column("label").to_pylist()
        examples = [np.frombuffer(x, np.int32) for x in table.column("own").to_pylist()]
        weights, bias = ftrl(list(zip(examples, label)))
        at = np.flatnonzero(weights)
        return pa.table({"feature": pa.array(np.append(at, -1), pa.int64()),
                         "weight": pa.array(np.append(weights[at], bias), pa.float64())})

    stages = Stages(documents.sparkSession, "toxicity")
    shards = max(1, math.ceil(min(sample, labels.where(learn).count()) / ROWS_IN_SHARD))
    texts = labelled_sample(documents, labels, "toxic", learn, sample).select(F.col("doc_id").cast("long"), "label", "text")
    found = texts.mapInArrow(distinct, "doc_id long, label int, own binary")
    learnt = found.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(shards))).groupBy("shard")
    learnt = stages.keep(learnt.applyInArrow(run, "feature long, weight double"), "weights")
    models = max(1, learnt.where("feature = -1").count())
    found = learnt.groupBy("feature").agg((F.sum("weight") / models).alias("weight")).toArrow()
    at, values = found.column("feature").to_numpy(), found.column("weight").to_numpy()
    weights = np.zeros(1 << BITS)
    weights[at[at >= 0]] = values[at >= 0]
    return weights, float(values[at < 0].sum())


def score_toxicity(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1), one row per row.

    Reads doc_id and text, whatever else there is. A null, empty or wordless text gets the score of the bias. Whole
    texts count, and repeated words once. An empty table gives no rows.
    """
    weights, bias = model
    sent = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(separators=SEPARATORS)
        for batch in batches:
            scores = []
            for found, rows, n in features(hasher, batch.column(1)):
                value = sent.value[found]
                used = np.flatnonzero(value)
                once, at = np.unique(rows[used] << BITS | found[used], return_index=True)
                total = bias + np.bincount(once >> BITS, value[used[at]].astype(np.float64), n)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")
