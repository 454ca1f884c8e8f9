"""Quality by nearest-neighbour voting over latent-semantic vectors of words and word shapes.

A word's shape is its bytes by class (upper, lower, digit, other letter, each sign itself) without repeats. Features
are hashed words, hashed runs of one to three shapes, and how much of a text repeats itself. A bounded sample of labelled texts gives
their weights and, by singular value decomposition, a latent space; its vectors go to all tasks. Each text is compared
with all of them by blocked cosine products, and the labels of its nearest are weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaudit.llm.labelled import labelled_sample
from glossaudit.llm.words import Hasher, grams, word_bounds

BITS = 12
SAMPLE = 4_096  # labelled texts at most: a vector of RANK floats for each is broadcast
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
ROWS = 256
WORD_BITS = 11
WORDS = 1 << BITS  # the words' features come after those of the shapes
REPEATS = WORDS + (1 << WORD_BITS)  # one more feature: the part of word 5-grams seen before in the text


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[48:58], table[128:] = ord("X"), ord("x"), ord("9"), ord("u")
    return table


def shape_counts(words: Hasher, shapes: Hasher, column) -> Iterator[np.ndarray]:
    """Feature counts of each text, a block of rows at a time: float32, (rows, REPEATS + 1)."""
    classes = _classes()
    for row, end, data, offsets in words.blocks(column):
        hashed, starts, _ = words.words(data, offsets)
        bounds = word_bounds(starts, offsets)
        kinds = classes[data]
        new = np.ones(len(data), bool)
        new[1:] = kinds[1:] != kinds[:-1]
        new[starts] = True
        shape, at, _ = shapes.words(kinds[new], np.concatenate([[0], np.cumsum(new)])[offsets])
        of_word = np.repeat(np.arange(end - row), np.diff(bounds)) << WORD_BITS | (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        edges = word_bounds(at, np.concatenate([[0], np.cumsum(new)])[offsets])
        owners = np.repeat(np.arange(end - row), np.diff(edges))
        for low in range(0, end - row, ROWS):
            high = min(low + ROWS, end - row)
            counts = np.zeros((high - low, REPEATS + 1), np.float32)
            a, b = edges[low], edges[high]
            for k in (1, 2, 3):
                run = grams(shape[a:b], k) >> np.uint64(64 - BITS)
                own = owners[a:b] - low
                inside = own[k - 1:] == own[:len(own) - k + 1]
                flat = np.bincount(own[k - 1:][inside] << BITS | run[inside].astype(np.int64),
                                   minlength=(high - low) << BITS)
                counts[:, :WORDS] += flat.reshape(high - low, -1)
            own = of_word[bounds[low]:bounds[high]] - (low << WORD_BITS)
            counts[:, WORDS:REPEATS] = np.bincount(own, minlength=(high - low) << WORD_BITS).reshape(high - low, -1)
            for i in range(low, high):
                five = grams(hashed[bounds[i]:bounds[i + 1]], 5)
                if len(five):
                    counts[i - low, REPEATS] = 20 * (1 - len(np.unique(five)) / len(five))
            yield counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts by inverse document frequency, shapes and words each of length 1, and the repeats as they are."""
    out = np.log1p(counts) * idf
    for part in (slice(0, WORDS), slice(WORDS, REPEATS)):
        out[:, part] /= np.maximum(np.linalg.norm(out[:, part], axis=1, keepdims=True), 1e-9)
    out[:, REPEATS] = counts[:, REPEATS] / 10
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _latent(table: pa.Table) -> pa.Table:
    """Weights, projection, vectors and labels, as bytes, from the sample of labelled texts."""
    table = table.sort_by("doc_id")
    counts = np.stack([np.frombuffer(c, np.float32) for c in table.column("counts").to_pylist()])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = weighted(counts, idf)
    generator = np.random.Generator(np.random.PCG64(3))
    q = x @ generator.standard_normal((x.shape[1], RANK + 8), np.float32)
    for _ in range(4):  # randomised range finder
        q, _ = np.linalg.qr(q)
        q, _ = np.linalg.qr(x.T @ q)
        q = x @ q
    q, _ = np.linalg.qr(q)
    _, _, right = np.linalg.svd(q.T @ x, full_matrices=False)
    basis = np.ascontiguousarray(right[:RANK].T, dtype=np.float32)
    vectors = unit(x @ basis).astype(np.float32)
    labels = table.column("label").to_numpy().astype(np.float32)
    return pa.table({"idf": pa.array([idf.tobytes()], pa.binary()), "basis": pa.array([basis.tobytes()], pa.binary()),
                     "vectors": pa.array([vectors.tobytes()], pa.binary()),
                     "labels": pa.array([labels.tobytes()], pa.binary())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature counts of each text as bytes: of one size, however long the text is."""
    hashers = Hasher(), Hasher(lower=False)
    for batch in batches:
        row = 0
        for counts in shape_counts(*hashers, batch.column("text")):
            part = batch.slice(row, len(counts))
            row += len(counts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "label": part.column("label"),
                "counts": pa.array([c.tobytes() for c in counts], pa.binary())})


Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def train_quality(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model | None:
    """The model from at most ``sample`` rows of ``labels`` for which ``learn`` holds; None without any.

    The sample is of bounded size (25 KB for each text), so one task fits it; every other text is read by :func:`score_quality`.
    """
    counted = labelled_sample(documents, labels, "quality", learn, sample).select(
        F.col("doc_id").cast("long"), "label", "text").mapInArrow(_counted, "doc_id long, label int, counts binary")
    rows = counted.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(_latent, "idf binary, basis binary, vectors binary, labels binary").collect()
    if not rows:
        return None
    idf, basis, vectors, known = (np.frombuffer(rows[0][c], np.float32) for c in ("idf", "basis", "vectors", "labels"))
    rank = len(basis) // (REPEATS + 1)
    return idf, basis.reshape(-1, rank), vectors.reshape(-1, rank), known


def score_quality(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, the neighbours' labels weighted by similarity), one row per row.

    Reads doc_id and text, whatever else there is. Null, empty and wordless texts have no direction, so all labelled
    vectors are equally near and they get the share of label 1 in the sample. Without a model every score is 0.5. An
    empty table gives no rows. Among equally near neighbours those of the smaller ids count.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hasher(), Hasher(lower=False)
        for batch in batches:
            scores = [np.full(len(batch), 0.5)] if sent.value is None else []
            if sent.value is not None:
                idf, basis, vectors, labels = sent.value
                near = min(NEIGHBOURS, len(labels))
                for counts in shape_counts(*hashers, batch.column(1)):
                    own = unit(weighted(counts, idf) @ basis)
                    cosine = np.round(own @ vectors.T, 5)
                    best = np.argpartition(-cosine - np.arange(len(labels), 0, -1) * 1e-9, near - 1, axis=1)[:, :near]
                    weight = np.maximum(np.take_along_axis(cosine, best, axis=1), 1e-6).astype(np.float64)
                    score = (weight * labels[best]).sum(axis=1) / weight.sum(axis=1)
                    blank = counts.sum(axis=1) == 0
                    scores.append(np.where(blank, labels.mean(), score))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")
