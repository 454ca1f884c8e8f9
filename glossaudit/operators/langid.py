"""Language identification: a trigram model trained from labelled text, applied by a join."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaudit import storage
from glossaudit.functions.text import clean_label, explode_trigrams, flatten_newlines, letters, normalize_text
from glossaudit.functions.trigrams import packed, summed_scores, trigram_counts, unpacked
from glossaudit.storage import fingerprint, small_enough, staged

TEMPERATURES = tuple(2.0 ** (k / 2) for k in range(21))  # 1 to 1,024
SCALE = 1_000_000  # log-probabilities are kept as whole millionths: sums do not depend on order


@dataclass(frozen=True)
class LanguageModel:
    """``grams`` holds (gram, lp, n): one log-probability per language, in the order of ``languages``, and how often the gram
    was counted. ``temperature`` is what softens scores into shares unless a caller names another."""

    languages: tuple[str, ...]
    grams: DataFrame
    n_grams: int
    temperature: float = 1.0

    @property
    def broadcastable(self) -> bool:
        return small_enough(self.n_grams, 64 + 8 * len(self.languages))

    @cached_property
    def sent(self) -> Broadcast:
        """(trigrams as sorted numbers, their scores by language), for tasks; only while :attr:`broadcastable`."""
        found = self.grams.select("gram", *(F.get("lp", F.lit(i)).alias(f"s{i}") for i in range(len(self.languages)))).toArrow()
        keys = packed(found.column("gram").to_pylist())
        order = np.argsort(keys)
        scores = [found.column(f"s{i}").to_numpy()[order] for i in range(len(self.languages))]
        scores = np.stack(scores) if scores else np.zeros((0, len(keys)), np.int64)
        return self.grams.sparkSession.sparkContext.broadcast((keys[order], scores))

    def fingerprint(self) -> str:
        """Differs for models that score differently."""
        return f"{','.join(self.languages)} {self.temperature} {fingerprint(self.grams, 'gram', 'lp')}"

    def hot(self) -> DataFrame:
        """(gram, lp) of the grams counted most often, as many as may be broadcast: all counted at least some power of 2 times."""
        room, least = storage.BROADCAST_LIMIT_BYTES // (64 + 8 * len(self.languages)), 64
        for row in self.grams.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():
            room -= row["count"]  # at most 64 rows
            if room < 0:
                break
            least = row["power"]
        return self.grams.where(F.floor(F.log2("n")) >= least).select("gram", "lp")

    def as_table(self) -> DataFrame:
        """(gram, lang, lp), one row per pair."""
        names = F.array(*[F.lit(lang) for lang in self.languages])
        return self.grams.select("gram", F.inline(F.arrays_zip(names.alias("lang"), F.col("lp")))).toDF(
            "gram", "lang", "lp")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", most_languages: int = 1_000) -> LanguageModel:
    """Count trigrams per language and smooth them (Laplace) into fixed-point log-probabilities.

    One pass over the text: tasks count the grams of their texts, so that the only shuffle moves at most one row per
    distinct gram, language and Arrow batch, however skewed the text is. The counts are written to the shared folder; only the totals (one row) come to the driver. A model has
    one score per language, so a table with more than ``most_languages`` labels raises.
    """
    known = labelled.select(clean_label(F.col(lang)).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull())
    found = known.select("lang").distinct().orderBy("lang").limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} labels: is {lang!r} really a language column?")
    languages = tuple(row.lang for row in found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[str, list[str]] = {}
            for code, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.setdefault(code, []).append(own)
            for code, texts in of.items():
                keys, times = trigram_counts(texts)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([code] * len(keys), pa.string()), "gram": pa.array(unpacked(keys), pa.string()),
                    "times": pa.array(times, pa.int64())})

    clean = known.select("lang", F.coalesce(letters(F.col("text")), F.lit("")).alias("text"))
    grams = clean.mapInArrow(count, "lang string, gram string, times long")
    per_language = [F.sum(F.when(F.col("lang") == code, F.col("times")).otherwise(0)) for code in languages]
    counts = staged(
        grams.groupBy("gram").agg(*[c.alias(f"n{i}") for i, c in enumerate(per_language)]), "gram-counts")

    totals = counts.agg(F.count("*").alias("v"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]).first()
    lp = [
        F.round(F.log((F.col(f"n{i}") + 1) / F.lit(totals[f"n{i}"] + totals["v"])) * SCALE).cast("long")
        for i in range(len(languages))
    ]
    seen = reduce(operator.add, (F.col(f"n{i}") for i in range(len(languages))))
    return LanguageModel(languages, counts.select("gram", F.array(*lp).alias("lp"), seen.alias("n")), totals["v"])


def _top(scores: list[Column], languages: tuple[str, ...], temperature: float) -> tuple[Column, Column]:
    """Best language (first in alphabetical order on a tie) and its softmax share."""
    array = F.array(*scores)
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    names = F.array(*[F.lit(code) for code in languages])
    shares = [F.exp((score - best) / F.lit(SCALE * temperature)) for score in scores]
    return F.get(names, (F.array_position(array, best) - 1).cast("int")), F.lit(1.0) / reduce(operator.add, shares)


def _scored_beyond_broadcast(grams: DataFrame, model: LanguageModel, *keys: str) -> DataFrame:
    """(keys, s0, s1, ...) with a model of any size, without a task for each frequent gram.

    The most frequent grams are sent to all tasks and summed up per text where the text is. Of the others a text's
    distinct ones are counted there too, and only those counts go to the model, dealt by gram. What is left of a text
    before that is one row and its distinct rare grams; it is written when this is called.
    """
    hot = grams.join(F.broadcast(model.hot()), "gram", "left")
    rare = F.when(F.col("lp").isNull(), F.col("gram"))
    sums = [F.sum(F.get("lp", F.lit(i))).alias(f"s{i}") for i in range(len(model.languages))]
    counted = staged(hot.withColumn("rare", rare).groupBy(*keys, "rare").agg(F.count("*").alias("times"), *sums), "gram-counts")
    found = counted.where("rare IS NOT NULL").select(*keys, F.col("rare").alias("gram"), "times").join(
        model.grams.select("gram", "lp"), "gram", "left")
    found = found.select(*keys, *((F.get("lp", F.lit(i)) * F.col("times")).alias(f"s{i}") for i in range(len(model.languages))))
    both = counted.where("rare IS NULL").select(found.columns).unionByName(found)
    return both.groupBy(*keys).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(model.languages))))


def score_sums(texts: DataFrame, model: LanguageModel, *keys: str, text: str = "text") -> DataFrame:
    """(keys, s0, s1, ...): the summed log-probability of each text in each language; null without a known gram.

    The keys must be unique. A model that may be broadcast is sent when this is called, and texts are scored where they
    are: nothing is moved.
    """
    normal = texts.select(*keys, flatten_newlines(normalize_text(F.col(text))).alias(text))
    if not model.broadcastable:
        return _scored_beyond_broadcast(explode_trigrams(normal, text, *keys), model, *keys)
    sent, names = model.sent, [f"s{i}" for i in range(len(model.languages))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = sent.value
        for batch in batches:
            hits, sums = summed_scores(batch.column(len(keys)).to_pylist(), known, scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], *(pa.array(own, pa.int64(), mask=hits == 0) for own in sums)], names=[*keys, *names])

    clean = normal.select(*keys, F.coalesce(letters(F.col(text)), F.lit("")).alias(text))
    schema = T.StructType([*clean.schema.fields[:-1], *(T.StructField(name, T.LongType()) for name in names)])
    return clean.mapInArrow(score, schema)


def language_scores(texts: DataFrame, model: LanguageModel, *keys: str, text: str = "text",
                    temperature: float | None = None) -> DataFrame:
    """(keys, lang, confidence): the language of each text, for keys that are unique and narrow.

    The keys go to Python with the text (with a large model to each of its characters), so they should be a few numbers.
    Texts without a known gram keep their row, as (null, 0.0). Nothing is shuffled, unless the model is too large to be
    broadcast.
    ``temperature``: the model's own if it is None.
    """
    scored = score_sums(texts, model, *keys, text=text)
    scores = [F.col(f"s{i}") for i in range(len(model.languages))]
    lang, confidence = _top(scores, model.languages, model.temperature if temperature is None else temperature)
    known = F.col("s0").isNotNull()
    return scored.select(
        *keys, F.when(known, lang).alias("lang"), F.when(known, confidence).otherwise(0.0).alias("confidence"))


def numbered(texts: DataFrame, name: str = "texts") -> DataFrame:
    """``texts`` written once, with a number ``row`` of their own; equal rows stay apart. Runs when called."""
    return staged(texts.withColumn("row", F.monotonically_increasing_id()), name)


def detect_language(
    texts: DataFrame, model: LanguageModel, text: str = "text", temperature: float | None = None,
) -> DataFrame:
    """The columns of ``texts`` but the text, with ``lang`` and ``confidence``; one row per row.

    The texts are written once with a row number. Only that number goes through the aggregation, however many columns
    there are; they are joined back by it. Runs its first step when called.
    """
    rows = numbered(texts)
    scores = language_scores(rows, model, "row", text=text, temperature=temperature)
    return rows.drop(text).join(scores, "row").drop("row")


def calibrated(model: LanguageModel, held_out: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model with the temperature of TEMPERATURES under which the labels of texts it has not seen are likeliest.

    Summed log-probabilities take neighbouring trigrams for independent and so are far too sure. Each text is scored
    once; one aggregate sums the log-likelihood of its label at every temperature. Texts whose label the model does
    not know, or without a known gram, do not count; with none that does, the temperature stays as it is.
    """
    rows = numbered(held_out.select(clean_label(F.col(lang)).alias("label"), F.col(text).alias("text")), "held-out")
    sums = [F.col(f"s{i}") for i in range(len(model.languages))]
    place = F.array_position(F.array(*(F.lit(code) for code in model.languages)), F.col("label")) - 1
    scored = score_sums(rows, model, "row").where("s0 IS NOT NULL").join(rows.select("row", "label"), "row")
    scored = scored.withColumn("own", F.get(F.array(*sums), place.cast("int"))).where("own IS NOT NULL")
    best = F.greatest(*sums) if len(sums) > 1 else sums[0]

    def unlikely(temperature: float) -> Column:
        scale = F.lit(SCALE * temperature)
        return F.log(reduce(operator.add, (F.exp((s - best) / scale) for s in sums))) - (F.col("own") - best) / scale

    losses = scored.agg(*(F.sum(unlikely(t)).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    if losses[0] is None:
        return model
    return replace(model, temperature=min(zip(losses, TEMPERATURES))[1])


def calibration(detections: DataFrame, label: str = "label") -> DataFrame:
    """(bin, n, confidence, accuracy): by tenths of confidence how sure detections are, and how often they are right."""
    tenth = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int").alias("bin")
    right = F.avg((F.col("lang") == F.col(label)).cast("double"))
    return detections.where(F.col("lang").isNotNull()).groupBy(tenth).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), right.alias("accuracy"))


def calibration_error(bins: DataFrame) -> float:
    """Mean distance of confidence from accuracy over all detections."""
    return bins.agg(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).first()[0]
