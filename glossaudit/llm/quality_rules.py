"""Quality rules: counts over whole texts, and robust multivariate outliers per language and source.

Base rules fail short and repetitive texts. Of the rest, the minimum-covariance-determinant estimate of each
(lang, source) describes the usual text; a text is rejected where the Mahalanobis distance of its transformed
statistics is beyond ``CUTOFF``. Everything is DataFrame functions; estimates are tables with one row per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaudit.llm.stages import Stages
from glossaudit.storage import broadcast_if_small

SPACES = r"\x20\x09-\x0D"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Smallest spread of each transformed statistic: less is not told apart from an ordinary text.
FLOORS = {"x_length": 0.5, "x_word": 0.25, "x_symbol": 0.05, "x_upper": 0.05, "x_punct": 0.05}
GRID = 1024  # statistics are rounded to 1 / GRID, so that medians are exact with bounded memory
MIN_GROUP = 100  # smaller groups share the estimate of their language, then of all
CORE = 0.75  # share of a group that the estimate fits
STEPS = 3
CHI2_MEDIAN = 4.351460  # of chi-square with 5 degrees of freedom
CHI2_CORE = 12.832502  # its 0.975 quantile
CUTOFF = 40.0  # chi-square with 5 degrees of freedom is beyond it once in some seven million texts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda uses it for each element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text.

    A window's hash and place share one long, the place in as few low bits as the text needs: two different
    windows of a text with n words are taken as equal with a chance below n ** 3 / 2 ** 64.
    """
    def of_windows(h: Column, n: Column) -> Column:
        room = F.expr("1L") * F.pow(F.lit(2.0), F.ceil(F.log2(n + 1.0))).cast("long")

        def of_room(m: Column) -> Column:
            def window(x: Column, i: Column) -> Column:
                key = F.xxhash64(x, *(F.get(h, i + j) for j in range(1, WINDOW)))
                return key.bitwiseAND(-m).bitwiseOR(i.cast("long"))

            def of_sorted(s: Column) -> Column:
                size = F.size(s)
                same = F.zip_with(F.slice(s, F.lit(1), size - 1), F.slice(s, F.lit(2), size - 1),
                                  lambda x, y: x.bitwiseAND(-m) == y.bitwiseAND(-m))

                def of_same(e: Column) -> Column:
                    twice = F.filter(s, lambda x, j: F.coalesce(F.get(e, j), F.lit(False))
                                     | F.coalesce(F.get(e, j - 1), F.lit(False)))
                    places = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(m - 1)))
                    covered = let(places, lambda p: F.aggregate(
                        F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(
                            F.coalesce(b - a, F.lit(WINDOW).cast("long")), F.lit(WINDOW).cast("long"))),
                        F.lit(0).cast("long"), lambda total, x: total + x))
                    return F.when(F.exists(e, lambda x: x), covered).otherwise(F.lit(0).cast("long"))

                return let(same, of_same)

            starts = F.slice(h, F.lit(1), n - (WINDOW - 1))
            return let(F.sort_array(F.transform(starts, window)), of_sorted)

        return let(room, of_room)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(
        F.size(h) > WINDOW, of_windows(h, F.size(h))).otherwise(F.lit(0).cast("long")))


def text_statistics(documents: DataFrame, *carry: Column) -> DataFrame:
    """Counts of each whole text (null: empty) as longs, and base_failed."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))
    words = F.array_remove(F.split(t, f"[{SPACES}]+", -1), "")
    counted = documents.select(
        *carry, "doc_id", F.col("lang").alias("q_lang"), F.col("source").alias("q_source"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        (F.char_length(t) - F.regexp_count(t, F.lit(f"[{SPACES}]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit(r"\p{P}")).cast("long").alias("n_punct"))
    n, r = F.col("w.n"), F.col("w.r")
    return counted.select(
        *(f"carried_{i}" for i in range(len(carry))), "doc_id", "q_lang", "q_source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        r.alias("n_repeat_words"), "n_upper", "n_punct",
        ((n < MIN_WORDS) | (100 * r > REPEAT_PERCENT * n)).alias("base_failed"))


def _vector(stats: DataFrame) -> DataFrame:
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    sure = F.sqrt(n / (n + 20))  # the mean of a few words says little
    values = {
        "x_length": F.log(n + 0.0), "x_word": (F.col("word_chars") / n - 5) * sure,
        "x_symbol": F.sqrt(F.col("n_symbols") / chars), "x_upper": F.sqrt(F.col("n_upper") / chars),
        "x_punct": F.sqrt(F.col("n_punct") / chars)}
    return stats.withColumns({k: F.round(v * GRID) / GRID for k, v in values.items()})


NAMES = tuple(FLOORS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance from columns m_i and the Cholesky factor l_i_j."""
    y: list[Column] = []
    for i, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * y[j]
        y.append(rest / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance, its diagonal raised by the floors, for each group."""
    sums = rows.groupBy("grp").agg(
        *(F.avg(name).alias(f"m_{i}") for i, name in enumerate(NAMES)),
        *(F.covar_pop(NAMES[i], NAMES[j]).alias(f"c_{i}_{j}") for i, j in PAIRS))
    for i, j in PAIRS:  # row by row, so each factor uses those before it
        rest = F.col(f"c_{i}_{j}") + (F.lit(FLOORS[NAMES[i]] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        sums = sums.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    return sums.select("grp", *(f"m_{i}" for i in range(len(NAMES))), *(f"l_{i}_{j}" for i, j in PAIRS))


def _log_distance() -> Column:
    return F.round(F.log(F.greatest(F.col("d2"), F.lit(1e-6))), 3)


def _with(rows: DataFrame, per_group: DataFrame) -> DataFrame:
    return rows.join(broadcast_if_small(per_group, 400), "grp")


def minimum_covariance(rows: DataFrame, stages: Stages) -> DataFrame:
    """The estimate of each group from the CORE share of rows that lie closest together.

    Starts from medians and median deviations, takes STEPS concentration steps, scales the covariance to the
    chi-square median, and fits once more to all rows within its 0.975 quantile.
    """
    middle = stages.keep(rows.groupBy("grp").agg(
        *(F.percentile(n, F.lit(0.5)).alias(f"m_{i}") for i, n in enumerate(NAMES))), "middle")
    spread = _with(rows, middle).groupBy("grp").agg(*(
        F.percentile(F.abs(F.col(n) - F.col(f"m_{i}")), F.lit(0.5)).alias(f"s_{i}") for i, n in enumerate(NAMES)))
    zeros = {f"l_{i}_{j}": F.lit(0.0) for i, j in PAIRS if i != j}
    scales = {f"l_{i}_{i}": F.sqrt(F.pow(1.4826 * F.col(f"s_{i}"), 2) + FLOORS[n] ** 2) for i, n in enumerate(NAMES)}
    now = stages.keep(middle.join(spread, "grp").withColumns(zeros | scales), "start")
    for _ in range(STEPS):
        measured = _with(rows, now).withColumn("d2", _distance()).select("grp", *NAMES, _log_distance().alias("d"))
        edge = stages.keep(measured.groupBy("grp").agg(F.percentile("d", F.lit(CORE)).alias("edge")), "edge")
        now = stages.keep(_estimate(_with(measured, edge).where("d <= edge")), "estimate")
    measured = _with(rows, now).withColumn("d2", _distance()).select("grp", *NAMES, _log_distance().alias("d"))
    scale = stages.keep(measured.groupBy("grp").agg(F.percentile("d", F.lit(0.5)).alias("mid")), "scale")
    inside = F.col("d") <= F.col("mid") + F.log(F.lit(CHI2_CORE / CHI2_MEDIAN))
    return stages.keep(_estimate(_with(measured, scale).where(inside)), "estimate")


def _judged(documents: DataFrame, stages: Stages, *carry: str) -> DataFrame:
    """Counts, base_failed, distance and kept; the column carry[i] as carried_i, so no names clash."""
    stats = stages.keep(_vector(text_statistics(documents, *(
        documents[c].alias(f"carried_{i}") for i, c in enumerate(carry)))), "stats")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = stats.where("NOT base_failed").withColumns({"by_lang": part("q_lang"), "by_source": part("q_source")})
    sizes = stages.keep(rows.groupBy("by_lang", "by_source").agg(F.count("*").alias("n")), "sizes")
    langs = sizes.where(F.col("n") < MIN_GROUP).groupBy("by_lang").agg(F.sum("n").alias("n_lang"))
    rest = langs.where(F.col("n_lang") < MIN_GROUP).groupBy(F.lit(1).alias("all")).agg(F.sum("n_lang").alias("n_all"))
    plan = sizes.withColumn("all", F.lit(1)).join(langs, "by_lang", "left").join(rest, "all", "left").select(
        "by_lang", "by_source", F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\x01", "by_lang", "by_source"))
        .when(F.col("n_lang") >= MIN_GROUP, F.col("by_lang"))
        .when(F.col("n_all") >= MIN_GROUP, F.lit("")).alias("grp"))
    plan = stages.keep(plan, "plan")
    grouped = rows.join(broadcast_if_small(plan, 200), ["by_lang", "by_source"]).where("grp IS NOT NULL")
    narrow = stages.keep(grouped.select("grp", *NAMES), "vectors")
    estimate = minimum_covariance(narrow, stages)
    per_source = stages.keep(plan.join(estimate, "grp"), "per-source")
    tagged = stats.withColumns({"by_lang": part("q_lang"), "by_source": part("q_source")})
    judged = tagged.join(broadcast_if_small(per_source, 600), ["by_lang", "by_source"], "left").withColumn(
        "distance", F.when(~F.col("base_failed"), _distance()))
    far = F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_rules(documents: DataFrame, stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, distance.

    ``documents`` needs doc_id, text, lang and source; no other column is read, whatever its name. A null or blank
    text has no words and fails the base rules. Null lang or source are groups of their own. Repeated rows count
    and return as often as they come. Groups too small even together (fewer than MIN_GROUP texts in all) have no
    estimate: their texts that pass the base rules are kept, with a null distance. An empty table gives no rows. Runs
    its steps when called.
    """
    return _judged(documents, stages or Stages(documents.sparkSession, "quality-rules")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_upper", "n_punct", "distance")


def filter_quality(documents: DataFrame, stages: Stages | None = None) -> DataFrame:
    """The rows of ``documents`` that :func:`quality_rules` keeps, with all their columns."""
    stages = stages or Stages(documents.sparkSession, "quality-rules")
    kept = _judged(documents, stages, *documents.columns).where("kept")
    return kept.select(*(F.col(f"carried_{i}").alias(c) for i, c in enumerate(documents.columns)))
