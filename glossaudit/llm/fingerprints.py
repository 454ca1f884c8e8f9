"""Document fingerprints by winnowing: hashes of word k-grams, the least of each window, with positions.

Any run of ``K + WINDOW - 1`` words that two texts share puts a common hash into both fingerprints. Everything is
DataFrame functions: a gram's hash and place share one long, so the least long of a window is the least hash, and
among equal ones the rightmost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaudit.llm.quality_rules import SPACES, let
from glossaudit.llm.stages import Stages
from glossaudit.storage import broadcast_if_small

K = 4
WINDOW = 8  # a power of two
PLACE_BITS = 30  # a Spark string holds fewer words; 34 bits are left for the hash
LAST_PLACE = (1 << PLACE_BITS) - 1
PIECE = 16  # code points; a longer word is several
#: characters of scripts that are written without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han): each is a word
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
ROWS_IN_RANGE = 512
RANGES_MOST = 4_096  # from quantiles; each is cut evenly when there are more rows


def words_of(text: Column) -> Column:
    """The words of a text, cut so that none is longer than PIECE and characters of unspaced scripts stand alone.

    So a passage of such a text, or of a word without end, is grams like any other.
    """
    def split(t: Column) -> Column:
        return F.array_remove(F.split(t, f"[{SPACES}]+", -1), "")

    cut = F.regexp_replace(F.regexp_replace(text, f"([{UNSPACED}])", " $1 "), f"([^{SPACES}]{{{PIECE}}})", "$1 ")
    foreign = (F.octet_length(text) > F.char_length(text)) & text.rlike(f"[{UNSPACED}]")
    return let(split(text), lambda words: F.when(
        foreign | F.exists(words, lambda w: F.char_length(w) > PIECE), split(cut)).otherwise(words))


def winnow(text: Column) -> Column:
    """Fingerprint as an array of longs in the order of the text: hash above, place (from the end) below.

    Words are those of :func:`words_of`. A null text or one without words has none; with fewer than K words the whole sequence is the one gram, with fewer
    grams than WINDOW all of them are one window.
    """
    def packed(hashed: Column, place: Column) -> Column:
        return hashed.bitwiseAND(-(1 << PLACE_BITS)).bitwiseOR(F.lit(LAST_PLACE).cast("long") - place)

    def grams(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.size(h) - (K - 1)), lambda x, i: packed(
            F.xxhash64(x, *(F.get(h, i + j) for j in range(1, K))), i))

    def halves(m: Column, step: int) -> Column:
        """Minima of runs twice as long; past the end the other side is null and ``least`` leaves it out."""
        return let(m, lambda a: F.zip_with(a, F.slice(a, F.lit(1 + step), F.size(a)), lambda x, y: F.least(x, y)))

    def least(g: Column) -> Column:
        runs, step = g, 1
        while step < WINDOW:
            runs, step = halves(runs, step), 2 * step
        return F.array_distinct(F.slice(runs, F.lit(1), F.greatest(F.size(g) - (WINDOW - 1), F.lit(1))))

    words = let(F.coalesce(text, F.lit("")), words_of)
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= K, let(grams(h), least)).when(
        F.size(h) > 0, F.array(packed(F.xxhash64(h), F.lit(0).cast("long")))).otherwise(F.array().cast("array<long>")))


def hashes(fingerprint: Column) -> Column:
    """Distinct hashes of a fingerprint, in the order of their first places."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, PLACE_BITS)))


def positions(fingerprint: Column) -> Column:
    """The fingerprint as structs of hash and pos, the number of words before the gram."""
    return F.transform(fingerprint, lambda x: F.struct(
        F.shiftright(x, PLACE_BITS).alias("hash"), (F.lit(LAST_PLACE) - x.bitwiseAND(LAST_PLACE)).alias("pos")))


def as_string(fingerprint: Column) -> Column:
    """``hash:pos`` of each entry, comma-joined; empty for an empty fingerprint."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(
        F.hex(F.shiftrightunsigned(x, PLACE_BITS)), F.lit(":"),
        (F.lit(LAST_PLACE) - x.bitwiseAND(LAST_PLACE)).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(
        n / (F.size(a) + F.size(b) - n)))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (array of hash and pos structs), one row per row; other columns are not read."""
    return documents.select("doc_id", positions(winnow(F.col("text"))).alias("fingerprint"))


def with_next(documents: DataFrame, fingerprint: Column, stages: Stages) -> DataFrame:
    """doc_id, text, own, and text and fingerprint of the next row by descending doc_id; after the last comes the first.

    Rows are dealt to ranges of doc_id, and each range's first row is sent to the range before it as well, so the
    order of the whole table needs no single task. Rows with equal doc_id follow each other by text, those without
    one come last. Equal ids stay in one range.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = documents.count()
    if not rows:
        return documents.select(
            "doc_id", "text", fingerprint.alias("own"), F.col("text").alias("next_text"), fingerprint.alias("next_own"))
    ranges = max(1, min(RANGES_MOST, rows // ROWS_IN_RANGE))
    parts = math.ceil(rows / (RANGES_MOST * ROWS_IN_RANGE))
    cuts = documents.agg(F.percentile_approx(
        key, F.array(*(F.lit(i / ranges) for i in range(ranges + 1))), F.lit(20 * RANGES_MOST)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts))
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    above = F.size(F.filter(bounds, lambda c: c > key))
    if parts == 1 or len(cuts) < 2:
        place = above.cast("long")
    else:  # an even cut of a quantile range
        top = F.get(bounds, F.lit(len(cuts)) - above).cast("double")
        low = F.get(bounds, F.lit(len(cuts) - 1) - above).cast("double")
        inside = F.coalesce(F.floor((top - key) / (top - low) * parts), F.lit(0))
        place = above.cast("long") * (parts + 1) + F.least(F.greatest(inside, F.lit(0)), F.lit(parts))
    placed = documents.select("doc_id", F.col("text"), place.alias("range"), key.alias("key"))
    heads = stages.keep(placed.groupBy("range").agg(F.max("key").alias("head")), "heads")
    order = Window.orderBy("range")  # over the ranges only
    before = F.coalesce(F.lag("range").over(order), F.max("range").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = stages.keep(heads.select("range", "head", before.alias("before")), "heads")
    first = placed.join(broadcast_if_small(heads, 32), "range").where("key = head").select(
        "doc_id", "text", F.col("before").alias("range"), "key", F.lit(1).alias("sent"))
    every = placed.withColumn("sent", F.lit(0)).unionByName(first).withColumn("own", fingerprint)
    by = Window.partitionBy("range").orderBy("sent", F.desc("key"), "text")
    return every.select(
        "doc_id", "text", "own", "sent", F.lead("text").over(by).alias("next_text"),
        F.lead("own").over(by).alias("next_own")).where("sent = 0").drop("sent")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next
    document by descending doc_id. Reads doc_id and text, whatever else there is. A null text is empty: its fingerprint
    is empty, and two empty ones are alike. An empty table gives no rows; a lone row is its own next one.
    """
    stages = Stages(documents.sparkSession, "fingerprints")
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = with_next(source, winnow(F.col("text")), stages)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    joined = joined.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")

    def compared(e: Column) -> Column:
        own, other, after = hashes(F.col("own")), hashes(e), hashes(F.col("next_own"))
        return F.struct(as_string(e).alias("text"), let(own, lambda a: F.struct(
            let(other, lambda b: likeness(a, b)).alias("edited"),
            let(after, lambda b: likeness(a, b)).alias("next"))).alias("near"))

    told = joined.withColumn("told", let(winnow(F.col("edited")), compared))
    return told.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("own")).alias("fingerprint"),
        F.col("told.text").alias("edited_fingerprint"), F.col("told.near.edited").alias("near_edited"),
        F.col("told.near.next").alias("near_next"))
