"""Substring dedup by content-defined chunks: cut by a gear hash, compare chunks by digest, extend matches to their true ends.

A text is a sequence of units: words with the blanks after them, characters of scripts without blanks, pieces of long words.
A gear hash rolls over the units, and a chunk begins where it is least within ``RADIUS`` units. A cut depends on the few
units around it alone, so an insertion moves no cut beyond them, and a passage of over 50 words holds whole chunks
whatever stands around it. Chunks with equal digests are copies; the one of the smallest document and place is the
original. Copies that touch form a run. Where a run ends, the bytes next to it are compared with those of the other
places, and the run grows by what they have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaudit.llm.stages import Stages
from glossaudit.llm.words import Hasher, mix

RADIUS = 4  # units to both sides of a cut that decide on it: a cut every 9 units on average
LONG = 16  # bytes of a word from which on it is cut into pieces, of 8 bytes on average
SPAN_BYTES = 101  # the bytes of 51 words of one letter, so passages of over 50 words always reach it
AROUND = 160  # bytes next to a chunk that are compared; the edges of a passage lie some 10 units beyond its chunks
CHANCE = 8  # among many copies some go on alike by chance: fewer bytes more than most of them share do not count
BYTES = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(values: np.ndarray, bits: int) -> np.ndarray:
    """At each place the 32-bit sum of the values up to it, each shifted by ``bits`` for every place since, by doubling."""
    h, width = values, 1
    while width * bits < 32:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(width * bits))
        width *= 2
    return h


def unit_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First bytes of the units: words, characters of three or four bytes, and pieces where a word is ``LONG`` already."""
    marks = data >= 0xE0
    marks[starts] = True
    if (ends - starts > LONG).any():
        begun, inside = np.zeros(len(data), np.int64), np.zeros(len(data) + 1, np.int8)
        begun[starts] = starts
        inside[starts], inside[ends] = 1, inside[ends] - 1
        since = np.arange(len(data)) - np.maximum.accumulate(begun)
        marks |= (gear(BYTES[data], 2) < 1 << 29) & (since >= LONG) & (np.cumsum(inside[:-1]) > 0) & (data & 0xC0 != 0x80)
    return np.flatnonzero(marks)


def cuts(hashed: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Units before which a chunk ends: the least within RADIUS units of their text, of equal ones as many as lie apart.

    In a repeating sequence the equal ones are whole periods apart, so its chunks are equal wherever the first one lies.
    """
    place = np.arange(len(hashed)) + RADIUS * (texts + 1)
    padded = np.full(place[-1] + RADIUS + 1 if len(place) else 0, 1 << 32, np.int64)
    padded[place] = hashed
    least = np.ones(len(hashed), bool)
    for s in range(1, RADIUS + 1):
        least &= (padded[place - s] >= hashed) & (padded[place + s] >= hashed)
    found = np.flatnonzero(least)
    if (np.diff(place[found]) > RADIUS).all():
        return found
    kept, last = [], -RADIUS
    for i, at in zip(found.tolist(), place[found].tolist()):
        if at - last > RADIUS:
            kept.append(i)
            last = at
    return np.array(kept, np.int64)


def chunk_starts(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of the texts that ``offsets`` delimit; each text begins one."""
    _, starts, ends = hasher.words(data, offsets)
    units = unit_starts(data, starts, ends)
    opened = offsets[:-1][np.diff(offsets) > 0]
    if not len(units):
        return opened
    texts = np.searchsorted(offsets, units, "right") - 1
    stop = np.append(units[1:], len(data))
    own = (hasher.stems(units, np.minimum(stop, offsets[texts + 1])) >> np.uint64(32)).astype(np.uint32)
    rolled = gear(own, 16)
    opening = np.flatnonzero(np.diff(texts, prepend=-1))
    rolled[opening] = own[opening]
    return np.union1d(opened, units[cuts(rolled.astype(np.int64), texts)])


def _chunks(texts: DataFrame) -> DataFrame:
    """(row, doc_id, place, digest) of each chunk; ``place`` is its first byte and, in the low 32 bits, its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(lower=False), Hasher(lower=False, separators=b"")
        two.values = mix(two.values ^ np.uint64(0x5851F42D4C957F2D))
        for batch in batches:
            rows, ids = batch.column(0), batch.column(1)
            for row, _, data, offsets in one.blocks(batch.column(2)):
                if len(data) < SPAN_BYTES:
                    continue
                starts = chunk_starts(one, data, offsets)
                ends, d = np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1
                two.words(data, offsets)
                digests = two.stems(starts, ends).view(np.int64)
                long = np.diff(offsets)[d] >= SPAN_BYTES
                at = pa.array(row + d[long])
                yield pa.RecordBatch.from_pydict({
                    "row": rows.take(at), "doc_id": ids.take(at),
                    "place": pa.array((starts - offsets[d] << 32 | ends - starts)[long], pa.int64()), "digest": pa.array(digests[long])})

    return texts.mapInArrow(run, "row long, doc_id long, place long, digest long")


def _surroundings(asked: DataFrame) -> DataFrame:
    """``asked`` (row, text, places) as a row per place and side asked for: the bytes next to the chunk, read away from it.

    ``side`` is -1 before the chunk (reversed) and 1 after it. The bytes end between characters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                data, out = text.encode(), []
                for p in places:
                    a = p["start"]
                    b = a + p["size"]
                    if p["before"]:
                        low = max(0, a - AROUND)
                        while data[low] & 0xC0 == 0x80:
                            low += 1
                        out.append((row, a, p["digest"], p["kept"], -1, p["opens"], data[low:a][::-1]))
                    if p["after"]:
                        high = min(len(data), b + AROUND)
                        while high < len(data) and data[high] & 0xC0 == 0x80:
                            high -= 1
                        out.append((row, a, p["digest"], p["kept"], 1, p["closes"], data[b:high]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = "row long, start long, digest long, kept boolean, side int, edge boolean, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]
             for c in schema.split(", ")]
    return asked.mapInArrow(run, schema)


def _shared(a: Column, b: Column, side: Column) -> Column:
    """Number of equal bytes at the start of two binary values, in whole characters of the first; 0 if one is null."""
    @F.pandas_udf("int")
    def count(one: pd.Series, other: pd.Series, sides: pd.Series) -> pd.Series:
        out = []
        for x, y, s in zip(one, other, sides.tolist()):
            if x is None or y is None:
                out.append(0)
                continue
            n = min(len(x), len(y))
            unlike = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            m = n - (unlike.bit_length() + 7) // 8
            if s > 0:
                while 0 < m < len(x) and x[m] & 0xC0 == 0x80:
                    m -= 1
            else:
                while m and x[m - 1] & 0xC0 == 0x80:
                    m -= 1
            out.append(m)
        return pd.Series(out, dtype="int32")

    return count(a, b, side)


def _grown(around: DataFrame, stages: Stages) -> DataFrame:
    """(row, start, side, more): by how many bytes a run grows beyond its last chunk on each side.

    What most places share with the original counts, or what any two share if it is ``CHANCE`` bytes longer. Among sorted
    values neighbours have most in common. Equal values count as one, and only those that begin alike are sorted
    together, so no chunk has to be sorted by one task as a whole.
    """
    group = ["digest", "side"]
    begin, side = F.substring("bytes", 1, CHANCE), F.col("side")
    values = around.groupBy(*group, "bytes").agg(
        F.count("*").alias("n"), F.max("kept").alias("own"), F.max("edge").alias("edge"))
    by = Window.partitionBy(*group, begin).orderBy("bytes")
    values = values.withColumns({"low": F.lag("bytes").over(by), "high": F.lead("bytes").over(by)}).withColumn(
        "most", F.when(F.col("n") > 1, F.length("bytes")).when(F.col("edge"), F.greatest(
            _shared(F.col("bytes"), F.col("low"), side), _shared(F.col("bytes"), F.col("high"), side)))).drop("low", "high")
    first = around.where("kept").select(*group, F.col("bytes").alias("first"))
    values = values.join(first, group).withColumn("same", _shared(F.col("bytes"), F.col("first"), side)).select(
        *group, F.xxhash64("bytes").alias("print"), "edge", "most", "same", (F.col("n") - F.col("own").cast("int")).alias("n"))
    values = stages.keep(values, "values")

    by = Window.partitionBy(*group)
    counts = values.where("n > 0").groupBy(*group, "same").agg(F.sum("n").alias("n"))
    usual = counts.withColumns({"upto": F.sum("n").over(by.orderBy("same")), "all": F.sum("n").over(by)}).where(
        "2 * upto >= all").groupBy(group).agg(F.min("same").alias("usual"))
    usual = stages.keep(usual, "usual")
    ends = around.where("edge").select("row", "start", *group, "kept", F.xxhash64("bytes").alias("print"))
    grown = ends.join(values.where("edge").join(usual, group).drop("edge", "n"), [*group, "print"]).withColumn(
        "more", F.when(F.col("kept"), F.col("usual")).otherwise(F.least("same", "usual")))
    more = F.when(F.col("most") - F.col("more") >= CHANCE, F.col("most")).otherwise(F.col("more"))
    return grown.select("row", "start", "side", more.cast("long").alias("more"))


def repeated_spans(documents: DataFrame) -> DataFrame:
    """One row per passage found elsewhere too: doc_id, start, end (bytes of the UTF-8 text), n_chunks, original, kept.

    A passage of over 50 words (or as many characters of a script without blanks) that two places share lies within a run
    of spans that touch; shorter ones of ``SPAN_BYTES`` bytes or more do if they hold a whole chunk, whole texts always.
    ``original`` is the smallest doc_id that holds a chunk, for most of the span's chunks (``n_chunks``); ``kept`` says that
    the span is itself the first occurrence. Passages repeated within one text count as well. Reads doc_id and text,
    whatever else there is. Rows without an id count as places of a passage but get no span, as no place can be named in
    them; null and empty texts have no chunks. Rows that repeat an id are texts of their own and count as copies of each
    other. An empty table gives no rows. Runs its steps when called.
    """
    stages = Stages(documents.sparkSession, "substring-dedup")
    texts = stages.keep(documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "texts")
    chunks = stages.keep(_chunks(texts), "chunks")
    # What is joined by digest is written first, so that AQE can split the chunks of a very common digest.
    digests = chunks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    common = stages.keep(chunks.join(stages.keep(digests, "digests"), "digest"), "common")
    stages.drop("chunks", "digests")
    first = common.groupBy("digest").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "place")).alias("first"))
    first = stages.keep(first, "first")
    start = F.shiftright("place", 32)
    copies = common.join(first, "digest").select(
        "row", "doc_id", start.alias("start"), F.col("place").bitwiseAND((1 << 32) - 1).alias("size"), "digest",
        F.col("first.doc_id").alias("original"),
        ((F.col("row") == F.col("first.row")) & (F.col("place") == F.col("first.place"))).alias("kept"),
        F.xxhash64("first.row", start - F.shiftright("first.place", 32)).alias("line"))

    # A piece is a run of chunks that lie alike in the original; it grows at both ends.
    by = Window.partitionBy("row").orderBy("start")
    end = F.col("start") + F.col("size")
    follows = (F.col("start") == F.lag(end).over(by)) & (F.col("line") == F.lag("line").over(by))
    led = (end == F.lead("start").over(by)) & (F.col("line") == F.lead("line").over(by))
    marked = copies.withColumns({"opens": ~F.coalesce(follows, F.lit(False)), "closes": ~F.coalesce(led, F.lit(False))})
    marked = stages.keep(marked.withColumn("piece", F.sum(F.col("opens").cast("int")).over(by)), "marked")
    stages.drop("common", "first")
    ends = marked.groupBy("digest").agg(F.max("opens").alias("before"), F.max("closes").alias("after")).where("before OR after")
    asked = marked.join(stages.keep(ends, "ends"), "digest").groupBy("row").agg(F.collect_list(F.struct(
        "start", "size", "digest", "kept", "opens", "closes", "before", "after")).alias("places"))
    around = stages.keep(_surroundings(texts.join(asked, "row").select("row", "text", "places")), "around")
    grown = stages.keep(_grown(around, stages), "grown")
    stages.drop("texts", "ends", "around", "values", "usual")

    named = marked.where("doc_id IS NOT NULL")
    pieces = named.groupBy("row", "doc_id", "piece", "kept", "original").agg(
        F.min("start").alias("opened"), F.max("start").alias("closed"), F.max(end).alias("last"),
        F.count("*").alias("n"))
    for side, at in ((-1, "opened"), (1, "closed")):
        pieces = pieces.join(grown.where(F.col("side") == side).select(
            "row", F.col("start").alias(at), F.col("more").alias(f"more_{at}")), ["row", at])
    pieces = pieces.withColumns({"start": F.col("opened") - F.col("more_opened"), "end": F.col("last") + F.col("more_closed")})

    # Pieces that touch are a run; of ends that differ by chance the nearer one counts.
    order = Window.partitionBy("row").orderBy("start", "end", "piece")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    pieces = pieces.withColumn("reach", F.max("end").over(before)).withColumn(
        "run", F.sum(F.when(F.col("start") > F.col("reach"), 1).otherwise(0)).over(order))
    run = Window.partitionBy("row", "run")
    pieces = pieces.withColumns({"low": F.min("start").over(run), "high": F.max("end").over(run)})
    pieces = pieces.withColumns({
        "low": F.max(F.when(F.col("start") < F.col("low") + CHANCE, F.col("start"))).over(run),
        "high": F.min(F.when(F.col("end") > F.col("high") - CHANCE, F.col("end"))).over(run)})
    pieces = pieces.where(F.col("high") - F.col("low") >= SPAN_BYTES)

    # What is a copy is not kept, also where a first occurrence reaches into it.
    copied = F.when(~F.col("kept"), F.col("end")), F.when(~F.col("kept"), F.col("start"))
    pieces = pieces.withColumns({"left": F.max(copied[0]).over(before), "right": F.min(copied[1]).over(after)})
    pieces = pieces.withColumns({
        "start": F.greatest("start", "low", F.when(F.col("kept"), F.col("left"))),
        "end": F.least("end", "high", F.when(F.col("kept"), F.col("right")))}).where("start < end")
    order = Window.partitionBy("row", "run").orderBy("start", "end", "piece")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    breaks = (F.col("kept") != F.lag("kept").over(order)) | (F.col("start") > reach)
    pieces = pieces.withColumn("breaks", F.when(breaks, 1).otherwise(0)).withColumn("part", F.sum("breaks").over(order))
    spans = pieces.groupBy("row", "doc_id", "run", "part", "kept").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_chunks"),
        F.max(F.struct("n", (-F.col("original")).alias("original"))).alias("usual"))
    return spans.select("doc_id", "start", "end", "n_chunks", (-F.col("usual.original")).alias("original"), "kept")
