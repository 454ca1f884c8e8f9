"""Words and word n-grams of whole Arrow batches as 64-bit hashes, by numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial over its bytes modulo 2**64 with random
byte values, taken from one running sum per block of texts, and mixed at the end. Memory is bounded by
``BLOCK`` bytes of text, or by one longer text: some 30 bytes for each byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes the words of texts; made once for each task. ``separators`` are the bytes between words."""

    def __init__(self, lower: bool = True, separators: bytes = b" \t\n\x0b\x0c\r"):
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[list(separators)] = True
        self.up, self.down = powers(BASE, BLOCK), powers(BASE_INVERSE, BLOCK)

    def blocks(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yield (first row, end row, bytes, offsets of the rows in them); a null text is empty."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
            yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
            row = end

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, its first byte, its end) in order; words end where a text ends."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = ~self.space[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = (self.up, self.down) if n <= BLOCK else (powers(BASE, n), powers(BASE_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * up[:n], out=sums[1:])
        self.sums, self.scale = sums, down
        return self.stems(starts, ends), starts, ends

    def stems(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each start to its end, in the bytes that :meth:`words` read last."""
        hashed = (self.sums[ends] - self.sums[starts]) * self.scale[starts]
        return mix(hashed + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; runs that cross texts are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= STEP
        out += words[i:n + i]
    return mix(out + np.uint64(k))


def word_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each text, and the number of words at the end."""
    return np.searchsorted(starts, offsets)


def word_sets(hasher: Hasher, column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (row, sorted distinct shingles of k words); with fewer words the whole sequence as one."""
    for row, _, data, offsets in hasher.blocks(column):
        words, starts, _ = hasher.words(data, offsets)
        bounds, all_grams = word_bounds(starts, offsets), grams(words, k)
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                own = np.sort(all_grams[a:b - k + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield row + i, own[keep]
            else:
                yield row + i, grams(words[a:b], int(b - a)) if b > a else words[:0]
