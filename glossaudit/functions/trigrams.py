"""Character trigrams as numbers, for tasks that get texts by Arrow batches.

Texts come as :func:`glossaudit.functions.text.letters` leaves them: words with one space between them. Functions are
pickled by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

SPACE, END = 32, 10
AT_ONCE = 1 << 20  # characters that are worked on at once
MOST_PLACES = 1 << 22  # of a table of trigrams, four bytes each: 160 characters


def pack(first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Three code points of 21 bits in one number."""
    return first.astype(np.int64) << 42 | middle.astype(np.int64) << 21 | last.astype(np.int64)


def unpacked(keys: np.ndarray) -> list[str]:
    points = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype(np.uint32)
    return np.ascontiguousarray(points).view("<U3").ravel().tolist()


def packed(grams: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, 3)
    return pack(points[:, 0], points[:, 1], points[:, 2])


def pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, code points) of some texts at a time, in order: blanks around each, an end between two.
    The first and the last code point of a piece are only neighbours."""
    start = 0
    while start < len(texts):
        stop, size = start + 1, len(texts[start])
        while stop < len(texts) and size + len(texts[stop]) <= AT_ONCE:
            size += len(texts[stop])
            stop += 1
        whole = np.frombuffer(f" {' \n '.join(texts[start:stop])} ".encode("utf-32-le"), np.uint32)
        before = start
        for at in range(0, len(whole) - 2, AT_ONCE):
            part = whole[at:at + AT_ONCE + 2]
            yield before, part
            before += int(np.count_nonzero(part[1:-1] == END))
        start = stop


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, trigram) of all words, each between two spaces; the texts in order, some characters at a time."""
    for before, part in pieces(texts):
        middle = part[1:-1]
        ends = middle == END
        text = np.cumsum(ends) + before
        keep = (middle != SPACE) & ~ends
        yield text[keep], pack(part[:-2][keep], middle[keep], part[2:][keep])


def counted(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed times."""
    every, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(n[order], first)


def piece_counts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a piece in ascending order, and how often each occurs: counted in a table if the piece has few
    different characters for its length, else sorted."""
    middle = part[1:-1]
    keep = (middle != SPACE) & (middle != END)
    present = np.zeros(int(part.max()) + 1, bool)
    present[part] = True
    alphabet = np.flatnonzero(present)
    size = len(alphabet)
    if size ** 3 > 4 * len(part):
        return np.unique(pack(part[:-2][keep], middle[keep], part[2:][keep]), return_counts=True)
    number = np.zeros(len(present), np.int32)
    number[alphabet] = np.arange(size)
    own = number[part]
    times = np.bincount(((own[:-2] * size + own[1:-1]) * size + own[2:])[keep])
    found = np.flatnonzero(times)
    return pack(alphabet[found // size ** 2], alphabet[found // size % size], alphabet[found % size]), times[found]


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of all texts together, and how often each occurs."""
    parts = [found for found in (piece_counts(part) for _, part in pieces(texts)) if len(found[0])]
    return counted(*zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def table_of(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(number of each code point, place + 1 of each trigram of numbers, how many numbers): for trigrams that share few
    characters a look-up instead of a search; None if they don't. Number 0 and place 0: in no known trigram."""
    points = np.stack([known >> 42, known >> 21 & 0x1FFFFF, known & 0x1FFFFF])
    alphabet = np.unique(points)
    size = len(alphabet) + 1
    if size ** 3 > MOST_PLACES:
        return None
    number = np.zeros(int(alphabet[-1]) + 2, np.int32)
    number[alphabet] = np.arange(1, size)
    first, middle, last = number[points]
    place = np.zeros(size ** 3, np.int32)
    place[(first * size + middle) * size + last] = np.arange(1, len(known) + 1)
    place.reshape(size, size, size)[:, number[[c for c in (SPACE, END) if c < len(number)]], :] = 0  # words hold neither
    return number, place, size


def summed_scores(texts: list[str], known: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known trigrams of each text, their summed scores by row of ``scores``); ``known`` is sorted, its scores stand in
    the same order."""
    hits, sums = np.zeros(len(texts), np.int64), np.zeros((len(scores), len(texts)), np.int64)
    if not len(known):
        return hits, sums
    table = table_of(known)
    if table is None:
        return searched_scores(texts, known, scores, hits, sums)
    number, place, size = table
    scores = np.concatenate([np.zeros((len(scores), 1), np.int64), scores], axis=1)
    for start, part in pieces(texts):
        own = number[np.minimum(part, len(number) - 1)]
        found = place[(own[:-2] * size + own[1:-1]) * size + own[2:]]
        begins = np.concatenate([[0], np.flatnonzero(part[1:-1] == END)])  # an end counts nothing, so each text has a sum
        which = slice(start, start + len(begins))
        hits[which] += np.add.reduceat((found > 0).astype(np.int64), begins)
        for total, score in zip(sums, scores):
            total[which] += np.add.reduceat(score[found], begins)
    return hits, sums


def searched_scores(
    texts: list[str], known: np.ndarray, scores: np.ndarray, hits: np.ndarray, sums: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """The same for trigrams of too many characters for a table, added to ``hits`` and ``sums``."""
    for text, keys in trigrams(texts):
        place = np.searchsorted(known, keys)
        place[place == len(known)] = 0
        hit = known[place] == keys
        text, place = text[hit], place[hit]
        if not len(text):
            continue
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        hits[text[first]] += np.diff(np.append(first, len(text)))
        for own, score in zip(sums, scores):
            own[text[first]] += np.add.reduceat(score[place], first)
    return hits, sums
