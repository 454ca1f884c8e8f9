"""Byte-level BPE by a transducer that is determinised as texts need it, and streaming decoding.

A run of tokens is what the merges give if and only if each token and each two neighbours are what the merges give
alone. So every prefix of a text has one last token, and a text can be read byte by byte: a thread is a place up to
which the text may be encoded, with the node of the vocabulary's trie for the bytes since then. All live threads together
are a state of the transducer, and a step tells the next state and the token that ends at this byte. Which of these
tokens stand is settled where the live threads' paths back meet: never further back than the longest tokens reach.
States and steps are made when first met, and made anew once there are too many.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
STEPS_MOST = 400_000
PAIRS_MOST = 200_000
PIECES_MOST = 200_000
SETTLE = 4_096  # bytes of a piece after which settled tokens are given out
FEW = 32
PIECE_BYTES = 64  # longer pieces are not remembered
BLOCK = 1 << 18
_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")  # no piece holds a space between two letters: a safe place to cut


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """Merge the neighbours of lowest rank, leftmost first, until none is in the vocabulary or ``least`` are left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > least:
        found = [(ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank == 1 << 62:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class State(dict):
    """byte -> (next state, token that ends here); ``threads`` is what the state stands for."""

    __slots__ = ("threads",)


class Transducer:
    """Pieces to token ids.

    A thread is (trie node, what may follow): the last token while much may follow; once few tokens lie beyond the
    node, those of them that fit after the last token, so that threads with the same future are the same.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.nodes: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at: dict[int, int] = {}
        self.depth = [0]
        self.children: dict[int, list[int]] = {}
        self.under: dict[int, tuple[int, ...] | None] = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.nodes:
                    self.children.setdefault(node, []).append(byte)
                    self.depth.append(self.depth[node] + 1)
                    self.nodes[key] = len(self.nodes) + 1
                node = self.nodes[key]
            self.token_at[node] = rank
        self.sizes = list(map(len, self.bytes_of))
        self.sound: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.fitting: dict[int, tuple[int, ...]] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.restart()

    def restart(self) -> None:
        self.made, self.states = 0, {}
        self.first = self._state(((0, -1),))

    def _state(self, threads: tuple) -> State:
        state = self.states.get(threads)
        if state is None:
            state = self.states[threads] = State()
            state.threads = threads
        return state

    def _spine(self, token: int, side: int) -> list[int]:
        """Ranks of the tokens at one edge of a token while it is merged, from its outer byte to itself."""
        found = self.spines[side].get(token)
        if found is None:
            text = self.bytes_of[token]
            if len(text) == 1:
                found = [token]
            else:
                parts = merged(text, self.ranks, 2)
                found = [*self._spine(parts[side], side), token]
            self.spines[side][token] = found
        return found

    def _follows(self, last: int, token: int) -> bool:
        """Would the merges of both texts in a row give just these two tokens?

        Merges come in the order of rank. Until one token spans the seam each side merges as it does alone, so only
        the tokens at the seam matter: a pair there merges if that comes before either of its tokens merges away.
        """
        if token not in self.sound:
            self.sound[token] = merged(self.bytes_of[token], self.ranks) == [token]
        if not self.sound[token] or last < 0:
            return self.sound[token]
        key = last << 32 | token
        found = self.fits.get(key)
        if found is not None:
            return found
        left, right = self._spine(last, 1), self._spine(token, 0)
        ranks, bytes_of, never, i, j = self.ranks, self.bytes_of, 1 << 62, 0, 0
        while True:
            across = ranks.get(bytes_of[left[i]] + bytes_of[right[j]], never)
            next_left = left[i + 1] if i + 1 < len(left) else never
            next_right = right[j + 1] if j + 1 < len(right) else never
            if across < next_left and across <= next_right:
                found = False
                break
            if next_left == next_right == never:
                found = True
                break
            if next_left <= next_right:
                i += 1
            else:
                j += 1
        if len(self.fits) >= PAIRS_MOST:
            self.fits.clear()
        self.fits[key] = found
        return found

    def _below(self, node: int) -> tuple[int, ...] | None:
        """Tokens that go on from a node; None if there are many."""
        if node not in self.under:
            found, open_nodes = [], [node]
            while open_nodes and len(found) <= FEW:
                at = open_nodes.pop()
                for byte in self.children.get(at, ()):
                    child = self.nodes[at << 8 | byte]
                    if child in self.token_at:
                        found.append(self.token_at[child])
                    open_nodes.append(child)
            self.under[node] = None if len(found) > FEW else tuple(sorted(found))
        return self.under[node]

    def _beyond(self, last: int, node: int) -> tuple[int, ...] | None:
        """Tokens beyond a node that fit after ``last``; None if many lie there."""
        below = self._below(node)
        if not below:
            return below
        key = last << 32 | node
        found = self.fitting.get(key)
        if found is None:
            if len(self.fitting) >= PAIRS_MOST:
                self.fitting.clear()
            found = self.fitting[key] = tuple(t for t in below if self._follows(last, t))
        return found

    def _step(self, state: State, byte: int) -> tuple[State, int]:
        threads, ended, nodes, token_at = [], None, self.nodes, self.token_at
        for node, follow in state.threads:
            node = nodes.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at.get(node)
            if type(follow) is int:
                if ended is None and token is not None and self._follows(follow, token):
                    ended = token
                beyond = self._beyond(follow, node)
                if beyond is None:
                    threads.append((node, follow))
                elif beyond:
                    threads.append((node, beyond))
            else:
                if token in follow:
                    ended = token
                below = self._below(node)
                beyond = tuple(t for t in follow if t in below)
                if beyond:
                    threads.append((node, beyond))
        threads.append((0, ended))
        step = state[byte] = self._state(tuple(threads)), ended
        self.made += 1
        return step

    def _settled(self, state: State, ends: list[int]) -> int:
        """How much of a piece is settled: where the paths back from all live threads meet."""
        starts = {len(ends) - self.depth[node] for node, _ in state.threads}
        while len(starts) > 1:
            latest = max(starts)
            starts.remove(latest)
            starts.add(latest - self.sizes[ends[latest - 1]])
        return starts.pop()

    def _path(self, ends: list[int], end: int) -> list[int]:
        """The tokens up to ``end``, from the token that ends at each byte."""
        out, sizes = [], self.sizes
        while end:
            token = ends[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.made >= STEPS_MOST:
            self.restart()
        state, ends, out = self.first, [], []
        for byte in piece:
            step = state.get(byte)
            if step is None:
                if self.made >= 2 * STEPS_MOST:  # within one very long piece: keep this state only
                    threads = state.threads
                    self.restart()
                    state = self._state(threads)
                step = self._step(state, byte)
            state, token = step
            ends.append(token)
            if len(ends) >= SETTLE:
                done = self._settled(state, ends)
                out += self._path(ends, done)
                del ends[:done]
        return out + self._path(ends, len(ends))


class Pieces(dict):
    """piece -> (its ids, the ids as text); remembers PIECES_MOST pieces."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.transducer.encode(piece.encode()))
        found = ids, " ".join(map(str, ids))
        if len(piece) <= PIECE_BYTES:
            if len(self) >= PIECES_MOST:
                self.clear()
            self[piece] = found
        return found


class Utf8Stream:
    """Bytes to text as they come: gives out whole characters, and holds back an unfinished one."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # a lead byte or ASCII: how many bytes does it announce?
                needs = 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if needs > back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def kept_pieces(path: str) -> Pieces:
    """The transducer of a rank file, one for each Python worker, which Spark uses for many tasks."""
    kept = sys.modules.setdefault("_kept_transducers", types.ModuleType("_kept_transducers"))
    if path not in vars(kept):
        setattr(kept, path, Pieces(Transducer(read_ranks(path))))
    return getattr(kept, path)


def blocks(text: str) -> Iterator[str]:
    """The text in parts whose pieces are the pieces of the text; bounded unless no place to cut is found."""
    start = 0
    while len(text) - start > BLOCK:
        place = _CUT.search(text, start + BLOCK)
        if place is None:
            break
        yield text[start:place.end()]
        start = place.end()
    yield text[start:] if start else text


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def encode_text(text: str, pattern, pieces: Pieces) -> Iterator[tuple[list, str]]:
    """(ids, ids as text joined by a space) of each block that has any."""
    for block in blocks(text):
        found = [pieces[p] for p in pattern.findall(block)]
        if found:
            yield [f[0] for f in found], " ".join([f[1] for f in found])


def bpe_encode(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per row of ``documents``: doc_id and tokens (array of ids).

    Reads doc_id and text only. A null text is taken as empty and has no tokens. An empty table gives no rows.
    ``path`` names the rank file; every executor needs it, or has it with the tokenizers' package.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, compiled = kept_pieces(path or public_tokenizers.path(RANKS)), regex.compile(pattern)
        for batch in parts_of(batches):
            ids, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                for groups, _ in encode_text(text or "", compiled, pieces):
                    ids.extend(chain.from_iterable(groups))
                ends.append(len(ids))
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "tokens": tokens})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, tokens array<int>")


def bpe_round_trip(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_tokens, digests of the ids and of the decoded bytes.

    The ids of each block are decoded as they come: to bytes, which are hashed, and to text by the stream decoder,
    whose characters are counted in n_chars_decoded. Nulls and empty tables as in :func:`bpe_encode`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, compiled = kept_pieces(path or public_tokenizers.path(RANKS)), regex.compile(pattern)
        token_bytes = pieces.transducer.bytes_of
        for batch in parts_of(batches):
            counts, encoded, decoded, chars = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, letters, ids_hash, bytes_hash, stream, joint = 0, 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream(), ""
                for groups, written in encode_text(text or "", compiled, pieces):
                    ids = list(chain.from_iterable(groups))
                    n += len(ids)
                    ids_hash.update((joint + written).encode())
                    data = b"".join(map(token_bytes.__getitem__, ids))
                    bytes_hash.update(data)
                    letters += len(stream.feed(data))
                    joint = " "
                counts.append(n)
                encoded.append(ids_hash.hexdigest())
                decoded.append(bytes_hash.hexdigest())
                chars.append(letters + len(stream.close()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(encoded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()),
                "n_chars_decoded": pa.array(chars, pa.int64())})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long")
