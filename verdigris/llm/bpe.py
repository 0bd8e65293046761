"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of bytes, exactly one token can be the last one of its encoding. A token ``t`` that ends
at a place is that token if it and the last token of the prefix before it stay apart when their bytes are merged
together. So one pass from left to right stores the last token of each prefix, and walking back from the end reads
off the ids. Prefixes never change when bytes are appended, and behind an edit the table is the old one again as
soon as as many places in a row agree as the longest token has bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import small_batches, whole_text

#: Pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Judgements on pairs of tokens that a worker remembers before it starts anew.
REMEMBERED_PAIRS = 3_000_000
#: Pieces longer than this are not remembered.
LONGEST_REMEMBERED = 64


class Vocabulary:
    """Tokens by rank, and which two of them may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: data for data, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._judged = 0
        #: Tokens that their own bytes never merge into; they stand only where they are a whole piece.
        self.unreachable: set[int] = set()
        for rank in sorted(self.token):
            self.halves(rank)
        #: By token: those that may stand before it (-1: the start of the piece), and those that may not.
        self.good = {rank: {-1} for rank in self.token}
        self.bad: dict[int, set[int]] = {rank: set() for rank in self.token}
        #: Finds all tokens that end at each byte, the longest first.
        self.finder = ahocorasick.Automaton()
        for data, rank in ranks.items():
            if rank not in self.unreachable:
                self.finder.add_word(data.decode("latin-1"), (rank, len(data) - 1, self.good[rank], self.bad[rank]))
        self.finder.make_automaton()

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if rank not in self._halves:
            self._halves[rank] = None
            data = self.token[rank]
            if len(data) > 1:
                parts = self.merged(data, below=rank)
                if len(parts) == 2:
                    self._halves[rank] = (parts[0], parts[1])
                else:
                    self.unreachable.add(rank)
        return self._halves[rank]

    def merged(self, data: bytes, below: float = float("inf")) -> list[int]:
        """Merge by rank, the lowest and then the leftmost first, with ranks under ``below`` only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[part] for part in parts]

    def _edge(self, rank: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge while this one is being merged, each with the rank that ends its time there."""
        known = self._right if side else self._left
        if rank not in known:
            edge, until, at = [], float("inf"), rank
            while True:
                edge.append((at, until))
                halves = self._halves[at]
                if halves is None:
                    break
                until, at = at, halves[side]
            known[rank] = edge
        return known[rank]

    def apart(self, one: int, two: int) -> bool:
        """Whether the two stay two when the bytes of both are merged together."""
        if one in self.good[two] or one in self.bad[two]:
            return one in self.good[two]
        if self._judged >= REMEMBERED_PAIRS:
            self._judged = 0
            for own in (*self.good.values(), *self.bad.values()):
                own.intersection_update((-1,))
        self._judged += 1
        stays = self._stay_apart(one, two)
        (self.good if stays else self.bad)[two].add(one)
        return stays

    def _stay_apart(self, one: int, two: int) -> bool:
        token, ranks = self.token, self.ranks
        for a, a_until in self._edge(one, 1):
            for b, b_until in self._edge(two, 0):
                across = ranks.get(token[a] + token[b])
                # Of equal ranks the leftmost merge goes first: the one inside ``one`` before it, that inside ``two`` after.
                if across is not None and across < a_until and across <= b_until:
                    made_a, made_b = a if len(token[a]) > 1 else -1, b if len(token[b]) > 1 else -1
                    if across > made_a and across > made_b:
                        return False
        return True

    def extend(self, data: bytes, last: list[int]) -> None:
        """Store the last token of every prefix of ``data`` that ``last`` (at 0: of the empty one) lacks."""
        near = max(0, len(last) - self.longest)
        done = len(last) - near  # prefixes known, counted from ``near``
        known, add = last[near:], last.append
        for at, (rank, back, good, bad) in self.finder.iter(data[near:].decode("latin-1")):
            if at + 1 < done:
                continue  # a shorter token than the one found, or a prefix known before
            before = known[at - back]
            if before in good or before not in bad and self.apart(before, rank):
                known.append(rank)
                add(rank)
                done += 1

    def read_back(self, data: bytes, last: list[int]) -> list[int]:
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= len(self.token[last[at]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(piece, last)
        return self.read_back(piece, last)

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


class Prefixes:
    """The bytes of one piece with the last token of each prefix, kept up to date under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.redone = vocabulary, b"", [-1], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.redone = len(more)
        self.vocabulary.extend(self.data, self.last)

    def splice(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` in place of the bytes from ``start`` to ``stop``; ``redone`` counts the prefixes computed anew."""
        old, moved = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        last, end, alike = old[: start + 1], start + len(new), 0
        while len(last) <= len(self.data):
            at = len(last)
            self.vocabulary.extend(self.data[:at], last)
            # Bytes before the edit must be out of reach of any token, and so must prefixes that differ.
            alike = alike + 1 if at > end and last[at] == old[at - moved] else 0
            if alike >= self.vocabulary.longest:
                break
        self.redone = len(last) - start - 1
        self.last = last + old[len(last) - moved :]

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return [whole] if whole is not None else self.vocabulary.read_back(self.data, self.last)


@functools.lru_cache(2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)})


@functools.lru_cache(2)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class _Known(dict):
    """Packed ids by piece, computed where missing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.vocabulary.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers) of every text; null text is empty.

    Every match of ``pattern`` is encoded by itself. Rows that repeat are encoded each; a null doc_id stays null;
    an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = _Known(load_vocabulary(path)), splitter(pattern).findall
        for batch in batches:
            ids = [b"".join(map(known.__getitem__, find(text.as_py()))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    small = small_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")))
    return small.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded bytes in column data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        for batch in batches:
            ids = batch.column(2)
            data = [vocabulary.decode(np.frombuffer(x.as_py(), "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(data, pa.binary())], names=["doc_id", "n_tokens", "ids", "data"]
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes that they decode to."""
    both = decode(encode(docs, path, pattern), path)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
