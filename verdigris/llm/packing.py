"""Packing documents into training sequences by concatenating and cutting.

One pass tokenizes and writes the ids to the shared folder together with each document's place among the tokens of
its partition. The partitions' totals are summed up (first prefix sum: over partitions; second: inside each), which
gives every document its global offset in one long stream. The stream is cut every ``window`` tokens. No token
moves between machines: a window that crosses from one partition into another is held together by its number
(``pieces``), or its parts travel as boundary records (``sequences``).
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import small_batches, whole_text
from verdigris.session import cut_lineage

WINDOW = 2048
#: The id that ends every document.
END_ID = 1
#: How the byte-level tokenizer splits text before merging (fixed by the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKEN_FIELDS = "doc_id long, part int, start_in_part long, doc_tokens long, ids binary"
PIECE_FIELDS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(2)
def load_encoder(vocabulary: str) -> tiktoken.Encoding:
    """An encoder with the ids of a byte-level tokenizer file.

    It gives the ids that the file's own library gives (tests compare them) in a fifth of its time. That needs merges
    listed in the order of their ids, which is checked. Strings of the file's added tokens are those tokens wherever
    they stand, as there.
    """
    with open(vocabulary, encoding="utf-8") as file:
        whole = json.load(file)
    model, added = whole["model"], whole.get("added_tokens", [])
    if any(token[rule] for token in added for rule in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what surrounds them")
    letters = _byte_letters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError("the merges are not in the order of their ids")
    singles = {letter: model["vocab"][letter] for letter in letters}
    if max(singles.values()) >= min(made):
        raise ValueError("single bytes must come before merges")
    words = list(singles.items()) + list(zip((a + b for a, b in pairs), made, strict=True))
    ranks = {bytes(letters[x] for x in word): i for word, i in words}
    special = {token["content"]: token["id"] for token in added}
    ranks = {data: i for data, i in ranks.items() if i not in set(special.values())}
    return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """The ids of each row with ``end_id`` behind them, its partition and its place there. Write before use."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = load_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, counts, ids = [], [], []
            for text in batch.column(1):
                own = encoder.encode(text.as_py(), allowed_special="all")
                own.append(end_id)
                starts.append(done)
                counts.append(len(own))
                ids.append(np.array(own, "<u4").tobytes() if encoder.n_vocab > 1 << 16 else np.array(own, "<u2").tobytes())
                done += len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "part", "start_in_part", "doc_tokens", "ids"],
            )

    small = small_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")))
    return small.mapInArrow(encode, TOKEN_FIELDS)


def part_offsets(tokens: DataFrame) -> dict[int, int]:
    """Where each partition's tokens begin in the stream: one number for each task of the tokenizing pass."""
    totals = {row.part: row.n for row in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}
    begins, sum_so_far = {}, 0
    for part in sorted(totals):
        begins[part] = sum_so_far
        sum_so_far += totals[part]
    return begins


def _ids(value: pa.Scalar, count: int) -> np.ndarray:
    data = value.as_py()
    return np.frombuffer(data, "<u2" if len(data) == 2 * count else "<u4").astype("<u4")


def _cut(begin: int, count: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document whose tokens begin at ``begin`` in the stream."""
    pieces, start = [], 0
    while start < count:
        sequence, offset = divmod(begin + start, window)
        length = min(window - offset, count - start)
        pieces.append((start, length, sequence, offset))
        start += length
    return pieces


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a sequence: where it lies in both, and the CRC-32 of its ids.

    Null text is empty: such a document is its end id alone. A null doc_id stays null; rows that repeat a doc_id
    are documents of their own. An empty table gives no piece. Other columns are not read.
    """
    tokens = cut_lineage(tokenized(docs, vocabulary, end_id))
    begins = part_offsets(tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            parts, starts, counts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = _ids(batch.column(4)[i], counts[i])
                for start, length, sequence, offset in _cut(begins[parts[i]] + starts[i], counts[i], window):
                    crc = zlib.crc32(ids[start : start + length])
                    rows.append((doc_id, start, length, crc, counts[i], sequence, offset))
            names = [field.split()[0] for field in PIECE_FIELDS.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return tokens.mapInArrow(cut, PIECE_FIELDS)


def sequences(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """sequence_id and ids (array of int): the packed sequences themselves, the last one unpadded.

    Windows that lie inside one task's rows are emitted there; the rest leave it as boundary records (at most two
    windows from each run of rows) and are put together by sequence.
    """
    tokens = cut_lineage(tokenized(docs, vocabulary, end_id))
    begins = part_offsets(tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            full = []
            parts, starts, counts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i in range(len(parts)):
                ids = _ids(batch.column(4)[i], counts[i])
                for start, length, sequence, offset in _cut(begins[parts[i]] + starts[i], counts[i], window):
                    open_parts.setdefault(sequence, []).append((offset, ids[start : start + length].copy()))
                    held[sequence] = held.get(sequence, 0) + length
                    if held[sequence] == window:
                        full.append((sequence, True, 0, _joined(open_parts.pop(sequence))))
                        held.pop(sequence)
            yield _records(full)
        yield _records([(s, False, o, x) for s, own in open_parts.items() for o, x in own])

    kinds = "sequence_id long, whole boolean, offset int, ids array<int>"
    records = cut_lineage(tokens.mapInArrow(cut, kinds))
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    met = records.where("not whole").groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
    return records.where("whole").select("sequence_id", "ids").unionByName(met)


def _joined(own: list[tuple[int, np.ndarray]]) -> np.ndarray:
    return np.concatenate([x for _, x in sorted(own, key=lambda piece: piece[0])])


def _records(rows: list[tuple[int, bool, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.bool_()),
            pa.array([r[2] for r in rows], pa.int32()),
            pa.array([r[3].astype("int32") for r in rows], pa.list_(pa.int32())),
        ],
        names=["sequence_id", "whole", "offset", "ids"],
    )
