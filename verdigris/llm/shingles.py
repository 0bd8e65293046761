"""Sets of five-word shingles as sorted 64-bit hashes, for a whole batch of texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text that are hashed at a time (a longer text is hashed by itself).
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, count: int, name: str) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < count:
        factors = np.full(max(count, CHUNK + 1), base, np.uint64)
        factors[0] = 1
        known = _powers[name] = np.multiply.accumulate(factors)
    return known[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, where each text's words begin (one more entry at the end), and their bytes."""
    begin = offsets[0]
    data = _LOWER[data[begin : offsets[-1]]]
    offsets = offsets - begin
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, size, "up"), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _power(_INVERSE, size, "down")[starts])
    return hashes, np.searchsorted(starts, offsets), ends - starts


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words, begins, _ = word_hashes(data, offsets)
    count = len(words)
    wide = np.zeros(count, np.uint64)
    for k in range(min(WORDS, count)):
        wide[: count - k] += words[k:] * _PLACE[k]
    wide = mixed(wide)
    found = []
    for first, last in zip(begins[:-1], begins[1:], strict=True):
        own = last - first
        if own >= WORDS:
            shingles = np.sort(wide[first : last - WORDS + 1])
            fresh = np.ones(len(shingles), bool)
            np.not_equal(shingles[1:], shingles[:-1], out=fresh[1:])
            found.append(shingles[fresh])
        elif own:
            short = (words[first:last] * _PLACE[:own]).sum(dtype=np.uint64) + np.uint64(own)
            found.append(mixed(np.array([short])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: empty)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    for first, last in _chunks(offsets):
        yield from _sets(data, offsets[first : last + 1])


def set_key(shingles: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty set."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
