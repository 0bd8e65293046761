"""Document fingerprints by SimHash.

A text's terms are its words. Each term's hash votes on every bit of the fingerprint with the weight of the term, and
a bit is set where the votes for it prevail. The share of differing bits estimates the angle between the weighted term
vectors of two texts.

Fingerprints within a Hamming radius are found through permuted block tables. The 256 bits are eight blocks of 32, and
table t holds every fingerprint under its block t. Two fingerprints within 23 bits differ in at most two bits of some
block (eight blocks with three each would be 24), so a query looks up, in each table, the 529 keys within two bits of
its own block, and the search is exact. With N random fingerprints a key has N / 2^32 of them: 2 at 10^10, so a query
verifies some 10^4 fingerprints there, besides those that are near. Tables are dealt out by the leading bits of their
keys, which a query reaches by flipping at most two of them; the other keys are found by binary search in its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import small_batches, whole_text
from verdigris.llm.shingles import mixed, word_hashes
from verdigris.session import cut_lineage

BITS = 256
TERM_WORDS = 1
#: Weight of a term: one more for each so many bytes of its words, up to a limit. Long words are rarer.
BYTES_PER_WEIGHT = 6
LARGEST_WEIGHT = 7
#: Of pairs of texts whose five-word shingles have a Jaccard similarity of 0.75 or more, 95 % lie within this radius (half
#: of them within 15 bits); of unrelated texts half differ in 121 bits or more.
RADIUS = 23
BLOCKS = 8
BLOCK_BITS = BITS // BLOCKS
#: Ranges of ids for each task that compares neighbours: several, so that hashing deals them out evenly.
RANGES_PER_TASK = 4
#: Fingerprints that a bucket of a table has on average; one with over four times as many is split.
BUCKET = 1 << 15
#: Lookups, and candidates, that are worked on at a time.
_AT_ONCE = 1 << 20
_CHUNK = 1 << 18
_TERMS = 1 << 13
_LEAST = -(1 << 63)
_BESIDE = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _votes(bits_of: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each text, the sum of the weights of the terms that set each bit."""
    ends = np.append(begins[1:], len(weights))
    votes = np.zeros((len(begins), BITS), np.int64)
    packed, wide = bits_of.view(np.uint8).reshape(len(weights), -1), weights.astype(np.float32)
    for k, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        for at in range(begin, end, _TERMS):  # sums of so few terms are exact in single precision
            stop = min(at + _TERMS, end)
            votes[k] += (wide[at:stop] @ np.unpackbits(packed[at:stop], axis=1).astype(np.float32)).astype(np.int64)
    return votes


def _chunk_fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    words, begins, sizes = word_hashes(data, offsets)
    found = []
    per_text = np.diff(begins)
    terms = np.maximum(per_text - TERM_WORDS + 1, (per_text > 0).astype(per_text.dtype))
    owner = np.repeat(np.arange(len(per_text)), terms)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(terms) - terms, terms) + begins[:-1][owner]
    last = begins[1:][owner]
    hashed, size = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.int64)
    for k in range(TERM_WORDS):  # a text of fewer words is one term
        there = first + k < last
        at = np.minimum(first + k, max(len(words) - 1, 0))
        hashed = np.where(there, mixed(hashed ^ words[at]) if len(words) else hashed, hashed)
        size += np.where(there, sizes[at] if len(words) else 0, 0)
    weights = np.minimum(size // BYTES_PER_WEIGHT + 1, LARGEST_WEIGHT).astype(np.uint8)
    wide = np.stack([mixed(hashed + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(BITS // 64)], axis=1)
    ends = np.cumsum(terms)
    empty = bytes(BITS // 8)
    some = np.flatnonzero(terms)
    if len(some):
        starts = (ends - terms)[some]
        votes = _votes(np.ascontiguousarray(wide), weights, starts)
        total = np.add.reduceat(weights, starts, dtype=np.int64)
        packed = np.packbits(2 * votes > total[:, None], axis=1)
    row = dict(zip(some.tolist(), range(len(some)), strict=True))
    for i in range(len(per_text)):
        found.append(packed[row[i]].tobytes() if i in row else empty)
    return found


def fingerprints_of(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text; that of a text without words has no bit set."""
    found, at = [], 0
    raw = [text.encode() for text in texts]
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= _CHUNK):
            size += len(raw[end])
            end += 1
        offsets = np.cumsum([0, *map(len, raw[at:end])])
        found += _chunk_fingerprints(np.frombuffer(b"".join(raw[at:end]), np.uint8), offsets)
        at = end
    return found


def likeness(one: bytes, two: bytes) -> float:
    """The cosine that the share of differing bits stands for, 0 if negative."""
    if one == two:
        return 1.0
    differing = (int.from_bytes(one, "little") ^ int.from_bytes(two, "little")).bit_count()
    return max(0.0, float(np.cos(np.pi * differing / BITS)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of each row. Null text is empty; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.hex() for x in fingerprints_of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    small = small_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")))
    return small.mapInArrow(run, "doc_id long, fingerprint string")


# Texts beside the next document.


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(ids: DataFrame, ranges: int) -> list[int]:
    """The first id of each range: the smallest of all (null counts as smaller than any), and quantiles.

    These are ``ranges`` numbers, whatever the table's size.
    """
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    key = F.coalesce("doc_id", F.lit(_LEAST))
    got = ids.agg(F.min(key).alias("least"), F.percentile_approx(key, shares, 100 * ranges).alias("cuts")).first()
    return [] if got.least is None else sorted({got.least, *(got.cuts if ranges > 1 else [])})


def beside_next(docs: DataFrame, ranges: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, the SHA-256 of the edited text, both fingerprints, and how like
    the text's is to the edited text's and to the next document's.

    Documents follow each other by doc_id (null first), rows of one id by text; the next of the last is the first, and
    a single row is its own next. Rows are dealt into ``ranges`` ranges of ids and sorted there; the first row of each
    range is also sent to the range before it. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    bounds = _bounds(rows.select("doc_id"), ranges)
    if not bounds:
        return rows.sparkSession.createDataFrame([], _BESIDE)
    key = F.coalesce("doc_id", F.lit(_LEAST))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds))

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        """2 * range, and one more for the id that begins it."""
        at = np.searchsorted(shared.value, keys.to_numpy(), "right") - 1
        return pd.Series(2 * at + (shared.value[at] == keys.to_numpy()))

    home = F.shiftright("place", 1)
    before = F.pmod(F.col("home") - 1, F.lit(len(bounds)))
    own = F.struct(F.lit(False).alias("guest"), F.col("home").alias("at"))
    guest = F.struct(F.lit(True).alias("guest"), before.alias("at"))
    homes = F.when(F.col("place") % 2 == 1, F.array(own, guest)).otherwise(F.array(own))
    dealt = (
        rows.withColumn("place", place(key)).withColumn("home", home).select("doc_id", "text", F.explode(homes).alias("to"))
    )
    placed = dealt.select("doc_id", "text", F.col("to.guest").alias("guest"), F.col("to.at").alias("at"))
    ordered = placed.repartition(max(1, ranges // RANGES_PER_TASK), "at").sortWithinPartitions("at", "guest", "doc_id", "text")
    return small_batches(ordered).mapInArrow(_beside, _BESIDE)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it; of a range's guests only the first counts, as the last row's next."""
    waiting: tuple[int | None, str, int] | None = None
    for batch in batches:
        ids, texts, guests, ranges = (column.to_pylist() for column in batch.columns)
        pairs = []
        for doc_id, text, guest, at in zip(ids, texts, guests, ranges, strict=True):
            if waiting is not None:
                pairs.append((waiting[0], waiting[1], text))
            waiting = None if guest else (doc_id, text, at)
        yield _compared(pairs)
    if waiting is not None:
        raise ValueError("a range has no guest")


def _compared(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    changed = [edited(text, following) for _, text, following in pairs]
    texts = [text for _, text, _ in pairs]
    # The next text is mostly the next row's own; it isn't at the end of a range or batch.
    alone = [k for k, (_, _, after) in enumerate(pairs) if k + 1 == len(pairs) or after is not texts[k + 1]]
    own = fingerprints_of([*texts, *(pairs[k][2] for k in alone)])
    of_next = own[1 : len(texts) + 1]
    for k, found in zip(alone, own[len(texts) :], strict=True):
        of_next[k] = found
    own = own[: len(texts)]
    of_edited = fingerprints_of(changed)
    columns = (
        [doc_id for doc_id, _, _ in pairs],
        [len(text) for text in texts],
        [hashlib.sha256(text.encode()).hexdigest() for text in changed],
        [x.hex() for x in own],
        [x.hex() for x in of_edited],
        [likeness(a, b) for a, b in zip(own, of_edited, strict=True)],
        [likeness(a, b) for a, b in zip(own, of_next, strict=True)],
    )
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in _BESIDE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


# Search.


def flips(radius: int) -> int:
    """Bits in which some block of two fingerprints within ``radius`` differs at most."""
    return radius // BLOCKS


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most ``most`` of them set, those with fewer first."""
    chosen = (sum(1 << k for k in c) for size in range(min(most, bits) + 1) for c in combinations(range(bits), size))
    return np.fromiter(chosen, np.uint64)


def _blocks(fingerprints: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints, given as rows of bytes."""
    return np.ascontiguousarray(fingerprints).view(">u4").astype(np.uint64)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the range, place) of all places in ranges, so many at a time."""
    some = np.flatnonzero(sizes)
    first = 0
    while first < len(some):
        ends = np.cumsum(sizes[some[first:]])
        last = first + max(1, int(np.searchsorted(ends, _AT_ONCE, "right")))
        own = some[first:last]
        number = np.repeat(own, sizes[own])
        yield number, np.arange(len(number)) + np.repeat(starts[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own])
        first = last


def bucket_hits(asked: np.ndarray, there: np.ndarray, table: int, depth: int, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(place in asked, place in there, distance) of the near pairs in a bucket that no earlier table finds.

    Both are rows of blocks; all of ``there`` share the leading ``depth`` bits of block ``table``. Pairs of equal
    fingerprints are left out.
    """
    low_bits = BLOCK_BITS - depth
    low = np.uint64((1 << low_bits) - 1)
    order = np.argsort(there[:, table], kind="stable")
    keys = there[order, table]
    lead, most = keys[0] >> np.uint64(low_bits), flips(radius)
    used = np.bitwise_count((asked[:, table] >> np.uint64(low_bits)) ^ lead).astype(np.int64)
    for spent in range(most + 1):
        probes = masks(low_bits, most - spent)
        queries = np.flatnonzero(used == spent)
        at_once = max(1, _AT_ONCE // len(probes))
        for first in range(0, len(queries), at_once):
            own = queries[first : first + at_once]
            wanted = (lead << np.uint64(low_bits)) | ((asked[own, table] & low)[:, None] ^ probes[None, :])
            begin, end = np.searchsorted(keys, wanted.ravel(), "left"), np.searchsorted(keys, wanted.ravel(), "right")
            for number, place in _spans(begin, end - begin):
                who, found = own[number // len(probes)], order[place]
                differing = np.bitwise_count(asked[who] ^ there[found]).astype(np.int64)
                distance = differing.sum(axis=1)
                fresh = (distance > 0) & (distance <= radius) & ~(differing[:, :table] <= most).any(axis=1)
                yield who[fresh], found[fresh], distance[fresh]


def _dealt(queries: DataFrame, classes: DataFrame, radius: int, tasks: int) -> tuple[DataFrame, int]:
    """Both sides in the buckets where they may meet, those of a bucket together and its classes first; leading bits."""
    count = classes.count()
    depth = max(0, min(24, max(count // BUCKET, tasks // BLOCKS).bit_length()))
    low = BLOCK_BITS - depth
    table = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("table")
    lead = F.conv(F.substring("fingerprint", F.col("table") * (BLOCK_BITS // 4) + 1, F.lit(BLOCK_BITS // 4)), 16, 10)
    prefix = F.shiftrightunsigned(lead.cast("long"), low)
    place = (F.col("table").cast("long") * (1 << depth) + F.col("prefix")).alias("bucket")
    held = classes.select("fingerprint", "name", table).withColumn("prefix", prefix)
    held = held.select(place, F.unhex("fingerprint").alias("bits"), "name")
    sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 4 * BUCKET)
    split = cut_lineage(sizes.select("bucket", F.ceil(F.col("rows") / BUCKET).cast("int").alias("parts")))
    held = held.join(split, "bucket", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("bits"), F.col("parts"))).cast("int")
    )
    flipped = F.array(*(F.lit(int(m)).cast("long") for m in masks(depth, flips(radius))))
    asked = queries.select("fingerprint", table).withColumn("prefix", prefix)
    asked = asked.withColumn("prefix", F.explode(F.transform(flipped, lambda m: m.bitwiseXOR(F.col("prefix")))))
    asked = asked.select(place, F.unhex("fingerprint").alias("bits")).join(split, "bucket", "left")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    sides = held.select("bucket", "part", F.lit(False).alias("asks"), "bits", "name").unionByName(
        asked.select("bucket", "part", F.lit(True).alias("asks"), "bits", F.lit(None).cast(classes.schema["name"].dataType).alias("name"))
    )
    return sides.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part", "asks"), depth


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """(bucket, blocks of its classes, their names, blocks of some of its queries) of sorted rows."""
    at, bits, names, there = None, [], [], None
    for batch in batches:
        spots = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        sides = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((spots[1:] != spots[:-1]).any(axis=1) | (sides[1:] != sides[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sides)], strict=True):
            if a == b:
                continue
            if at != tuple(spots[a]):
                at, bits, names, there = tuple(spots[a]), [], [], None
            own = np.frombuffer(b"".join(batch.column(3).slice(a, b - a).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            if not sides[a]:
                bits.append(own)
                names.append(batch.column(4).slice(a, b - a))
            elif bits:
                if there is None:
                    there = (_blocks(np.concatenate(bits)), pa.concat_arrays(names))
                yield at[0], there[0], there[1], own


def search(queries: DataFrame, classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, name and distance: a row for each fingerprint in ``classes`` within ``radius`` of one in ``queries``.

    Both have distinct values in column fingerprint (documents of equal fingerprints are one class); ``classes`` names
    them in column name. A query's own fingerprint isn't listed. Null fingerprints are nowhere.
    """
    return _found(queries, classes, radius, counted=False)


def _found(queries: DataFrame, classes: DataFrame, radius: int, counted: bool) -> DataFrame:
    """The pairs of ``search``, or a task's and bucket's counts of them with the nearest: query, n, distance, name."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries, classes = queries.where("fingerprint is not null"), classes.where("fingerprint is not null")
    dealt, depth = _dealt(queries, classes, radius, tasks)
    kind = f"query binary, n long, distance int, name {classes.schema['name'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, there, names, own in _buckets(batches):
            asked = _blocks(own)
            for who, found, distance in bucket_hits(asked, there, bucket >> depth, depth, radius):
                times = np.ones(len(who), np.int64)
                if counted and len(who):
                    shown = names.to_numpy(zero_copy_only=False)[found].astype(np.float64)  # nulls last
                    order = np.lexsort((shown, distance, who))
                    who, found, distance = who[order], found[order], distance[order]
                    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                    times = np.diff(np.r_[first, len(who)])
                    who, found, distance = who[first], found[first], distance[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own[i].tobytes() for i in who], pa.binary()),
                        pa.array(times, pa.int64()),
                        pa.array(distance, pa.int32()),
                        names.take(pa.array(found)),
                    ],
                    names=["query", "n", "distance", "name"],
                )

    rows = small_batches(dealt).mapInArrow(run, kind).withColumn("query", F.lower(F.hex("query")))
    return rows if counted else rows.select("query", "name", "distance")


def with_near_counts(found: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """``found`` (with doc_id and fingerprint) and, for documents whose id ``every`` divides (null for the rest):

    - class_id: the smallest doc_id of the documents with their fingerprint, which stands for all of them,
    - n_same: the number of other rows with their fingerprint,
    - n_near: the number of other fingerprints within ``radius`` of theirs, among those of all documents,
    - near_id and near_distance: the nearest of these, as its class_id (of equally near ones the smallest).

    The members of a class are the rows with the fingerprint of the row class_id; ``search`` lists the pairs. A class
    without any doc_id is named null. An empty table gives an empty result.
    """
    kept = cut_lineage(found)
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    classes = cut_lineage(
        kept.groupBy("fingerprint").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("rows"))
    )
    queries = cut_lineage(kept.where(asks).select("fingerprint").distinct())
    by_distance = F.struct("distance", F.col("name").isNull().alias("nameless"), "name")
    near = (
        _found(queries, classes.select("fingerprint", "name"), radius, counted=True)
        .groupBy(F.col("query").alias("fingerprint"))
        .agg(F.sum("n").alias("n_near"), F.min(by_distance).alias("nearest"))
    )
    own = queries.join(classes, "fingerprint").join(near, "fingerprint", "left").select(
        "fingerprint",
        F.col("name").alias("class_id"),
        (F.col("rows") - 1).alias("n_same"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.col("nearest.name").alias("near_id"),
        F.col("nearest.distance").alias("near_distance"),
    )
    none = {name: F.lit(None).cast("long") for name in ("class_id", "n_same", "n_near", "near_id")}
    rest = kept.where(~asks).withColumns(none | {"near_distance": F.lit(None).cast("int")})
    return rest.unionByName(kept.where(asks).join(own, "fingerprint"))
