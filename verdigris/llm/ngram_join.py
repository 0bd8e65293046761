"""Jaccard join of documents on five-word shingles, by vertical partitioning.

The order of all shingles (by hash) is cut into fragments. A document's set is cut along, and what documents have in
common is counted in each fragment separately and summed up: first per document (how many of its shingles occur in
another set at all; one with less than the threshold links with nothing), then per pair of candidates.

Candidates share a shingle among the rarest of both sets: of two sets that reach the threshold ``t``, the first
``n - ceil(t n) + 1`` shingles in any common order meet. To find the components, not every pair of a group of
copies is compared: in each round every set is compared with one other set, a hub of the shingles it has in common
with others of another component. When such pairs mostly don't link any more, all pairs of different components that
share a rare shingle, and may reach the threshold by what follows it, are compared. So no link that joins components is missed, and pairs do not grow with the square of a
group of copies.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import small_batches, whole_text
from verdigris.llm.graph import merge_components
from verdigris.llm.shingles import set_key, shingle_sets
from verdigris.session import cut_lineage

#: Per cent of the union that two sets must have in common.
THRESHOLD = 75
#: Shingles in a fragment of the first count, on average.
PER_FRAGMENT = 4_000_000
#: Shingles that a task gathers before it sends them to the fragments.
PER_FLUSH = 3_000_000
#: A fragment of the second count is one of 2 ** PART_BITS equal ranges of hashes.
PART_BITS = 3
#: Size of the filter that spares most other texts a second shuffle; it grows no further, an exact join follows.
FILTER_BITS = 1 << 26
#: Share of the pairs with hubs that must link for another turn with hubs.
MOSTLY = 0.5
_MANY = 0xFFFF  # owner of a shingle that several sets of one flush have


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")))


def shingle_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and set_key (null without shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for own in shingle_sets(batch.column(1)):
                sizes.append(len(own))
                keys.append(set_key(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
                names=["doc_id", "n_shingles", "set_key"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key long")


# First count: shingles that a set shares with any other.


def _flush(sets: dict[int, np.ndarray], fragments: int) -> pa.RecordBatch:
    """Rows for the fragments: the distinct shingles of these sets, each with its owner, and one row of the owners."""
    keys = np.fromiter(sets, np.int64, len(sets))
    sizes = np.array([len(x) for x in sets.values()], np.int64)
    hashes = np.concatenate(list(sets.values()))
    owners = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    runs = np.diff(np.append(first, len(hashes)))
    local = np.bincount(owners[np.repeat(runs > 1, runs)], minlength=len(sets))
    hashes, owners = hashes[first], np.where(runs > 1, np.uint16(_MANY), owners[first])
    name = int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)
    home = (hashes % np.uint64(fragments)).astype(np.int64)
    short = (hashes // np.uint64(fragments)).astype(np.uint32)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(fragments + 1))
    rows = [(name, name % fragments, True, keys.tobytes(), np.stack([sizes, local]).tobytes())]
    for f in range(fragments):
        own = order[cuts[f] : cuts[f + 1]]
        if len(own):
            rows.append((name, f, False, short[own].tobytes(), owners[own].tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["flush", "fragment", "table", "keys", "owners"])


def _in_fragments(docs: DataFrame, fragments: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for own in shingle_sets(batch.column(1)):
                key = set_key(own)
                if key is None or key in sets:
                    continue  # copies within a flush are sent once
                sets[key] = own
                held += len(own)
                if held >= PER_FLUSH or len(sets) >= _MANY:
                    yield _flush(sets, fragments)
                    sets, held = {}, 0
        if sets:
            yield _flush(sets, fragments)

    return _texts(docs).mapInArrow(run, "flush long, fragment long, table boolean, keys binary, owners binary")


def _count_shared(group: pa.Table) -> pa.Table:
    """Of a fragment's shingles, the owners of those that came more than once, by flush."""
    tables = group.filter(group["table"])
    rows = group.filter(pa.compute.invert(group["table"]))
    keys = [np.frombuffer(x.as_py(), np.uint32) for x in rows["keys"]]
    sent = [np.frombuffer(x.as_py(), np.uint16) for x in rows["owners"]]
    flushes, shared_by = rows["flush"].to_pylist(), []
    if keys:
        every = np.concatenate(keys)
        owners = np.concatenate(sent)
        order = np.argsort(every)
        first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        runs = np.diff(np.append(first, len(every)))
        many = np.logical_or.reduceat(owners[order] == _MANY, first) | (runs > 1)
        shared = np.zeros(len(every), bool)
        shared[order] = np.repeat(many, runs)
        shared &= owners != _MANY  # counted in their flush
        ends = np.cumsum([len(x) for x in keys])
        for begin, end in zip(ends - [len(x) for x in keys], ends, strict=True):
            shared_by.append(owners[begin:end][shared[begin:end]].tobytes())
    return pa.table(
        {
            "flush": pa.array(tables["flush"].to_pylist() + flushes, pa.int64()),
            "table": pa.array([True] * len(tables) + [False] * len(flushes), pa.bool_()),
            "keys": pa.array(tables["keys"].to_pylist() + shared_by, pa.binary()),
            "owners": pa.array(tables["owners"].to_pylist() + [None] * len(flushes), pa.binary()),
        }
    )


def _sum_shared(group: pa.Table) -> pa.Table:
    """Sum a flush's counts over the fragments; the sets with enough shared shingles to link with anything."""
    head = group.filter(group["table"]).slice(0, 1)
    keys = np.frombuffer(head["keys"][0].as_py(), np.int64)
    sizes, shared = np.frombuffer(head["owners"][0].as_py(), np.int64).reshape(2, -1).copy()
    for part in group.filter(pa.compute.invert(group["table"]))["keys"]:
        shared += np.bincount(np.frombuffer(part.as_py(), np.uint16), minlength=len(keys))
    return pa.table({"set_key": keys[shared * 100 >= sizes * THRESHOLD]})


def sets_that_may_link(docs: DataFrame, fragments: int) -> DataFrame:
    """set_key of every set that has enough shingles in common with others, and perhaps of some copied ones."""
    sent = _in_fragments(docs, fragments)
    counted = sent.groupBy("fragment").applyInArrow(
        _count_shared, "flush long, table boolean, keys binary, owners binary"
    )
    return counted.groupBy("flush").applyInArrow(_sum_shared, "set_key long").distinct()


# The shingles of the sets that may link, in parts.


def _filter_places(keys: np.ndarray) -> np.ndarray:
    """Four bits of the filter for each key."""
    wide = keys.view(np.uint64)
    return np.stack([(wide >> np.uint64(12 * k)) * np.uint64(2 * k + 1) % np.uint64(FILTER_BITS) for k in range(4)])


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the keys, made in the tasks and combined by stretches."""
    stretch = FILTER_BITS // 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(_filter_places(np.array(batch.column(0), np.int64)).ravel()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places)], names=["place"])

    def combine(group: pa.Table) -> pa.Table:
        places = np.array(group["place"], np.int64)
        bits = np.zeros(stretch, np.uint8)
        bits[places % stretch] = 1
        return pa.table({"at": [int(places[0]) // stretch], "bits": [np.packbits(bits).tobytes()]})

    marked = keys.mapInArrow(mark, "place long").distinct().withColumn("at", F.floor(F.col("place") / stretch))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in marked.groupBy("at").applyInArrow(combine, "at long, bits binary").collect():
        own = np.frombuffer(row.bits, np.uint8)
        bits[row.at * len(own) : (row.at + 1) * len(own)] = own
    return bits


def set_parts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """set_key, n, part and shingles (array of long) of each set in ``keys``, one row for each part with shingles."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = bits.value, set()
        pivots = np.arange(1, 1 << PART_BITS, dtype=np.uint64) << np.uint64(64 - PART_BITS)
        for batch in batches:
            rows = []
            for own in shingle_sets(batch.column(1)):
                key = set_key(own)
                if key is None or key in seen:
                    continue
                places = _filter_places(np.array([key], np.int64)).ravel()
                if not np.all(flags[places >> np.uint64(3)] >> (7 - (places & np.uint64(7)).astype(np.uint8)) & 1):
                    continue
                if len(seen) < 100_000:
                    seen.add(key)
                for part, shingles in enumerate(np.split(own, np.searchsorted(own, pivots))):
                    if len(shingles):
                        rows.append((key, len(own), part, shingles.view(np.int64)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.list_(pa.int64())),
                    ],
                    names=["set_key", "n", "part", "shingles"],
                )

    rows = _texts(docs).mapInArrow(run, "set_key long, n long, part int, shingles array<long>")
    once = rows.groupBy("set_key", "n", "part").agg(F.first("shingles").alias("shingles"))
    return once.join(keys, "set_key", "left_semi")


def rare_shingles(parts: DataFrame) -> DataFrame:
    """shingle, node, n, after, typical: the shingles of each set that two linked sets cannot both lack.

    They are its first ones in the order of how many sets have them; those that no other set has come before all and
    are left out. ``after`` counts the set's shingles from this one on; ``typical`` is how many sets have one of the
    set's shingles, on average.
    """
    each = parts.select("set_key", "n", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    held = each.join(common, "shingle").groupBy("set_key", "n").agg(
        F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("held"), F.sum("sets").alias("typical")
    )
    least = F.ceil(F.col("n") * THRESHOLD / 100)
    length = (F.size("held") - least + 1).cast("int")
    return (
        held.where(length > 0)
        .select("set_key", "n", "typical", F.size("held").alias("many"), F.posexplode(F.slice("held", F.lit(1), length)).alias("at", "own"))
        .select(
            F.col("own.shingle").alias("shingle"),
            F.col("set_key").alias("node"),
            "n",
            (F.col("many") - F.col("at")).alias("after"),
            (F.col("typical") / F.col("n")).alias("typical"),
        )
    )


# Second count: what the candidates of a pair have in common.


def _may_reach(n: Column, after: Column, m: Column, after_too: Column) -> Column:
    """Whether two sets that first meet in this shingle may have enough in common.

    Sets of n and m shingles link from an overlap of (n + m) t / (1 + t) on, and it cannot exceed what either has from
    the first common shingle on. That one passes this test whenever the sets link, so no link is missed.
    """
    return F.least(after, after_too) * (100 + THRESHOLD) >= (n + m) * THRESHOLD


def linked(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) that link: the overlap is counted in each part and summed."""
    one = parts.select(F.col("set_key").alias("a"), "part", F.col("shingles").alias("of_a"))
    two = parts.select(F.col("set_key").alias("b"), "part", F.col("shingles").alias("of_b"))
    common = pairs.join(one, "a").join(two, ["b", "part"])
    overlap = common.groupBy("a", "b", "na", "nb").agg(
        F.sum(F.size(F.array_intersect("of_a", "of_b"))).alias("both")
    )
    return overlap.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * THRESHOLD)


def _hub_pairs(rare: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Each set with one hub: of the hubs of its rare shingles in other components, the one it meets most often.

    A shingle has a hub for each class of sizes: first the most typical of its sets, which is near the middle of a
    group of edited copies, and any in later turns.
    """
    own = rare.join(labels, "node").withColumn("size", F.floor(F.log("n") * 6))
    place = F.xxhash64("node", F.lit(turn)) if turn else -F.col("typical")
    hub = F.struct(
        place.alias("place"),
        F.col("node").alias("hub"),
        F.col("n").alias("nb"),
        F.col("after").alias("hub_after"),
        F.col("component").alias("of"),
    )
    hubs = own.groupBy("shingle", "size").agg(
        F.min(hub).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    meets = (
        own.join(hubs.where("low <> high"), ["shingle", "size"])
        .where(
            (F.col("component") != F.col("hub.of"))
            & _may_reach(F.col("n"), F.col("after"), F.col("hub.nb"), F.col("hub.hub_after"))
        )
        .groupBy("node", "n", "hub.hub", "hub.nb")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    best = F.max(F.struct("times", "hub", "nb")).alias("best")
    return meets.groupBy("node", "n").agg(best).select(
        F.col("node").alias("a"), F.col("best.hub").alias("b"), F.col("n").alias("na"), F.col("best.nb").alias("nb")
    )


def _sides(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """Rare shingles whose sets lie in several components, with the largest of these and the sets outside it."""
    counts = rare.join(labels, "node").groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("own"))
    return (
        counts.groupBy("shingle")
        .agg(F.sum("own").alias("all"), F.max(F.struct("own", "component")).alias("most"))
        .where(F.col("all") > F.col("most.own"))
        .select("shingle", F.col("most.component").alias("main"), (F.col("all") - F.col("most.own")).alias("out"), "all")
    )


def _pairs_apart(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs of sets of different components that meet in a rare shingle and may reach the threshold there."""
    sides = _sides(rare, labels)
    own = rare.join(labels, "node").join(sides.select("shingle", "main"), "shingle")
    right = own.select(
        "shingle",
        F.col("node").alias("b"),
        F.col("n").alias("nb"),
        F.col("after").alias("after_b"),
        F.col("component").alias("cb"),
    )
    left = own.where(F.col("component") != F.col("main"))
    met = left.join(right, "shingle").where(
        (F.col("component") != F.col("cb"))
        & ((F.col("cb") == F.col("main")) | (F.col("node") < F.col("b")))
        & _may_reach(F.col("n"), F.col("after"), F.col("nb"), F.col("after_b"))
    )
    low, high = F.col("node") < F.col("b"), F.col("node") >= F.col("b")
    return met.select(
        F.least("node", "b").alias("a"),
        F.greatest("node", "b").alias("b"),
        F.when(low, F.col("n")).otherwise(F.col("nb")).alias("na"),
        F.when(high, F.col("n")).otherwise(F.col("nb")).alias("nb"),
    ).distinct()


def components_of(rare: DataFrame, parts: DataFrame) -> DataFrame:
    """node and component (a set_key) of every set that has rare shingles.

    Turns with hubs go on while most of the pairs that they try link; pairs of what then lies apart mostly don't, and
    all of them are tried.
    """
    labels = cut_lineage(rare.select("node", F.col("node").alias("component")).distinct())
    for turn in itertools.count():
        hubs = cut_lineage(_hub_pairs(rare, labels, turn))
        links = cut_lineage(linked(hubs, parts).select("a", "b"))
        tried, found = hubs.count(), links.count()
        if found:
            labels = merge_components(labels, links)
        if found < MOSTLY * tried or not found:
            break
    pairs = cut_lineage(_pairs_apart(rare, labels))
    return merge_components(labels, cut_lineage(linked(pairs, parts).select("a", "b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row of ``docs``.

    Documents without words (or with null text) are alone. Equal sets link. A null doc_id never names a component
    that has another id; rows that repeat are linked as equal sets. An empty table gives an empty result. Only
    ``doc_id`` and ``text`` are read. Shingles are compared by 64-bit hashes.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id")


def _judged(docs: DataFrame) -> DataFrame:
    """What ``near_duplicates`` returns, and of each row its set_key and ``keep_key``, the set that stands for its
    component: that of the smallest doc_id (null last), then the smallest key. Both are null without shingles."""
    counts = cut_lineage(shingle_counts(docs))
    total = counts.agg(F.sum("n_shingles")).first()[0] or 0
    classes = cut_lineage(
        counts.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    )
    keys = cut_lineage(sets_that_may_link(docs, max(1, -(-total // PER_FRAGMENT))))
    parts = cut_lineage(set_parts(docs, keys))
    rare = cut_lineage(rare_shingles(parts))
    labels = components_of(rare, parts).withColumnRenamed("node", "set_key")
    of_class = classes.join(labels, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    first = F.struct(F.col("class_id").isNull(), F.col("class_id"), F.col("set_key"))
    names = of_class.groupBy("component").agg(
        F.min("class_id").alias("component_id"), F.min_by("set_key", first).alias("keep_key")
    )
    named = of_class.join(names, "component").select("set_key", "component_id", "keep_key")
    return counts.join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "set_key",
        "keep_key",
    )


def similar_pairs(docs: DataFrame) -> DataFrame:
    """set_key and doc_id of each document with shingles are in ``shingle_counts``; this gives all linked pairs of
    different sets: a, b (set keys), na, nb and both (their overlap). Its rows grow with the links, group by group."""
    counts = cut_lineage(shingle_counts(docs))
    total = counts.agg(F.sum("n_shingles")).first()[0] or 0
    keys = cut_lineage(sets_that_may_link(docs, max(1, -(-total // PER_FRAGMENT))))
    parts = cut_lineage(set_parts(docs, keys))
    rare = cut_lineage(rare_shingles(parts))
    left = rare.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("after").alias("after_a"))
    right = rare.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("after").alias("after_b"))
    reach = _may_reach(F.col("na"), F.col("after_a"), F.col("nb"), F.col("after_b"))
    pairs = (
        left.join(right, "shingle").where((F.col("a") < F.col("b")) & reach).select("a", "b", "na", "nb").distinct()
    )
    return linked(pairs, parts)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns as they were.

    It is one of the smallest doc_id (null last); of several such rows, one of the smallest set, and of these the first
    by text. Rows without words are alone, so all stay. An id that stands for several texts is decided for each of them.
    """

    @F.pandas_udf("long")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(own) for own in shingle_sets(pa.array(texts, pa.string()))], dtype="Int64")

    judged = cut_lineage(_judged(docs))
    gone = cut_lineage(judged.where("doc_id <> component_id").select("doc_id").distinct())
    names = [f"`{name}`" for name in docs.columns]
    several = cut_lineage(
        judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null").select("doc_id")
    )
    if several.isEmpty():  # the usual case: the id says which text it is
        return docs.join(gone, "doc_id", "left_anti").select(*names)
    same_id = docs["doc_id"].eqNullSafe(several["doc_id"])
    once = docs.join(several, same_id, "left_anti").join(gone, "doc_id", "left_anti").select(*names)
    row = F.struct(*(F.col(name).alias(f"_{i}") for i, name in enumerate(names)))
    odd = docs.join(several, same_id, "left_semi").select(
        row.alias("row"), F.col("doc_id").alias("id"), whole_text().alias("own_text")
    )
    odd = cut_lineage(small_batches(odd).withColumn("key", keys("own_text")))
    keep = (
        judged.where("set_key = keep_key and doc_id <=> component_id").select(F.col("doc_id").alias("keep_id"), "keep_key").distinct()
    )
    stays = odd.join(keep, odd["id"].eqNullSafe(keep["keep_id"]) & (odd["key"] == keep["keep_key"]))
    one = stays.groupBy("id", "key").agg(F.min_by("row", "own_text").alias("row")).select("row")
    kept = one.unionByName(odd.where("key is null").select("row"))
    return once.unionByName(kept.select(*(F.col(f"row._{i}").alias(name) for i, name in enumerate(docs.columns))))
