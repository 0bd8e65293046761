"""Exact deduplication with a split of the heavy hitters.

Texts are equal when they are identical without ASCII white space. Every text is read and hashed once into a
narrow table. Misra-Gries counters find the digests that may hold more than a share ``support`` of all rows (at
most ``1 / support`` candidates, whatever the input); one pass of partial aggregates verifies their counts and
picks their winners, which are broadcast, so their rows never move. All other digests are shuffled as usual, and
none of them holds more than that share.

Nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm.common import whole_text
from verdigris.session import cut_lineage

#: Share of all rows from which a digest counts as heavy; at most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """The text without the characters space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def _winner() -> Column:
    """Orders rows of a group: most code points, then smallest doc_id, rows without doc_id last."""
    return F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and the SHA-256 digest of the normalised text, one row per row of ``docs``."""
    return docs.select(
        F.col("doc_id"),
        F.char_length(whole_text()).cast("long").alias("n_chars"),
        F.sha2(normalised(whole_text()), 256).alias("digest"),
    )


def heavy_hitters(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, winner and group_size of every digest with at least a share ``support`` of the rows.

    ``freqItems`` keeps Misra-Gries counters: it misses no such digest but may name others, so counts are verified.
    """
    named = rows.stat.freqItems(["digest"], support).select(F.explode(F.col("digest_freqItems")).alias("digest"))
    least = rows.agg(F.ceil(F.count(F.lit(1)) * F.lit(support)).alias("least"))
    return (
        rows.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.min(_winner()).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .join(F.broadcast(least), F.col("group_size") >= F.greatest(F.col("least"), F.lit(2)))
        .drop("least")
    )


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Null text counts as empty, and empty texts are one group. A null doc_id loses against every other. Rows that
    repeat both doc_id and text are one document: each of them carries the same ``kept``. An empty table gives an
    empty result. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    rows = cut_lineage(digests(docs))
    heavy = cut_lineage(heavy_hitters(rows, support))  # at most 1 / support rows
    moved = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = moved.withColumns(
        {"winner": F.min(_winner()).over(group), "group_size": F.count(F.lit(1)).over(group)}
    )
    stayed = rows.join(F.broadcast(heavy), "digest")
    return stayed.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        F.col("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner.doc_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("n_chars"),
    )


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row for each distinct text, all columns as they were.

    Rows that repeat a doc_id of the result with an equal text (one document written twice) are dropped too.
    """
    judged = exact_dedup(docs, support)
    keep = cut_lineage(
        judged.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"))
    )
    names = {name: f"_{i}" for i, name in enumerate(docs.columns)}  # no clash with own columns
    given = docs.select(
        *(F.col(f"`{name}`").alias(alias) for name, alias in names.items()),
        F.sha2(normalised(whole_text()), 256).alias("own_sha"),
        F.char_length(whole_text()).alias("own_chars"),
        whole_text().alias("own_text"),
    )
    own = keep.select(F.col("doc_id").alias("own_id"), F.col("text_sha256").alias("keep_sha"), F.col("rows"))
    stays = given.join(
        own, F.col(names["doc_id"]).eqNullSafe(F.col("own_id")) & (F.col("own_sha") == F.col("keep_sha"))
    )
    alike = Window.partitionBy("own_sha", names["doc_id"]).orderBy(F.desc("own_chars"), "own_text")
    once = stays.where("rows = 1").withColumn("place", F.lit(1))
    if keep.where("rows > 1").isEmpty():  # the usual case, which needs no second pass over the texts
        return once.select(*(F.col(alias).alias(name) for name, alias in names.items()))
    twice = stays.where("rows > 1").withColumn("place", F.row_number().over(alike)).where("place = 1")
    return once.unionByName(twice).select(*(F.col(alias).alias(name) for name, alias in names.items()))

