"""What each filter of a chain removes in every order, from one pass over the documents.

A document's failures are a bit mask, so a part of the corpus is at most 2^filters cells, whatever its size. A
Gray-code walk visits every set of active filters by toggling one filter at a time: each cell counts how many of
its failures are active, and the survivors change by the cells whose counter leaves or reaches zero. The 32 states
it stores answer every order and step by differences, so no order is run over documents.

The last filter (an equal text under a smaller doc_id) looks at the whole table. Rows are first reduced to counts by
digest, part, mask and labels, so that a text with any number of copies is a few rows when its digest meets the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.llm.common import whole_text

#: The filters' letters, in the order of their mask bits. The last one compares texts of the table.
FILTERS = "ABCDE"
#: Characters between words.
WHITE = r"[\x20\x09-\x0D]+"

REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D, which need no other document; ``words`` is the array of the text's words."""
    count = F.size(words)
    return [
        count < 200,
        F.size(F.array_distinct(words)) * 100 < count * 50,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 3,
        text.rlike(r"[#$%&*|]"),
    ]


def mask(failures: Sequence[Column]) -> Column:
    """Bit k is set where failure k holds."""
    bits = F.lit(0)
    for k, fails in enumerate(failures):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)))
    return bits


def document_facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the whole text and the mask of the failures that need no other document."""
    texts = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), whole_text().alias("text")
    )
    split = texts.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    return split.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        mask(own_failures(F.col("text"), F.col("words"))).alias("mask"),
    )


def with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``facts`` with good and toxic: whether any label row of the doc_id says quality 1, toxic 1.

    Rows without doc_id have no label; they stay out of the join, where they would all meet in one place.
    """
    known = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(
            F.max(F.col("quality").eqNullSafe(1)).alias("good"),
            F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"),
        )
    )
    named = facts.where("doc_id is not null").join(known, "doc_id", "left")
    nameless = facts.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return named.unionByName(nameless).withColumns(
        {"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    )


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part that fail exactly the filters of ``mask``.

    A row fails the last filter where its text occurs under a smaller doc_id. Rows that repeat both doc_id and text
    don't fail by each other, and a null doc_id is neither smaller nor larger than any.
    """
    alike = ["digest", "part", "mask", "good", "toxic"]
    rows = with_labels(document_facts(docs), labels).groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("n"))
    copies = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first_id"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless"),
    )
    first = F.min("first_id").over(Window.partitionBy("digest"))  # a row for each part and label of a text, not each copy
    unique = F.when(F.col("first_id") == first, F.col("n_first")).otherwise(0) + F.col("n_nameless")
    last = F.lit(1 << (len(FILTERS) - 1))
    split = copies.withColumn("unique", unique).select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct("mask", F.col("unique").alias("n")),
                F.struct(F.col("mask").bitwiseOR(last).alias("mask"), (F.col("n") - F.col("unique")).alias("n")),
            )
        ).alias("cell"),
    )
    return (
        split.where("cell.n > 0")
        .groupBy("part", F.col("cell.mask").alias("mask"))
        .agg(
            F.sum("cell.n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("cell.n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("cell.n")).otherwise(0)).alias("toxic"),
        )
    )


def gray_walk(masks: np.ndarray, weights: np.ndarray, filters: int) -> np.ndarray:
    """What survives each set of active filters: a row for each of the 2^filters sets, with the columns of ``weights``.

    ``masks`` holds each cell's failures, ``weights`` its counts.
    """
    states = np.zeros((1 << filters, weights.shape[1]), dtype=np.int64)
    active_failures = np.zeros(len(masks), dtype=np.int64)
    survivors = weights.sum(axis=0)
    states[0] = survivors
    active = 0
    for step in range(1, 1 << filters):
        toggled = step & -step  # the bit that changes between neighbours in Gray order
        active ^= toggled
        cells = (masks & toggled) > 0
        if active & toggled:
            survivors = survivors - weights[cells & (active_failures == 0)].sum(axis=0)
            active_failures[cells] += 1
        else:
            active_failures[cells] -= 1
            survivors = survivors + weights[cells & (active_failures == 0)].sum(axis=0)
        states[active] = survivors
    return states


def order_steps(states: np.ndarray, names: str = FILTERS) -> Iterator[tuple]:
    """Every order and step from the stored states: the columns of REPORT behind ``part``."""
    filters = len(names)
    full = (1 << filters) - 1
    n = states[:, 0]
    fails = [n[0] - n[1 << k] for k in range(filters)]
    unique = [n[full ^ (1 << k)] - n[full] for k in range(filters)]
    shapley = [
        sum(
            factorial(before.bit_count()) * factorial(filters - 1 - before.bit_count()) * int(n[before] - n[before | 1 << k])
            for before in range(full + 1)
            if not before >> k & 1
        )
        for k in range(filters)
    ]
    for order in permutations(range(filters)):
        name = "".join(names[k] for k in order)
        before = 0
        for step, k in enumerate(order, start=1):
            after = before | 1 << k
            removed, good, toxic = states[before] - states[after]
            yield name, step, n[after], removed, fails[k] - removed, unique[k], good, toxic, shapley[k]
            before = after


def interactions(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """The report of every part in ``cells`` (part, mask, n, good, toxic); a part is at most 2^filters rows."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        states = gray_walk(
            part["mask"].to_numpy(np.int64), part[["n", "good", "toxic"]].to_numpy(np.int64), len(names)
        )
        report = pd.DataFrame(list(order_steps(states, names)), columns=[f.split()[0] for f in REPORT.split(", ")][1:])
        report.insert(0, "part", part["part"].iloc[0])
        return report

    return cells.groupBy("part").applyInPandas(walk, REPORT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the five filters and step, the columns of REPORT.

    Null text is empty: it fails A, and E where an empty text has a smaller doc_id. Null lang and the empty lang are
    one part. Repeated rows count each. A doc_id labelled more than once counts as good or toxic if any of its labels
    says so; labels of unknown documents count nowhere. Texts may be of any length. An empty table of documents has no
    part and gives no row. Only doc_id, text and lang of documents and doc_id, quality and toxic of labels are read.
    """
    return interactions(failure_cells(docs, labels))
