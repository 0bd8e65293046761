"""Blocked pairing: compare every left row with every right row of its boundary, block by block.

A boundary is cut into row blocks on both sides and each pair of blocks meets in one task group.
No pair is materialised: the kernel returns only what survives (a top-k, pairs under a threshold,
partial sums), so a boundary holding a third of all rows is spread over many groups and nothing is
lost. Memory per group is bounded by the two block sizes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


#: Rows of the largest block, and into how many blocks a boundary is cut before its blocks grow beyond their usual rows.
LARGEST_BLOCK, MOST_BLOCKS = 16384, 12


def _block_counts(df: DataFrame, rows: int, grow: bool, name: str) -> DataFrame:
    count = F.count(F.lit(1))
    blocks = F.ceil(count / F.lit(float(rows)))
    if grow:
        blocks = F.least(blocks, F.greatest(F.lit(MOST_BLOCKS), F.ceil(count / F.lit(float(LARGEST_BLOCK)))))
    blocks = blocks.cast("int")
    return df.groupBy("__boundary").agg(blocks.alias(name))


def _assign(df: DataFrame, key: Column, own: str, own_count: str, other: str, other_count: str):
    return (
        df.withColumn(own, F.pmod(F.xxhash64(key), F.col(own_count)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
        .drop(own_count, other_count)
    )


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    schema: str,
    *,
    left_key: Column,
    right_key: Column,
    left_boundary: Column | None = None,
    right_boundary: Column | None = None,
    left_rows: int = 2048,
    right_rows: int = 2048,
    grow: bool = False,
) -> DataFrame:
    """Apply ``kernel`` to each (left block, right block) of every boundary both sides have.

    Rows with equal ``right_key`` (or ``left_key``) stay in one block, so a kernel may rely on
    seeing such a group whole; give the rows of an oversized group different keys.

    A row is copied once for each block of the other side. With ``grow`` a boundary of many rows gets larger blocks
    instead of more, so that the copies grow with the rows and not with their square; the kernel then has to go through
    its left rows in ``slices``.
    """
    whole = F.lit(0)
    left = left.withColumn("__boundary", whole if left_boundary is None else left_boundary)
    right = right.withColumn("__boundary", whole if right_boundary is None else right_boundary)
    counts = _block_counts(left, left_rows, grow, "__nl").join(
        _block_counts(right, right_rows, grow, "__nr"), "__boundary"
    )
    if left_boundary is None and right_boundary is None:
        counts = F.broadcast(counts)  # exactly one row
    lhs = _assign(left.join(counts, "__boundary"), left_key, "__lb", "__nl", "__rb", "__nr")
    rhs = _assign(right.join(counts, "__boundary"), right_key, "__rb", "__nr", "__lb", "__nl")
    rhs = rhs.select(*[F.col(name).alias(name) for name in rhs.columns])  # allow left = right
    keys = ["__boundary", "__lb", "__rb"]
    # A fixed partition count keeps adaptive execution from merging compute-heavy blocks that are
    # small in bytes into one task.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lhs, rhs = lhs.repartition(tasks, *keys), rhs.repartition(tasks, *keys)

    def meet(left_part: pd.DataFrame, right_part: pd.DataFrame) -> pd.DataFrame:
        if left_part.empty or right_part.empty:
            return pd.DataFrame(columns=output_columns)
        return kernel(left_part, right_part)[output_columns]

    output_columns = [field.split()[0] for field in schema.split(",")]
    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInPandas(meet, schema)


def slices(left: int, right: int, rows: int):
    """Slices of ``left`` rows that meet ``right`` rows in about as many pairs as two blocks of ``rows``."""
    step = max(1, rows * rows // max(1, right))
    return [slice(start, start + step) for start in range(0, left, step)]
