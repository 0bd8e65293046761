"""Join helpers: NULL-safe keys, checked cardinality, differing rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match each other (still a hash or sort-merge join)."""
    renamed = right.select(
        *[F.col(key).alias(f"__{key}") for key in keys],
        *[column for column in right.columns if column not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__{key}" for key in keys])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails at run time if a right key repeats, instead of multiplying rows.

    The right side is grouped by the key it is joined on, so the check adds no shuffle.
    """
    payload = [column for column in right.columns if column not in keys]
    checked = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(column).alias(column) for column in payload]
    )
    message = F.lit(f"right side is not unique on {', '.join(keys)}")
    checked = checked.withColumn(
        "__n", F.when(F.col("__n") > 1, F.raise_error(message).cast("long")).otherwise(F.col("__n"))
    ).filter(F.col("__n") >= 1)
    return left.join(checked.drop("__n"), list(keys), "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join that fails at run time if a key repeats or is missing on either side.

    Both sides are grouped by the key they are joined on, so the checks add no shuffle. NULL keys match each other.
    """

    def single(df: DataFrame, side: str) -> DataFrame:
        payload = [column for column in df.columns if column not in keys]
        grouped = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"__{side}"), *[F.first(column).alias(column) for column in payload]
        )
        return grouped if side == "left" else grouped.withColumnsRenamed({key: f"__{key}" for key in keys})

    condition = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in keys])
    joined = single(left, "left").join(single(right, "right"), condition, "full")

    def stop(text: str) -> Column:
        return F.raise_error(F.lit(f"{text} on {', '.join(keys)}")).cast("boolean")

    fine = (
        F.when((F.col("__left") > 1) | (F.col("__right") > 1), stop("a side is not unique"))
        .when(F.col("__left").isNull() | F.col("__right").isNull(), stop("a side lacks a key"))
        .otherwise(F.lit(True))
    )
    return joined.filter(fine).drop("__left", "__right", *[f"__{key}" for key in keys])


def differing_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Rows whose compared columns differ, NULL counting as a value."""
    pairs = left.alias("l").join(right.alias("r"), list(keys))
    changed = reduce(
        lambda a, b: a | b,
        [~F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}")) for column in columns],
    )
    return pairs.filter(changed).select(
        *keys,
        *[F.col(f"l.{column}").alias(f"left_{column}") for column in columns],
        *[F.col(f"r.{column}").alias(f"right_{column}") for column in columns],
    )
