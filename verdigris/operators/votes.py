"""Review-level votes: one collapsed sentiment per review and grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import (
    collapse_mask,
    distribution_columns,
    rounded,
    sentiment_bit,
    vote_counts,
    vote_mask,
    wilson_bounds,
)
from ..schemas import SENTIMENTS

ASPECT_KEYS = ("aspect_id", "aspect")
PAIR_KEYS = ("aspect_id", "status_id", "aspect", "status")


def review_votes(
    units: DataFrame, keys: Sequence[str] = ASPECT_KEYS, drop_null_keys: bool = False
) -> DataFrame:
    """One row per (product, review, keys) with its vote; a NULL key is a group of its own."""
    if drop_null_keys:
        units = units.dropna(subset=list(keys))
    return (
        units.groupBy("product_id", "review_id", *keys)
        .agg(vote_mask(F.col("sentiment")).alias("mask"))
        .withColumn("vote", collapse_mask(F.col("mask")))
    )


def coarser_votes(votes: DataFrame, keys: Sequence[str] = ASPECT_KEYS) -> DataFrame:
    """Votes of a coarser grain from finer ones: label sets unite, so units are not read again."""
    return (
        votes.groupBy("product_id", "review_id", *keys)
        .agg(F.bit_or("mask").alias("mask"))
        .withColumn("vote", collapse_mask(F.col("mask")))
    )


def both_grains(units: DataFrame) -> DataFrame:
    """Votes on pairs and on aspects, told apart by ``grain``, from one pass over the units."""
    names = ["status_id", "status"]
    pair = F.struct(F.lit("pair").alias("grain"), *names)
    aspect = F.struct(F.lit("aspect").alias("grain"), *[F.lit(None).cast(dict(units.dtypes)[n]).alias(n) for n in names])
    rows = units.select("product_id", "review_id", *ASPECT_KEYS, "sentiment", F.inline(F.array(pair, aspect)))
    return review_votes(rows, ["grain", *PAIR_KEYS])


def attach_votes(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every unit with the vote of its review at the grain."""
    grain = W.partitionBy("product_id", "review_id", *keys)
    mask = F.bit_or(sentiment_bit(F.col("sentiment"))).over(grain)
    return units.withColumn("review_vote_sentiment", collapse_mask(mask))


def count_votes(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vote counts per grain; partial aggregation leaves one row per task and group to shuffle."""
    return votes.groupBy(*keys).agg(*vote_counts(F.col("vote")))


def with_distribution(counted: DataFrame) -> DataFrame:
    return counted.select("*", *distribution_columns())


def sentiment_summary(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Short summary: counts, shares (0.0 when empty) and the positive Wilson interval."""
    counted = count_votes(votes, keys)
    total = F.col("supporting_review_count")
    lower, upper = wilson_bounds(F.col("positive_count"), total)
    shares = [
        F.coalesce(
            rounded(F.col(f"{name}_count") / F.when(total > 0, total)), F.lit(0.0)
        ).alias(f"{name}_share")
        for name in SENTIMENTS
    ]
    return counted.select(
        "*",
        *shares,
        rounded(lower).alias("positive_wilson_lower"),
        rounded(upper).alias("positive_wilson_upper"),
    )


def submission_votes(units: DataFrame, submission_key: str, keys: Sequence[str]) -> DataFrame:
    """Two levels: units to review votes, then review votes to one sentiment per submission."""
    per_review = (
        units.groupBy(submission_key, "review_id", *keys)
        .agg(vote_mask(F.col("sentiment")).alias("mask"))
        .withColumn("vote", collapse_mask(F.col("mask")))
    )
    return per_review.groupBy(submission_key, *keys).agg(
        F.count(F.lit(1)).alias("submitted_review_vote_count"),
        collapse_mask(vote_mask(F.col("vote"))).alias("submitted_sentiment"),
    )
