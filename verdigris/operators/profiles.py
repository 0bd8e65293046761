"""Product profiles in long form: one row per product and aspect (or aspect-status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentiment import rounded
from ..schemas import KNOWN_SENTIMENTS, MINIMUM_WEAKNESS_SUPPORT, PRIOR_STRENGTH
from .votes import with_distribution


def net_sentiment(aspect_votes: DataFrame) -> DataFrame:
    """Mean of +1 / -1 / 0 votes per product and aspect."""
    value = F.when(F.col("vote") == "positive", 1.0).when(F.col("vote") == "negative", -1.0)
    return aspect_votes.groupBy("product_id", "aspect_id").agg(
        rounded(F.avg(value.otherwise(0.0))).alias("net_sentiment")
    )


def net_profile_similarity(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """0.7 * (1 - L1 / 2n) + 0.3 * Jaccard for the given (left_id, right_id) pairs.

    Joins follow the pair list, so the work is pairs times aspects rather than all product pairs.
    """
    sizes = profiles.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    left = profiles.select(
        F.col("product_id").alias("left_id"), "aspect_id", F.col("net_sentiment").alias("l")
    )
    right = profiles.select(
        F.col("product_id").alias("right_id"), "aspect_id", F.col("net_sentiment").alias("r")
    )
    shared = (
        pairs.join(left, "left_id")
        .join(right, ["right_id", "aspect_id"])
        .groupBy("left_id", "right_id")
        .agg(F.count(F.lit(1)).alias("common"), F.sum(F.abs(F.col("l") - F.col("r"))).alias("l1"))
    )
    joined = (
        pairs.join(shared, ["left_id", "right_id"], "left")
        .join(sizes.select(F.col("product_id").alias("left_id"), F.col("n").alias("nl")), "left_id", "left")
        .join(sizes.select(F.col("product_id").alias("right_id"), F.col("n").alias("nr")), "right_id", "left")
    )
    common = F.col("common")
    union = F.col("nl") + F.col("nr") - common
    score = F.lit(0.7) * (F.lit(1.0) - F.col("l1") / (F.lit(2.0) * common)) + F.lit(0.3) * (
        common / union
    )
    return joined.select(
        "left_id",
        "right_id",
        F.coalesce(common, F.lit(0).cast("long")).alias("common_aspect_count"),
        F.coalesce(rounded(score), F.lit(0.0)).alias("profile_similarity"),
    )


def category_prior(aspect_counts: DataFrame) -> DataFrame:
    """Share of each known sentiment among all known votes of an aspect; uniform when none."""
    totals = aspect_counts.groupBy("aspect_id").agg(
        *[F.sum(f"{name}_count").alias(f"{name}_total") for name in KNOWN_SENTIMENTS]
    )
    known = sum((F.col(f"{name}_total") for name in KNOWN_SENTIMENTS), F.lit(0))
    uniform = F.lit(1.0 / len(KNOWN_SENTIMENTS))
    return totals.select(
        "aspect_id",
        *[
            F.when(known > 0, F.col(f"{name}_total") / known)
            .otherwise(uniform)
            .alias(f"{name}_prior")
            for name in KNOWN_SENTIMENTS
        ],
    )


def smoothed_profile(counts: DataFrame, review_counts: DataFrame) -> DataFrame:
    """Smoothed four-channel profile per product and aspect it mentions.

    Aspects a product does not mention have mention rate 0 and so contribute nothing: the sparse
    form is exact.
    """
    prior = category_prior(counts)
    joined = counts.join(prior, "aspect_id").join(
        review_counts.select("product_id", "review_count"), "product_id"
    )
    support = F.col("supporting_review_count")
    known = support - F.col("unknown_count")
    mention = support / F.col("review_count")
    reliability = support / (support + F.lit(PRIOR_STRENGTH))
    scale = F.sqrt(mention) * reliability * (F.lit(1.0) - F.col("unknown_count") / support)
    channels = [
        (
            scale
            * (F.col(f"{name}_count") + F.lit(PRIOR_STRENGTH) * F.col(f"{name}_prior"))
            / (known + F.lit(PRIOR_STRENGTH))
        ).alias(f"{name}_value")
        for name in KNOWN_SENTIMENTS
    ]
    return joined.select(
        "product_id",
        "aspect_id",
        "aspect",
        "supporting_review_count",
        mention.alias("mention_rate"),
        reliability.alias("support_reliability"),
        *channels,
    )


def pair_rates(pair_counts: DataFrame, review_counts: DataFrame) -> DataFrame:
    """Mention rate of every aspect-status pair, the NULL status included."""
    rate = F.col("supporting_review_count") / F.col("review_count")
    totals = review_counts.select("product_id", "review_count")
    return pair_counts.join(totals, "product_id").select(
        "product_id", "aspect_id", "status_id", rate.alias("rate")
    )


def pair_profiles(
    pair_counts: DataFrame, minimum_support: int = MINIMUM_WEAKNESS_SUPPORT
) -> DataFrame:
    """Distribution and support reliability of every observed pair with a status."""
    counted = with_distribution(pair_counts.filter(F.col("status_id").isNotNull()))
    reliability = F.least(
        F.lit(1.0), F.col("supporting_review_count") / F.lit(float(minimum_support))
    )
    return counted.withColumn("support_reliability", rounded(reliability))
