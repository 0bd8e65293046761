"""Exact product similarity: scores for chosen pairs, and the best candidates per product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import rounded
from ..schemas import KNOWN_SENTIMENTS, LOW_OVERLAP, LOW_RELIABILITY, RELATED_PRODUCT_LIMIT
from .tiles import block_pairs

_CHANNELS = [f"{name}_value" for name in KNOWN_SENTIMENTS]


def profile_arrays(profile: DataFrame, products: DataFrame) -> DataFrame:
    """One row per product (also without reviews) with its aspects as one array.

    The array is bounded by the number of canonical aspects in the taxonomy.
    """
    aspect = F.struct("aspect_id", "mention_rate", "support_reliability", *_CHANNELS)
    packed = profile.groupBy("product_id").agg(
        F.sort_array(F.collect_list(aspect)).alias("aspects")
    )
    return products.select("product_id", "product_name").join(packed, "product_id", "left")


class AspectMatrices:
    """Dense mention, reliability and channel matrices of the products of one block."""

    def __init__(self, arrays: pd.Series, index: dict[str, int]):
        size = (len(arrays), len(index))
        self.mention = np.zeros(size)
        self.reliability = np.zeros(size)
        self.channels = np.zeros((*size, len(_CHANNELS)))
        for row, aspects in enumerate(arrays):
            for item in () if aspects is None else aspects:
                column = index[item["aspect_id"]]
                self.mention[row, column] = item["mention_rate"]
                self.reliability[row, column] = item["support_reliability"]
                self.channels[row, column] = [item[name] for name in _CHANNELS]


def aspect_index(*series: pd.Series) -> dict[str, int]:
    names = {item["aspect_id"] for part in series for row in part if row is not None for item in row}
    return {name: position for position, name in enumerate(sorted(names))}


def _ratio(numerator: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    return np.divide(
        numerator, denominator, out=np.zeros_like(numerator), where=denominator != 0
    )


def experience_similarity(left: AspectMatrices, right: AspectMatrices) -> np.ndarray:
    """cosine(channels) * sqrt(overlap) for all rows of two blocks, rounded to 6 places."""
    overlap = np.zeros((left.mention.shape[0], right.mention.shape[0]))
    totals = left.mention.sum(1)[:, None] + right.mention.sum(1)[None, :]
    for row, mention in enumerate(left.mention):
        overlap[row] = np.minimum(mention[None, :], right.mention).sum(1)
    overlap = _ratio(overlap, totals - overlap)
    flat_left = left.channels.reshape(len(left.channels), -1)
    flat_right = right.channels.reshape(len(right.channels), -1)
    norms = np.linalg.norm(flat_left, axis=1)[:, None] * np.linalg.norm(flat_right, axis=1)[None, :]
    cosine = _ratio(flat_left @ flat_right.T, norms)
    return np.round(cosine * np.sqrt(overlap), 6) + 0.0


def best_per_row(order: list[np.ndarray], allowed: np.ndarray, limit: int):
    """Row and column positions of the first ``limit`` allowed columns of each row.

    ``order`` lists sort keys, most important first; each is a row-by-column matrix.
    """
    positions = np.lexsort([key for key in reversed([~allowed, *order])], axis=1)[:, :limit]
    rows = np.repeat(np.arange(len(positions)), positions.shape[1])
    columns = positions.ravel()
    keep = allowed[rows, columns]
    return rows[keep], columns[keep]


def similar_products(arrays: DataFrame, limit: int = RELATED_PRODUCT_LIMIT) -> DataFrame:
    """The ``limit`` most similar other products of every product, by similarity then name."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("product_name", kind="stable").reset_index(drop=True)
        index = aspect_index(left["aspects"], right["aspects"])
        scores = experience_similarity(
            AspectMatrices(left["aspects"], index), AspectMatrices(right["aspects"], index)
        )
        others = left["product_id"].to_numpy()[:, None] != right["product_id"].to_numpy()[None, :]
        name_order = np.broadcast_to(np.arange(len(right)), scores.shape)
        rows, columns = best_per_row([-scores, name_order], others, limit)
        return pd.DataFrame(
            {
                "source_id": left["product_id"].to_numpy()[rows],
                "candidate_id": right["product_id"].to_numpy()[columns],
                "candidate_name": right["product_name"].to_numpy()[columns],
                "experience_similarity": scores[rows, columns],
            }
        )

    kind = dict(arrays.dtypes)["product_id"]
    schema = (
        f"source_id {kind}, candidate_id {kind}, candidate_name string, "
        "experience_similarity double"
    )
    found = block_pairs(
        arrays,
        arrays,
        kernel,
        schema,
        left_key=F.col("product_id"),
        right_key=F.col("product_id"),
    )
    order = W.partitionBy("source_id").orderBy(F.desc("experience_similarity"), "candidate_name")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def pair_components(
    pairs: DataFrame, profile: DataFrame, pair_rates: DataFrame, products: DataFrame
) -> DataFrame:
    """All similarity components for the given (source_id, candidate_id) pairs.

    Joins run on the pair list only. The sum of maxima is the two totals less the sum of minima,
    so no outer join is needed.
    """
    channel_dot = sum((F.col(f"s_{c}") * F.col(f"c_{c}") for c in _CHANNELS), F.lit(0.0))
    minimum = F.least("s_mention_rate", "c_mention_rate")
    columns = ["mention_rate", "support_reliability", *_CHANNELS]

    def side(name: str, prefix: str) -> DataFrame:
        return profile.select(
            F.col("product_id").alias(name),
            "aspect_id",
            *[F.col(column).alias(f"{prefix}_{column}") for column in columns],
        )

    shared = (
        pairs.join(side("source_id", "s"), "source_id")
        .join(side("candidate_id", "c"), ["candidate_id", "aspect_id"])
        .groupBy("source_id", "candidate_id")
        .agg(
            F.sum(minimum).alias("low"),
            F.sum(
                minimum * F.sqrt(F.col("s_support_reliability") * F.col("c_support_reliability"))
            ).alias("reliable"),
            F.sum(F.sqrt(F.col("s_mention_rate") * F.col("c_mention_rate"))).alias("mention_dot"),
            F.sum(channel_dot).alias("channel_dot"),
        )
    )
    square = sum((F.col(c) * F.col(c) for c in _CHANNELS), F.lit(0.0))
    totals = profile.groupBy("product_id").agg(
        F.sum("mention_rate").alias("mention"), F.sum(square).alias("square")
    )
    rate_totals = pair_rates.groupBy("product_id").agg(F.sum("rate").alias("rates"))
    totals = totals.join(rate_totals, "product_id", "left")
    key = F.struct("aspect_id", "status_id").alias("pair_key")
    rates = pair_rates.select("product_id", F.to_json(key).alias("pair_key"), "rate")
    shared_rates = (
        pairs.join(rates.select(F.col("product_id").alias("source_id"), "pair_key", F.col("rate").alias("sr")), "source_id")
        .join(
            rates.select(F.col("product_id").alias("candidate_id"), "pair_key", F.col("rate").alias("cr")),
            ["candidate_id", "pair_key"],
        )
        .groupBy("source_id", "candidate_id")
        .agg(F.sum(F.least("sr", "cr")).alias("rate_low"))
    )
    result = pairs
    for side_id, prefix in (("source_id", "s"), ("candidate_id", "c")):
        renamed = totals.select(
            F.col("product_id").alias(side_id),
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("mention", "square", "rates")],
        )
        result = result.join(renamed, side_id, "left")
    counts = products.select(
        F.col("product_id").alias("candidate_id"), F.col("review_count").alias("catalog_review_count")
    )
    result = (
        result.join(shared, ["source_id", "candidate_id"], "left")
        .join(shared_rates, ["source_id", "candidate_id"], "left")
        .join(counts, "candidate_id", "left")
        .fillna(0.0)
    )

    def safe(numerator, denominator):
        return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))

    low = F.col("low")
    overlap = safe(low, F.col("s_mention") + F.col("c_mention") - low)
    reliability = safe(F.col("reliable"), low)
    cosine = safe(F.col("channel_dot"), F.sqrt("s_square") * F.sqrt("c_square"))
    mention_cosine = safe(F.col("mention_dot"), F.sqrt("s_mention") * F.sqrt("c_mention"))
    rate_low = F.col("rate_low")
    status_overlap = safe(rate_low, F.col("s_rates") + F.col("c_rates") - rate_low)
    codes = F.array_compact(
        F.array(
            F.when(overlap < LOW_OVERLAP, F.lit("LOW_EVIDENCE_OVERLAP")),
            F.when(reliability < LOW_RELIABILITY, F.lit("LOW_SHARED_SUPPORT_RELIABILITY")),
        )
    )
    return result.select(
        *pairs.columns,
        "catalog_review_count",
        rounded(cosine * F.sqrt(overlap)).alias("pair_similarity"),
        rounded(mention_cosine).alias("aspect_mention_similarity"),
        rounded(cosine).alias("aspect_sentiment_similarity"),
        rounded(overlap).alias("evidence_overlap"),
        rounded(reliability).alias("support_reliability"),
        rounded(status_overlap).alias("aspect_status_exact_overlap"),
        codes.alias("quality_codes"),
    )


def shared_aspects(pairs: DataFrame, profile: DataFrame, limit: int = 5) -> DataFrame:
    """The strongest shared aspects of the given pairs, by the smaller mention rate."""
    source = profile.select(
        F.col("product_id").alias("source_id"),
        "aspect_id",
        "aspect",
        F.col("mention_rate").alias("sm"),
    )
    candidate = profile.select(
        F.col("product_id").alias("candidate_id"), "aspect_id", F.col("mention_rate").alias("cm")
    )
    joined = (
        pairs.select("source_id", "candidate_id")
        .join(source, "source_id")
        .join(candidate, ["candidate_id", "aspect_id"])
        .select(
            "source_id",
            "candidate_id",
            "aspect_id",
            "aspect",
            rounded(F.col("sm")).alias("source_mention_rate"),
            rounded(F.col("cm")).alias("candidate_mention_rate"),
            rounded(F.least("sm", "cm")).alias("shared_mention_weight"),
        )
    )
    order = W.partitionBy("source_id", "candidate_id").orderBy(
        F.desc("shared_mention_weight"), "aspect", "aspect_id"
    )
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
