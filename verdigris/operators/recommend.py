"""Weakness repair: which other products avoid, or make up for, the negative conditions of a source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import first_match, rounded
from ..schemas import (
    MINIMUM_WEAKNESS_SUPPORT,
    PRIOR_STRENGTH,
    RELATED_PRODUCT_LIMIT,
    SIMILARITY_WEIGHT,
    UTILITY_WEIGHT,
    WEAKNESS_LIMIT,
)
from .similarity import AspectMatrices, aspect_index, best_per_row, experience_similarity
from .tiles import block_pairs

STATIC, SUBMITTED, DECISION = "static", "submitted", "decision"


def source_weaknesses(pair_matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered weaknesses, exclusions with a reason) from the aspect-status summary."""
    negative = pair_matrix.filter(F.col("negative_count") > 0)
    support = F.col("supporting_review_count")
    reason = first_match(
        [
            (F.col("status_id").isNull(), F.lit("STATUS_CLUSTER_ID_UNAVAILABLE")),
            (
                support < MINIMUM_WEAKNESS_SUPPORT,
                F.lit("SOURCE_NEGATIVE_SUPPORT_BELOW_MINIMUM"),
            ),
        ]
    )
    marked = negative.withColumn("reason", reason)
    excluded = marked.filter(F.col("reason").isNotNull()).select(
        "product_id", "aspect", "status", "reason", "negative_count", "supporting_review_count"
    )
    rate = F.col("negative_count") / support
    order = W.partitionBy("product_id").orderBy(
        F.desc("importance"),
        F.desc("negative_count"),
        F.desc("supporting_review_count"),
        F.asc("aspect"),
        F.asc("status"),
    )
    weaknesses = (
        marked.filter(F.col("reason").isNull())
        .select(
            "product_id",
            "aspect_id",
            "status_id",
            "aspect",
            "status",
            "negative_count",
            "supporting_review_count",
            rounded(rate).alias("negative_rate"),
            rounded(rate * support / (support + F.lit(PRIOR_STRENGTH))).alias("importance"),
        )
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= WEAKNESS_LIMIT)
        .withColumn("condition_id", F.concat(F.lit("weakness_"), F.col("position")))
    )
    return weaknesses, excluded


def strengths(pair_profiles: DataFrame, policy: str) -> DataFrame:
    """Per observed pair: how strongly it counts against, and for, a product."""
    against = F.col("support_reliability")
    if policy == SUBMITTED:
        against = against * F.coalesce("negative_wilson_upper", F.lit(0.0))
    positive = F.col("dominant_sentiment") == "positive"
    favour = F.col("support_reliability") * F.coalesce("positive_wilson_lower", F.lit(0.0))
    return pair_profiles.withColumn("against", against).withColumn(
        "favour", F.when(positive, favour)
    )


def candidate_arrays(pair_strengths: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per product: its aspects and its pair strengths, both bounded by the taxonomy."""
    entry = F.struct(
        "aspect_id",
        "status_id",
        "against",
        F.coalesce("favour", F.lit(-1.0)).alias("favour"),
        F.coalesce("positive_wilson_lower", F.lit(0.0)).alias("lower"),
    )
    packed = pair_strengths.groupBy("product_id").agg(
        F.sort_array(F.collect_list(entry)).alias("pairs")
    )
    return profiles.join(packed, "product_id", "left")


def condition(near: Column | None = None) -> Column:
    """A wanted or unwanted pair as a struct; ``near`` lists close statuses with their factor."""
    empty = F.array().cast("array<struct<distance:double,status_id:string,factor:double>>")
    return F.struct(
        F.col("aspect_id").cast("string").alias("aspect_id"),
        F.col("status_id").cast("string").alias("status_id"),
        F.col("sentiment"),
        F.col("importance").cast("double").alias("importance"),
        (empty if near is None else F.coalesce(near, empty)).alias("near"),
    )


def _aspect_strengths(pairs: pd.Series, aspects: set[str]) -> dict[str, dict]:
    """Dense candidate-by-status matrices of each needed aspect of one block."""
    entries: dict[str, list] = {aspect: [] for aspect in aspects}
    for row, items in enumerate(pairs):
        for item in () if items is None else items:
            if item["aspect_id"] in entries:
                entries[item["aspect_id"]].append((row, item))
    matrices = {}
    for aspect, found in entries.items():
        index = {s: i for i, s in enumerate(sorted({item["status_id"] for _, item in found}))}
        size = (len(pairs), len(index))
        seen = np.zeros(size, dtype=bool)
        values = {name: np.zeros(size) for name in ("against", "lower")}
        values["favour"] = np.full(size, -1.0)
        for row, item in found:
            column = index[item["status_id"]]
            seen[row, column] = True
            for name, matrix in values.items():
                matrix[row, column] = item[name]
        matrices[aspect] = {"index": index, "seen": seen, **values}
    return matrices


def _condition_values(key: tuple, data: dict, round_value: bool):
    """Contribution of one condition for every candidate of the block, and whether it has evidence."""
    _, status, sentiment, near = key
    index, seen = data["index"], data["seen"]
    options = [(0.0, status, 1.0), *[item for item in near if item[1] != status]]
    options = [(index[s], factor) for _, s, factor in sorted(options) if s in index]
    columns = [column for column, _ in options]
    factors = np.array([factor for _, factor in options])
    matched = seen[:, columns]
    strength = np.where(matched, data["against"][:, columns] * factors, -1.0)
    has_match = matched.any(1)
    if sentiment == "positive":
        if not columns:
            return np.zeros(len(seen)), has_match
        best = strength.argmax(1)
        rows = np.arange(len(seen))
        lower = data["lower"][:, columns][rows, best]
        return np.where(has_match, strength[rows, best] * lower, 0.0), has_match
    penalty = np.where(has_match, strength.max(1, initial=-1.0), 0.0)
    others = np.delete(data["favour"], columns, axis=1)
    favour = others.max(1, initial=-1.0)
    has_favour = favour >= 0.0
    value = np.where(has_favour, favour, 0.0) - penalty
    return (np.round(value, 6) + 0.0 if round_value else value), has_match | has_favour


def settled(values: np.ndarray) -> np.ndarray:
    """Six places, half to even, after removing float noise.

    A mean of six-place values often lies exactly between two of them; summation order must not
    decide which one it becomes.
    """
    return np.round(np.round(values, 9), 6) + 0.0


def _request_matrices(conditions: pd.Series):
    """Importance and count of each distinct condition (columns) in each request (rows)."""
    keys: dict[tuple, int] = {}
    cells = []
    for row, items in enumerate(conditions):
        for item in items:
            near = tuple((n["distance"], n["status_id"], n["factor"]) for n in item["near"])
            key = (item["aspect_id"], item["status_id"], item["sentiment"], near)
            cells.append((row, keys.setdefault(key, len(keys)), item["importance"]))
    importance = np.zeros((len(conditions), len(keys)))
    counts = np.zeros_like(importance)
    for row, column, weight in cells:
        importance[row, column] += weight
        counts[row, column] += 1
    return list(keys), importance, counts


def rank_candidates(
    requests: DataFrame, candidates: DataFrame, policy: str, limit: int = RELATED_PRODUCT_LIMIT
) -> DataFrame:
    """The best ``limit`` candidates of every request.

    ``requests``: request_id, source_id, conditions, for the repair policies the source's ``aspects``, and where a
    request names them ``excluded``, product ids that it must not be given. Request and candidate blocks meet in task groups and each group passes on only its
    own best rows, so the product of requests and candidates is never shuffled.
    """
    repair = policy != DECISION

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("product_name", kind="stable").reset_index(drop=True)
        keys, importance, counts = _request_matrices(left["conditions"])
        data = _aspect_strengths(right["pairs"], {key[0] for key in keys})
        scored = [_condition_values(key, data[key[0]], repair) for key in keys]
        values = np.array([value for value, _ in scored])
        supported = np.array([found for _, found in scored], dtype=float)
        utility = (importance @ values) / importance.sum(1)[:, None]
        support = counts @ supported
        coverage = support / counts.sum(1)[:, None]
        allowed = left["source_id"].to_numpy()[:, None] != right["product_id"].to_numpy()[None, :]
        if "excluded" in left:
            ids = right["product_id"]
            refused = [ids.isin(list(own)) if own is not None else np.zeros(len(ids), bool) for own in left["excluded"]]
            allowed = allowed & ~np.stack(refused)
        names = np.broadcast_to(np.arange(len(right)), utility.shape)
        if repair:
            index = aspect_index(left["aspects"], right["aspects"])
            similarity = experience_similarity(
                AspectMatrices(left["aspects"], index), AspectMatrices(right["aspects"], index)
            )
            score = SIMILARITY_WEIGHT * similarity + UTILITY_WEIGHT * ((utility + 1.0) / 2.0)
            allowed = allowed & (support > 0)
            order = [-settled(score), -settled(utility), -similarity, names]
        else:
            similarity = np.zeros_like(utility)
            score = utility
            order = [-settled(score), names]
        rows, columns = best_per_row(order, allowed, limit)
        pick = (rows, columns)
        return pd.DataFrame(
            {
                "request_id": left["request_id"].to_numpy()[rows],
                "source_id": left["source_id"].to_numpy()[rows],
                "candidate_id": right["product_id"].to_numpy()[columns],
                "candidate_name": right["product_name"].to_numpy()[columns],
                "utility": settled(utility[pick]),
                "experience_similarity": similarity[pick],
                "score": settled(score[pick]),
                "evidence_coverage": np.round(coverage[pick], 6),
                "supported_count": support[pick].astype(int),
            }
        )

    kinds = dict(candidates.dtypes)
    request_kind = dict(requests.dtypes)["request_id"]
    schema = (
        f"request_id {request_kind}, source_id {kinds['product_id']}, "
        f"candidate_id {kinds['product_id']}, candidate_name string, utility double, "
        "experience_similarity double, score double, evidence_coverage double, "
        "supported_count int"
    )
    found = block_pairs(
        requests,
        candidates,
        kernel,
        schema,
        left_key=F.col("request_id"),
        right_key=F.col("product_id"),
    )
    order = [F.desc("score")]
    if repair:
        order += [F.desc("utility"), F.desc("experience_similarity")]
    window = W.partitionBy("request_id").orderBy(*order, "candidate_name")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)


def product_requests(weaknesses: DataFrame, profiles: DataFrame) -> DataFrame:
    """One request per product from its own numbered weaknesses."""
    listed = weaknesses.withColumn("sentiment", F.lit("negative"))
    packed = listed.groupBy("product_id").agg(
        F.sort_array(F.collect_list(condition())).alias("conditions")
    )
    return packed.join(profiles.select("product_id", "aspects"), "product_id", "left").select(
        F.col("product_id").alias("request_id"),
        F.col("product_id").alias("source_id"),
        "conditions",
        "aspects",
    )


def condition_matches(
    ranked: DataFrame, conditions: DataFrame, pair_strengths: DataFrame
) -> DataFrame:
    """Explain ranked candidates: one row per condition with both evidence profiles and a reason.

    ``conditions``: request_id, condition_id, aspect_id, status_id, aspect, status.
    """
    top = ranked.select("request_id", "candidate_id", "rank").join(conditions, "request_id")
    target = pair_strengths.select(
        F.col("product_id").alias("candidate_id"),
        "aspect_id",
        "status_id",
        F.col("against"),
        F.col("negative_count").alias("target_negative_count"),
        F.col("supporting_review_count").alias("target_support"),
    )
    order = F.struct(
        (-F.col("favour")).alias("k0"),
        (-F.col("supporting_review_count")).alias("k1"),
        F.col("status").alias("status"),
        F.col("status_id").alias("status_id"),
        F.col("positive_count").alias("positive_count"),
    )
    options = pair_strengths.filter(F.col("favour").isNotNull()).select(
        F.col("product_id").alias("candidate_id"),
        "aspect_id",
        F.col("status_id").alias("other_status_id"),
        order.alias("option"),
    )
    grain = ["request_id", "candidate_id", "condition_id"]
    best = (
        top.join(options, ["candidate_id", "aspect_id"])
        .filter(F.col("other_status_id") != F.col("status_id"))
        .groupBy(*grain)
        .agg(F.min("option").alias("best"))
    )
    joined = top.join(target, ["candidate_id", "aspect_id", "status_id"], "left").join(
        best, grain, "left"
    )
    seen, favoured = F.col("against").isNotNull(), F.col("best").isNotNull()
    relation = first_match(
        [
            (seen & favoured, F.lit("EXACT_UNDESIRED_STATUS_AND_POSITIVE_ALTERNATIVE")),
            (seen, F.lit("EXACT_UNDESIRED_STATUS_ONLY")),
            (favoured, F.lit("POSITIVE_ALTERNATIVE_ONLY")),
        ],
        F.lit("NO_EVIDENCE"),
    )
    label = F.concat(F.lit("'"), "aspect", F.lit(" "), "status", F.lit("'"))
    alternative = F.concat(F.lit("'"), "aspect", F.lit(" "), F.col("best.status"), F.lit("'"))
    negative_part = F.when(
        seen, F.concat(label, F.lit(" 부정 근거 "), F.col("target_negative_count"), F.lit("개"))
    ).otherwise(F.concat(label, F.lit(" 부정 상태 미관측")))
    positive_part = F.when(
        favoured, F.concat(alternative, F.lit(" 긍정 근거 "), F.col("best.positive_count"), F.lit("개"))
    )
    utility = F.coalesce(-F.col("best.k0"), F.lit(0.0)) - F.coalesce("against", F.lit(0.0))
    return joined.select(
        *grain,
        "rank",
        "aspect_id",
        "status_id",
        "aspect",
        "status",
        relation.alias("relation"),
        rounded(utility).alias("utility"),
        "target_support",
        F.col("best.status_id").alias("positive_status_id"),
        F.concat_ws("; ", negative_part, positive_part).alias("reason"),
    )
