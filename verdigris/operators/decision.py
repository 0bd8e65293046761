"""Requirement requests: label resolution, conflicts, scoring and the decision policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import first_match, rounded
from ..schemas import MAPPED_EXACT
from ..session import cut_lineage
from . import recommend

ACTIONABLE = ("positive", "negative")


@dataclass(frozen=True)
class DecisionSettings:
    """Thresholds of the policy (fixed values)."""

    minimum_support: int = 3
    near_distance: float = 0.20
    score_threshold: float = 0.15
    compare_margin: float = 0.05
    minimum_coverage: float = 0.50


def requirements_from_reviews(units: DataFrame) -> DataFrame:
    """Every comparable unit of a review becomes a requirement of the review's request."""
    order = W.partitionBy("review_id").orderBy("unit_position")
    return units.filter(F.col("mapping_state") == MAPPED_EXACT).select(
        F.col("review_id").alias("request_id"),
        F.col("product_id").alias("source_id"),
        F.concat(F.lit("r"), F.row_number().over(order)).alias("requirement_id"),
        "aspect",
        "status",
        "sentiment",
        F.col("aspect_id").alias("aspect_cluster_id"),
        F.col("status_id").alias("status_cluster_id"),
        F.lit(1.0).alias("importance"),
        "excerpt",
    )


def submissions_from_reviews(units: DataFrame) -> DataFrame:
    """One nested submission per review: its text and its units in order."""
    unit = F.struct(
        "unit_position",
        "raw_aspect",
        "aspect",
        "raw_status",
        "status",
        "excerpt",
        "opinion",
        "sentiment",
        "aspect_id",
        "status_id",
    )
    return units.groupBy("review_id", "product_id", "review_text").agg(
        F.sort_array(F.collect_list(unit)).alias("opinion_units")
    ).withColumn("submission_id", F.concat(F.lit("demo-review-"), "review_id"))


def label_index(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ids per aspect label, ids per status label of an aspect, aspects by id, statuses by id)."""
    known = pairs.select("aspect_id", "aspect", "status_id", "status").distinct()
    aspects = known.select("aspect_id", "aspect").distinct()
    statuses = known.filter(F.col("status_id").isNotNull() & F.col("status").isNotNull()).select(
        "aspect_id", "status_id", "status"
    )
    by_aspect = aspects.groupBy("aspect").agg(
        F.count(F.lit(1)).alias("aspect_options"), F.min("aspect_id").alias("only_aspect_id")
    )
    by_status = statuses.groupBy(
        F.col("aspect_id").alias("resolved_aspect_id"), F.col("status")
    ).agg(F.count(F.lit(1)).alias("status_options"), F.min("status_id").alias("only_status_id"))
    return (
        by_aspect,
        by_status,
        aspects.select(
            F.col("aspect_id").alias("aspect_cluster_id"), F.col("aspect").alias("aspect_of_id")
        ),
        statuses.select(
            F.col("status_id").alias("status_cluster_id"),
            F.col("status").alias("status_of_id"),
            F.col("aspect_id").alias("aspect_of_status"),
        ),
    )


def resolve_labels(requirements: DataFrame, pairs: DataFrame) -> DataFrame:
    """Resolve labels and ids against the catalog; every failed check is named in ``reasons``."""
    by_aspect, by_status, aspect_ids, status_ids = label_index(pairs)

    def text(name: str):
        trimmed = F.trim(F.col(name))
        return F.when(F.length(trimmed) > 0, trimmed)

    given = requirements
    for name in ("aspect", "status", "aspect_cluster_id", "status_cluster_id"):
        given = given.withColumn(name, text(name))
    step = given.join(by_aspect, "aspect", "left").join(aspect_ids, "aspect_cluster_id", "left")
    no_id = F.col("aspect_cluster_id").isNull()
    options = F.coalesce("aspect_options", F.lit(0))
    aspect_reason = first_match(
        [
            (no_id & (options == 0), F.lit("ASPECT_LABEL_NOT_FOUND")),
            (no_id & (options > 1), F.lit("ASPECT_LABEL_AMBIGUOUS")),
            (~no_id & F.col("aspect_of_id").isNull(), F.lit("ASPECT_CLUSTER_ID_NOT_FOUND")),
            (
                ~no_id & (F.col("aspect_of_id") != F.col("aspect")),
                F.lit("ASPECT_LABEL_CLUSTER_MISMATCH"),
            ),
        ]
    )
    step = step.withColumn("aspect_reason", aspect_reason).withColumn(
        "resolved_aspect_id",
        F.coalesce("aspect_cluster_id", F.when(options == 1, F.col("only_aspect_id"))),
    )
    step = step.join(by_status, ["resolved_aspect_id", "status"], "left").join(
        status_ids, "status_cluster_id", "left"
    )
    has_aspect = F.col("resolved_aspect_id").isNotNull()
    status_given = F.col("status").isNotNull()
    id_given = F.col("status_cluster_id").isNotNull()
    id_known = F.col("status_of_id").isNotNull()
    by_label = has_aspect & status_given & ~id_given
    choices = F.coalesce("status_options", F.lit(0))
    status_reason = first_match(
        [
            (by_label & (choices == 0), F.lit("STATUS_LABEL_NOT_FOUND")),
            (by_label & (choices > 1), F.lit("STATUS_LABEL_AMBIGUOUS")),
            (id_given & ~id_known, F.lit("STATUS_CLUSTER_ID_NOT_FOUND")),
            (
                id_given & has_aspect & (F.col("aspect_of_status") != F.col("resolved_aspect_id")),
                F.lit("STATUS_CLUSTER_ASPECT_MISMATCH"),
            ),
        ]
    )
    label_reason = F.when(
        id_given & id_known & status_given & (F.col("status_of_id") != F.col("status")),
        F.lit("STATUS_LABEL_CLUSTER_MISMATCH"),
    )
    resolved_status = F.coalesce(
        "status_cluster_id", F.when(by_label & (choices == 1), F.col("only_status_id"))
    )
    step = step.withColumn("resolved_status_id", resolved_status)
    reasons = F.array_compact(F.array("aspect_reason", status_reason, label_reason))
    unpaired = (
        F.col("sentiment").isin(*ACTIONABLE)
        & (F.size(reasons) == 0)
        & (~has_aspect | F.col("resolved_status_id").isNull())
    )
    no_pair = F.array(F.lit("ACTIONABLE_REQUIREMENT_HAS_NO_RESOLVED_PAIR"))
    return step.withColumn("reasons", F.when(unpaired, no_pair).otherwise(reasons)).select(
        *[c for c in requirements.columns if c not in ("status",)],
        F.coalesce("status", "status_of_id").alias("status"),
        "resolved_aspect_id",
        "resolved_status_id",
        "reasons",
    )


def conflicts(requirements: DataFrame) -> DataFrame:
    """Pairs of one request that are wanted and unwanted at once."""
    return (
        requirements.filter(
            F.col("resolved_aspect_id").isNotNull() & F.col("resolved_status_id").isNotNull()
        )
        .groupBy("request_id", "resolved_aspect_id", "resolved_status_id")
        .agg(F.sort_array(F.collect_set("sentiment")).alias("sentiments"))
        .filter(
            F.array_contains("sentiments", "positive") & F.array_contains("sentiments", "negative")
        )
    )


def decision_requests(
    requirements: DataFrame, near_pairs: DataFrame | None, settings: DecisionSettings
) -> DataFrame:
    """One row per request with its resolved actionable conditions and their near statuses.

    ``near_pairs``: aspect_id, status_id, near_status_id, distance. The near list of a status is
    bounded by the statuses inside its aspect.
    """
    actionable = requirements.filter(
        F.col("sentiment").isin(*ACTIONABLE) & (F.size("reasons") == 0)
    ).select(
        "request_id",
        "source_id",
        "sentiment",
        "importance",
        F.col("resolved_aspect_id").alias("aspect_id"),
        F.col("resolved_status_id").alias("status_id"),
    )
    near = None
    if near_pairs is not None:
        factor = F.lit(1.0) - F.col("distance") / F.lit(settings.near_distance)
        listed = near_pairs.groupBy("aspect_id", "status_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "distance",
                        F.col("near_status_id").alias("status_id"),
                        F.greatest(F.lit(0.0), factor).alias("factor"),
                    )
                )
            ).alias("near")
        )
        actionable = actionable.join(listed, ["aspect_id", "status_id"], "left")
        near = F.col("near")
    return actionable.groupBy("request_id", "source_id").agg(
        F.collect_list(recommend.condition(near)).alias("conditions"),
        F.count(F.lit(1)).alias("actionable_count"),
    )


def rank_requests(requests: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` candidates of every request; those that ask for the same share one ranking.

    A ranking holds one candidate more, since the product that a request comes from is left out of it afterwards.
    """
    asked = [c for c in ("conditions", "excluded") if c in requests.columns]
    ordered = requests.withColumn("conditions", F.sort_array("conditions"))
    kept = cut_lineage(
        ordered.select("request_id", "source_id", *asked, F.sha2(F.to_json(F.struct(*asked)), 256).alias("asked_id"))
    )
    nobody = F.lit(None).cast(dict(candidates.dtypes)["product_id"])
    shared = kept.groupBy(F.col("asked_id").alias("request_id")).agg(*[F.first(c).alias(c) for c in asked])
    ranked = recommend.rank_candidates(shared.withColumn("source_id", nobody), candidates, recommend.DECISION, limit + 1)
    columns = [c for c in ranked.columns if c not in ("request_id", "source_id", "rank")]
    listed = ranked.groupBy(F.col("request_id").alias("asked_id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("best")
    )
    others = F.filter("best", lambda row: ~row["candidate_id"].eqNullSafe(F.col("source_id")))
    placed = kept.join(listed, "asked_id").select(
        "request_id", "source_id", F.posexplode(F.slice(others, 1, limit)).alias("place", "row")
    )
    return placed.select("request_id", "source_id", *[f"row.{c}" for c in columns], (F.col("place") + 1).alias("rank"))


def decide(requirements: DataFrame, ranked: DataFrame, settings: DecisionSettings) -> DataFrame:
    """Action and reason codes of every request from its two best candidates."""
    actionable = F.col("sentiment").isin(*ACTIONABLE)
    unresolved = F.size("reasons") > 0
    checks = requirements.groupBy("request_id", "source_id").agg(
        F.count_if(actionable & ~unresolved).alias("actionable_count"),
        F.count_if(actionable & unresolved).alias("unresolved_count"),
    )
    clashing = (
        conflicts(requirements)
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("conflict_count"))
    )
    at = {rank: F.col("rank") == rank for rank in (1, 2)}
    best = ranked.groupBy("request_id").agg(
        F.max(F.when(at[1], F.col("candidate_name"))).alias("top_product_name"),
        F.max(F.when(at[1], F.col("score"))).alias("top_score"),
        F.max(F.when(at[1], F.col("evidence_coverage"))).alias("top_coverage"),
        F.max(F.when(at[2], F.col("candidate_name"))).alias("runner_up_product_name"),
        F.max(F.when(at[2], F.col("score"))).alias("runner_up_score"),
    )
    joined = (
        checks.join(clashing, "request_id", "left")
        .join(best, "request_id", "left")
        .fillna(0, subset=["conflict_count"])
        .withColumn("margin", F.col("top_score") - F.col("runner_up_score"))
    )
    none = F.col("actionable_count") == 0
    open_questions = F.col("unresolved_count") > 0
    clash = F.col("conflict_count") > 0
    ask = none | open_questions | clash
    no_candidate = F.col("top_score").isNull()
    low_score = F.col("top_score") < settings.score_threshold
    low_coverage = F.col("top_coverage") < settings.minimum_coverage
    close = F.col("margin").isNotNull() & (F.col("margin") <= settings.compare_margin)
    action = first_match(
        [
            (ask, F.lit("ASK_CLARIFICATION")),
            (no_candidate | low_score | low_coverage, F.lit("ABSTAIN")),
            (close, F.lit("COMPARE")),
        ],
        F.lit("RECOMMEND"),
    )

    def codes(*pairs):
        return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]))

    always = F.lit(True)
    passed = ((always, "TOP_SCORE_ABOVE_THRESHOLD"), (always, "REQUIREMENT_COVERAGE_SUFFICIENT"))
    reason_codes = first_match(
        [
            (
                ask,
                codes(
                    (none, "NO_RESOLVED_ACTIONABLE_REQUIREMENT"),
                    (open_questions, "UNRESOLVED_ACTIONABLE_REQUIREMENT"),
                    (clash, "CONFLICTING_REQUIREMENTS"),
                ),
            ),
            (no_candidate, codes((always, "NO_CANDIDATE"))),
            (
                low_score | low_coverage,
                codes(
                    (low_score, "TOP_SCORE_BELOW_THRESHOLD"),
                    (low_coverage, "REQUIREMENT_COVERAGE_BELOW_THRESHOLD"),
                ),
            ),
            (close, codes(*passed, (always, "TOP_CANDIDATES_WITHIN_COMPARE_MARGIN"))),
        ],
        codes(
            *passed,
            (F.col("margin").isNotNull(), "RUNNER_UP_MARGIN_EXCEEDS_COMPARE_THRESHOLD"),
            (F.col("margin").isNull(), "NO_RUNNER_UP_AVAILABLE"),
        ),
    )
    return joined.select(
        "request_id",
        "source_id",
        "actionable_count",
        "unresolved_count",
        "conflict_count",
        "top_product_name",
        "top_score",
        "top_coverage",
        "runner_up_product_name",
        "runner_up_score",
        rounded(F.col("margin")).alias("runner_up_margin"),
        action.alias("action"),
        reason_codes.alias("reason_codes"),
    )
