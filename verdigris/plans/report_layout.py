"""Both report documents in the nested layout that their readers expect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_time
from ..schemas import (
    CANDIDATE,
    DISPLAY_TIME_ZONE,
    MINIMUM_WEAKNESS_SUPPORT,
    PRIOR_STRENGTH,
    SENTIMENTS,
    SIMILARITY_WEIGHT,
    UTILITY_WEIGHT,
)
from .reports import DYNAMIC_SCHEMA_VERSION, DYNAMIC_TYPE, STATIC_SCHEMA_VERSION, STATIC_TYPE

# What the documents state of their own rules.
ASPECT_GRAIN = ["product_name", "review_id", "aspect_cluster_id"]
PAIR_GRAIN = [*ASPECT_GRAIN, "status_cluster_id"]
ABSENCE_POLICY = "NO_EVIDENCE"
SUPPORTED = [
    "SUMMARIZE_STRUCTURED",
    "COMPARE_REVIEW_EVIDENCE",
    "RECOMMEND_REVIEW_CONDITIONED",
    "ASK_CLARIFICATION",
    "ABSTAIN",
]
UNSUPPORTED = [
    "best_overall_product",
    "lowest_price",
    "in_stock",
    "fastest_shipping",
    "objective_spec_superiority",
    "causal_product_effect",
]
RELATED_SCHEMA_VERSION = "1.0.1"
GENERATOR_VERSION = "verdigris-reports-1"


@dataclass(frozen=True)
class Release:
    """The catalog release that a document was made from."""

    release_id: str
    mapping_version: str
    mapping_sha256: str
    encoder_version: str
    prompt_sha256: str
    generated_at: str


def _struct(**fields: Column | str | float | list | None) -> Column:
    """A struct of named columns; other values are literals."""
    return F.struct(*[_value(value).alias(name) for name, value in fields.items()])


def _value(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.array(*[F.lit(item) for item in value]) if isinstance(value, list) else F.lit(value)


def _rows(rows: Column | str, item) -> Column:
    """The rows of a list, reshaped; an empty list where there are none."""
    return F.coalesce(F.transform(rows, item), F.array())


def _source(release: Release) -> Column:
    run = release.mapping_version.removeprefix("mapping-table-")
    return _struct(
        run_id=run,
        release_id=release.release_id,
        created_at_local=release.generated_at,
        scope="catalog_release_full_snapshot",
        sampling_used=False,
        run_manifest_sha256=release.mapping_sha256,
        normalization=_struct(
            embedding_model_id=release.encoder_version,
            normalization_version=release.mapping_version,
            normalization_run_id=run,
            normalization_config_sha256=release.mapping_sha256,
            mapping_distance_metric="cosine",
        ),
        input_sha256=_struct(opinion_unit_prompt=release.prompt_sha256, mapping_table=release.mapping_sha256),
        human_evaluation=_struct(status="not_bundled_in_catalog_release", completed_result_file_count=0, evaluator_count=0),
    )


def _document_id(kind: str, version: str, release: Release, key: str) -> Column:
    """An id that follows from what the document is about, not from when it was made."""
    identity = F.to_json(_struct(key=F.col(key), release_id=release.release_id, schema_version=version))
    run = release.mapping_version.removeprefix("mapping-table-")
    return F.concat(F.lit(f"{kind}:{run}:"), F.substring(F.sha2(identity, 256), 1, 12))


def _reduction(part: str, grain: str) -> Column:
    return _struct(
        raw_count=F.col(f"raw_{part}_count"),
        normalized_count=F.col(f"{part}_count"),
        comparison_grain=grain,
        decrease_rate=F.col(f"{part}_decrease_rate"),
    )


def _alternative(item: Column) -> Column:
    def match(m: Column) -> Column:
        target = _struct(status_cluster_id=m["status_id"], supporting_review_count=m["target_support"])
        other = _struct(status_cluster_id=m["positive_status_id"])
        return _struct(
            condition_id=m["condition_id"],
            aspect=m["aspect"],
            status=m["status"],
            relation=m["relation"],
            utility=m["utility"],
            undesired_status_profile=F.when(m["target_support"].isNotNull(), target),
            positive_alternative_profile=F.when(m["positive_status_id"].isNotNull(), other),
            reason=m["reason"],
        )

    return _struct(
        rank=item["rank"],
        product_id=item["product_id"],
        product_name=item["product_name"],
        weakness_utility=item["weakness_utility"],
        weakness_utility_score=item["weakness_utility"],
        experience_similarity=item["experience_similarity"],
        weakness_repair_score=item["weakness_repair_score"],
        evidence_coverage=item["evidence_coverage"],
        requirement_matches=F.transform(item["requirement_matches"], match),
        recommendation_reason=item["recommendation_reason"],
    )


def _flag(flag: Column) -> Column:
    """A flag with its value as JSON: a number, or a list where it names several things."""
    value = F.when(
        flag["code"] == "COMMERCE_CONTEXT_UNAVAILABLE", F.to_json(F.split(flag["value"], ","))
    ).otherwise(flag["value"])
    return _struct(
        code=flag["code"], severity=flag["severity"], value=F.parse_json(value), implication=flag["implication"]
    )


def _ranking_contract(**more) -> Column:
    return _struct(
        **more, experience_similarity_weight=SIMILARITY_WEIGHT, weakness_utility_weight=UTILITY_WEIGHT
    )


def static_layout(built: DataFrame, release: Release) -> DataFrame:
    """The rows of ``static_reports`` as documents: product_id and one column for each field of the document."""
    latest = F.col("latest_review")
    shown = latest.withField("created_at", F.date_format(latest["created_at"], "yyyy-MM-dd'T'HH:mm:ss"))

    def weakness(w: Column) -> Column:
        return w.withField("requirement_id", w["condition_id"])

    debated = F.col("most_debated_aspect")
    fields = {
        "schema_version": F.lit(STATIC_SCHEMA_VERSION),
        "report_type": F.lit(STATIC_TYPE),
        "report_id": _document_id(STATIC_TYPE, STATIC_SCHEMA_VERSION, release, "product_id"),
        "source": _source(release),
        "product": _struct(
            product_name=F.col("product_name"),
            catalog_review_count=F.col("review_count"),
            reviews_with_eligible_opinion_units=F.col("covered_review_count"),
            review_coverage_rate=F.col("review_coverage_rate"),
        ),
        "coverage": _struct(
            opinion_unit_count=F.col("opinion_unit_count"),
            review_aspect_vote_count=F.col("review_aspect_vote_count"),
            review_aspect_status_vote_count=F.col("review_aspect_status_vote_count"),
            unique_aspect_cluster_count=F.col("unique_aspect_count"),
            unique_aspect_status_cluster_count=F.col("unique_aspect_status_count"),
            excluded_general_experience_opinion_unit_count=F.col("excluded_opinion_unit_count"),
            excluded_general_experience_review_count=F.col("excluded_review_count"),
            mean_opinion_units_per_covered_review=F.col("mean_units_per_covered_review"),
        ),
        "normalization_reduction": _struct(
            aspect=_reduction("aspect", "unique_raw_aspect_to_unique_aspect_cluster_id"),
            status=_reduction(
                "status",
                "unique_aspect_cluster_id_raw_status_to_unique_status_cluster_id; null_status_excluded",
            ),
            aspect_status=_reduction(
                "pair", "unique_raw_aspect_raw_status_to_unique_aspect_cluster_id_status_cluster_id"
            ),
        ),
        "latest_review": shown,
        "aggregation_contract": _struct(
            aspect_vote_grain=ASPECT_GRAIN,
            aspect_status_vote_grain=PAIR_GRAIN,
            sentiment_order=list(SENTIMENTS),
            review_vote_collapse=_struct(
                unknown_only="unknown",
                one_distinct_known_sentiment="that_sentiment",
                multiple_distinct_known_sentiments="mixed",
            ),
            sentiment_denominator="review_level_vote",
            decimal_places=6,
            absence_policy=ABSENCE_POLICY,
        ),
        "sentiment_distribution": F.col("sentiment_distribution"),
        "aspect_summary": _rows("aspect_summary", lambda row: row),
        "aspect_status_summary": _rows("aspect_status_summary", lambda row: row),
        "most_debated_aspect": F.when(
            debated.isNotNull(),
            debated["summary"]
            .withField("positive_negative_rate_gap", debated["positive_negative_rate_gap"])
            .withField("selection_scope", debated["selection_scope"]),
        ),
        "related_products": _struct(
            schema_version=RELATED_SCHEMA_VERSION,
            source_product_name=F.col("product_name"),
            similarity_contract=_struct(
                feature_scope="all_canonical_aspect_cluster_ids_not_display_top_n",
                vote_grain=ASPECT_GRAIN,
                category_prior_strength=float(PRIOR_STRENGTH),
            ),
            similar_products=_rows("similar_products", lambda row: row),
            weakness_repair_alternatives=_struct(
                status=F.col("repair_status"),
                ranking_contract=_ranking_contract(source_negative_support_minimum=MINIMUM_WEAKNESS_SUPPORT),
                source_weakness_requirements=_rows("weaknesses", weakness),
                excluded_source_weaknesses=_rows("excluded_weaknesses", lambda row: row),
                alternatives=_rows("alternatives", _alternative),
            ),
        ),
        "normalization_quality": _struct(
            aspect_mapping=F.get("aspect_summary", F.lit(0))["aspect_mapping"],
            status_mapping=F.get("aspect_status_summary", F.lit(0))["status_mapping"],
        ),
        "quality_flags": _rows("quality_flags", _flag),
        "agent_capabilities": _struct(
            supported=SUPPORTED, unsupported_claims=UNSUPPORTED, absence_policy=ABSENCE_POLICY
        ),
        "generator_version": F.lit(GENERATOR_VERSION),
    }
    return built.select("product_id", *[column.alias(name) for name, column in fields.items()])


def _relationship(row: Column) -> Column:
    def bounds(name: str) -> Column:
        return _struct(lower=row[f"other_{name}_wilson_lower"], upper=row[f"other_{name}_wilson_upper"])

    others = _struct(
        counts=_struct(**{name: row[f"other_{name}_count"] for name in SENTIMENTS}),
        shares=_struct(**{name: row[f"other_{name}_share"] for name in SENTIMENTS}),
        dominant_sentiment=row["other_dominant_sentiment"],
        dominant_share=row["other_dominant_share"],
        positive_wilson_95=bounds("positive"),
        negative_wilson_95=bounds("negative"),
        normalized_entropy=row["other_normalized_entropy"],
    )
    return _struct(
        rank=row["rank"],
        comparison_grain=row["comparison_grain"],
        aspect=row["aspect"],
        status=row["status"],
        aspect_cluster_id=row["aspect_id"],
        status_cluster_id=row["status_id"],
        catalog_review_count=row["catalog_review_count"],
        aspect_review_count=row["aspect_review_count"],
        same_status_review_count=row["same_status_review_count"],
        other_status_review_count=row["other_supporting_review_count"],
        other_status_sentiment=others,
        other_aspect_top_statuses=row["other_aspect_top_statuses"],
        submitted_sentiment=row["submitted_sentiment"],
        submitted_review_vote_count=row["submitted_review_vote_count"],
        submitted_opinion_unit_ids=row["submitted_opinion_unit_ids"],
        relation_code=row["relation_code"],
        relation_label=row["relation_label"],
    )


def submission_layout(built: DataFrame, release: Release, time_zone: str = DISPLAY_TIME_ZONE) -> DataFrame:
    """The rows of ``submission_reports`` as documents: submission_id and one column for each field of the document."""

    def unit(u: Column) -> Column:
        named = u.withField("aspect_cluster_id", u["aspect_id"]).withField("status_cluster_id", u["status_id"])
        return named.dropFields("aspect_id", "status_id").withField("submission_review_id", F.col("submission_id"))

    def unresolved(u: Column) -> Column:
        reason = F.when(u["mapping_state"] == CANDIDATE, F.lit("CANDIDATE_HAS_NO_CANONICAL_ASPECT_STATUS"))
        return _struct(
            **{
                name: u[name]
                for name in (
                    "opinion_unit_id",
                    "raw_aspect",
                    "raw_status",
                    "sentiment",
                    "mapping_state",
                    "suggested_aspect",
                    "suggested_status",
                )
            },
            reason=reason.otherwise(F.lit("EXCLUDED_FROM_TAXONOMY")),
        )

    def condition(c: Column) -> Column:
        named = c.withField("aspect_cluster_id", c["aspect_id"]).withField("status_cluster_id", c["status_id"])
        return named.dropFields("aspect_id", "status_id")

    opened = F.filter("opinion_units", lambda u: ~u["catalog_comparison_eligible"])
    counts = {
        name: F.coalesce(F.col(name), F.lit(0))
        for name in (
            "submitted_opinion_unit_count",
            "exact_mapped_opinion_unit_count",
            "exact_mapped_aspect_status_count",
            "unresolved_opinion_unit_count",
        )
    }
    fields = {
        "schema_version": F.lit(DYNAMIC_SCHEMA_VERSION),
        "proposal_type": F.lit(DYNAMIC_TYPE),
        "proposal_id": _document_id(DYNAMIC_TYPE, DYNAMIC_SCHEMA_VERSION, release, "submission_id"),
        "source": _source(release),
        "submission": _struct(
            submission_id=F.col("submission_id"),
            submitted_at_local=display_time("submitted_at", time_zone),
            product_name=F.col("product_name"),
            reviews=F.array(
                _struct(
                    submission_review_id=F.col("submission_id"),
                    review=F.col("review_text"),
                    opinion_units=_rows("opinion_units", unit),
                )
            ),
            excluded_products=F.array("product_name"),
        ),
        "submitted_opinion_units": _rows("opinion_units", unit),
        "catalog_relationships": _rows("relationships", _relationship),
        "catalog_comparison": _struct(**counts, unresolved_opinion_units=_rows(opened, unresolved)),
        "alternative_recommendations": _struct(
            status=F.col("recommendation_status"),
            ranking_contract=_ranking_contract(
                source="submitted_negative_aspect_status_review_votes",
                status_match_policy="exact_status_cluster_id_for_undesired_condition",
                negative_evidence_strength="support_reliability * negative_wilson_upper_95",
                positive_alternative_strength="support_reliability * positive_wilson_lower_95",
            ),
            observed_negative_opinion_unit_count=F.col("observed_negative_opinion_unit_count"),
            negative_conditions=_rows("negative_conditions", condition),
            excluded_negative_conditions=_rows("excluded_negative_conditions", lambda row: row),
            alternatives=_rows("alternatives", _alternative),
        ),
        "generator_version": F.lit(GENERATOR_VERSION),
    }
    return built.select("submission_id", *[column.alias(name) for name, column in fields.items()])


def written(documents: DataFrame, key: str, id_field: str) -> DataFrame:
    """key, report_id and payload, the JSON text of each document with its fields in their order."""
    fields = [name for name in documents.columns if name != key]
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return documents.select(key, F.col(id_field).alias("report_id"), payload.alias("payload"))
