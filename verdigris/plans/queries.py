"""Registered queries: each reads the given tables whole and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.sentiment import first_match, rounded
from ..functions.text import compact_timestamp, content_hash, derived_id, display_time, field_violations, fingerprint
from ..functions.vectors import cosine_distance
from ..operators import (
    decision,
    encode,
    evaluation,
    ingest,
    joins,
    mapping,
    profiles,
    quality,
    recommend,
    similarity,
    submission,
    summary,
    taxonomy,
    votes,
)
from ..operators.votes import ASPECT_KEYS, PAIR_KEYS
from ..schemas import DISPLAY_TIME_ZONE, EXCLUDED, INBOX, KNOWN_SENTIMENTS, MAPPED_EXACT, STATUS_CONSTRAINTS
from ..session import cut_and_deal, cut_lineage
from ..sources import bundle as bundles
from ..sources import driver_tables as src
from ..sources import inbox
from . import report_layout, reports
from .statistics import CatalogStatistics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _votes(spark: SparkSession, sf: str, keys=ASPECT_KEYS) -> DataFrame:
    return votes.review_votes(src.mapped_units(spark, sf), keys)


def _counts(spark: SparkSession, sf: str, keys=ASPECT_KEYS) -> DataFrame:
    return votes.count_votes(_votes(spark, sf, keys), ["product_id", *keys])


def _review_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = summary.product_review_counts(src.products(spark, sf), src.reviews(spark, sf))
    return counted.drop("category")


@query
def aspect_sentiment_matrix(spark, sf):
    return summary.sentiment_matrix(_counts(spark, sf), _review_counts(spark, sf), ASPECT_KEYS)


@query
def aspect_status_matrix(spark, sf):
    return summary.sentiment_matrix(
        _counts(spark, sf, PAIR_KEYS), _review_counts(spark, sf), PAIR_KEYS
    )


@query
def mapping_stats_by_aspect(spark, sf):
    return summary.mapping_stats(
        src.mapped_units(spark, sf), ["product_id", *ASPECT_KEYS], "aspect_distance"
    )


@query
def mapping_stats_by_pair(spark, sf):
    return summary.mapping_stats(
        src.mapped_units(spark, sf), ["product_id", *PAIR_KEYS], "status_distance"
    )


@query
def sentiment_entropy(spark, sf):
    mapped = src.mapped_units(spark, sf)
    by_unit = votes.count_votes(mapped.withColumnRenamed("sentiment", "vote"), ["product_id"])
    by_vote = votes.count_votes(votes.review_votes(mapped), ["product_id"])
    scoped = by_unit.withColumn("scope", F.lit("opinion_unit")).unionByName(
        by_vote.withColumn("scope", F.lit("review_aspect_vote"))
    )
    return votes.with_distribution(scoped)


@query
def normalization_reduction(spark, sf):
    return summary.normalization_reduction(src.mapped_units(spark, sf))


@query
def coverage_by_product(spark, sf):
    return summary.coverage(
        src.catalog_units(spark, sf),
        summary.product_review_counts(src.products(spark, sf), src.reviews(spark, sf)),
        _votes(spark, sf, PAIR_KEYS),
    )


@query
def product_review_counts(spark, sf):
    return summary.product_review_counts(src.products(spark, sf), src.reviews(spark, sf))


@query
def evidence_top_aspect(spark, sf):
    return summary.evidence(src.mapped_units(spark, sf), ASPECT_KEYS, 3)


@query
def evidence_top_pair(spark, sf):
    return summary.evidence(src.mapped_units(spark, sf), PAIR_KEYS, 2)


@query
def latest_review(spark, sf):
    return summary.latest_review_units(src.reviews(spark, sf), src.units(spark, sf))


@query
def most_debated_aspect(spark, sf):
    return summary.most_debated(aspect_sentiment_matrix(spark, sf)).select(
        "product_id",
        "aspect_id",
        "aspect",
        "supporting_review_count",
        "positive_share",
        "negative_share",
        "positive_negative_rate_gap",
        "selection_scope",
    )


@query
def top_negative_row(spark, sf):
    return summary.top_negative(aspect_status_matrix(spark, sf)).select(
        "product_id",
        "aspect_id",
        "status_id",
        "negative_count",
        "negative_share",
        "supporting_review_count",
        "rank",
    )


@query
def unit_votes(spark, sf):
    return votes.attach_votes(src.mapped_units(spark, sf), ASPECT_KEYS).select(
        "opinion_unit_id", "sentiment", "review_vote_sentiment"
    )


@query
def quality_flags(spark, sf):
    return summary.quality_flags(coverage_by_product(spark, sf))


@query
def net_sentiment_profile(spark, sf):
    return profiles.net_sentiment(_votes(spark, sf))


@query
def profile_similarity_l1(spark, sf):
    """All ordered pairs of products that have an aspect in common."""
    net = net_sentiment_profile(spark, sf)
    left = net.select("aspect_id", F.col("product_id").alias("left_id"))
    right = net.select("aspect_id", F.col("product_id").alias("right_id"))
    pairs = left.join(right, "aspect_id").filter("left_id <> right_id").select("left_id", "right_id")
    return profiles.net_profile_similarity(net, cut_lineage(pairs.distinct()))


@query
def category_prior(spark, sf):
    prior = profiles.category_prior(votes.count_votes(_votes(spark, sf), ["product_id", "aspect_id"]))
    return prior.select(
        "aspect_id", *[rounded(F.col(f"{s}_prior")).alias(f"{s}_prior") for s in KNOWN_SENTIMENTS]
    )


@query
def smoothed_profile(spark, sf):
    values = ["mention_rate", "support_reliability", *[f"{s}_value" for s in KNOWN_SENTIMENTS]]
    return profiles.smoothed_profile(_counts(spark, sf), _review_counts(spark, sf)).select(
        "product_id",
        "aspect_id",
        "aspect",
        "supporting_review_count",
        *[rounded(F.col(value)).alias(value) for value in values],
    )


@query
def pair_profiles(spark, sf):
    return profiles.pair_profiles(_counts(spark, sf, PAIR_KEYS))


def _statistics(spark: SparkSession, sf: str, mapped: DataFrame | None = None) -> CatalogStatistics:
    units = src.mapped_units(spark, sf) if mapped is None else mapped
    return CatalogStatistics.compute(units, src.products(spark, sf), src.dealt_reviews(spark, sf))


def _dealt_units(spark: SparkSession, sf: str) -> DataFrame:
    """The mapped units for what reads them more than once: written dealt by review, so that votes and evidence need no
    shuffle and a task has as many rows as one that numbers lines.
    """
    return cut_and_deal(src.mapped_units(spark, sf), "review_id", src.line_tasks(spark, sf))


@query
def similar_products(spark, sf):
    components = _statistics(spark, sf).similar_products()
    return components.withColumn("quality_codes", F.concat_ws(",", "quality_codes"))


@query
def shared_aspects_top5(spark, sf):
    statistics = _statistics(spark, sf)
    ranked = similarity.similar_products(statistics.profile_arrays)
    return similarity.shared_aspects(ranked, statistics.profile)


@query
def source_weaknesses(spark, sf):
    return recommend.source_weaknesses(aspect_status_matrix(spark, sf))[0]


@query
def excluded_weaknesses(spark, sf):
    return recommend.source_weaknesses(aspect_status_matrix(spark, sf))[1]


@query
def weakness_repair_static(spark, sf):
    return _statistics(spark, sf).weakness_repairs()


@query
def condition_matches_static(spark, sf):
    return _statistics(spark, sf).weakness_repair_matches()


def _submitted(spark: SparkSession, sf: str, by: str = src.CUSTOMER) -> DataFrame:
    """Every catalog review as a submission of its own."""
    return src.catalog_units(spark, sf, by).withColumn("submission_id", F.col("review_id"))


def _flat_ids(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "submitted_opinion_unit_ids", F.concat_ws(",", "submitted_opinion_unit_ids")
    )


def _relations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relationships, pair counts, pair votes) with customers as products; a review is the submission of its own id.
    The units are written dealt by review, so that groups and votes need no shuffle.
    """
    columns = ["product_id", "review_id", *PAIR_KEYS, "sentiment", "mapping_state", "unit_position", "opinion_unit_id"]
    units = src.mapped_units(spark, sf, src.CUSTOMER).select(*columns)
    mapped = cut_and_deal(units, "review_id", src.line_tasks(spark, sf))
    pair_votes = votes.review_votes(mapped, PAIR_KEYS)
    aspect_votes = votes.coarser_votes(pair_votes)
    pair_counts = votes.count_votes(pair_votes, ["product_id", *PAIR_KEYS])
    aspect_counts = votes.count_votes(aspect_votes, ["product_id", *ASPECT_KEYS])
    reviews = src.reviews(spark, sf, src.CUSTOMER)
    groups = submission.submitted_groups(mapped.withColumn("submission_id", F.col("review_id")))
    relations = submission.relationships(
        groups,
        aspect_votes,
        pair_votes,
        aspect_counts,
        pair_counts,
        None,
        summary.product_review_counts(src.products(spark, sf, src.CUSTOMER), reviews),
    )
    return relations, pair_counts, pair_votes


@query
def submitted_relationships(spark, sf):
    return _flat_ids(_relations(spark, sf)[0])


@query
def unmentioned_pairs(spark, sf):
    return _flat_ids(submission.unmentioned_pairs(_relations(spark, sf)[0]))


@query
def other_top_statuses(spark, sf):
    relations, pair_counts, pair_votes = _relations(spark, sf)
    unmentioned = submission.unmentioned_pairs(relations)
    return submission.other_top_statuses(unmentioned, pair_counts, pair_votes, None)


@query
def comparison_summary(spark, sf):
    return submission.comparison_summary(_submitted(spark, sf))


@query
def unresolved_units(spark, sf):
    return submission.unresolved_units(_submitted(spark, sf)).select(
        "submission_id", "opinion_unit_id", "raw_aspect", "raw_status", "mapping_state", "reason"
    )


@query
def negative_conditions(spark, sf):
    return _flat_ids(
        submission.negative_conditions(submission.submitted_groups(_submitted(spark, sf)))
    )


@query
def excluded_negative_conditions(spark, sf):
    submitted = _submitted(spark, sf)
    return submission.excluded_conditions(submission.submitted_groups(submitted), submitted)


@query
def two_level_collapse(spark, sf):
    """All reviews of a customer as one submission."""
    units = src.mapped_units(spark, sf, src.CUSTOMER).withColumnRenamed(
        "product_id", "submission_id"
    )
    return votes.submission_votes(units, "submission_id", PAIR_KEYS)


def _submitted_repairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked candidates, conditions, excluded conditions) of every review as a submission.

    Submissions with the same product and conditions share one ranking.
    """
    submitted = _submitted(spark, sf, src.NATION)
    groups = cut_lineage(submission.submitted_groups(submitted))
    conditions = submission.negative_conditions(groups)
    ranked = reports.ranked_submissions(_statistics(spark, sf), conditions)
    return ranked, conditions, submission.excluded_conditions(groups, submitted)


@query
def weakness_repair_submitted(spark, sf):
    return _submitted_repairs(spark, sf)[0]


@query
def recommendation_status(spark, sf):
    ranked, conditions, excluded = _submitted_repairs(spark, sf)
    submissions = src.reviews(spark, sf).select(F.col("review_id").alias("submission_id"))
    return submission.recommendation_status(submissions, ranked, conditions, excluded)


def _canonical_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(src.canonical_pairs(spark, sf))


@query
def label_resolution(spark, sf):
    resolved = decision.resolve_labels(src.requests(spark, sf), _canonical_pairs(spark, sf))
    return resolved.withColumn("reasons", F.concat_ws(",", "reasons"))


def _review_requirements(spark: SparkSession, sf: str) -> DataFrame:
    requirements = decision.requirements_from_reviews(src.catalog_units(spark, sf))
    return decision.resolve_labels(requirements, _canonical_pairs(spark, sf))


@query
def requirement_conflicts(spark, sf):
    clashes = decision.conflicts(_review_requirements(spark, sf))
    return clashes.withColumn("sentiments", F.concat_ws(",", "sentiments"))


NEAR_SETTINGS = decision.DecisionSettings(near_distance=0.9)


def _scored_requests(
    spark: SparkSession, sf: str, excluded: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    requirements = cut_lineage(_review_requirements(spark, sf))
    near = near_status_pairs(spark, sf)
    requests = decision.decision_requests(requirements, near, NEAR_SETTINGS)
    if excluded is not None:
        requests = requests.withColumn("excluded", excluded)
    statistics = _statistics(spark, sf)
    profile = profiles.pair_profiles(statistics.pair_counts, NEAR_SETTINGS.minimum_support)
    candidates = recommend.candidate_arrays(
        recommend.strengths(profile, recommend.DECISION), statistics.profile_arrays
    )
    return requirements, decision.rank_requests(requests, candidates, 2)


@query
def decision_excluded_products(spark, sf):
    """The best candidates of requests that each refuse some products, besides the one they come from."""
    products = F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))
    refused = F.filter(products, lambda p: (p + F.col("request_id")) % 5 == 0)
    return _scored_requests(spark, sf, refused)[1].drop("utility", "experience_similarity")


@query
def near_status_pairs(spark, sf):
    return mapping.near_statuses(src.status_vectors(spark, sf), NEAR_SETTINGS.near_distance)


@query
def requirement_scores(spark, sf):
    return _scored_requests(spark, sf)[1].drop("utility", "experience_similarity")


@query
def decision_policy(spark, sf):
    requirements, ranked = _scored_requests(spark, sf)
    decided = decision.decide(requirements, ranked, NEAR_SETTINGS)
    return decided.withColumn("reason_codes", F.concat_ws(",", "reason_codes"))


def _clusters(members: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Cluster rows of given members: centroid, and the first member's vector as canonical."""
    heads = members.groupBy(*keys).agg(
        F.min(label).alias("label"),
        F.min_by("embedding", "text").alias("canonical"),
        F.max("distance_threshold").alias("distance_threshold"),
    )
    return heads.join(mapping.centroids(members, keys), keys)


@query
def candidate_ranking(spark, sf):
    """Every expression against the clusters of its boundary."""
    members = src.clustered_embeddings(spark, sf).withColumn(
        "distance_threshold", F.lit(src.CANDIDATE_THRESHOLD)
    )
    expressions = src.embeddings(spark, sf).withColumn("expression_id", F.col("vec_id"))
    return mapping.nearest_clusters(
        expressions, members, _clusters(members, ["boundary", "cluster_id"], "text")
    )


@query
def candidate_ranking_global(spark, sf):
    """Every expression against all clusters, as for unseen aspects."""
    members = (
        src.embeddings(spark, sf)
        .withColumn("cluster_id", F.concat_ws("-", F.lit("L"), "boundary"))
        .withColumn("boundary", F.lit("all"))
        .withColumn("distance_threshold", F.lit(src.CANDIDATE_THRESHOLD))
    )
    expressions = (
        src.embeddings(spark, sf)
        .withColumn("expression_id", F.col("vec_id"))
        .withColumn("boundary", F.lit("all"))
    )
    return mapping.nearest_clusters(
        expressions, members, _clusters(members, ["boundary", "cluster_id"], "text")
    )


def _mapping_maps(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cluster tables and exact lookup maps of the partly known taxonomy."""
    aspects, statuses = tables["aspect_members"], tables["status_members"]
    aspect_clusters = _clusters(aspects, ["cluster_id"], "aspect")
    status_clusters = _clusters(statuses, ["boundary", "cluster_id"], "status")
    aspect_map = aspects.join(aspect_clusters.select("cluster_id", "canonical"), "cluster_id").select(
        F.col("text").alias("raw_aspect"),
        F.col("cluster_id").alias("aspect_id"),
        "aspect",
        cosine_distance("embedding", "canonical").alias("aspect_map_distance"),
    )
    status_map = statuses.join(
        status_clusters.select("boundary", "cluster_id", "canonical"), ["boundary", "cluster_id"]
    ).select(
        F.col("boundary").alias("aspect_id"),
        F.col("text").alias("raw_status"),
        F.col("cluster_id").alias("status_id"),
        "status",
        cosine_distance("embedding", "canonical").alias("status_map_distance"),
    )
    return {
        "aspect_map": aspect_map,
        "status_map": status_map,
        "aspect_clusters": aspect_clusters,
        "status_clusters": status_clusters,
    }


@query
def exact_mapping(spark, sf):
    maps = _mapping_maps(src.mapping_tables(spark, sf))
    units = src.units(spark, sf).select("opinion_unit_id", "raw_aspect", "raw_status")
    found = mapping.exact_mapping(units, maps["aspect_map"], maps["status_map"])
    return found.withColumn(
        "aspect_map_distance", rounded(F.col("aspect_map_distance"), 8)
    ).withColumn("status_map_distance", rounded(F.col("status_map_distance"), 8))


@query
def mapping_state_machine(spark, sf):
    tables = src.mapping_tables(spark, sf)
    tables = {name: cut_lineage(df) for name, df in tables.items()}
    maps = _mapping_maps(tables)
    units = src.units(spark, sf).select("opinion_unit_id", "raw_aspect", "raw_status")
    decisions = mapping.map_expressions(
        units,
        maps["aspect_map"],
        maps["status_map"],
        tables["aspect_members"],
        maps["aspect_clusters"],
        tables["status_members"],
        maps["status_clusters"],
        tables["vectors"],
        src.EXCLUDED_ASPECTS,
    )
    return mapping.apply_mapping(units, decisions)


CLUSTER_SETTINGS = taxonomy.ClusterSettings(threshold=0.75, naming_max=0.75)
LABEL_SETTINGS = taxonomy.ClusterSettings(
    threshold=1.4, naming_max=1.25, label_stop_list=("e000003", "e000010", "e000017")
)


def _label_members(spark: SparkSession, sf: str) -> DataFrame:
    members = src.clustered_embeddings(spark, sf).drop("vec_id")
    return members.withColumn("source_row_count", F.col("unique_review_count"))


@query
def cluster_labels(spark, sf):
    details = cut_lineage(taxonomy.label_details(_label_members(spark, sf), LABEL_SETTINGS))
    labels = taxonomy.select_labels(details, LABEL_SETTINGS)
    distances = [
        "cluster_max_distance",
        "representative_average_distance",
        "representative_max_distance",
    ]
    return labels.withColumns({name: rounded(F.col(name), 8) for name in distances})


@query
def cluster_member_details(spark, sf):
    details = taxonomy.label_details(_label_members(spark, sf), LABEL_SETTINGS)
    values = [
        "average_distance",
        "max_distance",
        "centrality",
        "frequency_score",
        "combined_score",
    ]
    return details.select(
        "cluster_id",
        "text",
        "unique_review_count",
        "central_candidate",
        "role_filter_passed",
        *[rounded(F.col(value), 8).alias(value) for value in values],
    )


@query
def cluster_stats(spark, sf):
    members = _label_members(spark, sf)
    details = cut_lineage(taxonomy.label_details(members, LABEL_SETTINGS))
    labels = taxonomy.select_labels(details, LABEL_SETTINGS)
    _, clusters = taxonomy.cluster_statistics(members, details, labels)
    return clusters.select(
        "cluster_id",
        "member_count",
        "source_row_count",
        "canonical_label",
        F.concat_ws(",", "member_expressions").alias("member_expressions"),
        rounded(F.col("representative_centroid_distance"), 8).alias(
            "representative_centroid_distance"
        ),
    )


@query
def node_mapping_distance(spark, sf):
    members = _label_members(spark, sf)
    details = cut_lineage(taxonomy.label_details(members, LABEL_SETTINGS))
    labels = taxonomy.select_labels(details, LABEL_SETTINGS)
    nodes, _ = taxonomy.cluster_statistics(members, details, labels)
    return nodes.select(
        "cluster_id",
        "text",
        "canonical_label",
        "mapping_applied",
        rounded(F.col("mapping_distance"), 8).alias("mapping_distance"),
    )


@query
def complete_linkage(spark, sf):
    return taxonomy.complete_linkage(src.embeddings(spark, sf), CLUSTER_SETTINGS)


@query
def complete_linkage_rounds(spark, sf):
    """The whole vocabulary as one boundary, through the distributed rounds."""
    nodes = src.embeddings(spark, sf).withColumn("boundary", F.lit("all"))
    settings = replace(CLUSTER_SETTINGS, local_boundary_rows=0)
    return taxonomy.complete_linkage(nodes, settings)


@query
def mapping_nodes(spark, sf):
    return taxonomy.expression_nodes(
        src.units(spark, sf).filter(F.col("raw_status").isNotNull()), "raw_status", F.col("aspect_id")
    )


STATUS_RULES = {
    "opposition_groups": [(("ECONOMY/F",), ("LARGE/O",))],
    "suffix_pairs": [("/F", "/O")],
    "negation_suffixes": [],
    "negation_tokens": [],
    "negation_enabled": False,
    "core_similarity": 0.65,
}
REBUILD_SETTINGS = taxonomy.TaxonomySettings(
    aspect=taxonomy.ClusterSettings(1.0, 1.0),
    status=taxonomy.ClusterSettings(1.0, 1.0, constraints=STATUS_RULES),
    excluded_aspects=src.EXCLUDED_ASPECTS,
)


@query
def cannot_link_pairs(spark, sf):
    """Opposed status pairs per aspect, found over the distinct statuses of each aspect."""
    nodes = mapping_nodes(spark, sf)
    return taxonomy.cannot_link_pairs(nodes, STATUS_RULES)


def _rebuilt(spark: SparkSession, sf: str) -> taxonomy.Taxonomy:
    units = src.units(spark, sf).select("opinion_unit_id", "review_id", "raw_aspect", "raw_status")
    vectors = cut_lineage(src.text_vectors(spark, sf))
    return taxonomy.build_taxonomy(units, vectors, REBUILD_SETTINGS)


@query
def taxonomy_rebuild(spark, sf):
    return _rebuilt(spark, sf).assignments


@query
def taxonomy_rebuild_clusters(spark, sf):
    rebuilt = _rebuilt(spark, sf)
    columns = [
        "cluster_id",
        "boundary",
        "canonical_label",
        "naming_status",
        "member_count",
        "source_row_count",
        "unique_review_count",
        "cannot_link_pair_count",
        "cluster_max_distance",
    ]
    return rebuilt.aspect_clusters.select(*columns).unionByName(
        rebuilt.status_clusters.select(*columns)
    )


@query
def taxonomy_invariants(spark, sf):
    """What must hold of a rebuilt taxonomy whatever its clusters are: sizes of its tables, and counts of violations."""
    units = src.units(spark, sf).select("opinion_unit_id", "review_id", "raw_aspect", "raw_status")
    rebuilt = _rebuilt(spark, sf)
    aspect, status = REBUILD_SETTINGS.aspect, REBUILD_SETTINGS.status
    aspect_nodes, status_nodes = rebuilt.aspect_nodes, rebuilt.status_nodes
    eligible = units.filter(~F.col("raw_aspect").isin(*REBUILD_SETTINGS.excluded_aspects))
    by_aspect = eligible.join(aspect_nodes.select(F.col("text").alias("raw_aspect"), "cluster_id"), "raw_aspect")
    recounted = by_aspect.groupBy("cluster_id").agg(F.countDistinct("review_id").alias("recounted"))
    miscounted = rebuilt.aspect_clusters.join(recounted, "cluster_id", "full").filter(
        ~F.col("recounted").eqNullSafe(F.col("unique_review_count"))
    )
    both = rebuilt.aspect_clusters.select("cluster_id", "cluster_max_distance").unionByName(
        rebuilt.status_clusters.select("cluster_id", "cluster_max_distance")
    )
    one, total = F.count(F.lit(1)), F.coalesce(F.sum("source_row_count"), F.lit(0))
    checks = {
        "aspect_nodes": aspect_nodes.agg(one.alias("value")),
        "aspect_source_rows": rebuilt.aspect_clusters.agg(total.alias("value")),
        "status_source_rows": rebuilt.status_clusters.agg(total.alias("value")),
        "units": rebuilt.assignments.agg(one.alias("value")),
        "wide_clusters": taxonomy.threshold_violations(both, aspect).agg(one.alias("value")),
        "mergeable_aspect_clusters": taxonomy.mergeable_clusters(aspect_nodes, aspect).agg(one.alias("value")),
        "mergeable_status_clusters": taxonomy.mergeable_clusters(status_nodes, status).agg(one.alias("value")),
        "opposed_members": taxonomy.opposed_members(status_nodes, STATUS_RULES).agg(one.alias("value")),
        "miscounted_reviews": miscounted.agg(one.alias("value")),
    }
    rows = [df.select(F.lit(name).alias("name"), "value") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def _captured_assignments(spark: SparkSession, sf: str, units: DataFrame | None = None) -> DataFrame:
    """A new mapping of the units captured from the source files; units added later have none."""
    units = src.units(spark, sf) if units is None else units
    captured = units.filter(F.col("source_opinion_unit_idx").isNotNull())
    kept_out = F.col("mapping_state") == EXCLUDED
    return captured.select(
        "opinion_unit_id",
        F.when(kept_out, F.lit(EXCLUDED)).otherwise(F.lit(MAPPED_EXACT)).alias("mapping_state"),
        F.when(~kept_out, F.concat(F.lit("v2-"), "aspect_id")).alias("aspect_cluster_id"),
        F.when(~kept_out, F.upper("aspect")).alias("aspect"),
        F.when(~kept_out, F.concat(F.lit("v2-"), "status_id")).alias("status_cluster_id"),
        F.when(~kept_out, F.lower("status")).alias("status"),
        F.col("aspect_distance").alias("aspect_mapping_distance"),
        F.col("status_distance").alias("status_mapping_distance"),
    )


@query
def remap_with_late_rows(spark, sf):
    units = src.units(spark, sf).withColumn("mapping_table_version_id", F.lit("v1"))
    remapped = taxonomy.remap_units(
        units, _captured_assignments(spark, sf), {"mapping_table_version_id": "v2"}
    )
    return remapped.select(
        "opinion_unit_id",
        "mapping_state",
        "aspect_id",
        "aspect",
        "status_id",
        "status",
        "aspect_distance",
        "status_distance",
        "mapping_table_version_id",
    )


@query
def rebuild_audit(spark, sf):
    return taxonomy.rebuild_audit(src.units(spark, sf), _captured_assignments(spark, sf))


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.stage_inbox(src.document_inbox(spark, sf))


def _existing_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts the catalog already holds: the documents labelled as good."""
    good = src.table(spark, sf, "labels").filter(F.col("quality") == 1).select("doc_id")
    known = src.table(spark, sf, "documents").join(good, "doc_id", "left_semi")
    return known.select(content_hash("text").alias("content_sha256")).distinct()


@query
def surrogate_ids(spark, sf):
    return _staged(spark, sf).select(
        "source_review_id",
        "review_id",
        "source",
        "content_sha256",
        derived_id("monitor-", "product_name").alias("product_key"),
    )


@query
def dedup_inbox(spark, sf):
    kept = ingest.deduplicate(_staged(spark, sf), _existing_hashes(spark, sf))
    return kept.select("source_review_id", "product_id", "content_sha256")


@query
def dedup_duplicate_count(spark, sf):
    staged = _staged(spark, sf)
    return ingest.duplicate_count(staged, ingest.deduplicate(staged, _existing_hashes(spark, sf)))


@query
def insert_or_ignore_products(spark, sf):
    """Products known from labelled documents, then those that the whole inbox adds."""
    documents = src.document_inbox(spark, sf)
    keyed = documents.withColumn("product_id", F.concat_ws("/", "product_id", "category"))
    labelled = src.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("source_review_id")
    )
    known = keyed.join(labelled, "source_review_id", "left_semi")
    existing = known.groupBy("product_id").agg(
        F.min(F.struct("ordinal", "product_name", "category")).alias("first")
    ).select("product_id", "first.product_name", "first.category", F.lit("seed").alias("first_seen_run_id"))
    return existing.unionByName(ingest.new_products(existing, keyed, "run-1"))


@query
def field_validation(spark, sf):
    checked = ingest.unit_violations(src.document_units(spark, sf))
    return checked.select(
        "doc_id", "unit_position", F.concat_ws(",", "violations").alias("violations")
    )


@query
def grounding_check(spark, sf):
    units = src.document_units(spark, sf)
    return quality.ungrounded(units).select("doc_id", "unit_position", "excerpt")


@query
def valid_units_dropped(spark, sf):
    """Units kept when invalid items are dropped alone."""
    kept, _ = ingest.validate_units(src.document_units(spark, sf), "drop")
    return kept.select("doc_id", "unit_position", "raw_aspect", "raw_status", "opinion", "sentiment")


@query
def json_units_explode(spark, sf):
    return inbox.parse_units(src.document_responses(spark, sf), "doc_id")


@query
def json_field_contract(spark, sf):
    missing, unexpected = field_violations("props", ["k", "v"])
    return src.table(spark, sf, "events").select(
        "event_id",
        F.concat_ws(",", missing).alias("missing"),
        F.concat_ws(",", unexpected).alias("unexpected"),
    )


@query
def non_product_filter(spark, sf):
    return src.units(spark, sf).select(
        "opinion_unit_id",
        "raw_aspect",
        submission.is_non_product_aspect(F.col("raw_aspect"), ("dring", "anvil")).alias(
            "is_non_product"
        ),
    )


@query
def submission_validation(spark, sf):
    """Orders of one customer as one submission: too many, blank or overlong reviews."""
    submitted = src.reviews(spark, sf, src.CUSTOMER).withColumnRenamed("product_id", "submission_id")
    return ingest.submission_violations(submitted)


@query
def commit_receipt(spark, sf):
    receipt = ingest.commit_receipt(src.reviews(spark, sf), src.units(spark, sf), "run-1")
    return receipt.drop("delta_checksum")


@query
def rebuild_recommendation(spark, sf):
    units = src.catalog_units(spark, sf).withColumn(
        "run_id", F.date_format("created_at", "yyyy-MM")
    )
    return ingest.rebuild_recommendation(units, "run_id")


@query
def mapping_differences(spark, sf):
    """Labels that differ between the current mapping and the remapped one."""
    units = src.units(spark, sf)
    remapped = taxonomy.remap_units(units, _captured_assignments(spark, sf), {})
    columns = ["aspect", "status"]
    rows = ["opinion_unit_id", *columns]
    return joins.differing_rows(
        units.select(*rows), remapped.select(*rows), ["opinion_unit_id"], columns
    )


@query
def integrity_checks(spark, sf):
    """Checks of the catalog's tables. Units and reviews are written once, dealt by review, as most checks read them."""
    buckets = src.review_buckets(spark, sf)
    rows = src.units(spark, sf, tasks=buckets).drop("raw_aspect", "raw_status", "opinion", "unit_position")
    units = cut_and_deal(rows, "review_id", buckets)
    reviews = cut_and_deal(src.reviews(spark, sf).drop("created_at"), "review_id", buckets)
    products, vectors = src.products(spark, sf), src.embeddings(spark, sf)
    lines = src.table(spark, sf, "lineitem")
    placed = units.join(reviews, "review_id")
    cast = votes.review_votes(placed.filter(F.col("mapping_state") == MAPPED_EXACT))
    matrix = summary.sentiment_matrix(
        votes.count_votes(cast, ["product_id", *ASPECT_KEYS]),
        summary.product_review_counts(products, reviews).drop("category"),
        ASPECT_KEYS,
    )
    # After a rebuild the captured units share a version, late ones keep the one before.
    version = "mapping_table_version_id"
    remapped = taxonomy.remap_units(
        units.withColumn(version, F.lit("v1")), _captured_assignments(spark, sf, units), {version: "v2"}
    )
    stamped = cut_lineage(
        remapped.select(F.col("source_opinion_unit_idx").isNotNull().alias("captured"), version).distinct()
    )
    return quality.report(
        {
            "unit_key_unique": quality.check_unique(units, ["opinion_unit_id"]),
            "unit_key_not_null": quality.null_keys(units, ["opinion_unit_id", "review_id"]),
            "review_key_unique": quality.check_unique(reviews, ["review_id"]),
            "line_key_unique": quality.check_unique(lines, ["l_orderkey", "l_linenumber"]),
            "one_label_per_aspect": quality.ambiguous_labels(units, "aspect_id", ["aspect"]),
            "one_aspect_per_status": quality.ambiguous_labels(
                units, "status_id", ["aspect_id", "status"]
            ),
            "units_have_review": quality.orphans(units, reviews, "review_id"),
            "reviews_have_product": quality.orphans(reviews, products, "product_id"),
            "reviews_have_units": quality.orphans(reviews, units, "review_id"),
            "excerpts_grounded": quality.ungrounded(placed),
            "constant_lineage": quality.varying_lineage(stamped.filter("captured"), [version]),
            "mixed_lineage": quality.varying_lineage(stamped, [version]),
            "embeddings_valid": quality.invalid_embeddings(vectors, 64),
            "source_rows_preserved": quality.lost_rows(
                reviews.select("review_id", "product_id"),
                placed.select("review_id", "product_id").distinct(),
            ),
            "distribution_invariants": quality.distribution_violations(matrix),
        }
    )


@query
def rating_summary(spark, sf):
    return evaluation.rating_summary(src.ratings(spark, sf))


@query
def factorial_effects(spark, sf):
    return evaluation.factorial_effects(src.ratings(spark, sf))


@query
def preference_rates(spark, sf):
    return evaluation.preference_rates(src.ratings(spark, sf).filter("preferred"))


@query
def cohort_violations(spark, sf):
    return evaluation.cohort_violations(src.ratings(spark, sf))


@query
def icc(spark, sf):
    return evaluation.icc_agreement(src.ratings(spark, sf))


@query
def bootstrap_ci(spark, sf):
    wide = evaluation.complete_items(src.ratings(spark, sf))
    return evaluation.bootstrap_means(wide, "item_id", list(evaluation.ARMS))


@query
def cluster_silhouettes(spark, sf):
    return evaluation.silhouettes(src.clustered_embeddings(spark, sf))


@query
def nearest_cluster_pairs(spark, sf):
    members = src.clustered_embeddings(spark, sf)
    centres = mapping.centroids(members, ["cluster_id"])
    return evaluation.nearest_cluster_pairs(centres.withColumnRenamed("centroid", "embedding"))


def _static_reports(spark: SparkSession, sf: str) -> DataFrame:
    units = cut_and_deal(src.catalog_units(spark, sf), "review_id", src.line_tasks(spark, sf))
    reviews = src.dealt_reviews(spark, sf)
    statistics = CatalogStatistics.compute(
        units.filter(F.col("mapping_state") == MAPPED_EXACT), src.products(spark, sf), reviews
    )
    return reports.static_reports(statistics, units, reviews)


RELEASE = report_layout.Release("release-1", "mapping-table-1", "0" * 64, "encoder-1", "0" * 64, "2026-08-04T09:00:00")


@query
def static_report(spark, sf):
    documents = report_layout.static_layout(_static_reports(spark, sf), RELEASE)
    return report_layout.written(documents, "product_id", "report_id")


def _joined(rows: str, field: str):
    """One field of all rows of a list, as text."""
    return F.array_join(F.transform(rows, lambda row: row[field].cast("string")), ",")


@query
def static_report_facts(spark, sf):
    """What the fields of the static documents hold, one row for each document."""
    documents = report_layout.static_layout(_static_reports(spark, sf), RELEASE)
    related, repair = "related_products.", "related_products.weakness_repair_alternatives."
    return documents.select(
        "product_id",
        "product.product_name",
        "product.catalog_review_count",
        "product.reviews_with_eligible_opinion_units",
        "product.review_coverage_rate",
        "coverage.*",
        F.col("normalization_reduction.aspect_status.raw_count").alias("raw_pair_count"),
        F.col("normalization_reduction.status.decrease_rate").alias("status_decrease_rate"),
        F.col("latest_review.review_id").alias("latest_review_id"),
        _joined("latest_review.opinion_units", "raw_aspect").alias("latest_aspects"),
        _joined("aspect_summary", "aspect_cluster_id").alias("aspects"),
        F.size("aspect_status_summary").alias("pair_count"),
        F.col("most_debated_aspect.aspect").alias("debated_aspect"),
        F.col("most_debated_aspect.positive_negative_rate_gap").alias("debated_gap"),
        F.col("sentiment_distribution.review_aspect_vote.counts.mixed").alias("mixed_vote_count"),
        _joined(related + "similar_products", "product_id").alias("similar_products"),
        F.col(repair + "status").alias("repair_status"),
        _joined(repair + "source_weakness_requirements", "status_cluster_id").alias("weaknesses"),
        F.size(repair + "excluded_source_weaknesses").alias("excluded_weakness_count"),
        _joined(repair + "alternatives", "product_id").alias("alternatives"),
        F.get(repair + "alternatives", F.lit(0))["weakness_repair_score"].alias("best_score"),
        F.get(F.get(repair + "alternatives", F.lit(0))["requirement_matches"], F.lit(0))["reason"].alias("first_reason"),
        F.to_json(F.transform("quality_flags", lambda flag: flag["value"])).alias("flag_values"),
    )


@query
def static_report_markdown(spark, sf):
    return reports.render_static(_static_reports(spark, sf))


def _submission_reports(spark: SparkSession, sf: str) -> DataFrame:
    submissions = src.reviews(spark, sf).select(
        F.col("review_id").alias("submission_id"),
        "review_id",
        "product_id",
        "review_text",
        F.col("created_at").cast("timestamp").alias("submitted_at"),
    )
    tasks = src.line_tasks(spark, sf)
    units = cut_and_deal(src.catalog_units(spark, sf), "review_id", tasks)
    mapped = units.filter(F.col("mapping_state") == MAPPED_EXACT)
    statistics = CatalogStatistics.compute(mapped, src.products(spark, sf), src.reviews(spark, sf))
    submitted = units.withColumn("submission_id", F.col("review_id"))
    return reports.submission_reports(statistics, submitted, submissions, mapped, tasks)


@query
def dynamic_report(spark, sf):
    documents = report_layout.submission_layout(_submission_reports(spark, sf), RELEASE)
    return report_layout.written(documents, "submission_id", "proposal_id")


@query
def dynamic_report_facts(spark, sf):
    """What the fields of the submission documents hold, one row for each document."""
    documents = report_layout.submission_layout(_submission_reports(spark, sf), RELEASE)
    advice = "alternative_recommendations."
    return documents.select(
        "submission_id",
        "submission.product_name",
        _joined("submitted_opinion_units", "raw_aspect").alias("raw_aspects"),
        "catalog_comparison.exact_mapped_opinion_unit_count",
        "catalog_comparison.exact_mapped_aspect_status_count",
        "catalog_comparison.unresolved_opinion_unit_count",
        _joined("catalog_comparison.unresolved_opinion_units", "reason").alias("unresolved_reasons"),
        _joined("catalog_relationships", "relation_code").alias("relation_codes"),
        F.get("catalog_relationships", F.lit(0))["other_status_sentiment"]["counts"]["negative"].alias("first_other_negative_count"),
        F.col(advice + "status").alias("recommendation_status"),
        F.col(advice + "observed_negative_opinion_unit_count").alias("observed_negative_count"),
        _joined(advice + "negative_conditions", "status_cluster_id").alias("conditions"),
        F.size(advice + "excluded_negative_conditions").alias("excluded_condition_count"),
        _joined(advice + "alternatives", "product_id").alias("alternatives"),
        F.get(advice + "alternatives", F.lit(0))["weakness_repair_score"].alias("best_score"),
    )


@query
def dynamic_report_markdown(spark, sf):
    return reports.render_submission(_submission_reports(spark, sf))


@query
def sentiment_summary(spark, sf):
    return votes.sentiment_summary(_votes(spark, sf), ["product_id", *ASPECT_KEYS])


@query
def excluded_experience(spark, sf):
    return summary.excluded_experience(src.units(spark, sf), src.reviews(spark, sf))


@query
def risky_clusters_present(spark, sf):
    """Risky clusters that each product meets, for a given list of them.

    The list stands in for one that is delivered: statuses with a larger share of undecided votes than the average.
    """
    pairs = cut_lineage(_counts(spark, sf, PAIR_KEYS))
    totals = pairs.filter(F.col("status_id").isNotNull()).groupBy("status_id").agg(
        (F.sum("unknown_count") / F.sum("supporting_review_count")).alias("risk")
    )
    average = F.broadcast(totals.agg(F.avg("risk").alias("average")))
    risky = totals.join(average, F.col("risk") > F.col("average") + 1e-12).select(
        F.col("status_id").alias("cluster_id")
    )
    return summary.risk_overlap(pairs, risky)


@query
def catalog_submissions(spark, sf):
    """Every catalog review written as a submission document."""
    built = decision.submissions_from_reviews(src.mapped_units(spark, sf))
    return built.select(
        "submission_id",
        "product_id",
        "review_text",
        F.size("opinion_units").alias("unit_count"),
        F.concat_ws(",", "opinion_units.raw_aspect").alias("raw_aspects"),
        F.concat_ws(",", "opinion_units.sentiment").alias("sentiments"),
    )


@query
def submission_results(spark, sf):
    reviews = src.reviews(spark, sf).withColumn(
        "demo_review_id", F.concat_ws("-", F.lit("demo"), "review_id")
    )
    columns = ["opinion_unit_id", "review_id", "unit_position", "raw_aspect", "raw_status"]
    columns += ["aspect", "status", "sentiment", "mapping_state", "excerpt", "opinion"]
    return ingest.submission_result(src.units(spark, sf).select(*columns), reviews)


@query
def submission_unit_problems(spark, sf):
    units = src.catalog_units(spark, sf).select(
        F.col("review_id").alias("submission_id"),
        "unit_position",
        "review_text",
        "raw_aspect",
        "raw_status",
        F.when(F.col("sentiment") == "mixed", F.col("opinion"))
        .otherwise(F.col("excerpt"))
        .alias("excerpt"),
        "opinion",
        "sentiment",
        F.when(F.col("mapping_state") == MAPPED_EXACT, F.col("aspect")).alias("aspect"),
        "status",
        F.lit(None).cast("string").alias("aspect_cluster_id"),
        F.lit(None).cast("string").alias("status_cluster_id"),
    )
    found = submission.unit_problems(units, _canonical_pairs(spark, sf))
    return found.select(
        "submission_id",
        "unit_position",
        "resolved_aspect_id",
        "resolved_status_id",
        "catalog_comparison_eligible",
        F.concat_ws(",", "problems").alias("problems"),
    )


ORIGIN = bundles.Origin("import-1", "mapping-1", attributes_sha256="0" * 64)


def _imported(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return bundles.import_bundle(src.bundle(spark, sf), ORIGIN)


@query
def bundle_import(spark, sf):
    """Units of a bundle with the assignment of their number, if it has one, and their review's response."""
    return _imported(spark, sf)["opinion_units"].select(
        "opinion_unit_id",
        "source_opinion_unit_idx",
        "review_id",
        "unit_position",
        "raw_aspect",
        "raw_status",
        "sentiment",
        "mapping_state",
        "aspect_id",
        "status_id",
        "aspect_distance",
        "status_distance",
        "mapping_table_version_id",
        "extraction_response_sha256",
    )


@query
def bundle_import_reviews(spark, sf):
    """Reviews of a bundle beside their product and the number of their representative attributes."""
    tables = _imported(spark, sf)
    attributes = tables["representative_attributes"].groupBy("review_id").agg(F.count(F.lit(1)).alias("attribute_count"))
    named = tables["reviews"].join(tables["products"].select("product_id", "product_name", "category"), "product_id")
    return named.join(attributes, "review_id", "left").select(
        "review_id",
        "source_review_id",
        "external_review_idx",
        "product_id",
        "product_name",
        "category",
        "content_sha256",
        F.coalesce("attribute_count", F.lit(0)).alias("attribute_count"),
    )


@query
def report_inputs(spark, sf):
    """What a report reads of an imported bundle, after the checks of its keys, references and labels."""
    tables = _imported(spark, sf)
    joined = bundles.load_report_inputs(tables | {"opinion_units": cut_lineage(tables["opinion_units"])})["joined"]
    return joined.groupBy("product_name", "mapping_state").agg(
        F.count(F.lit(1)).alias("opinion_unit_count"), F.countDistinct("review_id").alias("review_count")
    )


@query
def encoded_texts(spark, sf):
    """Vectors of all raw expressions: statuses are known from an earlier run, the other texts are encoded."""
    units = src.units(spark, sf)
    none = spark.createDataFrame([], "text string, encoder_version string, embedding array<float>")
    factory = encode.character_encoder(16)
    earlier = cut_lineage(encode.encode_missing(units, none, factory, "characters-16", "raw_status"))
    texts = units.select(F.explode(F.array("raw_aspect", "raw_status")).alias("text"))
    vectors = encode.with_new_vectors(texts, earlier, factory, "characters-16")
    return vectors.select(
        "text",
        "encoder_version",
        F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double"))), ",").alias("entries"),
    )


@query
def one_to_one_merge(spark, sf):
    """Products beside their review counts, which have exactly one row for each other."""
    counts = product_review_counts(spark, sf).select("product_id", "review_count")
    return joins.one_to_one(src.products(spark, sf).select("product_id", "product_name"), counts, ["product_id"])


def _risky_statuses(pairs: DataFrame) -> DataFrame:
    """A list that stands in for a delivered one: statuses with a larger share of undecided votes than the average."""
    totals = pairs.filter(F.col("status_id").isNotNull()).groupBy("status_id").agg(
        (F.sum("unknown_count") / F.sum("supporting_review_count")).alias("risk")
    )
    average = F.broadcast(totals.agg(F.avg("risk").alias("average")))
    return totals.join(average, F.col("risk") > F.col("average") + 1e-12).select(
        F.lit("status").alias("stage"), F.col("status_id").alias("cluster_id")
    )


@query
def quality_flags_evaluation(spark, sf):
    """The five flags that risky clusters and a finished evaluation of some of them add."""
    pairs = cut_lineage(_counts(spark, sf, PAIR_KEYS))
    risky = cut_lineage(_risky_statuses(pairs))
    evaluated = risky.filter(F.col("cluster_id") < "m")
    raters = src.ratings(spark, sf).agg(F.countDistinct("rater_id").alias("evaluator_count"))
    return summary.evaluation_flags(
        src.products(spark, sf), summary.risk_overlap(pairs, risky), evaluation.risk_coverage(risky, evaluated), raters, 3
    )


@query
def staged_submissions(spark, sf):
    """Reviews of a customer staged as submitted ones, in the order of their position."""
    submitted = src.reviews(spark, sf, src.CUSTOMER).select(
        F.col("product_id").alias("submission_id"),
        F.concat(F.lit("demo-"), F.col("review_id")).alias("demo_review_id"),
        F.col("review_id").alias("position"),
        "product_id",
        "review_text",
    )
    staged = ingest.stage_submissions(submitted, src.products(spark, sf, src.CUSTOMER))
    kept = ingest.deduplicate(staged, _existing_hashes(spark, sf))
    return kept.select(
        "review_id", "source", "source_review_id", F.col("product_id").cast("string").alias("product_id"), "product_name",
        "content_sha256", "demo_review_id", "ordinal",
    )


@query
def repeated_responses(spark, sf):
    """Documents that more than one stored response claims: those whose line is a response and which are also labelled."""
    responses = src.document_responses(spark, sf).select(F.col("doc_id").alias("review_id"))
    again = src.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    return ingest.repeated_results(responses.unionByName(again))


DENIED_RULES = STATUS_CONSTRAINTS | {"core_similarity": 0.8}


@query
def opposed_expressions(spark, sf):
    """Raw expressions of an aspect that deny each other: a negative or mixed opinion denies what it names."""
    text = first_match(
        [
            (F.col("sentiment") == "negative", F.concat("raw_aspect", F.lit(" 아님"))),
            (F.col("sentiment") == "mixed", F.concat(F.lit("안 "), "raw_aspect")),
        ],
        F.col("raw_aspect"),
    )
    nodes = src.units(spark, sf).select(F.col("aspect_id").alias("boundary"), text.alias("text")).distinct()
    return taxonomy.cannot_link_pairs(nodes, DENIED_RULES)


@query
def unit_fingerprints(spark, sf):
    columns = ["opinion_unit_id", "raw_aspect", "raw_status", "sentiment", "unit_position"]
    return src.units(spark, sf).select("opinion_unit_id", fingerprint(*columns).alias("fingerprint"))


@query
def mapping_stats_changed(spark, sf):
    """Mapping statistics in which only labels count as mapped that the mapping changed."""
    changed = F.when(F.col("status_distance").isNotNull(), F.col("status_distance") > 0)
    units = src.mapped_units(spark, sf).withColumn("changed", changed)
    return summary.mapping_stats(units, ["product_id", *ASPECT_KEYS], "status_distance", applied="changed")


@query
def status_votes_known(spark, sf):
    """Votes on pairs that have a status; the others are no group of their own here."""
    known = votes.review_votes(src.mapped_units(spark, sf), PAIR_KEYS, drop_null_keys=True)
    return votes.count_votes(known, ["product_id", *PAIR_KEYS])


def _summary_rows(spark: SparkSession, sf: str, keys) -> DataFrame:
    mapped = _dealt_units(spark, sf)
    counts = votes.count_votes(votes.review_votes(mapped, keys), ["product_id", *keys])
    return summary.summary_rows(mapped, counts, _review_counts(spark, sf), keys)


@query
def aspect_summary_rows(spark, sf):
    return _summary_rows(spark, sf, ASPECT_KEYS)


@query
def pair_summary_rows(spark, sf):
    return _summary_rows(spark, sf, PAIR_KEYS)


@query
def primary_keys(spark, sf):
    """The key rules of the imported tables, and of the units as they are before their numbers are unique ids."""
    tables = _imported(spark, sf)
    names = ("products", "reviews", "opinion_units", "representative_attributes")
    return quality.report(quality.key_checks({name: tables[name] for name in names}))


@query
def contract_invariants(spark, sf):
    """What must hold of the ranked and selected rows of all reports."""
    mapped = _dealt_units(spark, sf)
    statistics = _statistics(spark, sf, mapped)
    checks = {
        "aspect_distributions": quality.distribution_violations(statistics.aspect_matrix),
        "pair_distributions": quality.distribution_violations(statistics.pair_matrix),
        "similar_products": quality.ranking_violations(similarity.similar_products(statistics.profile_arrays), 3),
        "weakness_repairs": quality.ranking_violations(statistics.weakness_repairs(), 3),
    }
    for name, keys, limit in (("aspect", ["aspect_id", "aspect"], 3), ("pair", ["aspect_id", "status_id", "aspect", "status"], 2)):
        rows = mapped if name == "aspect" else mapped.filter(F.col("status_id").isNotNull())
        selected = cut_lineage(summary.evidence(rows, keys, limit))
        listed = rows.join(selected.select("review_id"), "review_id", "left_semi")
        checks[f"{name}_evidence"] = quality.unsupported_evidence(selected, votes.review_votes(listed, keys), keys)
        checks[f"{name}_evidence_limit"] = selected.filter(F.col("evidence_rank") > limit)
    return quality.report(checks)


@query
def review_times(spark, sf):
    """Times of reviews as reports show them, from a timestamp and from a text."""
    moment = F.col("created_at") + F.make_dt_interval(secs=(F.col("review_id") % 86400).cast("decimal(18,6)"))
    text = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    given = F.when(F.col("review_id") % 5 == 0, F.date_format(moment, "yyyy-MM-dd HH:mm")).otherwise(text)
    return src.reviews(spark, sf).select(
        "review_id",
        display_time(moment, DISPLAY_TIME_ZONE).alias("shown"),
        compact_timestamp(given).alias("compact"),
    )


@query
def label_cells(spark, sf):
    """Part names with a syllable behind them as Markdown cells, with the particles that go with it."""
    code = F.lit(0xAC00) + F.col("p_partkey") % 11172
    syllable = F.decode(F.unhex(F.hex(code)), "UTF-16BE")
    label = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("|*", "p_name", syllable))
    share = F.when(F.col("p_partkey") % 7 > 0, (F.col("p_partkey") % 7) / F.lit(8.0))
    return src.table(spark, sf, "part").select(
        "p_partkey",
        md.cell(F.concat(label, F.lit("\n"), "p_type")).alias("cell"),
        md.bold(label).alias("bold"),
        md.topic_particle(label).alias("topic"),
        md.directional_particle(label).alias("direction"),
        md.fixed(share, 3).alias("fixed"),
        md.count_and_rate(F.col("p_partkey"), share).alias("share"),
    )


@query
def cluster_details_json(spark, sf):
    """The members of every cluster, read back from the cluster's JSON."""
    members = _label_members(spark, sf)
    details = cut_lineage(taxonomy.label_details(members, LABEL_SETTINGS))
    _, clusters = taxonomy.cluster_statistics(members, details, taxonomy.select_labels(details, LABEL_SETTINGS))
    return taxonomy.member_details(clusters).withColumnRenamed("expression", "text")


@query
def inbox_first_reviews(spark, sf):
    """The first four reviews of inbox files that hold ten ids each."""
    documents = src.document_inbox(spark, sf).withColumn("inbox_file", F.floor(F.col("ordinal") / 10).cast("string"))
    placed = F.struct("ordinal", F.struct(*INBOX.names).alias("review"))
    files = documents.groupBy("inbox_file").agg(F.to_json(F.sort_array(F.collect_list(placed))["review"]).alias("value"))
    first = inbox.inbox_elements(files, 4)
    return first.select("inbox_file", "ordinal", "source_review_id", "product_id", "category", F.length("review_text").alias("n_chars"))


@query
def parsed_attributes(spark, sf):
    """Representative attributes of each document's stored response: the first word of every line."""
    item = F.struct(F.concat(F.lit(" "), "raw_aspect", F.lit("\t")).alias("raw_attribute"), "sentiment")
    placed = F.struct("unit_position", item.alias("item"))
    responses = (
        src.document_units(spark, sf)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(placed)).alias("rows"))
        .select("doc_id", F.to_json(F.struct(F.col("rows.item").alias("representative_attributes"))).alias("response"))
    )
    return inbox.parse_attributes(responses, "doc_id")
