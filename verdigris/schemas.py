"""Constants and table schemas of the catalog."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Results must agree on them.
SENTIMENTS = ("positive", "negative", "mixed", "neutral", "unknown")
KNOWN_SENTIMENTS = ("positive", "negative", "mixed", "neutral")
MAPPED_EXACT = "mapped_exact"
CANDIDATE = "candidate"
EXCLUDED = "excluded_taxonomy"
WILSON_Z = 1.959963984540054
PRIOR_STRENGTH = 5.0
MINIMUM_WEAKNESS_SUPPORT = 2
RELATED_PRODUCT_LIMIT = 3
WEAKNESS_LIMIT = 10
DISPLAY_LIMIT = 10
SIMILARITY_WEIGHT = 0.25
UTILITY_WEIGHT = 0.75
LOW_OVERLAP = 0.2
LOW_RELIABILITY = 0.5
ASPECT_DISTANCE_THRESHOLD = 0.3591
STATUS_DISTANCE_THRESHOLD = 0.20
DISTANCE_TOLERANCE = 1e-6
NAMING_TOLERANCE = 1e-12
CENTRALITY_WEIGHT = 0.70
REBUILD_CANDIDATE_THRESHOLD = 100
SUBMISSION_REVIEW_LIMIT = 20
SUBMISSION_TEXT_LIMIT = 10_000
GENERAL_EXPERIENCE_ASPECTS = ("전반적 상품 경험",)
NON_PRODUCT_TERMS = ("배송", "배달", "포장", "서비스", "사은품", "증정", "쿠폰")
DEFAULT_INBOX_SOURCE = "catalog_inbox"
SUBMISSION_SOURCE = "demo_ui"
DEFAULT_CATEGORY = "모니터"
DISPLAY_TIME_ZONE = "Asia/Seoul"

# Which status expressions may never share a cluster.
STATUS_CONSTRAINTS = {
    "opposition_groups": [
        (("있음", "존재", "발생"), ("없음", "부재", "미발생")),
        (("좋음", "만족", "우수함"), ("나쁨", "불만", "불량")),
        (("빠름", "신속함"), ("느림", "지연")),
        (("가벼움",), ("무거움",)),
        (("높음",), ("낮음",)),
        (("밝음",), ("어두움",)),
        (("큼",), ("작음",)),
        (("편리함",), ("불편함",)),
    ],
    "suffix_pairs": [("있음", "없음"), ("발생", "미발생")],
    "negation_suffixes": ["지 않음", "아님"],
    "negation_tokens": ["안", "못"],
    "negation_enabled": True,
    "core_similarity": 0.65,
}

# Aspect expressions that can never be a canonical label.
ASPECT_LABEL_STOP_LIST = ("좋음", "나쁨", "만족", "불만", "추천", "아쉬움", "긍정", "부정", "중립")


def _fields(kind, names: str, nullable: bool = True) -> list[StructField]:
    return [StructField(name, kind, nullable) for name in names.split()]


_S, _L, _I, _D, _B, _T = (
    StringType(),
    LongType(),
    IntegerType(),
    DoubleType(),
    BooleanType(),
    TimestampType(),
)
_V = ArrayType(DoubleType())


def _diagnostics(part: str) -> list[StructField]:
    return (
        _fields(_S, f"suggested_{part}_id suggested_{part}")
        + _fields(
            _D,
            f"{part}_distance {part}_membership_max_distance {part}_centroid_distance "
            f"{part}_second_nearest_distance {part}_distance_margin",
        )
        + _fields(_B, f"{part}_candidate_eligible")
    )


PRODUCTS = StructType(
    _fields(_S, "product_id product_name category first_seen_run_id", False)
    + _fields(_T, "created_at", False)
)
REVIEWS = StructType(
    _fields(_S, "review_id source", False)
    + _fields(_S, "source_review_id")
    + _fields(_L, "external_review_idx")
    + _fields(_S, "product_id review_text content_sha256 ingestion_run_id", False)
    + _fields(_S, "demo_review_id")
    + _fields(_T, "created_at", False)
)
MAPPING_COLUMNS = (
    _fields(_S, "mapping_state", False)
    + _fields(_S, "aspect_id aspect status_id status")
    + _diagnostics("aspect")
    + _diagnostics("status")
)
OPINION_UNITS = StructType(
    _fields(_S, "opinion_unit_id", False)
    + _fields(_L, "source_opinion_unit_idx")
    + _fields(_S, "review_id", False)
    + _fields(_I, "unit_position", False)
    + _fields(_S, "raw_aspect", False)
    + _fields(_S, "raw_status")
    + _fields(_S, "excerpt opinion sentiment", False)
    + MAPPING_COLUMNS
    + _fields(
        _S,
        "prompt_version_id model_version_id mapping_table_version_id embedding_model_version_id "
        "normalization_run_id normalization_config_sha256 extraction_response_sha256 "
        "ingestion_run_id",
        False,
    )
    + _fields(_T, "created_at", False)
)
REPRESENTATIVE_ATTRIBUTES = StructType(
    _fields(_S, "representative_attribute_id", False)
    + _fields(_L, "source_attribute_idx", False)
    + _fields(_S, "review_id raw_attribute sentiment source_artifact_sha256 ingestion_run_id", False)
    + _fields(_T, "created_at", False)
)
_NODE_TAIL = (
    _fields(_S, "canonical_label naming_status", False)
    + _fields(_B, "mapping_applied", False)
    + _fields(_D, "mapping_distance", False)
    + _fields(_L, "source_row_count unique_review_count", False)
    + _fields(_V, "embedding", False)
)
ASPECT_MAPPING_TABLE = StructType(
    _fields(_S, "mapping_table_version_id raw_aspect aspect_cluster_id", False) + _NODE_TAIL
)
STATUS_MAPPING_TABLE = StructType(
    _fields(_S, "mapping_table_version_id aspect_cluster_id raw_status status_cluster_id", False)
    + _NODE_TAIL
)
_CLUSTER_TAIL = (
    _fields(_S, "canonical_label medoid_label naming_status", False)
    + _fields(_L, "member_count source_row_count unique_review_count", False)
    + _fields(_D, "distance_threshold naming_max_distance cluster_max_distance", False)
    + _fields(
        _D,
        "representative_average_distance representative_max_distance "
        "representative_centroid_distance",
    )
    + _fields(ArrayType(_S), "member_expressions", False)
    + _fields(_S, "member_details_json", False)
    + _fields(_V, "centroid_embedding canonical_embedding", False)
)
ASPECT_CLUSTERS = StructType(
    _fields(_S, "mapping_table_version_id aspect_cluster_id", False) + _CLUSTER_TAIL
)
STATUS_CLUSTERS = StructType(
    _fields(_S, "mapping_table_version_id aspect_cluster_id status_cluster_id", False)
    + _CLUSTER_TAIL
    + _fields(_L, "cannot_link_pair_count_in_boundary", False)
)
TAXONOMY_VERSIONS = StructType(
    _fields(_S, "mapping_table_version_id normalization_run_id normalization_config_sha256", False)
    + _fields(
        _L,
        "aspect_mapping_count aspect_cluster_count status_mapping_count status_cluster_count",
        False,
    )
    + _fields(_T, "created_at", False)
)
TAXONOMY_REBUILDS = StructType(
    _fields(
        _S,
        "recluster_run_id mapping_table_version_id embedding_model_version_id "
        "captured_snapshot_checksum",
        False,
    )
    + _fields(_L, "captured_opinion_unit_count carried_forward_opinion_unit_count", False)
    + _fields(_T, "created_at", False)
)
CATALOG_COMMITS = StructType(
    _fields(_S, "run_id", False)
    + _fields(_T, "committed_at", False)
    + _fields(_L, "review_count opinion_unit_count candidate_count", False)
    + _fields(_S, "versions_json delta_checksum", False)
)
INBOX = StructType(
    _fields(_S, "source source_review_id product_id product_name category review_text")
)
UNIT_PAYLOAD = StructType(_fields(_S, "raw_aspect raw_status excerpt opinion sentiment"))
# Reviews whose response is not there yet, as they were staged.
PENDING_REVIEWS = StructType(
    _fields(
        _S,
        "review_id source source_review_id product_id product_name category review_text content_sha256 demo_review_id",
    )
    + _fields(_L, "ordinal")
    + _fields(_S, "inbox_file pending_run_id")
)
# Which ingestion runs a mapping version holds the units of.
TAXONOMY_CAPTURES = StructType(_fields(_S, "mapping_table_version_id ingestion_run_id", False))
# Extracted units that break a rule, with the rules.
QUARANTINED_UNITS = StructType(
    _fields(_S, "review_id")
    + _fields(_L, "unit_position")
    + _fields(_S, "raw_aspect raw_status excerpt opinion sentiment")
    + [StructField("violations", ArrayType(StringType()))]
    + _fields(_S, "ingestion_run_id")
)

TABLES = {
    "products": PRODUCTS,
    "reviews": REVIEWS,
    "opinion_units": OPINION_UNITS,
    "representative_attributes": REPRESENTATIVE_ATTRIBUTES,
    "aspect_mapping_table": ASPECT_MAPPING_TABLE,
    "status_mapping_table": STATUS_MAPPING_TABLE,
    "aspect_clusters": ASPECT_CLUSTERS,
    "status_clusters": STATUS_CLUSTERS,
    "taxonomy_versions": TAXONOMY_VERSIONS,
    "taxonomy_captures": TAXONOMY_CAPTURES,
    "taxonomy_rebuilds": TAXONOMY_REBUILDS,
    "catalog_commits": CATALOG_COMMITS,
    "pending_reviews": PENDING_REVIEWS,
    "quarantined_units": QUARANTINED_UNITS,
}
PRIMARY_KEYS = {
    "products": ["product_id"],
    "reviews": ["review_id"],
    "opinion_units": ["opinion_unit_id"],
    "representative_attributes": ["representative_attribute_id"],
    "aspect_mapping_table": ["mapping_table_version_id", "raw_aspect"],
    "status_mapping_table": ["mapping_table_version_id", "aspect_cluster_id", "raw_status"],
    "aspect_clusters": ["mapping_table_version_id", "aspect_cluster_id"],
    "status_clusters": ["mapping_table_version_id", "status_cluster_id"],
    "taxonomy_versions": ["mapping_table_version_id"],
    "taxonomy_captures": ["mapping_table_version_id", "ingestion_run_id"],
    "taxonomy_rebuilds": ["recluster_run_id"],
    "catalog_commits": ["run_id"],
}
