"""Incremental ingestion: inbox to committed reviews and mapped opinion units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import derived_id
from ..operators import ingest, mapping
from ..schemas import (
    GENERAL_EXPERIENCE_ASPECTS,
    OPINION_UNITS,
    PENDING_REVIEWS,
    PRODUCTS,
    QUARANTINED_UNITS,
    REVIEWS,
    STATUS_CONSTRAINTS,
)
from ..session import cut_lineage
from ..sources.catalog import CatalogStore
from ..sources.inbox import parse_units


@dataclass(frozen=True)
class TaxonomyTables:
    """The active taxonomy as the mapping operators read it, and vectors of raw texts."""

    aspect_map: DataFrame
    status_map: DataFrame
    aspect_members: DataFrame
    aspect_clusters: DataFrame
    status_members: DataFrame
    status_clusters: DataFrame
    vectors: DataFrame
    excluded_aspects: tuple = GENERAL_EXPERIENCE_ASPECTS
    constraints: dict | None = None


@dataclass(frozen=True)
class Lineage:
    """Version columns stamped on every new unit."""

    prompt_version_id: str
    model_version_id: str
    mapping_table_version_id: str
    embedding_model_version_id: str
    normalization_run_id: str
    normalization_config_sha256: str


def conform(df: DataFrame, schema) -> DataFrame:
    """Order and cast columns to a table schema; absent ones become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def map_units(units: DataFrame, taxonomy: TaxonomyTables) -> DataFrame:
    decisions = mapping.map_expressions(
        units,
        taxonomy.aspect_map,
        taxonomy.status_map,
        taxonomy.aspect_members,
        taxonomy.aspect_clusters,
        taxonomy.status_members,
        taxonomy.status_clusters,
        taxonomy.vectors,
        taxonomy.excluded_aspects,
        taxonomy.constraints or STATUS_CONSTRAINTS,
    )
    return mapping.apply_mapping(units, decisions)


def ingest_run(
    store: CatalogStore,
    staged: DataFrame,
    responses: DataFrame,
    taxonomy: TaxonomyTables,
    lineage: Lineage,
    run_id: str,
    on_invalid: str = "fail",
) -> bool:
    """Commit one run; False if it was committed before.

    ``responses``: content_sha256, response, response_sha256 - the stored extraction of each text;
    two different ones of a text are refused. A review without one is not committed but kept in
    ``pending_reviews`` and tried again by every later run. With ``on_invalid="quarantine"`` invalid
    units go to ``quarantined_units`` with the rules they break.
    """
    if store.is_committed(run_id):
        return False
    existing = store.read("reviews").select("content_sha256")
    waiting = store.read("pending_reviews").drop("pending_run_id")
    fresh = cut_lineage(ingest.deduplicate(staged.unionByName(waiting.select(staged.columns)), existing))
    stored = cut_lineage(responses.select("content_sha256", "response", "response_sha256").distinct())
    if not stored.groupBy("content_sha256").count().filter("count > 1").isEmpty():
        raise ValueError("a text has more than one stored response")
    kept = fresh.join(stored, "content_sha256", "left_semi").select(fresh.columns)
    pending = fresh.join(stored, "content_sha256", "left_anti").select(fresh.columns)
    now = F.current_timestamp()
    found = kept.select("review_id", "review_text", "content_sha256").join(stored, "content_sha256")
    context = found.select("review_id", "review_text", "response_sha256")
    units = parse_units(found, "review_id").join(context, "review_id")
    valid, rejected = ingest.validate_units(units, on_invalid)
    mapped = map_units(cut_lineage(valid), taxonomy)
    stamped = mapped.withColumns(
        {
            "opinion_unit_id": derived_id("ou-", "review_id", "unit_position"),
            "extraction_response_sha256": F.col("response_sha256"),
            "ingestion_run_id": F.lit(run_id),
            "created_at": now,
            **{name: F.lit(value) for name, value in vars(lineage).items()},
        }
    )
    reviews = kept.withColumns({"ingestion_run_id": F.lit(run_id), "created_at": now})
    products = ingest.new_products(store.read("products"), kept, run_id).withColumn(
        "created_at", now
    )
    new_units = cut_lineage(conform(stamped, OPINION_UNITS))
    new_reviews = conform(reviews, REVIEWS)
    return store.commit(
        run_id,
        {
            "products": conform(products, PRODUCTS),
            "reviews": new_reviews,
            "opinion_units": new_units,
            "quarantined_units": conform(
                rejected.withColumn("ingestion_run_id", F.lit(run_id)), QUARANTINED_UNITS
            ),
            "pending_reviews": conform(
                pending.withColumn("pending_run_id", F.lit(run_id)), PENDING_REVIEWS
            ),
        },
        ingest.commit_receipt(new_reviews, new_units, run_id),
    )
