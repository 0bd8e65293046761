"""Import of a delivered bundle of Parquet files: declarative projections onto the catalog's tables.

A bundle holds review, unit and attribute files, the unit assignments of a finished normalization, the four files of
its taxonomy, and one stored response for every review. Each target table is one projection of one file; units
are joined with their assignments (a unit without one was kept out of the taxonomy) and with their review's response.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import content_hash, derived_id
from ..operators import quality
from ..operators.joins import many_to_one
from ..schemas import DEFAULT_CATEGORY, EXCLUDED, MAPPED_EXACT, TABLES

#: Files of a bundle, and the columns each must have.
FILES = {
    "reviews": "idx productName review",
    "opinion_units": "idx review_idx raw_aspect raw_status excerpt opinion sentiment",
    "representative_attributes": "idx review_idx raw_attribute sentiment",
    "assignments": (
        "idx aspect_cluster_id aspect status_cluster_id status aspect_mapping_distance status_mapping_distance"
    ),
    "responses": "review_idx response_sha256",
}
#: Files of a taxonomy, by the table they become; cluster_id takes the name of its table's part.
TAXONOMY_FILES = {
    "aspect_nodes": ("aspect_mapping_table", {"cluster_id": "aspect_cluster_id"}),
    "aspect_clusters": ("aspect_clusters", {"cluster_id": "aspect_cluster_id"}),
    "status_nodes": ("status_mapping_table", {"cluster_id": "status_cluster_id"}),
    "status_clusters": (
        "status_clusters",
        {
            "cluster_id": "status_cluster_id",
            "status_cannot_link_pair_count_in_boundary": "cannot_link_pair_count_in_boundary",
        },
    ),
}


@dataclass(frozen=True)
class Origin:
    """Lineage stamped on what a bundle brings."""

    run_id: str
    mapping_table_version_id: str
    prompt_version_id: str = ""
    model_version_id: str = ""
    embedding_model_version_id: str = ""
    normalization_run_id: str = ""
    normalization_config_sha256: str = ""
    attributes_sha256: str = ""
    source: str = "legacy_parquet"
    product_prefix: str = "monitor-"
    id_prefix: str = "legacy-"


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The Parquet files of a bundle's folder, by name, with the columns that are needed; others are not read."""
    found = {name: spark.read.parquet(f"{folder}/{name}.parquet").select(*columns.split()) for name, columns in FILES.items()}
    return found | {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TAXONOMY_FILES}


def _id(origin: Origin, kind: str, number: str) -> Column:
    return F.concat(F.lit(f"{origin.id_prefix}{kind}-"), F.col(number).cast("string"))


def _product(origin: Origin) -> Column:
    return derived_id(origin.product_prefix, "productName")


def _projected(df: DataFrame, columns: dict[str, Column], schema: StructType) -> DataFrame:
    """``columns`` by the names of a table, typed; those the projection doesn't name are NULL."""
    return df.select(
        *(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields)
    )


def answered(reviews: DataFrame, responses: DataFrame) -> DataFrame:
    """``reviews`` with response_sha256; fails where a review has no response, or more than one."""
    known = responses.select(F.col("review_idx").alias("idx"), "response_sha256")
    joined = many_to_one(reviews, known, ["idx"])
    message = F.concat(F.lit("no stored response of review "), F.col("idx").cast("string"))
    stop = F.raise_error(message).cast("boolean")  # in a filter, which no unread column takes away
    return joined.filter(F.when(F.col("response_sha256").isNull(), stop).otherwise(F.lit(True)))


def import_bundle(bundle: dict[str, DataFrame], origin: Origin) -> dict[str, DataFrame]:
    """The catalog tables of a bundle. Repeated assignments or responses of a unit or review fail at run time.

    Null raw statuses stay, null texts are empty for the content hash, and empty files give empty tables. Rows of units
    whose review isn't in the bundle are left out, as the inner join with the responses says.
    """
    now, run = F.current_timestamp(), F.lit(origin.run_id)
    reviews = answered(bundle["reviews"], bundle["responses"])
    stamped = {"ingestion_run_id": run, "created_at": now}
    tables = {
        "products": _projected(
            bundle["reviews"].select("productName").distinct(),
            {
                "product_id": _product(origin),
                "product_name": F.col("productName"),
                "category": F.lit(DEFAULT_CATEGORY),
                "first_seen_run_id": run,
                "created_at": now,
            },
            TABLES["products"],
        ),
        "reviews": _projected(
            reviews,
            {
                "review_id": _id(origin, "review", "idx"),
                "source": F.lit(origin.source),
                "source_review_id": F.col("idx"),
                "external_review_idx": F.col("idx"),
                "product_id": _product(origin),
                "review_text": F.col("review"),
                "content_sha256": content_hash(F.coalesce("review", F.lit(""))),
                **stamped,
            },
            TABLES["reviews"],
        ),
        "representative_attributes": _projected(
            bundle["representative_attributes"],
            {
                "representative_attribute_id": _id(origin, "ra", "idx"),
                "source_attribute_idx": F.col("idx"),
                "review_id": _id(origin, "review", "review_idx"),
                "raw_attribute": F.col("raw_attribute"),
                "sentiment": F.col("sentiment"),
                "source_artifact_sha256": F.lit(origin.attributes_sha256),
                **stamped,
            },
            TABLES["representative_attributes"],
        ),
    }
    position = F.row_number().over(W.partitionBy("review_idx").orderBy("idx"))
    marked = bundle["assignments"].withColumn("assigned", F.lit(True))
    hashes = reviews.select(F.col("idx").alias("review_idx"), "response_sha256")
    # Assignments come to the review of their unit, so that units dealt by review stay where they are.
    named = many_to_one(bundle["opinion_units"].select("idx", "review_idx"), marked, ["idx"])
    known = named.filter(F.col("assigned") & F.col("review_idx").isNotNull())
    entry = F.struct(*[name for name in known.columns if name != "review_idx"])
    listed = known.groupBy("review_idx").agg(F.collect_list(entry).alias("__known"))
    own = F.get(F.filter("__known", lambda a: a["idx"] == F.col("idx")), F.lit(0))
    placed = bundle["opinion_units"].withColumn("unit_position", position).join(hashes, "review_idx")
    units = placed.join(listed, "review_idx", "left").withColumn("__own", own).select(
        *placed.columns, *[F.col(f"__own.{name}").alias(name) for name in marked.columns if name != "idx"]
    )
    lineage = {
        name: F.lit(getattr(origin, name))
        for name in (
            "prompt_version_id",
            "model_version_id",
            "mapping_table_version_id",
            "embedding_model_version_id",
            "normalization_run_id",
            "normalization_config_sha256",
        )
    }
    same = "unit_position raw_aspect raw_status excerpt opinion sentiment aspect status".split()
    tables["opinion_units"] = _projected(
        units,
        {
            "opinion_unit_id": _id(origin, "ou", "idx"),
            "source_opinion_unit_idx": F.col("idx"),
            "review_id": _id(origin, "review", "review_idx"),
            "mapping_state": F.when(F.col("assigned"), F.lit(MAPPED_EXACT)).otherwise(F.lit(EXCLUDED)),
            "aspect_id": F.col("aspect_cluster_id"),
            "status_id": F.col("status_cluster_id"),
            "aspect_distance": F.col("aspect_mapping_distance"),
            "status_distance": F.col("status_mapping_distance"),
            "extraction_response_sha256": F.col("response_sha256"),
            **{name: F.col(name) for name in same},
            **lineage,
            **stamped,
        },
        TABLES["opinion_units"],
    )
    for file, (table, renamed) in TAXONOMY_FILES.items():
        if file in bundle:
            names = {renamed.get(name, name): F.col(name) for name in bundle[file].columns}
            version = {"mapping_table_version_id": F.lit(origin.mapping_table_version_id)}
            tables[table] = _projected(bundle[file], names | version, TABLES[table])
    return tables


def load_report_inputs(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables a report reads and ``joined``, their units with review and product, after checks that must hold.

    Fails if a key is null or repeats, a unit lacks its review, a review its product, or an id has two labels.
    """
    units, reviews, products = tables["opinion_units"], tables["reviews"], tables["products"]
    checks = {
        "units repeat": quality.check_unique(units, ["opinion_unit_id"]),
        "reviews repeat": quality.check_unique(reviews, ["review_id"]),
        "products repeat": quality.check_unique(products, ["product_id"]),
        "units without an id": quality.null_keys(units, ["opinion_unit_id", "review_id"]),
        "units without their review": quality.orphans(units, reviews, "review_id"),
        "reviews without their product": quality.orphans(reviews, products, "product_id"),
        "aspect ids with several labels": quality.ambiguous_labels(units, "aspect_id", ["aspect"]),
        "status ids with several labels": quality.ambiguous_labels(units, "status_id", ["aspect_id", "status"]),
    }
    wrong = [row["check"] for row in quality.report(checks).collect() if not row["passed"]]  # one row for each check
    if wrong:
        raise ValueError(f"report inputs are not valid: {', '.join(sorted(wrong))}")
    named = reviews.select("review_id", "product_id", "review_text").join(
        products.select("product_id", "product_name", "category"), "product_id"
    )
    return tables | {"joined": units.join(named, "review_id")}
