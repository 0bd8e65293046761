"""Staging, de-duplication, validation and delta assembly of new reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import (
    content_hash,
    derived_id,
    grounded,
    non_blank,
    strip,
    valid_sentiment,
)
from ..schemas import (
    CANDIDATE,
    DEFAULT_CATEGORY,
    DEFAULT_INBOX_SOURCE,
    REBUILD_CANDIDATE_THRESHOLD,
    SUBMISSION_REVIEW_LIMIT,
    SUBMISSION_SOURCE,
    SUBMISSION_TEXT_LIMIT,
)


def _place(reviews: DataFrame) -> list[str]:
    """The columns that order reviews: file and place, or the place alone where there are no files."""
    return ["inbox_file", "ordinal"] if "inbox_file" in reviews.columns else ["ordinal"]


def stage_inbox(inbox: DataFrame) -> DataFrame:
    """Defaults, stripped text, content hash and an id derived from the natural key.

    Reviews come in order of inbox_file and ordinal; an inbox without files needs no inbox_file.
    """
    file = F.col("inbox_file") if "inbox_file" in inbox.columns else F.lit("")
    source = F.coalesce("source", F.lit(DEFAULT_INBOX_SOURCE))
    text = strip("review_text")
    return inbox.select(
        derived_id("review-", source, "source_review_id").alias("review_id"),
        source.alias("source"),
        F.col("source_review_id").cast("string").alias("source_review_id"),
        F.col("product_id").cast("string").alias("product_id"),
        "product_name",
        F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        text.alias("review_text"),
        content_hash("review_text").alias("content_sha256"),
        F.lit(None).cast("string").alias("demo_review_id"),
        "ordinal",
        file.alias("inbox_file"),
    )


def stage_submissions(submitted: DataFrame, products: DataFrame) -> DataFrame:
    """Submitted reviews (submission_id, position, demo_review_id, product_id, review_text)."""
    named = submitted.join(products.select("product_id", "product_name", "category"), "product_id")
    return named.select(
        derived_id("review-", F.lit(SUBMISSION_SOURCE), "demo_review_id").alias("review_id"),
        F.lit(SUBMISSION_SOURCE).alias("source"),
        F.col("demo_review_id").alias("source_review_id"),
        "product_id",
        "product_name",
        F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        "review_text",
        content_hash("review_text").alias("content_sha256"),
        "demo_review_id",
        F.col("position").cast("long").alias("ordinal"),
        F.col("submission_id").cast("string").alias("inbox_file"),
    )


def submission_violations(submitted: DataFrame) -> DataFrame:
    """Submissions outside 1-20 reviews, or with a blank or overlong review."""
    length = F.length(strip("review_text"))
    checked = submitted.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.count_if(F.coalesce(length, F.lit(0)) == 0).alias("blank_count"),
        F.count_if(length > SUBMISSION_TEXT_LIMIT).alias("overlong_count"),
    )
    return checked.filter(
        (F.col("review_count") > SUBMISSION_REVIEW_LIMIT)
        | (F.col("blank_count") > 0)
        | (F.col("overlong_count") > 0)
    )


def deduplicate(staged: DataFrame, existing_hashes: DataFrame) -> DataFrame:
    """Keep reviews whose text is new to the catalog, the first of equal ones in the batch.

    A submitted review is an event and stays even if its text is known; it repeats only if its
    submission id does. The key of a review is therefore its submission id or its content hash.
    The ranked window keeps one row per key in every input partition before the shuffle, so a
    text copied into a third of all rows is no hot group.
    """
    is_submission = F.col("source") == SUBMISSION_SOURCE
    keyed = staged.withColumn(
        "__key",
        F.when(is_submission, F.concat(F.lit("s|"), "demo_review_id")).otherwise(
            F.concat(F.lit("h|"), "content_sha256")
        ),
    )
    known = existing_hashes.select(F.concat(F.lit("h|"), "content_sha256").alias("__key"))
    order = W.partitionBy("__key").orderBy(*_place(staged), "review_id")
    first = keyed.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == 1)
    return first.join(known, "__key", "left_anti").drop("__n", "__key")


def duplicate_count(staged: DataFrame, kept: DataFrame) -> DataFrame:
    """Number of staged reviews that were dropped, in one row."""
    counts = staged.select(F.lit(1).alias("n")).unionByName(kept.select(F.lit(-1).alias("n")))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_count"))


def unit_violations(units: DataFrame) -> DataFrame:
    """Every unit with the list of rules it breaks; ``units`` carries its ``review_text``."""
    blank_status = F.col("raw_status").isNotNull() & ~non_blank("raw_status")
    rules = [
        (~non_blank("raw_aspect"), "BLANK_ASPECT"),
        (blank_status, "BLANK_STATUS"),
        (~non_blank("excerpt"), "BLANK_EXCERPT"),
        (non_blank("excerpt") & ~grounded("review_text", "excerpt"), "UNGROUNDED_EXCERPT"),
        (~non_blank("opinion"), "BLANK_OPINION"),
        (~valid_sentiment("sentiment"), "INVALID_SENTIMENT"),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for rule, code in rules]))
    return units.withColumn("violations", found)


def validate_units(units: DataFrame, on_invalid: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(valid units with stripped text, invalid units) under a policy.

    ``drop`` filters invalid items alone, ``quarantine`` returns them, ``fail`` makes the job fail
    when an invalid unit is met.
    """
    checked = unit_violations(units)
    valid = F.size("violations") == 0
    if on_invalid == "fail":
        message = F.concat(F.lit("invalid opinion unit: "), F.concat_ws(",", "violations"))
        stop = F.raise_error(message).cast("boolean")
        kept = checked.filter(F.when(valid, F.lit(True)).otherwise(stop))
        rejected = checked.filter(F.lit(False))
    elif on_invalid in ("drop", "quarantine"):
        kept = checked.filter(valid)
        rejected = checked.filter(~valid if on_invalid == "quarantine" else F.lit(False))
    else:
        raise ValueError(f"unknown policy: {on_invalid}")
    cleaned = kept.withColumns(
        {name: strip(name) for name in ("raw_aspect", "raw_status", "opinion")}
    )
    return cleaned.drop("violations"), rejected


def repeated_results(results: DataFrame) -> DataFrame:
    """Reviews with more than one extraction result."""
    return results.groupBy("review_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def new_products(existing: DataFrame, reviews: DataFrame, run_id: str) -> DataFrame:
    """Products of new reviews that the catalog lacks, as their first review names them."""
    first = reviews.groupBy("product_id").agg(
        F.min(F.struct(*_place(reviews), "product_name", "category")).alias("first")
    )
    named = first.select(
        "product_id", "first.product_name", "first.category", F.lit(run_id).alias("first_seen_run_id")
    )
    return named.join(existing.select("product_id"), "product_id", "left_anti")


def commit_receipt(reviews: DataFrame, units: DataFrame, run_id: str) -> DataFrame:
    """One row of counts and an order-free checksum of what a run adds."""
    unit_counts = units.agg(
        F.count(F.lit(1)).alias("opinion_unit_count"),
        F.count_if(F.col("mapping_state") == CANDIDATE).alias("candidate_count"),
        F.coalesce(F.bit_xor(F.xxhash64("opinion_unit_id")), F.lit(0)).alias("units_checksum"),
    ).withColumn("run_id", F.lit(run_id))
    review_counts = reviews.agg(
        F.count(F.lit(1)).alias("review_count"),
        F.coalesce(F.bit_xor(F.xxhash64("review_id")), F.lit(0)).alias("reviews_checksum"),
    ).withColumn("run_id", F.lit(run_id))
    return review_counts.join(unit_counts, "run_id").select(
        "run_id",
        "review_count",
        "opinion_unit_count",
        "candidate_count",
        F.concat_ws("-", F.hex("reviews_checksum"), F.hex("units_checksum")).alias("delta_checksum"),
    )


def rebuild_recommendation(
    units: DataFrame, run: str, threshold: int = REBUILD_CANDIDATE_THRESHOLD
) -> DataFrame:
    """Candidate units per run and whether they call for a rebuild."""
    counted = units.groupBy(run).agg(
        F.count(F.lit(1)).alias("opinion_unit_count"),
        F.count_if(F.col("mapping_state") == CANDIDATE).alias("candidate_count"),
    )
    return counted.withColumn("recommended", F.col("candidate_count") >= threshold)


def submission_result(units: DataFrame, reviews: DataFrame) -> DataFrame:
    """Units of submitted reviews with all diagnostics, in order of position inside each review."""
    submitted = reviews.filter(F.col("demo_review_id").isNotNull()).select(
        "review_id", "demo_review_id"
    )
    return (
        submitted.join(units, "review_id")
        .drop("review_id", "opinion_unit_id")
        .repartition("demo_review_id")
        .sortWithinPartitions("demo_review_id", "unit_position")
    )
