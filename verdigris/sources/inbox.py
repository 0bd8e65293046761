"""Readers of new reviews, stored extraction responses and review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import non_blank, strip
from ..schemas import INBOX, UNIT_PAYLOAD


def inbox_elements(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviews of whole JSON array files (value, inbox_file) with their place: inbox_file and ordinal, from 0.

    The place comes from the array itself, so it is the same however the files are dealt out or read again. A file that
    is no such array has no reviews; ``limit`` keeps the first elements of each file.
    """
    elements = F.posexplode(F.from_json("value", ArrayType(INBOX))).alias("ordinal", "review")
    rows = files.select("inbox_file", elements).select("review.*", "inbox_file", F.col("ordinal").cast("long"))
    return rows if limit is None else rows.filter(F.col("ordinal") < limit)


def read_inbox(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON array files of reviews, each read whole, with the place of every review (see ``inbox_elements``)."""
    files = spark.read.option("wholetext", True).text(path)
    return inbox_elements(files.select("value", F.col("_metadata.file_path").alias("inbox_file")), limit)


def read_inbox_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with a JSON review on each line, for files too large for one task, with the place of every review.

    ``ordinal`` grows with the line: the byte at which a block of the file begins, and the number of the row in its
    task. A block has more bytes than a task has rows, so the order of a file's lines doesn't depend on the blocks.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.schema(INBOX).json(path)
    return rows.select(
        *INBOX.names,
        F.col("_metadata.file_path").alias("inbox_file"),
        (F.col("_metadata.file_block_start") + in_task).alias("ordinal"),
    )


def read_responses(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One stored raw response per file: its review id is the file name, its hash is of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("review_id"),
        F.sha2(F.col("content"), 256).alias("response_sha256"),
        F.decode("content", "UTF-8").alias("response"),
    )


def missing_responses(reviews: DataFrame, responses: DataFrame) -> DataFrame:
    """Reviews without a stored response; must be empty before an import."""
    ids = reviews.select(F.col("review_id").cast("string").alias("review_id"))
    return ids.join(responses.select("review_id"), "review_id", "left_anti")


def normalize_review_files(frame: DataFrame) -> DataFrame:
    """Accept exactly one spelling of the product column and name columns alike."""
    spellings = [name for name in ("productName", "product_name") if name in frame.columns]
    if len(spellings) != 1:
        raise ValueError("reviews need exactly one of productName and product_name")
    for name in ("idx", "review"):
        if name not in frame.columns:
            raise ValueError(f"reviews need a column {name}")
    return frame.select(
        F.col("idx").alias("review_idx"),
        "review",
        F.col(spellings[0]).alias("product_name"),
    )


def review_file_violations(reviews: DataFrame) -> DataFrame:
    """Rows of normalized review files that break the key or text rules, with a reason."""
    repeated = (
        reviews.groupBy("review_idx")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) | F.col("review_idx").isNull())
        .select("review_idx", F.lit("REPEATED_OR_NULL_IDX").alias("reason"))
    )
    blank = reviews.filter(~non_blank("review") | ~non_blank("product_name")).select(
        "review_idx", F.lit("BLANK_TEXT").alias("reason")
    )
    return repeated.unionByName(blank)


def parse_units(responses: DataFrame, key: str, payload: str = "response") -> DataFrame:
    """Units of each response with their 1-based position; an unreadable response has none."""
    schema = StructType([StructField("opinion_units", ArrayType(UNIT_PAYLOAD))])
    parsed = F.from_json(payload, schema)["opinion_units"]
    return responses.select(key, F.posexplode(parsed).alias("place", "unit")).select(
        key, (F.col("place") + 1).alias("unit_position"), "unit.*"
    )


def parse_attributes(responses: DataFrame, key: str, payload: str = "response") -> DataFrame:
    """Representative attributes of each response: one per row, stripped."""
    item = StructType(
        [StructField("raw_attribute", StringType()), StructField("sentiment", StringType())]
    )
    schema = StructType([StructField("representative_attributes", ArrayType(item))])
    parsed = F.from_json(payload, schema)["representative_attributes"]
    return responses.select(key, F.posexplode(parsed).alias("place", "item")).select(
        key,
        (F.col("place") + 1).alias("attribute_position"),
        strip("item.raw_attribute").alias("raw_attribute"),
        F.col("item.sentiment").alias("sentiment"),
    )
