"""Reading tables and small column rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be long, so a batch holds fewer rows than Spark's default.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session, which Python workers hold whole."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def hash_share(key: str, count: Column | int, rows: int) -> Column:
    """Whether a row belongs to a share of about ``3 * rows`` of ``count`` rows, chosen by the hash of its key.

    Cutting a bounded sample out of this share needs no more than that many rows in one place, however many tasks
    there are. Of fewer rows, all belong to it.
    """
    total = count if isinstance(count, Column) else F.lit(count)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 31)).cast("double")
    return place * total < F.lit(3.0 * rows * (1 << 31))
