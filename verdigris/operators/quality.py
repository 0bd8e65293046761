"""Data-quality jobs: each check yields a row with its number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import grounded
from ..schemas import PRIMARY_KEYS
from .joins import repeated_keys


def check(name: str, violations: DataFrame) -> DataFrame:
    """One row (check, violations, passed)."""
    return violations.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed")
    )


def report(checks: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b), [check(name, rows) for name, rows in checks.items()]
    )


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys]))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that repeat; a key is unique and non-NULL if this and ``null_keys`` are empty."""
    return repeated_keys(df, keys)


def ambiguous_labels(units: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Ids that stand for more than one label or parent; counted over the distinct vocabulary."""
    distinct = units.select(key, *values).filter(F.col(key).isNotNull()).distinct()
    return distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def ungrounded(units: DataFrame, text: str = "review_text") -> DataFrame:
    return units.filter(~grounded(text, "excerpt"))


def varying_lineage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lineage combinations beyond the first: empty if every row shares one."""
    distinct = df.select(*columns).distinct()
    return distinct.exceptAll(distinct.orderBy(*columns).limit(1))


def invalid_embeddings(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Vectors that are missing, not finite, all zero or of another length."""
    vector = F.col(column)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall(vector, lambda v: v == 0.0)
    return vectors.filter(vector.isNull() | (F.size(vector) != dimension) | bad | zero)


def lost_rows(source: DataFrame, result: DataFrame) -> DataFrame:
    """Rows of either table missing in the other: empty if source columns were preserved."""
    columns = source.columns
    # One pass over both: a row that one table has n times more comes out n times.
    both = source.withColumn("__n", F.lit(1)).unionByName(result.select(*columns).withColumn("__n", F.lit(-1)))
    more = both.groupBy(*columns).agg(F.abs(F.sum("__n")).alias("__n")).filter(F.col("__n") > 0)
    return more.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__n")).drop("__n")


def distribution_violations(matrix: DataFrame) -> DataFrame:
    """Rows of a sentiment matrix that break its invariants."""
    names = ("positive", "negative", "mixed", "neutral", "unknown")
    counts = sum((F.col(f"{name}_count") for name in names), F.lit(0))
    shares = sum((F.col(f"{name}_share") for name in names), F.lit(0.0))
    bounds = [
        F.col(name).between(0.0, 1.0)
        for name in (
            "positive_wilson_lower",
            "positive_wilson_upper",
            "negative_wilson_lower",
            "negative_wilson_upper",
            "normalized_entropy",
        )
    ]
    fine = reduce(lambda a, b: a & b, bounds)
    fine = fine & (counts == F.col("supporting_review_count")) & (F.abs(shares - 1.0) < 1e-5)
    return matrix.filter(~fine)


def key_checks(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Violations of each table's primary key by table and rule: key values that repeat, and rows without one."""
    checks = {}
    for name, table in tables.items():
        keys = PRIMARY_KEYS[name]
        checks[f"{name}_unique"] = check_unique(table, keys)
        checks[f"{name}_not_null"] = null_keys(table, keys)
    return checks


def unsupported_evidence(selected: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence listed under a sentiment that its review did not vote for."""
    voted = votes.select("product_id", "review_id", *keys, F.col("vote").alias("review_vote_sentiment"))
    return selected.join(voted, voted.columns, "left_anti")


def ranking_violations(ranked: DataFrame, limit: int) -> DataFrame:
    """Recommendations of the source itself, or beyond the allowed rank."""
    return ranked.filter((F.col("source_id") == F.col("candidate_id")) | (F.col("rank") > limit))


def schema_difference(df: DataFrame, required: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names."""
    return sorted(set(required) - set(df.columns)), sorted(set(df.columns) - set(required))
