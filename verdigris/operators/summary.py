"""Static catalog summaries, computed for all products together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sentiment import collapse_mask, rounded, vote_mask
from ..schemas import CANDIDATE, DISPLAY_LIMIT, EXCLUDED, MAPPED_EXACT, SENTIMENTS
from .joins import null_safe_join
from .votes import ASPECT_KEYS, PAIR_KEYS, with_distribution


def product_review_counts(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews per product; a product without reviews keeps a zero.

    Reviews are counted before they meet the product table, so a hot product is one row by then.
    """
    counted = (
        reviews.groupBy("product_id", "review_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("review_count"))
    )
    return products.join(counted, "product_id", "left").withColumn(
        "review_count", F.coalesce("review_count", F.lit(0).cast("long"))
    )


def mapping_stats(
    units: DataFrame, keys: Sequence[str], distance: str, applied: str | None = None
) -> DataFrame:
    """Eligible and mapped unit counts with exact interpolated percentiles of the distance.

    Rows are first reduced to (keys, distance) frequencies. A distance belongs to a mapping node,
    so a group holds at most as many frequencies as its cluster has expressions. ``applied``
    restricts the mapped rows to those whose label really changed.
    """
    mapped = F.col(distance).isNotNull()
    if applied:
        units = units.filter(F.col(applied).isNotNull())
        mapped = F.col(applied)
    value = F.when(mapped, F.col(distance).cast("double"))
    frequencies = units.groupBy(*keys, value.alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    quantiles = F.percentile("__d", F.array(F.lit(0.5), F.lit(0.95)), F.col("__n"))
    return (
        frequencies.groupBy(*keys)
        .agg(
            F.sum("__n").alias("eligible_opinion_unit_count"),
            F.sum(F.when(F.col("__d").isNotNull(), F.col("__n")).otherwise(0)).alias(
                "mapped_opinion_unit_count"
            ),
            quantiles.alias("__q"),
            F.max("__d").alias("__max"),
        )
        .select(
            *keys,
            "eligible_opinion_unit_count",
            "mapped_opinion_unit_count",
            rounded(
                F.col("mapped_opinion_unit_count") / F.col("eligible_opinion_unit_count")
            ).alias("mapping_rate"),
            rounded(F.col("__q")[0]).alias("distance_p50"),
            rounded(F.col("__q")[1]).alias("distance_p95"),
            rounded(F.col("__max")).alias("distance_max"),
        )
    )


def summary_order(keys: Sequence[str]) -> list:
    """Support first, then labels and ids; NULL status sorts as an empty string."""
    order = [F.desc("supporting_review_count"), F.asc("aspect")]
    if "status_id" in keys:
        order.append(F.coalesce("status", F.lit("")).asc())
    order.append(F.asc("aspect_id"))
    if "status_id" in keys:
        order.append(F.coalesce("status_id", F.lit("")).asc())
    return order


def sentiment_matrix(counts: DataFrame, review_counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranked summary row per product and aspect (or aspect-status) from its vote counts."""
    joined = counts.join(review_counts, "product_id")
    mention = F.col("supporting_review_count") / F.when(
        F.col("review_count") > 0, F.col("review_count")
    )
    rank = F.row_number().over(W.partitionBy("product_id").orderBy(*summary_order(keys)))
    return (
        with_distribution(joined)
        .withColumn("mention_rate", rounded(mention))
        .withColumn("rank", rank)
    )


def evidence(units: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Up to ``limit`` reviews per (product, keys, vote), each by its best-supporting unit.

    A unit agreeing with the vote comes first, then the smallest mapping distance, source index
    (NULL last), position and id. The best unit of a review is an aggregate; the final cut is a
    ranked window, which Spark already limits before the shuffle, so a hot group stays small.
    """
    distance = F.coalesce("aspect_distance", F.lit(0.0)) + F.coalesce(
        "status_distance", F.lit(0.0)
    )
    key = F.struct(
        distance.alias("d"),
        F.col("source_opinion_unit_idx").isNull().alias("no_idx"),
        F.coalesce("source_opinion_unit_idx", F.lit(0)).alias("idx"),
        F.col("unit_position").alias("pos"),
        F.col("opinion_unit_id").alias("id"),
        F.col("sentiment").alias("sentiment"),
    )
    grain = ["product_id", "review_id", *keys]
    best_by_label = [
        F.min(F.when(F.col("sentiment") == name, key)).alias(f"best_{name}") for name in SENTIMENTS
    ]
    per_review = units.groupBy(*grain).agg(
        collapse_mask(vote_mask(F.col("sentiment"))).alias("review_vote_sentiment"),
        F.min(key).alias("best_any"),
        *best_by_label,
    )
    agreeing = F.coalesce(
        *[
            F.when(F.col("review_vote_sentiment") == name, F.col(f"best_{name}"))
            for name in SENTIMENTS
        ]
    )
    chosen = per_review.select(
        *grain,
        "review_vote_sentiment",
        agreeing.isNull().alias("disagrees"),
        F.coalesce(agreeing, F.col("best_any")).alias("best"),
    )
    order = W.partitionBy("product_id", *keys, "review_vote_sentiment").orderBy(
        "disagrees", "best.d", "best.no_idx", "best.idx", "best.pos", "best.id"
    )
    return (
        chosen.withColumn("evidence_rank", F.row_number().over(order))
        .filter(F.col("evidence_rank") <= limit)
        .select(
            "product_id",
            *keys,
            "review_vote_sentiment",
            "evidence_rank",
            "review_id",
            F.col("best.id").alias("opinion_unit_id"),
            F.col("best.sentiment").alias("sentiment"),
        )
    )


def evidence_with_text(selected: DataFrame, units: DataFrame) -> DataFrame:
    """Add the unit's texts to the few selected rows."""
    texts = units.select(
        "opinion_unit_id",
        F.col("source_opinion_unit_idx").alias("opinion_unit_idx"),
        "review_text",
        "excerpt",
        "opinion",
        "raw_aspect",
        "raw_status",
        rounded(F.col("aspect_distance")).alias("aspect_mapping_distance"),
        rounded(F.col("status_distance")).alias("status_mapping_distance"),
    )
    return selected.join(texts, "opinion_unit_id")


def latest_review(reviews: DataFrame) -> DataFrame:
    """Newest review per product; the id breaks ties. An aggregate, so a hot product is no skew."""
    newest = reviews.groupBy("product_id").agg(
        F.max(F.struct("created_at", "review_id")).alias("newest")
    )
    return newest.select(
        "product_id",
        F.col("newest.review_id").alias("review_id"),
        F.col("newest.created_at").alias("created_at"),
    )


def latest_review_units(reviews: DataFrame, units: DataFrame) -> DataFrame:
    """The newest review of each product with its units (none: one row of NULLs)."""
    latest = latest_review(reviews)
    columns = ["unit_position", "raw_aspect", "aspect", "raw_status", "status"]
    picked = units.select("review_id", *columns, "excerpt", "opinion", "sentiment")
    return latest.join(picked, "review_id", "left")


def most_debated(matrix: DataFrame, top_limit: int = DISPLAY_LIMIT) -> DataFrame:
    """Among the top aspects, the one with the smallest positive-negative share gap."""
    gap = F.abs(
        F.coalesce("positive_share", F.lit(0.0)) - F.coalesce("negative_share", F.lit(0.0))
    )
    candidates = matrix.filter(
        (F.col("rank") <= top_limit) & (F.col("positive_count") + F.col("negative_count") > 0)
    ).withColumn("__gap", gap)
    order = W.partitionBy("product_id").orderBy(
        "__gap", F.desc("supporting_review_count"), "aspect", "aspect_id"
    )
    return (
        candidates.withColumn("__n", F.row_number().over(order))
        .filter(F.col("__n") == 1)
        .withColumn("positive_negative_rate_gap", rounded(F.col("__gap")))
        .withColumn("selection_scope", F.lit(f"top_{top_limit}_aspect_summary"))
        .drop("__n", "__gap")
    )


def top_negative(matrix: DataFrame, top_limit: int | None = None) -> DataFrame:
    """The row with the most negative votes, then share, support and the better rank."""
    rows = matrix.filter(F.col("negative_count") > 0)
    if top_limit:
        rows = rows.filter(F.col("rank") <= top_limit)
    order = W.partitionBy("product_id").orderBy(
        F.desc("negative_count"),
        F.desc(F.coalesce("negative_share", F.lit(0.0))),
        F.desc("supporting_review_count"),
        F.asc("rank"),
    )
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def normalization_reduction(units: DataFrame) -> DataFrame:
    """Distinct raw against distinct canonical values at three grains, per product.

    Counting distinct values runs on the distinct vocabulary of a product, not on its units.
    """
    vocabulary = units.select(
        "product_id", "raw_aspect", "raw_status", "aspect_id", "status_id"
    ).distinct()
    raw_status = F.when(F.col("raw_status").isNotNull(), F.struct("aspect_id", "raw_status"))
    counted = vocabulary.groupBy("product_id").agg(
        F.countDistinct("raw_aspect").alias("raw_aspect_count"),
        F.countDistinct("aspect_id").alias("aspect_count"),
        F.countDistinct(raw_status).alias("raw_status_count"),
        F.countDistinct("status_id").alias("status_count"),
        F.countDistinct(F.struct("raw_aspect", "raw_status")).alias("raw_pair_count"),
        F.countDistinct(F.struct("aspect_id", "status_id")).alias("pair_count"),
    )
    for grain in ("aspect", "status", "pair"):
        raw, canonical = F.col(f"raw_{grain}_count"), F.col(f"{grain}_count")
        rate = (raw - canonical) / F.when(raw > 0, raw)
        counted = counted.withColumn(f"{grain}_decrease_rate", rounded(rate))
    return counted


def coverage(units: DataFrame, review_counts: DataFrame, votes: DataFrame) -> DataFrame:
    """Unit, vote and review coverage per product, with excluded and candidate counts.

    ``units`` holds every mapping state; ``votes`` are the aspect-status votes. Reviews collapse to
    one row first, so no distinct count over raw units is needed.
    """
    per_review = units.groupBy("product_id", "review_id").agg(
        *[
            F.count_if(F.col("mapping_state") == state).alias(state)
            for state in (MAPPED_EXACT, EXCLUDED, CANDIDATE)
        ]
    )
    unit_counts = per_review.groupBy("product_id").agg(
        F.sum(MAPPED_EXACT).alias("opinion_unit_count"),
        F.count_if(F.col(MAPPED_EXACT) > 0).alias("covered_review_count"),
        F.sum(EXCLUDED).alias("excluded_opinion_unit_count"),
        F.count_if(F.col(EXCLUDED) > 0).alias("excluded_review_count"),
        F.sum(CANDIDATE).alias("candidate_opinion_unit_count"),
    )
    pairs = votes.groupBy("product_id", *PAIR_KEYS).agg(F.count(F.lit(1)).alias("n"))
    pair_counts = pairs.groupBy("product_id").agg(
        F.sum("n").alias("review_aspect_status_vote_count"),
        F.count(F.lit(1)).alias("unique_aspect_status_count"),
    )
    aspects = (
        votes.groupBy("product_id", "review_id", *ASPECT_KEYS)
        .agg(F.lit(1).alias("one"))
        .groupBy("product_id", *ASPECT_KEYS)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    aspect_counts = aspects.groupBy("product_id").agg(
        F.sum("n").alias("review_aspect_vote_count"),
        F.count(F.lit(1)).alias("unique_aspect_count"),
    )
    joined = (
        review_counts.join(unit_counts, "product_id", "left")
        .join(aspect_counts, "product_id", "left")
        .join(pair_counts, "product_id", "left")
    )
    zero = [c for c in joined.columns if c.endswith("_count")]
    filled = joined.fillna(0, subset=zero)
    covered = F.when(F.col("covered_review_count") > 0, F.col("covered_review_count"))
    total = F.when(F.col("review_count") > 0, F.col("review_count"))
    return filled.withColumn(
        "review_coverage_rate", rounded(F.col("covered_review_count") / total)
    ).withColumn("mean_units_per_covered_review", rounded(F.col("opinion_unit_count") / covered))


def quality_flags(coverage_rows: DataFrame) -> DataFrame:
    """One row per product and flag."""
    candidates = F.col("candidate_opinion_unit_count")
    pending = F.struct(
        F.lit("PENDING_MAPPING_CANDIDATES").alias("code"),
        F.when(candidates > 0, F.lit("warning")).otherwise(F.lit("info")).alias("severity"),
        candidates.cast("string").alias("value"),
        F.lit("excluded_from_canonical_report_aggregation").alias("implication"),
    )
    commerce = F.struct(
        F.lit("COMMERCE_CONTEXT_UNAVAILABLE").alias("code"),
        F.lit("warning").alias("severity"),
        F.lit("price,inventory,shipping,promotion").alias("value"),
        F.lit("review_experience_only_not_purchase_optimality").alias("implication"),
    )
    return coverage_rows.select(
        "product_id", F.inline(F.array(pending, commerce))
    )


def evaluation_flags(
    products: DataFrame, overlap: DataFrame, coverage: DataFrame, evaluators: DataFrame, minimum: int
) -> DataFrame:
    """The flags that a run's evaluation and its list of risky clusters add, for every product.

    ``overlap``: product_id, risky_cluster_count (see ``risk_overlap``). ``coverage``: bounded and evaluated risky
    clusters by stage. ``evaluators``: one row with evaluator_count, 0 where no evaluation was completed; then the two
    flags about the evaluation itself are left out. Both small tables are one row after their aggregates.
    """
    whole = coverage.agg(
        F.coalesce(F.sum("bounded_risky_cluster_count"), F.lit(0)).alias("bounded"),
        F.coalesce(F.sum("evaluated_risky_cluster_count"), F.lit(0)).alias("evaluated"),
    )
    rate = rounded(F.col("evaluated") / F.nullif(F.col("bounded"), F.lit(0)))
    rows = (
        products.select("product_id")
        .join(overlap.select("product_id", "risky_cluster_count"), "product_id", "left")
        .fillna(0, subset=["risky_cluster_count"])
        .join(F.broadcast(whole))
        .join(F.broadcast(evaluators.select("evaluator_count")))
        .withColumn("rate", rate)
    )
    done = F.col("evaluator_count") > 0

    def flag(code: str, warns: Column, value: Column, implication: Column) -> Column:
        severity = F.when(warns, F.lit("warning")).otherwise(F.lit("info"))
        return F.struct(
            F.lit(code).alias("code"),
            severity.alias("severity"),
            value.cast("string").alias("value"),
            implication.alias("implication"),
        )

    text = F.lit
    limited = F.concat_ws("/", "evaluated", "bounded", "rate")
    return rows.select(
        "product_id",
        F.inline(
            F.array_compact(
                F.array(
                    flag(
                        "HUMAN_EVALUATION_INCOMPLETE",
                        ~done,
                        ~done,
                        F.when(done, text("completed_human_evaluation_available")).otherwise(
                            text("normalization_quality_not_human_validated_for_this_run")
                        ),
                    ),
                    flag(
                        "REVIEW_TIMESTAMPS_UNAVAILABLE",
                        F.lit(True),
                        F.lit(True),
                        text("freshness_and_temporal_drift_unavailable"),
                    ),
                    flag(
                        "NORMALIZATION_RISK_CLUSTERS_PRESENT",
                        F.col("risky_cluster_count") > 0,
                        F.col("risky_cluster_count"),
                        text("inspect_cluster_lineage_before_high_stakes_use"),
                    ),
                    F.when(
                        done,
                        flag(
                            "HUMAN_EVALUATION_RISK_COVERAGE_LIMITED",
                            F.coalesce(F.col("rate") < 0.5, F.lit(False)),
                            limited,
                            text("sampled_cluster_scores_do_not_validate_all_risky_clusters"),
                        ),
                    ),
                    F.when(
                        done,
                        flag(
                            "HUMAN_EVALUATION_EVALUATOR_COUNT_AT_MINIMUM",
                            F.col("evaluator_count") == minimum,
                            F.concat_ws("/", "evaluator_count", F.lit(minimum)),
                            text("agreement_and_generalization_have_limited_precision"),
                        ),
                    ),
                )
            )
        ),
    )


def summary_rows(
    units: DataFrame,
    counts: DataFrame,
    review_counts: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """The full summary: sentiment matrix joined with mapping statistics at the same grain."""
    grain = ["product_id", *keys]
    parts = ["aspect", "status"] if "status_id" in keys else ["aspect"]
    result = sentiment_matrix(counts, review_counts, keys)
    for part in parts:
        stats = mapping_stats(units, grain, f"{part}_distance")
        renamed = stats.select(
            *grain,
            *[F.col(c).alias(f"{part}_{c}") for c in stats.columns if c not in grain],
        )
        result = null_safe_join(result, renamed, grain)
    return result


def risk_overlap(pairs: DataFrame, risky_clusters: DataFrame) -> DataFrame:
    """Risky clusters met by each product: semi-join its canonical ids with the risk table."""
    ids = pairs.select("product_id", F.col("aspect_id").alias("cluster_id")).unionByName(
        pairs.select("product_id", F.col("status_id").alias("cluster_id"))
    )
    return (
        ids.filter(F.col("cluster_id").isNotNull())
        .distinct()
        .join(risky_clusters.select("cluster_id"), "cluster_id", "left_semi")
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("risky_cluster_count"))
    )


def excluded_experience(units: DataFrame, reviews: DataFrame) -> DataFrame:
    """Units kept out of the taxonomy, counted per product of their review."""
    excluded = units.filter(F.col("mapping_state") == EXCLUDED)
    per_review = excluded.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_review.join(reviews.select("review_id", "product_id"), "review_id", "left")
        .groupBy("product_id")
        .agg(
            F.sum("n").alias("excluded_opinion_unit_count"),
            F.count(F.lit(1)).alias("excluded_review_count"),
        )
    )
