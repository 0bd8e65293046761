"""Normalization of raw expressions: exact lookup, nearest-cluster candidates, mapping states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cannot_link import cannot_link_matrix
from ..functions.sentiment import rounded
from ..functions.vectors import cosine_distance, distance_matrix, unit_matrix, unit_vector
from ..schemas import (
    CANDIDATE,
    DISTANCE_TOLERANCE,
    EXCLUDED,
    GENERAL_EXPERIENCE_ASPECTS,
    MAPPED_EXACT,
    STATUS_CONSTRAINTS,
)
from ..session import cut_lineage
from .joins import null_safe_join
from .tiles import block_pairs, slices


def near_statuses(vectors: DataFrame, maximum: float) -> DataFrame:
    """Other statuses of the same aspect within a cosine distance.

    ``vectors``: aspect_id, status_id, embedding. Only pairs within the distance leave a task.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        distances = distance_matrix(unit_matrix(left["embedding"]), unit_matrix(right["embedding"]))
        other = left["status_id"].to_numpy()[:, None] != right["status_id"].to_numpy()[None, :]
        rows, columns = np.nonzero(other & (distances <= maximum))
        return pd.DataFrame(
            {
                "aspect_id": left["aspect_id"].to_numpy()[rows],
                "status_id": left["status_id"].to_numpy()[rows],
                "near_status_id": right["status_id"].to_numpy()[columns],
                "distance": np.round(distances[rows, columns], 8),
            }
        )

    rows = vectors.select("aspect_id", "status_id", "embedding")
    return block_pairs(
        rows,
        rows,
        kernel,
        "aspect_id string, status_id string, near_status_id string, distance double",
        left_key=F.col("status_id"),
        right_key=F.col("status_id"),
        left_boundary=F.col("aspect_id"),
        right_boundary=F.col("aspect_id"),
    )


def centroids(members: DataFrame, keys: list[str]) -> DataFrame:
    """Length-one mean vector per cluster; components are averaged apart, with partial sums."""
    component = members.select(*keys, F.posexplode("embedding").alias("i", "x"))
    means = component.groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    listed = means.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")
    )
    return listed.select(*keys, unit_vector("v").alias("centroid"))


def cluster_distances(
    expressions: DataFrame,
    members: DataFrame,
    constraints: dict | None = None,
    block_rows: int = 2048,
) -> DataFrame:
    """Largest member distance of the clusters that can be first or second for an expression.

    ``expressions``: expression_id, boundary, text, embedding. ``members``: boundary, cluster_id,
    text, embedding, distance_threshold. A cluster normally lies in one block, and a block passes
    on each expression's two best clusters with all ties. A cluster too large for a block is split
    and passes on its partial maxima, which are combined here, so every maximum is complete.
    """
    sizes = members.groupBy("boundary", "cluster_id").agg(F.count(F.lit(1)).alias("__members"))
    split = F.col("__members") > block_rows // 4
    placed = (
        members.join(sizes, ["boundary", "cluster_id"])
        .withColumn("split", split)
        .withColumn("place", F.concat_ws("|", "cluster_id", F.when(split, F.col("text"))))
        .drop("__members")
    )

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("cluster_id", kind="stable").reset_index(drop=True)
        lefts, rights = unit_matrix(left["embedding"]), unit_matrix(right["embedding"])
        ids, starts = np.unique(right["cluster_id"].to_numpy().astype(str), return_index=True)
        farthest = np.empty((len(left), len(ids)))
        for part in slices(len(left), len(right), block_rows):
            distances = distance_matrix(lefts[part], rights)
            if constraints is not None:
                opposed = cannot_link_matrix(left["text"].iloc[part].tolist(), right["text"].tolist(), constraints)
                distances[opposed] = 2.0
            farthest[part] = np.maximum.reduceat(distances, starts, axis=1)
        threshold = right["distance_threshold"].to_numpy()[starts]
        partial = right["split"].to_numpy()[starts].astype(bool)
        outside = farthest > threshold + DISTANCE_TOLERANCE
        key = outside * 4.0 + farthest
        key[:, partial] = np.inf
        second = np.sort(key, axis=1)[:, min(1, key.shape[1] - 1)]
        keep = (key <= second[:, None]) | partial[None, :]
        rows, columns = np.nonzero(keep)
        return pd.DataFrame(
            {
                "expression_id": left["expression_id"].to_numpy()[rows],
                "boundary": left["boundary"].to_numpy()[rows],
                "cluster_id": ids[columns],
                "max_member_distance": farthest[rows, columns],
            }
        )

    kinds = dict(expressions.dtypes)
    found = block_pairs(
        expressions.select("expression_id", "boundary", "text", "embedding"),
        placed,
        kernel,
        f"expression_id {kinds['expression_id']}, boundary {kinds['boundary']}, "
        "cluster_id string, max_member_distance double",
        left_key=F.col("expression_id"),
        right_key=F.col("place"),
        left_boundary=F.col("boundary"),
        right_boundary=F.col("boundary"),
        left_rows=block_rows,
        right_rows=block_rows,
        grow=True,
    )
    return found.groupBy("expression_id", "boundary", "cluster_id").agg(
        F.max("max_member_distance").alias("max_member_distance")
    )


def nearest_clusters(
    expressions: DataFrame,
    members: DataFrame,
    clusters: DataFrame,
    constraints: dict | None = None,
    block_rows: int = 2048,
) -> DataFrame:
    """The best cluster of every unseen expression with its margin over the second best.

    Order: clusters the expression may join first, then largest member, centroid and canonical
    distance, then id. ``clusters``: boundary, cluster_id, label, distance_threshold, centroid,
    canonical.
    """
    distances = cluster_distances(expressions, members, constraints, block_rows)
    vectors = expressions.select("expression_id", "boundary", "embedding")
    joined = distances.join(clusters, ["boundary", "cluster_id"]).join(
        vectors, ["expression_id", "boundary"]
    )
    ranked = joined.select(
        "expression_id",
        "boundary",
        "cluster_id",
        "label",
        "max_member_distance",
        cosine_distance("embedding", "centroid").alias("centroid_distance"),
        cosine_distance("embedding", "canonical").alias("canonical_distance"),
        (
            F.col("max_member_distance") <= F.col("distance_threshold") + DISTANCE_TOLERANCE
        ).alias("eligible"),
    )
    order = W.partitionBy("expression_id", "boundary").orderBy(
        F.desc("eligible"),
        "max_member_distance",
        "centroid_distance",
        "canonical_distance",
        "cluster_id",
    )
    placed = ranked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2)
    first, second = F.col("n") == 1, F.col("n") == 2
    best = placed.groupBy("expression_id", "boundary").agg(
        *[
            F.max(F.when(first, F.col(name))).alias(name)
            for name in (
                "cluster_id",
                "label",
                "max_member_distance",
                "centroid_distance",
                "canonical_distance",
                "eligible",
            )
        ],
        F.max(F.when(second, F.col("max_member_distance"))).alias("second_distance"),
    )
    margin = F.col("second_distance") - F.col("max_member_distance")
    return best.select(
        "expression_id",
        "boundary",
        F.col("cluster_id").alias("suggested_id"),
        F.col("label").alias("suggested_label"),
        rounded(F.col("canonical_distance"), 8).alias("distance"),
        rounded(F.col("max_member_distance"), 8).alias("membership_max_distance"),
        rounded(F.col("centroid_distance"), 8).alias("centroid_distance"),
        rounded(F.col("second_distance"), 8).alias("second_nearest_distance"),
        rounded(margin, 8).alias("distance_margin"),
        F.col("eligible").alias("candidate_eligible"),
    )


_DIAGNOSTICS = (
    "membership_max_distance",
    "centroid_distance",
    "second_nearest_distance",
    "distance_margin",
    "candidate_eligible",
)


def exact_mapping(expressions: DataFrame, aspect_map: DataFrame, status_map: DataFrame) -> DataFrame:
    """Look raw aspects up, then raw statuses inside the aspect found.

    ``aspect_map``: raw_aspect, aspect_id, aspect, aspect_map_distance; ``status_map``: aspect_id,
    raw_status, status_id, status, status_map_distance. No broadcast is forced: Spark broadcasts a
    map only if its size allows, and splits hot keys otherwise.
    """
    return expressions.join(aspect_map, "raw_aspect", "left").join(
        status_map, ["aspect_id", "raw_status"], "left"
    )


def _suggestions(found: DataFrame, part: str, boundary: str | None) -> DataFrame:
    columns = [
        F.col("suggested_id").alias(f"suggested_{part}_id"),
        F.col("suggested_label").alias(f"suggested_{part}"),
        F.col("distance").alias(f"{part}_candidate_distance"),
        *[F.col(name).alias(f"{part}_{name}") for name in _DIAGNOSTICS],
    ]
    keys = [F.col("expression_id").alias(f"raw_{part}")]
    if boundary:
        keys.append(F.col("boundary").alias(boundary))
    return found.select(*keys, *columns)


def map_expressions(
    expressions: DataFrame,
    aspect_map: DataFrame,
    status_map: DataFrame,
    aspect_members: DataFrame,
    aspect_clusters: DataFrame,
    status_members: DataFrame,
    status_clusters: DataFrame,
    vectors: DataFrame,
    excluded_aspects=GENERAL_EXPERIENCE_ASPECTS,
    constraints: dict | None = STATUS_CONSTRAINTS,
) -> DataFrame:
    """Mapping decision of every distinct (raw_aspect, raw_status).

    Only expressions without an exact match are encoded and ranked. An unseen status is ranked
    inside its exact aspect, or inside the suggested aspect when the aspect is unseen too.
    ``vectors``: text, embedding.
    """
    distinct = expressions.select("raw_aspect", "raw_status").distinct()
    excluded = F.col("raw_aspect").isin(*excluded_aspects)
    distinct = cut_lineage(distinct)
    looked_up = exact_mapping(distinct.filter(~excluded), aspect_map, status_map)

    def with_vectors(df: DataFrame, text: str) -> DataFrame:
        return df.join(vectors.withColumnRenamed("text", text), text)

    unseen = looked_up.filter(F.col("aspect_id").isNull()).select("raw_aspect").distinct()
    aspects = nearest_clusters(
        with_vectors(unseen, "raw_aspect").select(
            F.col("raw_aspect").alias("expression_id"),
            F.lit("all").alias("boundary"),
            F.col("raw_aspect").alias("text"),
            "embedding",
        ),
        aspect_members.withColumn("boundary", F.lit("all")),
        aspect_clusters.withColumn("boundary", F.lit("all")),
    )
    unseen_status = F.col("raw_status").isNotNull() & F.col("status_id").isNull()
    located = cut_lineage(
        looked_up.join(_suggestions(aspects, "aspect", None), "raw_aspect", "left").withColumn(
            "search_aspect_id",
            F.when(unseen_status, F.coalesce("aspect_id", "suggested_aspect_id")),
        )
    )
    open_statuses = (
        located.filter(F.col("search_aspect_id").isNotNull())
        .select("search_aspect_id", "raw_status")
        .distinct()
    )
    statuses = nearest_clusters(
        with_vectors(open_statuses, "raw_status").select(
            F.col("raw_status").alias("expression_id"),
            F.col("search_aspect_id").alias("boundary"),
            F.col("raw_status").alias("text"),
            "embedding",
        ),
        status_members,
        status_clusters,
        constraints,
    )
    decided = located.join(
        _suggestions(statuses, "status", "search_aspect_id"),
        ["search_aspect_id", "raw_status"],
        "left",
    )
    is_exact = F.col("aspect_id").isNotNull() & (
        F.col("raw_status").isNull() | F.col("status_id").isNotNull()
    )
    mapped = decided.select(
        "raw_aspect",
        "raw_status",
        F.when(is_exact, F.lit(MAPPED_EXACT)).otherwise(F.lit(CANDIDATE)).alias("mapping_state"),
        "aspect_id",
        "aspect",
        "status_id",
        "status",
        *[
            column
            for part in ("aspect", "status")
            for column in (
                F.col(f"suggested_{part}_id"),
                F.col(f"suggested_{part}"),
                F.coalesce(
                    rounded(F.col(f"{part}_map_distance"), 8), F.col(f"{part}_candidate_distance")
                ).alias(f"{part}_distance"),
                *[F.col(f"{part}_{name}") for name in _DIAGNOSTICS],
            )
        ],
    )
    kept_out = distinct.filter(excluded).withColumn("mapping_state", F.lit(EXCLUDED))
    return mapped.unionByName(kept_out, allowMissingColumns=True)


def apply_mapping(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """Give every unit the decision of its expressions."""
    return null_safe_join(units, decisions, ["raw_aspect", "raw_status"], "left")
