"""Rebuilding the taxonomy: nodes, constrained complete linkage, labels, cluster statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cannot_link import cannot_link_matrix
from ..functions.sentiment import first_match, rounded
from ..functions.vectors import cosine_distance, distance_matrix, unit_matrix
from ..schemas import (
    ASPECT_DISTANCE_THRESHOLD,
    ASPECT_LABEL_STOP_LIST,
    CENTRALITY_WEIGHT,
    DISTANCE_TOLERANCE,
    EXCLUDED,
    GENERAL_EXPERIENCE_ASPECTS,
    MAPPED_EXACT,
    NAMING_TOLERANCE,
    STATUS_CONSTRAINTS,
    STATUS_DISTANCE_THRESHOLD,
)
from ..session import cut_and_observe, cut_lineage
from .components import connected_components
from .joins import many_to_one, null_safe_join
from .mapping import centroids
from .tiles import block_pairs, slices


@dataclass(frozen=True)
class ClusterSettings:
    """Thresholds of one clustering stage."""

    threshold: float
    naming_max: float
    label_stop_list: tuple = ()
    constraints: dict | None = None
    minimum_reviews: int = 1
    minimum_margin: float = 0.0
    local_boundary_rows: int = 1500
    block_rows: int = 2048


ASPECT_SETTINGS = ClusterSettings(
    ASPECT_DISTANCE_THRESHOLD, ASPECT_DISTANCE_THRESHOLD, ASPECT_LABEL_STOP_LIST
)
STATUS_SETTINGS = ClusterSettings(
    STATUS_DISTANCE_THRESHOLD, STATUS_DISTANCE_THRESHOLD, (), STATUS_CONSTRAINTS
)


#: Rounds of merges between two searches for components.
MERGE_ROUNDS = 8


class Taxonomy(NamedTuple):
    assignments: DataFrame
    aspect_nodes: DataFrame
    aspect_clusters: DataFrame
    status_nodes: DataFrame
    status_clusters: DataFrame


def expression_nodes(units: DataFrame, text: str, boundary: Column) -> DataFrame:
    """Distinct expressions per boundary with their unit count and distinct review count."""
    per_review = units.groupBy(boundary.alias("boundary"), F.col(text).alias("text"), "review_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_review.groupBy("boundary", "text").agg(
        F.sum("n").alias("source_row_count"), F.count(F.lit(1)).alias("unique_review_count")
    )


def _linkage_rounds(distances: np.ndarray, threshold: float) -> np.ndarray:
    """Complete linkage under a threshold: merge mutual nearest neighbours until none is left.

    Complete linkage is reducible, so merging all mutual pairs of a round gives the clusters of
    one-by-one merging. Ties go to the earlier rows.
    """
    size = len(distances)
    labels = np.arange(size)
    active = np.where(distances < threshold, distances, np.inf)
    np.fill_diagonal(active, np.inf)
    while True:
        nearest = active.argmin(1)
        reach = active[np.arange(size), nearest]
        mutual = np.isfinite(reach) & (nearest[nearest] == np.arange(size))
        keep = np.flatnonzero(mutual & (np.arange(size) < nearest))
        if not len(keep):
            return labels
        gone = nearest[keep]
        active[keep] = np.maximum(active[keep], active[gone])
        active[:, keep] = np.maximum(active[:, keep], active[:, gone])
        active[gone] = np.inf
        active[:, gone] = np.inf
        active[keep, keep] = np.inf
        renamed = np.arange(size)
        renamed[gone] = keep
        labels = renamed[labels]


def linkage_edges(nodes: DataFrame, settings: ClusterSettings) -> DataFrame:
    """Pairs of nodes (boundary, node, text, embedding) under the threshold that may share a cluster, lo < hi.

    A row whose ``lo`` is -1 carries a block's number of opposed pairs instead. Nodes are numbers, in the order of
    their texts, so that an edge is 24 bytes however long its texts are.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        low, high = left["node"].to_numpy(), right["node"].to_numpy()
        lefts, rights = unit_matrix(left["embedding"]), unit_matrix(right["embedding"])
        texts = left["text"].to_numpy(), right["text"].tolist()
        found, opposed_pairs = [], 0
        for part in slices(len(left), len(right), settings.block_rows):
            kept = low[part][:, None] < high[None, :]
            if settings.constraints is not None:
                opposed = kept & cannot_link_matrix(texts[0][part].tolist(), texts[1], settings.constraints)
                opposed_pairs += int(opposed.sum())
                kept &= ~opposed
            distances = distance_matrix(lefts[part], rights)
            rows, columns = np.nonzero(kept & (distances < settings.threshold))
            found.append(pd.DataFrame({"lo": low[part][rows], "hi": high[columns], "d": distances[rows, columns]}))
        edges = pd.concat(found, ignore_index=True)
        if opposed_pairs:
            edges.loc[len(edges)] = (-1, -1, float(opposed_pairs))
        return edges.astype({"lo": "int64", "hi": "int64"}).assign(boundary=left["boundary"].iloc[0])

    rows = nodes.select("boundary", "node", "text", "embedding")
    return block_pairs(
        rows,
        rows,
        kernel,
        "boundary string, lo long, hi long, d double",
        left_key=F.col("node"),
        right_key=F.col("node"),
        left_boundary=F.col("boundary"),
        right_boundary=F.col("boundary"),
        left_rows=settings.block_rows,
        right_rows=settings.block_rows,
        grow=True,
    )


def cannot_link_pairs(nodes: DataFrame, constraints: dict, block_rows: int = 2048) -> DataFrame:
    """Opposed status pairs (lo < hi) inside each boundary; only these pairs leave a task."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        low, high = left["text"].to_numpy(), right["text"].to_numpy()
        opposed = cannot_link_matrix(low.tolist(), high.tolist(), constraints)
        rows, columns = np.nonzero(opposed & (low[:, None] < high[None, :]))
        pairs = pd.DataFrame({"lo": low[rows], "hi": high[columns]})
        return pairs.assign(boundary=left["boundary"].iloc[0])

    rows = nodes.select(F.col("boundary").cast("string").alias("boundary"), "text")
    return block_pairs(
        rows,
        rows,
        kernel,
        "boundary string, lo string, hi string",
        left_key=F.col("text"),
        right_key=F.col("text"),
        left_boundary=F.col("boundary"),
        right_boundary=F.col("boundary"),
        left_rows=block_rows,
        right_rows=block_rows,
    )


def _mutual_pairs(edges: DataFrame) -> DataFrame:
    """Edges that are the first choice, by (distance, lo, hi), of both their ends."""
    best = F.struct("d", "lo", "hi")
    choice = edges.select(F.explode(F.array("lo", "hi")).alias("node"), best.alias("e"))
    chosen = choice.groupBy("node").agg(F.min("e").alias("e"))
    return (
        chosen.groupBy(F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 2")
        .select("lo", "hi")
    )


def _merged_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges between the merged clusters: the largest distance, if every crossing pair is an edge."""
    roles = merges.select(F.explode(F.array("lo", "hi")).alias("node"), F.col("lo").alias("cluster"))
    named = edges
    for end in ("lo", "hi"):
        role = roles.select(F.col("node").alias(end), F.col("cluster").alias(f"{end}_cluster"))
        named = named.join(role, end, "left")
    size = F.lit(1)
    for end in ("lo", "hi"):
        size = size * F.when(F.col(f"{end}_cluster").isNull(), 1).otherwise(2)
    a, b = F.coalesce("lo_cluster", "lo"), F.coalesce("hi_cluster", "hi")
    sized = named.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "d", size.alias("size"))
    # An edge between two nodes that stay is alone already.
    return sized.filter("size = 1").select("lo", "hi", "d").unionByName(
        sized.filter((F.col("size") > 1) & (F.col("lo") != F.col("hi")))
        .groupBy("lo", "hi")
        .agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        .filter(F.col("n") == F.col("size"))
        .select("lo", "hi", "d")
    )


def _link_part(edges: pd.DataFrame) -> pd.DataFrame:
    """node, cluster (its smallest node) of one part, from all of its edges; what isn't an edge never merges."""
    nodes, ends = np.unique(edges[["lo", "hi"]].to_numpy(), return_inverse=True)
    lo, hi = ends.reshape(-1, 2).T
    distances = np.full((len(nodes), len(nodes)), np.inf)
    distances[lo, hi] = distances[hi, lo] = edges["d"].to_numpy()
    return pd.DataFrame({"node": nodes, "cluster": nodes[_linkage_rounds(distances, np.inf)]})


def _renamed(kept: DataFrame | None, merges: DataFrame) -> DataFrame:
    """node, cluster after the merges (lo, hi), for all nodes that any merge has moved."""
    step = merges.select(F.col("hi").alias("node"), F.col("lo").alias("cluster"))
    if kept is None:
        return step
    onward = merges.select(F.col("hi").alias("cluster"), F.col("lo").alias("further"))
    moved = kept.join(onward, "cluster", "left").select("node", F.coalesce("further", "cluster").alias("cluster"))
    return cut_lineage(moved.unionByName(step))


def linked_nodes(edges: DataFrame, part_nodes: int) -> DataFrame:
    """node, cluster of complete linkage over ``edges`` (part, lo, hi, d), for the nodes that have edges.

    Nodes of different components can never merge. A part with at most ``part_nodes`` nodes is linked in one task
    group; a larger one goes through rounds of joins that merge all its mutual nearest neighbours at once, after which
    it falls into smaller components. The rounds come first, since each leaves far fewer edges for the search for
    components. Parts that are linked leave the table, so no round touches them again.
    """
    kept: DataFrame | None = None
    linked: list[DataFrame] = []
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        ends = edges.select("part", F.explode(F.array("lo", "hi")).alias("node"))
        sizes = ends.distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        over, found = cut_and_observe(sizes.filter(F.col("n") > part_nodes).select("part"))
        small = edges.join(over, "part", "left_anti") if found["rows"] else edges
        linked.append(
            small.repartition(tasks, "part").groupBy("part").applyInPandas(
                lambda group: _link_part(group), "node long, cluster long"
            )
        )
        if not found["rows"]:
            break
        large, left = edges.join(over, "part", "left_semi").drop("part"), 1
        for _ in range(MERGE_ROUNDS):
            merges = cut_lineage(_mutual_pairs(large))
            kept = _renamed(kept, merges)
            large, found = cut_and_observe(_merged_edges(large, merges))
            left = found["rows"]
            if not left:
                break
        if not left:
            break
        parts = connected_components(large).select(F.col("node").alias("lo"), F.col("component").alias("part"))
        edges = cut_lineage(large.join(parts, "lo").select("part", "lo", "hi", "d"))
    found = reduce(DataFrame.unionByName, linked)
    if kept is None:
        return found
    found = cut_lineage(found)
    last = found.select(F.col("node").alias("cluster"), F.col("cluster").alias("last"))
    moved = kept.join(last, "cluster", "left").select("node", F.coalesce("last", "cluster").alias("cluster"))
    return found.unionByName(moved)


def complete_linkage(nodes: DataFrame, settings: ClusterSettings) -> DataFrame:
    """Clusters of ``nodes`` (boundary, text, embedding): boundary, text, cluster (smallest text).

    Complete linkage needs only the pairs under its threshold: they are found block by block, and ``linked_nodes``
    links them part by part (a part is a boundary to begin with).
    """
    ordered = nodes.select(F.col("boundary").cast("string").alias("boundary"), "text", "embedding")
    # Ranges come in order, so the numbers do too; written, they stay.
    numbered = cut_lineage(ordered.orderBy("boundary", "text").withColumn("node", F.monotonically_increasing_id()))
    found = cut_lineage(linkage_edges(numbered, settings))
    opposed = found.filter("lo < 0").groupBy("boundary").agg(
        F.sum("d").cast("long").alias("cannot_link_pair_count")
    )
    edges = found.filter("lo >= 0").select(F.col("boundary").alias("part"), "lo", "hi", "d")
    clusters = linked_nodes(edges, settings.local_boundary_rows)
    heads = numbered.select(F.col("node").alias("cluster"), F.col("text").alias("cluster_text"))
    return (
        numbered.select("boundary", "text", "node")
        .join(clusters, "node", "left")
        .withColumn("cluster", F.coalesce("cluster", "node"))
        .join(heads, "cluster")
        .join(opposed, "boundary", "left")
        .select("boundary", "text", F.col("cluster_text").alias("cluster"), "cannot_link_pair_count")
        .fillna(0, subset=["cannot_link_pair_count"])
    )


def sequential_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows 1.. in a global order without one task seeing them all.

    Rows are range-partitioned and kept; each range is numbered apart and shifted by the sizes of
    the ranges before it.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    kept = cut_lineage(ranged)
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return kept.join(offsets, "__part").withColumn(name, number).drop("__part", "__before")


def sequential_ids(df: DataFrame, order: list[str], name: str, prefix: str) -> DataFrame:
    """Number rows in a global order as ids of at least six digits."""
    numbered = sequential_numbers(df, order, name)
    return numbered.withColumn(name, F.format_string(f"{prefix}%06d", F.col(name)))  # widens from a million on


def member_distances(members: DataFrame, block_rows: int = 2048) -> DataFrame:
    """Average and largest distance of every node to the other members of its cluster."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        distances = distance_matrix(unit_matrix(left["embedding"]), unit_matrix(right["embedding"]))
        distances[left["text"].to_numpy()[:, None] == right["text"].to_numpy()[None, :]] = 0.0
        return pd.DataFrame(
            {
                "cluster_id": left["cluster_id"],
                "text": left["text"],
                "total": distances.sum(1),
                "largest": distances.max(1),
                "seen": len(right),
            }
        )

    rows = members.select("cluster_id", "text", "embedding")
    partial = block_pairs(
        rows,
        rows,
        kernel,
        "cluster_id string, text string, total double, largest double, seen long",
        left_key=F.col("text"),
        right_key=F.col("text"),
        left_boundary=F.col("cluster_id"),
        right_boundary=F.col("cluster_id"),
        left_rows=block_rows,
        right_rows=block_rows,
    )
    others = F.sum("seen") - 1
    return partial.groupBy("cluster_id", "text").agg(
        F.when(others > 0, F.sum("total") / others).otherwise(F.lit(0.0)).alias("average_distance"),
        F.max("largest").alias("max_distance"),
        F.sum("seen").alias("member_count"),
    )


def candidate_limit(size: Column) -> Column:
    """How many central members may become the label (fixed values)."""
    return first_match(
        [(size == 1, F.lit(1)), (size == 2, F.lit(2)), (size < 10, F.lit(3))], F.lit(5)
    )


def label_details(members: DataFrame, settings: ClusterSettings, forbidden: DataFrame | None = None):
    """Every member with its centrality, frequency and combined label score.

    ``forbidden``: cluster_id, text pairs that may not be a label.
    """
    measured = members.join(member_distances(members, settings.block_rows), ["cluster_id", "text"])
    blocked = F.lit(False)
    if settings.label_stop_list:
        blocked = blocked | F.col("text").isin(*settings.label_stop_list)
    if forbidden is not None:
        marks = forbidden.select("cluster_id", "text").distinct().withColumn("__hit", F.lit(True))
        measured = measured.join(marks, ["cluster_id", "text"], "left")
        blocked = blocked | F.coalesce("__hit", F.lit(False))
    central_order = W.partitionBy("cluster_id").orderBy("average_distance", "text")
    placed = measured.withColumn("central_rank", F.row_number().over(central_order)).withColumn(
        "role_filter_passed", ~blocked
    )
    central = F.col("central_rank") <= candidate_limit(F.col("member_count"))
    placed = placed.withColumn("central_candidate", central)
    single = F.col("member_count") == 1
    eligible = F.col("central_candidate") & (F.col("role_filter_passed") | single)
    logs = F.log1p(F.col("unique_review_count").cast("double"))
    top_logs = placed.filter(eligible).groupBy("cluster_id").agg(F.max(logs).alias("__top"))
    scored = placed.join(top_logs, "cluster_id", "left")
    centrality = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("average_distance") / 2.0)
    )
    frequency = F.when(F.col("__top") > 0, logs / F.col("__top")).otherwise(F.lit(1.0))
    combined = F.lit(CENTRALITY_WEIGHT) * centrality + F.lit(1.0 - CENTRALITY_WEIGHT) * frequency
    one = F.lit(1.0)
    return (
        scored.withColumn("eligible", eligible)
        .withColumn("centrality", F.when(eligible, F.when(single, one).otherwise(centrality)))
        .withColumn("frequency_score", F.when(eligible, F.when(single, one).otherwise(frequency)))
        .withColumn("combined_score", F.when(eligible, F.when(single, one).otherwise(combined)))
        .drop("__top", "__hit")
    )


def select_labels(details: DataFrame, settings: ClusterSettings) -> DataFrame:
    """Medoid, canonical label (or NULL) and naming status per cluster, all as aggregates."""
    key = F.struct(
        (-F.col("combined_score")).alias("k0"),
        F.col("average_distance").alias("k1"),
        (-F.col("unique_review_count")).alias("k2"),
        F.col("text").alias("text"),
        F.col("max_distance").alias("max_distance"),
    )
    scores = F.sort_array(F.collect_list(F.when(F.col("eligible"), key)))
    grouped = details.groupBy("cluster_id").agg(
        F.max("member_count").alias("member_count"),
        F.max("max_distance").alias("cluster_max_distance"),
        F.min(F.struct("average_distance", "text")).alias("medoid"),
        scores.alias("ranked"),
    )
    first = F.when(F.size("ranked") > 0, F.col("ranked")[0])
    margin = F.when(F.size("ranked") > 1, F.col("ranked")[1]["k0"] - F.col("ranked")[0]["k0"])
    named = grouped.withColumn("first", first).withColumn("margin", margin)
    status = first_match(
        [
            (F.col("member_count") == 1, F.lit("singleton_inherited")),
            (
                F.col("cluster_max_distance") > settings.naming_max + NAMING_TOLERANCE,
                F.lit("cohesion_review_required"),
            ),
            (F.col("first").isNull(), F.lit("no_role_eligible_candidate")),
            (
                -F.col("first.k2") < settings.minimum_reviews,
                F.lit("insufficient_review_support"),
            ),
            (F.col("margin") < settings.minimum_margin, F.lit("ambiguous_score")),
        ],
        F.lit("selected"),
    )
    chosen = F.col("naming_status").isin("singleton_inherited", "selected")
    return (
        named.withColumn("naming_status", status)
        .withColumn("canonical_label", F.when(chosen, F.col("first.text")))
        .select(
            "cluster_id",
            "member_count",
            "cluster_max_distance",
            F.col("medoid.text").alias("medoid_label"),
            "canonical_label",
            "naming_status",
            F.when(chosen, F.col("first.k1")).alias("representative_average_distance"),
            F.when(chosen, F.col("first.max_distance")).alias("representative_max_distance"),
        )
    )


def cluster_statistics(
    members: DataFrame, details: DataFrame, labels: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(nodes with their mapping distance, clusters with centroid and canonical vectors)."""
    canonical = members.select(
        "cluster_id",
        F.col("text").alias("canonical_label"),
        F.col("embedding").alias("canonical_embedding"),
    )
    clusters = (
        labels.join(canonical, ["cluster_id", "canonical_label"], "left")
        .join(centroids(members, ["cluster_id"]), "cluster_id")
        .withColumnRenamed("centroid", "centroid_embedding")
        .withColumn(
            "representative_centroid_distance",
            cosine_distance("canonical_embedding", "centroid_embedding"),
        )
    )
    picked = clusters.select("cluster_id", "canonical_label", "naming_status", "canonical_embedding")
    nodes = members.join(picked, "cluster_id").select(
        *members.columns,
        "canonical_label",
        "naming_status",
        F.coalesce(F.col("text") != F.col("canonical_label"), F.lit(False)).alias(
            "mapping_applied"
        ),
        F.coalesce(
            F.when(F.col("text") == F.col("canonical_label"), F.lit(0.0)),
            cosine_distance("embedding", "canonical_embedding"),
            F.lit(0.0),
        ).alias("mapping_distance"),
    )
    detail = F.struct(
        F.col("text").alias("expression"),
        rounded(F.col("average_distance"), 8).alias("average_distance"),
        rounded(F.col("max_distance"), 8).alias("max_distance"),
        "unique_review_count",
        "central_candidate",
        "role_filter_passed",
        rounded(F.col("centrality"), 8).alias("centrality"),
        rounded(F.col("frequency_score"), 8).alias("frequency_score"),
        rounded(F.col("combined_score"), 8).alias("combined_score"),
    )
    listed = details.groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(detail)).alias("__details"),
        F.sum("source_row_count").alias("source_row_count"),
    )
    rolled = clusters.join(listed, "cluster_id").withColumns(
        {
            "member_expressions": F.col("__details.expression"),
            "member_details_json": F.to_json("__details", {"ignoreNullFields": "false"}),
        }
    )
    return nodes, rolled.drop("__details")


def member_details(clusters: DataFrame) -> DataFrame:
    """The members that each cluster's ``member_details_json`` lists, as rows again."""
    member = (
        "expression string, average_distance double, max_distance double, unique_review_count long, "
        "central_candidate boolean, role_filter_passed boolean, centrality double, frequency_score double, "
        "combined_score double"
    )
    listed = F.from_json("member_details_json", f"array<struct<{member.replace(' ', ':').replace(',:', ',')}>>")
    return clusters.select("cluster_id", F.explode(listed).alias("member")).select("cluster_id", "member.*")


def review_union(units: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct reviews per cluster, recounted from the units instead of uniting review lists."""
    per_review = null_safe_join(
        units.select("review_id", *keys).distinct(), assigned, keys
    ).groupBy("cluster_id", "review_id").agg(F.lit(1).alias("one"))
    return per_review.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("unique_review_count"))


def threshold_violations(clusters: DataFrame, settings: ClusterSettings) -> DataFrame:
    """Clusters wider than the linkage threshold allows; must be empty."""
    limit = settings.threshold + DISTANCE_TOLERANCE
    return clusters.filter(F.col("cluster_max_distance") > limit)


def mergeable_clusters(nodes: DataFrame, settings: ClusterSettings) -> DataFrame:
    """Pairs of clusters of a boundary that complete linkage should have merged; must be empty.

    All their crossing pairs are under the threshold and none is opposed. ``nodes``: boundary, text, embedding,
    cluster_id.
    """
    columns = nodes.select(F.col("boundary").cast("string").alias("boundary"), "text", "embedding", "cluster_id")
    numbered = cut_lineage(columns.orderBy("boundary", "text").withColumn("node", F.monotonically_increasing_id()))
    edges = linkage_edges(numbered, settings).filter("lo >= 0").select("lo", "hi")
    for end in ("lo", "hi"):
        edges = edges.join(numbered.select(F.col("node").alias(end), F.col("cluster_id").alias(f"{end}_cluster")), end)
    a, b = F.least("lo_cluster", "hi_cluster"), F.greatest("lo_cluster", "hi_cluster")
    crossing = (
        edges.filter("lo_cluster <> hi_cluster")
        .groupBy(a.alias("one"), b.alias("two"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    for name in ("one", "two"):
        sizes = numbered.groupBy(F.col("cluster_id").alias(name)).agg(F.count(F.lit(1)).alias(f"{name}_size"))
        crossing = crossing.join(sizes, name)
    return crossing.filter("n = one_size * two_size").select("one", "two")


def opposed_members(nodes: DataFrame, constraints: dict) -> DataFrame:
    """Opposed pairs inside a cluster; must be empty."""
    return cannot_link_pairs(nodes.select(F.col("cluster_id").alias("boundary"), "text"), constraints)


def cluster_stage(
    nodes: DataFrame,
    settings: ClusterSettings,
    id_prefix: str,
    forbidden: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Linkage, ids, labels and statistics of one stage: (nodes, clusters).

    ``nodes``: boundary, text, counts, embedding. ``forbidden``: boundary, text.
    """
    nodes = cut_lineage(nodes)
    linked = cut_lineage(complete_linkage(nodes, settings))
    distinct = linked.select("boundary", "cluster", "cannot_link_pair_count").distinct()
    numbered = sequential_ids(distinct, ["boundary", "cluster"], "cluster_id", id_prefix)
    members = cut_lineage(
        nodes.withColumn("boundary", F.col("boundary").cast("string"))
        .join(linked.drop("cannot_link_pair_count"), ["boundary", "text"])
        .join(numbered, ["boundary", "cluster"])
    )
    rows = members.drop("cluster", "cannot_link_pair_count")
    blocked = None
    if forbidden is not None:
        blocked = numbered.select("boundary", "cluster_id").join(forbidden, "boundary")
        blocked = rows.select("cluster_id", "text").join(
            blocked.drop("boundary"), ["cluster_id", "text"], "left_semi"
        )
    details = cut_lineage(label_details(rows, settings, blocked))
    found_nodes, clusters = cluster_statistics(rows, details, select_labels(details, settings))
    extra = numbered.select("cluster_id", "boundary", "cannot_link_pair_count")
    return found_nodes, clusters.join(extra, "cluster_id").withColumns(
        {
            "distance_threshold": F.lit(settings.threshold),
            "naming_max_distance": F.lit(settings.naming_max),
        }
    )


@dataclass(frozen=True)
class TaxonomySettings:
    aspect: ClusterSettings = field(default=ASPECT_SETTINGS)
    status: ClusterSettings = field(default=STATUS_SETTINGS)
    excluded_aspects: tuple = GENERAL_EXPERIENCE_ASPECTS


def with_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with their embedding; fails if an expression has no vector, which would leave it unclustered."""
    known = vectors.select("text").distinct()
    lacking = [row["text"] for row in nodes.join(known, "text", "left_anti").select("text").limit(5).collect()]
    if lacking:
        raise ValueError(f"expressions without a vector: {lacking}")
    return nodes.join(vectors, "text")


def unmapped_exact(assignments: DataFrame, units: DataFrame) -> DataFrame:
    """Units marked as mapped exactly that lack an aspect, or a status although their raw status is set."""
    raw = units.select("opinion_unit_id", "raw_status")
    exact = assignments.filter(F.col("mapping_state") == MAPPED_EXACT).join(raw, "opinion_unit_id")
    lacks_status = F.col("raw_status").isNotNull() & F.col("status_cluster_id").isNull()
    return exact.filter(F.col("aspect_cluster_id").isNull() | lacks_status)


def build_taxonomy(units: DataFrame, vectors: DataFrame, settings: TaxonomySettings) -> Taxonomy:
    """Aspects over the whole catalog, then statuses inside each aspect cluster.

    ``units``: opinion_unit_id, review_id, raw_aspect, raw_status. ``vectors``: text, embedding.
    """
    eligible = units.filter(~F.col("raw_aspect").isin(*settings.excluded_aspects))
    aspect_nodes, aspect_clusters = cluster_stage(
        with_vectors(expression_nodes(eligible, "raw_aspect", F.lit("all")), vectors),
        settings.aspect,
        "D-A-",
    )
    aspect_nodes, aspect_clusters = cut_lineage(aspect_nodes), cut_lineage(aspect_clusters)
    aspect_lookup = aspect_nodes.select(
        F.col("text").alias("raw_aspect"),
        F.col("cluster_id").alias("aspect_cluster_id"),
        F.col("canonical_label").alias("aspect"),
        F.col("mapping_distance").alias("aspect_mapping_distance"),
    )
    assigned = many_to_one(eligible, aspect_lookup, ["raw_aspect"])
    with_status = assigned.filter(F.col("raw_status").isNotNull())
    status_nodes, status_clusters = cluster_stage(
        with_vectors(
            expression_nodes(with_status, "raw_status", F.col("aspect_cluster_id")), vectors
        ),
        settings.status,
        "D-S-",
        aspect_nodes.select(F.col("cluster_id").alias("boundary"), "text"),
    )
    status_nodes, status_clusters = cut_lineage(status_nodes), cut_lineage(status_clusters)
    status_lookup = status_nodes.select(
        F.col("boundary").alias("aspect_cluster_id"),
        F.col("text").alias("raw_status"),
        F.col("cluster_id").alias("status_cluster_id"),
        F.col("canonical_label").alias("status"),
        F.col("mapping_distance").alias("status_mapping_distance"),
    )
    mapped = many_to_one(assigned, status_lookup, ["aspect_cluster_id", "raw_status"])
    columns = ["aspect_cluster_id", "aspect", "status_cluster_id", "status"]
    distances = ["aspect_mapping_distance", "status_mapping_distance"]
    kept_out = units.filter(F.col("raw_aspect").isin(*settings.excluded_aspects))
    assignments = (
        mapped.select("opinion_unit_id", *columns, *distances)
        .withColumn("mapping_state", F.lit(MAPPED_EXACT))
        .unionByName(
            kept_out.select("opinion_unit_id").withColumn("mapping_state", F.lit(EXCLUDED)),
            allowMissingColumns=True,
        )
    )
    by_aspect = aspect_lookup.select(F.col("aspect_cluster_id").alias("cluster_id"), "raw_aspect")
    aspect_reviews = review_union(eligible, by_aspect, ["raw_aspect"])
    by_status = status_lookup.select(
        F.col("status_cluster_id").alias("cluster_id"), "aspect_cluster_id", "raw_status"
    )
    status_reviews = review_union(with_status, by_status, ["aspect_cluster_id", "raw_status"])
    return Taxonomy(
        assignments,
        aspect_nodes,
        aspect_clusters.join(aspect_reviews, "cluster_id"),
        status_nodes,
        status_clusters.join(status_reviews, "cluster_id"),
    )


_RESET = [
    column
    for part in ("aspect", "status")
    for column in (
        f"suggested_{part}_id",
        f"suggested_{part}",
        f"{part}_membership_max_distance",
        f"{part}_centroid_distance",
        f"{part}_second_nearest_distance",
        f"{part}_distance_margin",
        f"{part}_candidate_eligible",
    )
]


def remap_units(units: DataFrame, assignments: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Give captured units their new mapping; units that came later keep theirs.

    Copy-on-write: the result is the whole unit table. ``versions`` stamps lineage columns.
    """
    new = assignments.select(
        "opinion_unit_id",
        F.lit(True).alias("__captured"),
        F.col("mapping_state").alias("__mapping_state"),
        F.col("aspect_cluster_id").alias("__aspect_id"),
        F.col("aspect").alias("__aspect"),
        F.col("status_cluster_id").alias("__status_id"),
        F.col("status").alias("__status"),
        F.col("aspect_mapping_distance").alias("__aspect_distance"),
        F.col("status_mapping_distance").alias("__status_distance"),
    )
    joined = units.join(new, "opinion_unit_id", "left")
    captured = F.coalesce("__captured", F.lit(False))
    replaced = {
        name: F.when(captured, F.col(f"__{name}")).otherwise(F.col(name))
        for name in (
            "mapping_state",
            "aspect_id",
            "aspect",
            "status_id",
            "status",
            "aspect_distance",
            "status_distance",
        )
    }
    replaced |= {name: F.when(~captured, F.col(name)) for name in _RESET if name in units.columns}
    replaced |= {
        name: F.when(captured, F.lit(value)).otherwise(F.col(name))
        for name, value in versions.items()
    }
    return joined.withColumns(replaced).select(*units.columns)


def rebuild_audit(units: DataFrame, assignments: DataFrame) -> DataFrame:
    """Captured, carried-forward and missing unit counts of a rebuild, in one row."""
    ids = units.select("opinion_unit_id", F.lit(1).alias("in_catalog"))
    marked = ids.join(
        assignments.select("opinion_unit_id", F.lit(1).alias("captured")), "opinion_unit_id", "full"
    )
    return marked.agg(
        F.count("captured").alias("captured_opinion_unit_count"),
        F.count_if(F.col("captured").isNull()).alias("carried_forward_opinion_unit_count"),
        F.count_if(F.col("in_catalog").isNull()).alias("missing_opinion_unit_count"),
    )
