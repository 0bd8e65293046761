"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import cut_lineage


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after merging the components that ``links`` (a, b: nodes) connect.

    Each round hooks every component onto the smallest that a link ties it to, follows these hooks to their ends by
    doubling, and relabels; components only point to smaller ones, so there is no cycle.
    """
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = links.join(one, "a").join(two, "b").select("ca", "cb")
    while True:
        apart = ends.where("ca <> cb").select(
            F.greatest("ca", "cb").alias("component"), F.least("ca", "cb").alias("other")
        )
        hooks = cut_lineage(apart.groupBy("component").agg(F.min("other").alias("root")))
        if hooks.isEmpty():
            return labels
        while True:
            next_hooks = hooks.select(F.col("component").alias("root"), F.col("root").alias("further"))
            jumped = cut_lineage(
                hooks.join(next_hooks, "root", "left").select(
                    "component", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
                )
            )
            hooks = jumped.select("component", "root")
            if jumped.where("moved").isEmpty():
                break
        labels = cut_lineage(
            labels.join(hooks, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        )
        one = hooks.select(F.col("component").alias("ca"), F.col("root").alias("ra"))
        two = hooks.select(F.col("component").alias("cb"), F.col("root").alias("rb"))
        ends = cut_lineage(
            apart.select(F.col("component").alias("ca"), F.col("other").alias("cb"))
            .distinct()
            .join(one, "ca", "left")
            .join(two, "cb", "left")
            .select(F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"))
            .where("ca <> cb")
        )
