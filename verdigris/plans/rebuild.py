"""Full taxonomy rebuild over a captured unit table, committed as a run that holds a new mapping version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import taxonomy
from ..schemas import OPINION_UNITS, TAXONOMY_CAPTURES, TAXONOMY_VERSIONS
from ..session import cut_lineage
from ..sources.catalog import CatalogStore, refuse_known_version, with_version
from .ingestion import conform


def mapping_bundle(rebuilt: taxonomy.Taxonomy, version: str, installed: DataFrame) -> dict:
    """The four mapping tables of a rebuilt taxonomy, stamped with a version that must be new."""

    def stamped(df: DataFrame, part: str, aspect: str | None = None) -> DataFrame:
        renamed = df.withColumnRenamed("cluster_id", f"{part}_cluster_id")
        if aspect:
            renamed = renamed.withColumnRenamed("boundary", aspect)
        return with_version(renamed, version, installed)

    pairs = "cannot_link_pair_count_in_boundary"
    return {
        "aspect_mapping_table": stamped(rebuilt.aspect_nodes, "aspect").withColumnRenamed(
            "text", "raw_aspect"
        ),
        "aspect_clusters": stamped(rebuilt.aspect_clusters, "aspect"),
        "status_mapping_table": stamped(
            rebuilt.status_nodes, "status", "aspect_cluster_id"
        ).withColumnRenamed("text", "raw_status"),
        "status_clusters": stamped(
            rebuilt.status_clusters, "status", "aspect_cluster_id"
        ).withColumnRenamed("cannot_link_pair_count", pairs),
    }


def version_row(bundle: dict, version: str, run_id: str, config_sha256: str) -> DataFrame:
    """The row of an installed version with the sizes of its mapping tables."""
    counted = [
        bundle[table].agg(F.count(F.lit(1)).alias(name))
        for table, name in (
            ("aspect_mapping_table", "aspect_mapping_count"),
            ("aspect_clusters", "aspect_cluster_count"),
            ("status_mapping_table", "status_mapping_count"),
            ("status_clusters", "status_cluster_count"),
        )
    ]
    one = [df.withColumn("one", F.lit(1)) for df in counted]
    joined = reduce(lambda a, b: a.join(b, "one"), one)
    return joined.withColumns(
        {
            "mapping_table_version_id": F.lit(version),
            "normalization_run_id": F.lit(run_id),
            "normalization_config_sha256": F.lit(config_sha256),
            "created_at": F.current_timestamp(),
        }
    )


def rebuild(
    store: CatalogStore,
    captured: DataFrame,
    vectors: DataFrame,
    settings: taxonomy.TaxonomySettings,
    version: str,
    run_id: str,
    strict: bool = True,
    config_sha256: str = "",
) -> DataFrame:
    """Cluster the captured units, remap them, and commit them under a new mapping version.

    The version gets a row in ``taxonomy_versions``; one that is there already is refused. The runs whose units it
    holds are pinned when it begins: what is committed meanwhile stays visible as it is and can be captured by the next
    rebuild. A rebuild that fails before its receipt leaves nothing a reader sees, and can be run again.

    ``captured`` are the units frozen when the rebuild began; other units of the pinned runs keep their old mapping.
    Returns the audit row. ``strict`` fails if a cluster has no canonical label.
    """
    versions = store.read("taxonomy_versions")
    refuse_known_version(version, versions)
    if store.is_committed(run_id):
        raise ValueError(f"run {run_id} was committed before")
    holders = cut_lineage(store.holders())
    rebuilt = taxonomy.build_taxonomy(captured, vectors, settings)
    assignments = cut_lineage(rebuilt.assignments)
    if not taxonomy.unmapped_exact(assignments, captured).isEmpty():
        raise ValueError("a unit is marked as mapped exactly without an aspect or status")
    if strict:
        for clusters in (rebuilt.aspect_clusters, rebuilt.status_clusters):
            if not clusters.filter(F.col("canonical_label").isNull()).isEmpty():
                raise ValueError("a cluster needs a canonical label before publication")
    for clusters, stage in (
        (rebuilt.aspect_clusters, settings.aspect),
        (rebuilt.status_clusters, settings.status),
    ):
        if not taxonomy.threshold_violations(clusters, stage).isEmpty():
            raise ValueError("a cluster is wider than its linkage threshold")
    units = store.read("opinion_units", holders=holders)
    audit = taxonomy.rebuild_audit(units, assignments)
    if audit.first()["missing_opinion_unit_count"]:
        raise ValueError("the catalog lacks captured opinion units")
    remapped = taxonomy.remap_units(
        units, assignments, {"mapping_table_version_id": version, "normalization_run_id": run_id}
    )
    bundle = mapping_bundle(rebuilt, version, versions)
    tables = {
        "opinion_units": conform(remapped, OPINION_UNITS),
        "taxonomy_versions": conform(
            version_row(bundle, version, run_id, config_sha256), TAXONOMY_VERSIONS
        ),
        "taxonomy_captures": conform(
            holders.withColumn("mapping_table_version_id", F.lit(version)), TAXONOMY_CAPTURES
        ),
        "taxonomy_rebuilds": audit.withColumn("recluster_run_id", F.lit(run_id)),
        **bundle,
    }
    if not store.commit(run_id, tables, audit):
        raise ValueError(f"run {run_id} was committed before")
    return audit
