"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from verdigris.plans.queries import QUERIES  # noqa: E402
from verdigris.session import build_session  # noqa: E402

HEADLINE = [
    "aspect_sentiment_matrix",
    "aspect_status_matrix",
    "mapping_stats_by_aspect",
    "coverage_by_product",
    "normalization_reduction",
    "evidence_top_pair",
    "most_debated_aspect",
    "smoothed_profile",
    "similar_products",
    "weakness_repair_static",
    "submitted_relationships",
    "weakness_repair_submitted",
    "decision_policy",
    "dedup_inbox",
    "field_validation",
    "mapping_state_machine",
    "candidate_ranking",
    "complete_linkage",
    "complete_linkage_rounds",
    "cluster_labels",
    "taxonomy_rebuild",
    "remap_with_late_rows",
    "static_report_markdown",
    "dynamic_report_markdown",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["product_review_counts"](spark, folder).collect()  # start the workers
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
