"""The driver contract, and every statement against its query on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import TABLES, duck_rows, spark_rows

SMALL = "/root/testdata/sf0.001"
QUICK = [
    "aspect_sentiment_matrix",
    "aspect_status_matrix",
    "mapping_stats_by_pair",
    "normalization_reduction",
    "evidence_top_pair",
    "other_top_statuses",
    "weakness_repair_static",
    "weakness_repair_submitted",
    "decision_policy",
    "label_resolution",
    "candidate_ranking",
    "mapping_state_machine",
    "cluster_labels",
    "dedup_inbox",
    "field_validation",
    "remap_with_late_rows",
    "icc",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return connection


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_statement(spark, duck, name):
    names, rows = spark_rows(contract.queries()[name](spark, SMALL))
    expected_names, expected = duck_rows(duck, contract.oracle_sql()[name])
    assert names == expected_names
    assert rows == expected


def test_a_missing_library_costs_only_the_training_data_queries():
    blocked = (
        "import sys; sys.modules['ahocorasick'] = None; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as contract\n"
        "from verdigris.plans.queries import QUERIES\n"
        "assert set(contract.queries()) == set(QUERIES)\n"
        "assert len(contract.oracle_sql()) > 70\n"
    )
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", blocked], cwd=root, check=True, timeout=120)
