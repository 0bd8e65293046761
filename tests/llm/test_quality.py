import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import rules


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return rules.fit(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    truth = {row.doc_id: row.quality for row in labels.collect()}
    got = rules.score(docs, model).collect()
    assert len(got) == docs.count()
    hold = [row for row in got if row.held_out and row.doc_id in truth]
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in got)
    assert np.mean([row.predicted == truth[row.doc_id] for row in hold]) > 0.95
    assert all(row.predicted == int(row.score >= 0.5) and 0 <= row.score <= 1 for row in got)


def test_compiled_rules_equal_numpy(tables, model):
    docs, _ = tables
    rows = rules._measured(docs.limit(80), "doc_id").withColumn("score", rules.compiled(model)).toPandas()
    x = rows[list(rules.FEATURES)].to_numpy(float)
    odds = model.base + sum(weight * rules.holds(rule, x) for rule, weight in model.rules)
    assert np.allclose(rows["score"], 1 / (1 + np.exp(-odds)))
    assert tuple(rules.statistics(F.lit(""))) == rules.FEATURES
    assert 1 < len(model.rules) < 120 and all(rules.described(model))


def test_lasso_is_sparse_and_finds_the_signal():
    random = np.random.default_rng(0)
    z = random.integers(0, 2, (600, 30)).astype(float)
    y = (random.random(600) < 1 / (1 + np.exp(-(4 * z[:, 3] - 2)))).astype(float)
    _, weights = rules.lasso_logistic(z, y, 0.03)
    assert weights[3] > 1 and np.count_nonzero(weights) < 8
    _, none = rules.lasso_logistic(z, y, 1.0)
    assert not none.any()


def test_odd_rows(make, model):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "?" * 30_000), (5, "word " * 30_000), (6, "same"), (6, "same"), (None, "x y")]
    got = rules.score(make(rows, clash=("score", "chars", "words", "predicted")), model).collect()
    assert len(got) == len(rows) and all(row.score is not None and row.predicted in (0, 1) for row in got)
    by_id = {row.doc_id: row.score for row in got}
    assert by_id[1] == by_id[2]
    assert rules.score(make([]), model).count() == 0


def test_few_or_contradicting_labels(spark, make):
    docs = make([(i, f"text {i}") for i in range(30)])
    kind = "doc_id long, quality int, toxic int"
    assert rules.fit(docs, spark.createDataFrame([], kind)).rules == []
    both = [(i, q, 0) for i in range(30) for q in (0, 1)] + [(None, 1, 0), (3, None, None), (4, 7, 0)]
    assert rules.fit(docs, spark.createDataFrame(both, kind)).rules == []
    ones = [(i, 1, 0) for i in range(30)]
    assert rules.fit(docs, spark.createDataFrame(ones, kind)).base > 1
