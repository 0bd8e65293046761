"""Bundle import, validated report inputs, the vector table and one-to-one merges on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import encode, joins, summary
from verdigris.sources import bundle, catalog

ORIGIN = bundle.Origin("import-1", "mapping-1", "prompt", "model", "encoder", "norm", "0" * 64, "1" * 64)


def files(spark):
    reviews = [(1, "상품", " 화면이 밝음 "), (2, "상품", "어두움"), (3, "다른 상품", "좋아요")]
    units = [(10, 1, "화면", "밝음", "밝음", "밝다", "positive"), (11, 1, "경험", None, "화면", "y", "neutral"), (12, 2, "화면", "어두움", "어두움", "x", "negative")]
    return {
        "reviews": spark.createDataFrame(reviews, "idx long, productName string, review string"),
        "opinion_units": spark.createDataFrame(
            units, "idx long, review_idx long, raw_aspect string, raw_status string, excerpt string, opinion string, sentiment string"
        ),
        "representative_attributes": spark.createDataFrame(
            [(5, 1, "화면", "positive")], "idx long, review_idx long, raw_attribute string, sentiment string"
        ),
        "assignments": spark.createDataFrame(
            [(10, "A1", "화면", "S1", "밝음", 0.0, 0.1), (12, "A1", "화면", "S2", "어두움", 0.0, 0.2)],
            "idx long, aspect_cluster_id string, aspect string, status_cluster_id string, status string, "
            "aspect_mapping_distance double, status_mapping_distance double",
        ),
        "responses": spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "review_idx long, response_sha256 string"),
    }


def test_units_take_their_assignment_or_are_kept_out(spark):
    tables = bundle.import_bundle(files(spark), ORIGIN)
    units = {r.source_opinion_unit_idx: r for r in tables["opinion_units"].collect()}
    assert {i: (u.unit_position, u.mapping_state, u.aspect_id, u.extraction_response_sha256) for i, u in units.items()} == {
        10: (1, "mapped_exact", "A1", "h1"), 11: (2, "excluded_taxonomy", None, "h1"), 12: (1, "mapped_exact", "A1", "h2"),
    }
    assert units[10].opinion_unit_id == "legacy-ou-10" and units[10].normalization_run_id == "norm"
    reviews = {r.external_review_idx: r for r in tables["reviews"].collect()}
    assert reviews[1].review_text == " 화면이 밝음 " and len(reviews) == 3
    assert reviews[1].product_id == reviews[2].product_id != reviews[3].product_id
    assert tables["products"].count() == 2
    assert tables["representative_attributes"].first().source_artifact_sha256 == "1" * 64


def test_repeated_and_missing_numbers_of_units(spark):
    given = files(spark)
    more = [(10, 2, "화면", "밝음", "x", "y", "mixed"), (None, 2, "화면", None, "x", "y", "mixed"), (12, None, "화면", None, "x", "y", "mixed")]
    given["opinion_units"] = given["opinion_units"].unionByName(spark.createDataFrame(more, given["opinion_units"].schema))
    units = bundle.import_bundle(given, ORIGIN)["opinion_units"].collect()
    found = sorted((u.review_id, u.unit_position, str(u.source_opinion_unit_idx), u.mapping_state, u.status_id) for u in units)
    assert found == [
        ("legacy-review-1", 1, "10", "mapped_exact", "S1"),
        ("legacy-review-1", 2, "11", "excluded_taxonomy", None),
        ("legacy-review-2", 1, "None", "excluded_taxonomy", None),
        ("legacy-review-2", 2, "10", "mapped_exact", "S1"),
        ("legacy-review-2", 3, "12", "mapped_exact", "S2"),
    ]


def test_units_of_a_bundle_are_not_shuffled_by_their_number(spark):
    from verdigris.plans import queries

    units = queries.bundle_import(spark, "/root/testdata/sf0.001")
    plan = units._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert 0 < len(shuffles) <= 3 and not any("raw_aspect" in line for line in shuffles)


def test_files_of_a_bundle_are_read_and_projected(spark, tmp_path):
    given = files(spark)
    node = "raw_aspect string, cluster_id string, canonical_label string, naming_status string, mapping_applied boolean, mapping_distance double, source_row_count long, unique_review_count long, embedding array<double>, more int"
    nodes = spark.createDataFrame([("화면", "A1", "화면", "selected", False, 0.0, 2, 2, [1.0], 1)], node)
    clusters = spark.createDataFrame([("A1", "화면", 7)], "cluster_id string, canonical_label string, member_count long")
    status = nodes.withColumnRenamed("raw_aspect", "raw_status").withColumn("aspect_cluster_id", F.lit("A1"))
    counted = clusters.withColumn("aspect_cluster_id", F.lit("A1")).withColumn("status_cannot_link_pair_count_in_boundary", F.lit(3))
    given |= {"aspect_nodes": nodes, "aspect_clusters": clusters, "status_nodes": status, "status_clusters": counted}
    for name, df in given.items():
        df.withColumn("unread", F.lit("x")).write.parquet(str(tmp_path / f"{name}.parquet"))
    tables = bundle.import_bundle(bundle.read_bundle(spark, str(tmp_path)), ORIGIN)
    assert tables["aspect_mapping_table"].first().aspect_cluster_id == "A1"
    assert tables["status_mapping_table"].first().mapping_table_version_id == "mapping-1"
    assert tables["status_clusters"].first().cannot_link_pair_count_in_boundary == 3
    store = catalog.CatalogStore(spark, str(tmp_path / "catalog"))
    assert store.commit("import-1", tables)
    assert store.read("opinion_units").count() == 3
    inputs = bundle.load_report_inputs(store.load())
    assert inputs["joined"].filter("product_name = '상품'").count() == 3


def test_bundles_that_contradict_themselves_fail(spark):
    given = files(spark)
    lacking = given | {"responses": given["responses"].filter("review_idx < 3")}
    with pytest.raises(Exception, match="no stored response of review 3"):
        bundle.import_bundle(lacking, ORIGIN)["reviews"].collect()
    doubled = given | {"assignments": given["assignments"].unionByName(given["assignments"])}
    with pytest.raises(Exception, match="not unique"):
        bundle.import_bundle(doubled, ORIGIN)["opinion_units"].collect()
    empty = {name: df.where("false") for name, df in given.items()}
    assert all(df.isEmpty() for df in bundle.import_bundle(empty, ORIGIN).values())


def test_report_inputs_are_checked(spark):
    tables = bundle.import_bundle(files(spark), ORIGIN)
    assert bundle.load_report_inputs(tables)["joined"].count() == 3
    orphaned = tables | {"reviews": tables["reviews"].filter("external_review_idx <> 2")}
    with pytest.raises(ValueError, match="units without their review"):
        bundle.load_report_inputs(orphaned)
    renamed = F.when(F.col("source_opinion_unit_idx") == 12, "다른 것").otherwise(F.col("aspect"))
    labels = tables | {"opinion_units": tables["opinion_units"].withColumn("aspect", renamed)}
    with pytest.raises(ValueError, match="aspect ids with several labels"):
        bundle.load_report_inputs(labels)


def test_one_to_one_checks_both_sides(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k long, x string")
    right = spark.createDataFrame([(None, 2.0), (1, 1.0)], "k long, y double")
    assert sorted((str(r.k), r.x, r.y) for r in joins.one_to_one(left, right, ["k"]).collect()) == [("1", "a", 1.0), ("None", "b", 2.0)]
    for one, two, message in (
        (left.unionByName(left), right, "not unique"),
        (left, right.unionByName(right), "not unique"),
        (left.filter("k = 1"), right, "lacks a key"),
        (left, right.filter("k = 1"), "lacks a key"),
    ):
        with pytest.raises(Exception, match=message):
            joins.one_to_one(one, two, ["k"]).collect()


def test_only_unseen_texts_are_encoded(spark):
    texts = spark.createDataFrame([("밝음",), ("ab",), ("ab",), (None,), ("",)], "text string")
    none = spark.createDataFrame([], "text string, encoder_version string, embedding array<float>")
    first = encode.encode_missing(texts.filter("text = 'ab'"), none, encode.character_encoder(4), "v1")
    table = encode.with_new_vectors(texts, first, encode.character_encoder(4), "v1")
    vectors = {r.text: r.embedding for r in table.collect()}
    assert set(vectors) == {"밝음", "ab", ""} and table.count() == 3
    assert np.allclose(vectors["ab"], [0, 2**-0.5, 2**-0.5, 0]) and vectors[""] == [0.0] * 4
    assert encode.encode_missing(texts, table, encode.character_encoder(4), "v1").isEmpty()
    assert encode.encode_missing(texts, table, encode.character_encoder(4), "v2").count() == 3


def test_flags_without_an_evaluation(spark):
    products = spark.createDataFrame([("p",), ("q",)], "product_id string")
    overlap = spark.createDataFrame([("p", 2)], "product_id string, risky_cluster_count long")
    coverage = spark.createDataFrame([], "bounded_risky_cluster_count long, evaluated_risky_cluster_count long")
    none = spark.createDataFrame([(0,)], "evaluator_count long")
    rows = {(r.product_id, r.code): (r.severity, r.value) for r in summary.evaluation_flags(products, overlap, coverage, none, 3).collect()}
    assert len(rows) == 6
    assert rows["p", "NORMALIZATION_RISK_CLUSTERS_PRESENT"] == ("warning", "2")
    assert rows["q", "NORMALIZATION_RISK_CLUSTERS_PRESENT"] == ("info", "0")
    assert rows["p", "HUMAN_EVALUATION_INCOMPLETE"] == ("warning", "true")
