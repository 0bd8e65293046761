"""Small situations end to end: a tiny catalog, late rows, repeated texts, rejected excerpts."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verdigris.operators import ingest, quality, taxonomy, votes
from verdigris.plans import rebuild, reports
from verdigris.plans.ingestion import Lineage, TaxonomyTables
from verdigris.plans.statistics import CatalogStatistics
from verdigris.sources import catalog, inbox
from verdigris.streaming.inbox_stream import inbox_stream, ingest_available

UNIT = (
    "opinion_unit_id string, source_opinion_unit_idx long, review_id string, unit_position int, "
    "raw_aspect string, raw_status string, excerpt string, opinion string, sentiment string, "
    "mapping_state string, aspect_id string, aspect string, status_id string, status string, "
    "aspect_distance double, status_distance double, suggested_aspect string, suggested_status string"
)
ASPECT = "화면 밝기"


def exact(unit_id, review, status_id, status, sentiment):
    text = f"{ASPECT} {status}"
    return (unit_id, None, review, 1, ASPECT, status, text, text, sentiment, "mapped_exact",
            "aspect-brightness", ASPECT, status_id, status, 0.0, 0.0, None, None)


def candidate(unit_id, review, position, aspect, status):
    return (unit_id, None, review, position, aspect, status, f"{aspect} {status}", f"{aspect} {status}",
            "negative", "candidate", None, None, None, None, 0.12, 0.11, "패널 상태", "불량")


def build(spark, products, reviews, units):
    product_df = spark.createDataFrame(products, "product_id string, product_name string").withColumn(
        "category", F.lit("모니터")
    )
    review_df = spark.createDataFrame(
        reviews, "review_id string, product_id string, review_text string, demo string, created_at timestamp"
    )
    unit_df = spark.createDataFrame(units, UNIT)
    joined = unit_df.join(review_df.drop("demo"), "review_id")
    mapped = joined.filter("mapping_state = 'mapped_exact'")
    statistics = CatalogStatistics.compute(mapped, product_df, review_df)
    submissions = review_df.filter("demo is not null").select(
        F.col("demo").alias("submission_id"), "review_id", "product_id", "review_text",
        F.lit(datetime(2026, 8, 4)).alias("submitted_at"),
    )
    submitted = joined.join(submissions.select("submission_id", "review_id"), "review_id")
    return statistics, joined, review_df, submissions, submitted, mapped


@pytest.fixture(scope="module")
def tiny(spark):
    at = [datetime(2026, 8, 4, 0, 0, i) for i in range(4)]
    return build(
        spark,
        [("product-a", "상품 A"), ("product-b", "상품 B"), ("product-empty", "속성 없는 상품")],
        [
            ("review-source", "product-a", "화면 밝기 어두움", "demo-1", at[0]),
            ("review-a2", "product-a", "화면 밝기 어두움", None, at[1]),
            ("review-b", "product-b", "화면 밝기 밝음", None, at[2]),
            ("review-empty", "product-empty", "배송이 빨라요", "demo-empty", at[3]),
        ],
        [
            exact("u1", "review-source", "status-dark", "어두움", "negative"),
            exact("u2", "review-a2", "status-dark", "어두움", "negative"),
            exact("u3", "review-b", "status-bright", "밝음", "positive"),
        ],
    )


def test_static_report_of_tiny_catalog(tiny):
    statistics, units, reviews, *_ = tiny
    built = reports.static_reports(statistics, units, reviews)
    documents = reports.document(built, "product_id", reports.STATIC_TYPE, reports.STATIC_SCHEMA_VERSION)
    payload = {r.product_id: json.loads(r.payload) for r in documents.collect()}
    assert payload["product-a"]["aspect_summary"][0]["supporting_review_count"] == 2
    assert payload["product-a"]["alternatives"][0]["product_id"] == "product-b"
    assert payload["product-a"]["schema_version"] == "1.3.0"
    text = {r.product_id: r.markdown for r in reports.render_static(built).collect()}
    first = text["product-a"]
    assert first.startswith("# **상품 A** 상품에 대한 정적 카탈로그 분석 보고서\n")
    assert first.index("## 최근 추가된 리뷰와 속성") < first.index("## 속성 감성 행렬 (상위 10개)")
    for heading in ("## 속성-상태 행렬 (상위 10개)", "## 가장 논쟁적인 속성", "## 관련 상품",
                    "### 관찰된 약점을 보완하는 대안 상품"):
        assert heading in first
    empty = text["product-empty"].split("## 속성 감성 행렬", maxsplit=1)[0]
    assert "> 배송이 빨라요" in empty
    assert "배송 상태와 같이 상품과 관련되지 않은 속성은 추출하지 않습니다." in empty
    assert "| raw_aspect |" not in empty


def test_submission_report_of_tiny_catalog(tiny):
    statistics, _, _, submissions, submitted, mapped = tiny
    built = reports.submission_reports(statistics, submitted, submissions, mapped)
    row = {r.submission_id: r for r in built.collect()}
    assert row["demo-1"].recommendation_status == "COMPLETED"
    assert row["demo-1"].alternatives[0].product_id == "product-b"
    assert row["demo-1"].relationships[0].relation_code == "ALIGNS_WITH_OTHER_REVIEW_MAJORITY"
    text = {r.submission_id: r.markdown for r in reports.render_submission(built).collect()}
    assert text["demo-1"].startswith("# 동적 의사결정 제안서\n")
    assert "20260804-090000에 제출된 **상품 A**에 대한 리뷰" in text["demo-1"]
    assert '### "**화면 밝기 > 어두움**"' in text["demo-1"]
    assert '동일한 "**화면 밝기 > 어두움**" 조합' in text["demo-1"]
    assert "## 대안 상품 추천" in text["demo-1"]
    assert "제출된 리뷰에서 추출 및 정규화된 속성은 다음과 같습니다." not in text["demo-empty"]


def test_candidates_stay_out_of_comparison(spark):
    at = datetime(2026, 8, 4)
    statistics, _, _, submissions, submitted, mapped = build(
        spark,
        [("product-a", "상품 A")],
        [
            ("review-demo", "product-a", "화질은 선명한데 액정 파손이 존재해요.", "demo-1", at),
            ("review-supported", "product-a", "화면 밝기가 밝아요.", None, at),
        ],
        [
            exact("u-demo", "review-demo", "status-bright", "밝음", "positive"),
            exact("u-supported", "review-supported", "status-bright", "밝음", "positive"),
            candidate("u-fade", "review-demo", 2, "액정 빛 바램", "존재함"),
            candidate("u-damage", "review-demo", 3, "액정 파손", "존재함"),
            candidate("u-return", "review-demo", 4, "반품 의사", "반품 예정"),
        ],
    )
    built = reports.submission_reports(statistics, submitted, submissions, mapped)
    row = built.first()
    assert row.exact_mapped_aspect_status_count == 1
    assert row.unresolved_opinion_unit_count == 3
    assert row.recommendation_status == "NEGATIVE_INPUT_UNRESOLVED"
    assert row.observed_negative_opinion_unit_count == 3
    assert row.negative_conditions is None
    assert len(row.excluded_negative_conditions) == 3
    text = reports.render_submission(built).first().markdown
    assert "### 다른 리뷰와의 비교가 보류된 Opinion Unit" in text
    assert "candidate 추정값은 근거 기반 대안 순위에 사용하지 않으므로 추천을 보류합니다" in text
    assert "| 액정 파손 | 존재함 | negative | candidate | 패널 상태 | 불량 |" in text


VECTORS = [("화면", [1.0, 0.0, 0.0]), ("디스플레이", [0.995, 0.1, 0.0]), ("밝음", [0.0, 1.0, 0.0]),
           ("어두움", [0.0, 0.995, 0.1])]


def captured_units(spark):
    rows = [("ou-1", "r1", "화면", "밝음"), ("ou-2", "r2", "디스플레이", "어두움"),
            ("ou-3", "r3", "전반적 상품 경험", None)]
    return spark.createDataFrame(
        rows, "opinion_unit_id string, review_id string, raw_aspect string, raw_status string"
    )


def test_rebuild_of_three_units(spark):
    vectors = spark.createDataFrame(VECTORS, "text string, embedding array<double>")
    rebuilt = taxonomy.build_taxonomy(captured_units(spark), vectors, taxonomy.TaxonomySettings())
    assert [r.cluster_id for r in rebuilt.aspect_clusters.collect()] == ["D-A-000001"]
    statuses = rebuilt.status_clusters.collect()
    assert len(statuses) == 2
    assert all(r.cannot_link_pair_count >= 1 for r in statuses)
    states = {r.opinion_unit_id: r.mapping_state for r in rebuilt.assignments.collect()}
    assert states == {"ou-1": "mapped_exact", "ou-2": "mapped_exact", "ou-3": "excluded_taxonomy"}


LINEAGE = Lineage("prompt-1", "model-1", "mapping-1", "encoder-1", "run-0", "0" * 64)


def known_taxonomy(spark):
    vectors = spark.createDataFrame(
        [*VECTORS, ("색감", [0.0, 0.0, 1.0])], "text string, embedding array<double>"
    )
    member = "boundary string, cluster_id string, text string, embedding array<double>, distance_threshold double"
    aspects = spark.createDataFrame([("all", "A1", "화면", [1.0, 0.0, 0.0], 0.36)], member)
    statuses = spark.createDataFrame([("A1", "S1", "밝음", [0.0, 1.0, 0.0], 0.2)], member)

    def clusters(df):
        return df.select("boundary", "cluster_id", F.col("text").alias("label"), "distance_threshold",
                         F.col("embedding").alias("centroid"), F.col("embedding").alias("canonical"))

    return TaxonomyTables(
        spark.createDataFrame([("화면", "A1", "화면", 0.0)],
                              "raw_aspect string, aspect_id string, aspect string, aspect_map_distance double"),
        spark.createDataFrame([("A1", "밝음", "S1", "밝음", 0.0)],
                              "aspect_id string, raw_status string, status_id string, status string, status_map_distance double"),
        aspects.drop("boundary"), clusters(aspects).drop("boundary"), statuses, clusters(statuses), vectors,
    )


def response(units):
    return json.dumps({"opinion_units": [
        dict(zip(("raw_aspect", "raw_status", "excerpt", "opinion", "sentiment"), u)) for u in units
    ]}, ensure_ascii=False)


def test_stream_rebuild_and_late_rows(spark, tmp_path):
    texts = ["화면이 밝음", "디스플레이가 어두움", "그냥 좋아요"]
    box = tmp_path / "inbox"
    box.mkdir()

    def drop_file(name, items):
        rows = [{"source_review_id": str(i), "product_id": "p1", "product_name": "상품", "review_text": t}
                for i, t in items]
        (box / name).write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")

    drop_file("a.json", [(0, texts[0]), (1, texts[1]), (2, " 화면이 밝음 "), (3, texts[2])])
    answers = [
        (texts[0], response([("화면", "밝음", "밝음", "밝다", "positive")])),
        (texts[1], response([("디스플레이", "어두움", "어두움", "어둡다", "negative"),
                             ("화면", "밝음", "없는 말", "밝다", "positive")])),
        (texts[2], response([("전반적 상품 경험", None, "좋아요", "좋다", "positive")])),
        ("색감 좋음", response([("색감", "밝음", "색감", "좋다", "positive")])),
    ]
    from verdigris.functions.text import content_hash

    answered = spark.createDataFrame(answers, "text string, response string").select(
        content_hash("text").alias("content_sha256"), "response", F.sha2("response", 256).alias("response_sha256")
    )
    store = catalog.CatalogStore(spark, str(tmp_path / "catalog"))
    tables = known_taxonomy(spark)

    def run():
        stream = inbox_stream(spark, str(box))
        ingest_available(
            stream, store, answered, tables, LINEAGE, str(tmp_path / "cp"), "quarantine"
        ).awaitTermination()

    run()
    assert store.read("reviews").count() == 3
    assert [(r.raw_aspect, r.violations) for r in store.read("quarantined_units").collect()] == [
        ("화면", ["UNGROUNDED_EXCERPT"])
    ]
    units = {(r.raw_aspect, r.raw_status): r for r in store.read("opinion_units").collect()}
    assert units["화면", "밝음"].mapping_state == "mapped_exact"
    unseen = units["디스플레이", "어두움"]
    assert (unseen.mapping_state, unseen.suggested_aspect_id, unseen.aspect_candidate_eligible) == ("candidate", "A1", True)
    assert unseen.status_membership_max_distance == 2.0
    assert units["전반적 상품 경험", None].mapping_state == "excluded_taxonomy"
    captured = store.read("opinion_units").select("opinion_unit_id", "review_id", "raw_aspect", "raw_status")
    captured = captured.collect()
    drop_file("b.json", [(9, "색감 좋음"), (0, texts[0])])
    run()
    run()
    assert store.read("reviews").count() == 4
    assert store.commits().agg(F.sum("review_count"), F.sum("candidate_count")).first()[:] == (4, 2)
    frozen = spark.createDataFrame(captured, captured_units(spark).schema)
    audit = rebuild.rebuild(
        store, frozen, tables.vectors, taxonomy.TaxonomySettings(), "mapping-2", "rebuild-1"
    ).first()
    assert (audit.captured_opinion_unit_count, audit.carried_forward_opinion_unit_count) == (3, 1)
    versions = {r.raw_aspect: (r.mapping_table_version_id, r.mapping_state)
                for r in store.read("opinion_units").collect()}
    assert versions["디스플레이"] == ("mapping-2", "mapped_exact")
    assert versions["색감"] == ("mapping-1", "candidate")
    assert store.read("aspect_mapping_table").count() == 2


def test_ingestion_and_rebuild_are_one_lineage(spark, tmp_path):
    from verdigris.functions.text import content_hash
    from verdigris.operators.ingest import stage_inbox
    from verdigris.plans.ingestion import ingest_run
    from verdigris.schemas import INBOX

    texts = ["화면이 밝음", "디스플레이가 어두움", "색감 좋음"]
    units = [
        response([("화면", "밝음", "밝음", "밝다", "positive")]),
        response([("디스플레이", "어두움", "어두움", "어둡다", "negative")]),
        response([("색감", "밝음", "색감", "좋다", "positive")]),
    ]
    store = catalog.CatalogStore(spark, str(tmp_path / "catalog"))
    tables = known_taxonomy(spark)

    def answers(numbers):
        rows = [(texts[i], units[i]) for i in numbers]
        return spark.createDataFrame(rows, "text string, response string").select(
            content_hash("text").alias("content_sha256"), "response", F.sha2("response", 256).alias("response_sha256")
        )

    def ingest(run_id, numbers, answered):
        rows = [(None, str(i), "p1", "상품", None, texts[i]) for i in numbers]
        inbox = spark.createDataFrame(rows, INBOX).withColumn("ordinal", F.col("source_review_id").cast("long"))
        return ingest_run(store, stage_inbox(inbox), answered, tables, LINEAGE, run_id)

    def rebuild_all(version):
        frozen = store.read("opinion_units").select("opinion_unit_id", "review_id", "raw_aspect", "raw_status")
        return rebuild.rebuild(
            store, frozen, tables.vectors, taxonomy.TaxonomySettings(), version, f"rebuild-{version}"
        )

    assert ingest("run-1", [0, 1], answers([0]))  # the second has no response yet
    assert (store.read("reviews").count(), store.read("pending_reviews").count()) == (1, 1)
    rebuild_all("mapping-2")
    assert ingest("run-2", [2], answers([0, 1, 2]))  # and is taken up again
    assert not ingest("run-2", [2], answers([0, 1, 2]))
    assert store.read("reviews").count() == 3 and store.read("products").count() == 1
    assert {r.raw_aspect: r.mapping_table_version_id for r in store.read("opinion_units").collect()} == {
        "화면": "mapping-2", "디스플레이": "mapping-1", "색감": "mapping-1",
    }
    with pytest.raises(ValueError, match="already exists"):
        rebuild_all("mapping-2")
    rebuild_all("mapping-3")
    assert {r.mapping_table_version_id for r in store.read("opinion_units").collect()} == {"mapping-3"}
    assert store.read("opinion_units", "mapping-2").count() == 1
    assert store.read("opinion_units", "mapping-3").count() == 3
    assert sorted(r.mapping_table_version_id for r in store.read("taxonomy_versions").collect()) == [
        "mapping-2", "mapping-3",
    ]
    doubled = answers([0]).unionByName(answers([0]).withColumn("response", F.lit("{}")))
    with pytest.raises(ValueError, match="more than one"):
        ingest("run-3", [0], doubled)


def unit_rows(spark, run_id, ids):
    from verdigris.plans.ingestion import conform
    from verdigris.schemas import OPINION_UNITS

    rows = spark.createDataFrame(
        [(i, f"r-{i}", 1, "화면", "밝음", "x", "y", "positive", run_id, "mapping-1") for i in ids],
        "opinion_unit_id string, review_id string, unit_position long, raw_aspect string, raw_status string, "
        "excerpt string, opinion string, sentiment string, ingestion_run_id string, mapping_table_version_id string",
    )
    return {"opinion_units": conform(rows, OPINION_UNITS)}


def current(store, version=None):
    return {r.opinion_unit_id: r.mapping_table_version_id for r in store.read("opinion_units", version).collect()}


@pytest.fixture
def store_of_two_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rebuild.taxonomy, "build_taxonomy", one_cluster)
    store = catalog.CatalogStore(spark, str(tmp_path / "catalog"))
    for run_id, ids in (("run-1", ["a", "b"]), ("run-2", ["c"])):
        assert store.commit(run_id, unit_rows(spark, run_id, ids))
    return store


def one_cluster(units, vectors, settings):
    """A taxonomy without clustering: all units in one aspect cluster."""
    spark = units.sparkSession
    columns = "cluster_id string, boundary string, text string, canonical_label string, cluster_max_distance double, cannot_link_pair_count long"
    clusters = spark.createDataFrame([("D-A-000001", "all", "화면", "화면", 0.0, 0)], columns)
    assigned = units.select(
        "opinion_unit_id",
        F.lit("mapped_exact").alias("mapping_state"),
        *(F.lit("x").alias(c) for c in ("aspect_cluster_id", "aspect", "status_cluster_id", "status")),
        *(F.lit(0.0).alias(c) for c in ("aspect_mapping_distance", "status_mapping_distance")),
    )
    return taxonomy.Taxonomy(assigned, clusters, clusters, clusters, clusters)


def rebuild_units(spark, store, version, run_id=None):
    frozen = store.read("opinion_units").select("opinion_unit_id", "review_id", "raw_aspect", "raw_status")
    vectors = spark.createDataFrame(VECTORS, "text string, embedding array<double>")
    run_id = run_id or f"rebuild-{version}"
    return rebuild.rebuild(store, frozen, vectors, taxonomy.TaxonomySettings(), version, run_id)


def test_a_run_committed_during_a_rebuild_stays_visible(spark, store_of_two_runs, monkeypatch):
    store = store_of_two_runs

    def build_while_a_run_commits(*args):
        assert store.commit("run-3", unit_rows(spark, "run-3", ["d", "e"]))
        return one_cluster(*args)

    monkeypatch.setattr(rebuild.taxonomy, "build_taxonomy", build_while_a_run_commits)
    rebuild_units(spark, store, "mapping-2")
    monkeypatch.setattr(rebuild.taxonomy, "build_taxonomy", one_cluster)
    late = {"a": "mapping-2", "b": "mapping-2", "c": "mapping-2", "d": "mapping-1", "e": "mapping-1"}
    assert current(store) == late
    assert set(current(store, "mapping-2")) == {"a", "b", "c"}
    rebuild_units(spark, store, "mapping-3")
    assert current(store) == dict.fromkeys("abcde", "mapping-3")


def test_a_rebuild_that_fails_before_its_receipt_can_be_repeated(spark, store_of_two_runs, monkeypatch):
    store, commit = store_of_two_runs, catalog.CatalogStore.commit

    def crash(self, run_id, tables, receipt=None):
        for name, df in tables.items():  # everything is written, but the receipt
            df.write.parquet(f"{self.root}/{name}/run_id={run_id}/attempt=lost")
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(catalog.CatalogStore, "commit", crash)
    with pytest.raises(RuntimeError):
        rebuild_units(spark, store, "mapping-2")
    monkeypatch.setattr(catalog.CatalogStore, "commit", commit)
    assert current(store) == dict.fromkeys("abc", "mapping-1")
    assert store.read("taxonomy_versions").isEmpty()
    rebuild_units(spark, store, "mapping-2")
    assert current(store) == dict.fromkeys("abc", "mapping-2")
    with pytest.raises(ValueError, match="already exists"):
        rebuild_units(spark, store, "mapping-2")


@pytest.mark.parametrize("inner_first", [True, False])
def test_two_rebuilds_at_a_time_lose_nothing(spark, store_of_two_runs, monkeypatch, inner_first):
    """One rebuild begins inside another, with or without a run between; units have one row each in either order."""
    store = store_of_two_runs

    def build_beside_another(*args):
        monkeypatch.setattr(rebuild.taxonomy, "build_taxonomy", one_cluster)
        if inner_first:
            assert store.commit("run-3", unit_rows(spark, "run-3", ["d"]))
        rebuild_units(spark, store, "mapping-inner")
        if not inner_first:
            assert store.commit("run-3", unit_rows(spark, "run-3", ["d"]))
        return one_cluster(*args)

    monkeypatch.setattr(rebuild.taxonomy, "build_taxonomy", build_beside_another)
    rebuild_units(spark, store, "mapping-outer")
    own = "mapping-inner" if inner_first else "mapping-1"  # the outer one began before that run
    assert store.read("opinion_units").count() == 4
    assert current(store) == {"a": "mapping-outer", "b": "mapping-outer", "c": "mapping-outer", "d": own}


def test_missing_vectors_and_wide_ids(spark):
    captured = spark.createDataFrame(
        [("ou-1", "r1", "화면", None), ("ou-2", "r2", "색감", None)],
        "opinion_unit_id string, review_id string, raw_aspect string, raw_status string",
    )
    vectors = spark.createDataFrame([("화면", [1.0, 0.0])], "text string, embedding array<double>")
    with pytest.raises(ValueError, match="without a vector"):
        taxonomy.build_taxonomy(captured, vectors, taxonomy.TaxonomySettings())
    assignments = spark.createDataFrame(
        [("ou-1", "mapped_exact", None, None), ("ou-2", "mapped_exact", "A", None)],
        "opinion_unit_id string, mapping_state string, aspect_cluster_id string, status_cluster_id string",
    )
    assert [r.opinion_unit_id for r in taxonomy.unmapped_exact(assignments, captured).collect()] == ["ou-1"]
    ids = taxonomy.sequential_ids(spark.range(1_000_100), ["id"], "name", "D-A-")
    assert ids.select("name").distinct().count() == 1_000_100
    assert {r.name for r in ids.filter("id in (0, 999999)").collect()} == {"D-A-000001", "D-A-1000000"}


def test_store_commits_once_and_release_is_verified(spark, tmp_path):
    store = catalog.CatalogStore(spark, str(tmp_path / "store"))
    table = spark.range(20).withColumn("v", F.col("id") * 2)
    assert store.commit("run-1", {"numbers": table})
    assert not store.commit("run-1", {"numbers": table})
    table.write.parquet(f"{store.root}/numbers/run_id=unfinished/attempt=1")
    assert store.read("numbers").count() == 20
    assert store.capture("numbers").first().run_ids == ["run-1"]
    manifest = store.publish("release-1", {"numbers": store.read("numbers")})
    assert manifest.first().rows == 20
    assert store.current_release() == "release-1"
    assert store.read_release("numbers").count() == 20
    table.limit(1).write.mode("append").parquet(f"{store.root}/releases/release-1/numbers")
    assert store.verify("release-1").count() == 1
    written = catalog.write_verified(table, str(tmp_path / "copy"))
    assert written.count() == 20
    sums = catalog.file_checksums(spark, str(tmp_path / "copy"))
    assert catalog.checksum_mismatches(sums, sums.withColumn("bytes", F.col("bytes") + 1)).count() == sums.count()


def test_report_files(spark, tiny, tmp_path):
    statistics, units, reviews, *_ = tiny
    built = reports.static_reports(statistics, units, reviews)
    documents = reports.document(built, "product_id", reports.STATIC_TYPE, reports.STATIC_SCHEMA_VERSION)
    catalog.write_reports(documents, reports.render_static(built), "product_id", str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out/json"))
    assert rows.count() == 3 and all(json.loads(r.value)["report_type"] for r in rows.collect())
    assert rows.filter(F.col("bucket") != catalog.report_bucket("product_id")).isEmpty()
    one = rows.filter(F.col("product_id") == rows.first().product_id)
    assert one.filter(F.col("bucket") == catalog.report_bucket("product_id")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/markdown")).filter(F.length("value") > 0).count() == 3


def test_submitted_texts_survive_deduplication(spark):
    staged = spark.createDataFrame(
        [("r1", "demo_ui", "d1", "h0", 0), ("r2", "demo_ui", "d2", "h0", 1), ("r3", "demo_ui", "d2", "h0", 2),
         ("r4", "catalog_inbox", None, "h1", 3), ("r5", "catalog_inbox", None, "h1", 4),
         ("r6", "catalog_inbox", None, "h0", 5)],
        "review_id string, source string, demo_review_id string, content_sha256 string, ordinal long",
    )
    seen = spark.createDataFrame([("h0",)], "content_sha256 string")
    kept = ingest.deduplicate(staged, seen)
    assert {r.review_id for r in kept.collect()} == {"r1", "r2", "r4"}
    assert ingest.duplicate_count(staged, kept).first()[0] == 3


def test_ungrounded_excerpt_policies(spark):
    units = spark.createDataFrame(
        [("화질이 선명합니다.", "화질", None, "화질이 매우 선명합니다.", "선명", "positive"),
         ("화질이 선명합니다.", " 화질 ", None, "선명합니다", "선명", "positive")],
        "review_text string, raw_aspect string, raw_status string, excerpt string, opinion string, sentiment string",
    )
    with pytest.raises(Exception, match="UNGROUNDED_EXCERPT"):
        ingest.validate_units(units, "fail")[0].collect()
    kept, none = ingest.validate_units(units, "drop")
    assert [r.raw_aspect for r in kept.collect()] == ["화질"] and none.count() == 0
    assert ingest.validate_units(units, "quarantine")[1].count() == 1


def test_inbox_files_responses_and_attributes(spark, tmp_path):
    rows = [{"source_review_id": str(i), "product_id": "p", "product_name": "n", "review_text": f" t{i} "}
            for i in range(5)]
    (tmp_path / "inbox.json").write_text(json.dumps(rows))
    limited = inbox.read_inbox(spark, str(tmp_path / "inbox.json"), limit=3)
    staged = ingest.stage_inbox(limited).orderBy("ordinal").collect()
    assert [r.source_review_id for r in staged] == ["0", "1", "2"]
    assert (staged[0].review_text, staged[0].source, staged[0].category) == ("t0", "catalog_inbox", "모니터")
    folder = tmp_path / "responses"
    folder.mkdir()
    body = {"representative_attributes": [{"raw_attribute": " 화면 ", "sentiment": "positive"}]}
    (folder / "r1.json").write_text(json.dumps(body))
    found = inbox.read_responses(spark, str(folder))
    assert inbox.parse_attributes(found, "review_id").first()[:] == ("r1", 1, "화면", "positive")
    reviews = spark.createDataFrame([("r1",), ("r2",)], "review_id string")
    assert [r.review_id for r in inbox.missing_responses(reviews, found).collect()] == ["r2"]
    files = spark.createDataFrame([(1, "t", "p"), (1, " ", "p")], "idx long, review string, productName string")
    normal = inbox.normalize_review_files(files)
    assert {r.reason for r in inbox.review_file_violations(normal).collect()} == {"REPEATED_OR_NULL_IDX", "BLANK_TEXT"}
    with pytest.raises(ValueError):
        inbox.normalize_review_files(files.withColumn("product_name", F.lit("x")))


def test_the_first_of_equal_texts_is_told_by_file_and_place(spark, tmp_path):
    """Two files with equal texts, under any partitioning and in either format."""
    folder, lines = tmp_path / "arrays", tmp_path / "lines"
    folder.mkdir()
    lines.mkdir()
    for name, ids in (("a", range(50)), ("b", range(50, 100))):
        rows = [{"source_review_id": str(i), "product_id": f"p{i % 7}", "product_name": f"n{i}", "review_text": f"text {i % 10}"} for i in ids]
        (folder / f"{name}.json").write_text(json.dumps(rows))
        (lines / f"{name}.json").write_text("\n".join(json.dumps(row) for row in rows))
    (folder / "c.json").write_text("no array")
    nothing = spark.createDataFrame([], "content_sha256 string")
    no_products = spark.createDataFrame([], "product_id string")
    for read, path in ((inbox.read_inbox, folder), (inbox.read_inbox_lines, lines)):
        rows = read(spark, str(path))
        assert rows.count() == 100
        for parts in (1, 3, 16):
            staged = ingest.stage_inbox(rows.repartition(parts, "review_text"))
            kept = ingest.deduplicate(staged, nothing)
            assert {r.source_review_id for r in kept.collect()} == {str(i) for i in range(10)}
            products = ingest.new_products(no_products, staged, "run")
            assert {r.product_id: r.product_name for r in products.collect()} == {f"p{i}": f"n{i}" for i in range(7)}
    assert inbox.read_inbox(spark, str(folder), 2).count() == 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        cut = inbox.read_inbox_lines(spark, str(lines))
        assert cut.rdd.getNumPartitions() > 4
        for file in ("a.json", "b.json"):
            placed = cut.filter(F.col("inbox_file").endswith(file)).orderBy("ordinal").collect()
            ids = [int(r.source_review_id) for r in placed]
            assert ids == sorted(ids) and len({r.ordinal for r in placed}) == 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_votes_keep_null_status_as_a_group(spark):
    rows = [("p", "r1", "a", None, "positive"), ("p", "r1", "a", None, "negative"), ("p", "r1", "a", "s", "positive")]
    units = spark.createDataFrame(rows, "product_id string, review_id string, aspect_id string, status_id string, sentiment string")
    got = {(r.status_id, r.vote) for r in votes.review_votes(units, ["aspect_id", "status_id"]).collect()}
    assert got == {(None, "mixed"), ("s", "positive")}
    strict = votes.review_votes(units, ["aspect_id", "status_id"], drop_null_keys=True)
    assert strict.count() == 1


def test_quality_checks(spark):
    vectors = spark.createDataFrame(
        [([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "embedding array<double>"
    )
    assert quality.invalid_embeddings(vectors, 2).count() == 4
    pairs = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "a")], "status_id string, aspect_id string")
    assert quality.ambiguous_labels(pairs, "status_id", ["aspect_id"]).count() == 1
    assert quality.varying_lineage(pairs, ["status_id"]).count() == 1
    assert quality.lost_rows(pairs, pairs.limit(2)).count() == 1
    assert quality.schema_difference(pairs, ["status_id", "x"]) == (["x"], ["aspect_id"])


def test_documents_in_nested_layout(tiny):
    from verdigris.plans import report_layout

    statistics, units, reviews, submissions, submitted, mapped = tiny
    release = report_layout.Release("release-1", "mapping-table-7", "m" * 64, "encoder-1", "p" * 64, "2026-08-04T09:00:00")
    built = reports.static_reports(statistics, units, reviews)
    rows = report_layout.written(report_layout.static_layout(built, release), "product_id", "report_id").collect()
    texts = {row.product_id: json.loads(row.payload) for row in rows}
    first, empty = texts["product-a"], texts["product-empty"]
    assert list(first)[:4] == ["schema_version", "report_type", "report_id", "source"]
    assert first["report_id"].startswith("static_catalog_analysis:7:")
    assert len({row.report_id for row in rows}) == 3
    assert first["product"]["catalog_review_count"] == 2
    repair = first["related_products"]["weakness_repair_alternatives"]
    assert repair["status"] == "COMPLETED"
    assert repair["alternatives"][0]["product_id"] == "product-b"
    match = repair["alternatives"][0]["requirement_matches"][0]
    assert match["undesired_status_profile"] is None
    assert match["positive_alternative_profile"] == {"status_cluster_id": "status-bright"}
    assert first["aspect_summary"][0]["sentiment"]["counts"]["negative"] == 2
    assert [flag["value"] for flag in first["quality_flags"]] == [["price", "inventory", "shipping", "promotion"], 0]
    assert empty["aspect_summary"] == [] and empty["most_debated_aspect"] is None
    assert empty["latest_review"]["opinion_units"] == []
    built = reports.submission_reports(statistics, submitted, submissions, mapped)
    rows = report_layout.written(report_layout.submission_layout(built, release), "submission_id", "proposal_id").collect()
    texts = {row.submission_id: json.loads(row.payload) for row in rows}
    full, empty = texts["demo-1"], texts["demo-empty"]
    assert full["submission"]["submitted_at_local"] == "20260804-090000"
    assert full["submission"]["excluded_products"] == ["상품 A"]
    assert full["submitted_opinion_units"][0]["aspect_cluster_id"] == "aspect-brightness"
    assert full["catalog_relationships"][0]["other_status_sentiment"]["counts"]["negative"] == 1
    assert full["alternative_recommendations"]["negative_conditions"][0]["submitted_review_vote_count"] == 1
    assert full["alternative_recommendations"]["alternatives"][0]["rank"] == 1
    assert empty["catalog_relationships"] == [] and empty["catalog_comparison"]["unresolved_opinion_units"] == []
    assert empty["alternative_recommendations"]["status"] == "NO_NEGATIVE_SUBMITTED_ASPECT_STATUS"
