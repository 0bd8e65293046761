"""Blocked pairing against brute force, with blocks far smaller than the data and one hot boundary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators.components import connected_components
from verdigris.operators import evaluation, mapping, similarity, taxonomy


def expressions(count, seed=7, dimension=6, hot=0.5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        boundary = "hot" if rng.random() < hot else f"b{i % 3}"
        vector = rng.normal(size=dimension)
        vector /= np.linalg.norm(vector)
        rows.append((f"t{i:04d}", boundary, [float(x) for x in vector]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, boundary string, embedding array<double>")


def brute_linkage(rows, threshold):
    """Merge the closest pair until no two clusters are closer than the threshold."""
    result = {}
    for boundary in {row[1] for row in rows}:
        texts = sorted(row[0] for row in rows if row[1] == boundary)
        vectors = {row[0]: np.array(row[2]) for row in rows}
        clusters = [[text] for text in texts]

        def distance(a, b):
            return max(1 - vectors[x] @ vectors[y] for x in a for y in b)

        while len(clusters) > 1:
            best = min(
                (distance(a, b), i, j)
                for i, a in enumerate(clusters)
                for j, b in enumerate(clusters)
                if i < j
            )
            if best[0] >= threshold:
                break
            clusters[best[1]] = sorted(clusters[best[1]] + clusters.pop(best[2]))
        for cluster in clusters:
            for text in cluster:
                result[boundary, text] = cluster[0]
    return result


@pytest.mark.parametrize("local_rows", [0, 9, 10_000])
def test_complete_linkage_is_exact_locally_and_in_rounds(spark, local_rows):
    rows = expressions(60)
    settings = taxonomy.ClusterSettings(0.6, 0.6, local_boundary_rows=local_rows, block_rows=8)
    linked = taxonomy.complete_linkage(frame(spark, rows), settings).collect()
    assert {(r.boundary, r.text): r.cluster for r in linked} == brute_linkage(rows, 0.6)


@pytest.mark.parametrize("local_rows", [0, 100])
def test_constraints_keep_opposites_apart(spark, local_rows):
    rows = [("밝음", "a", [0.0, 1.0, 0.0]), ("어두움", "a", [0.0, 0.995, 0.1]), ("환함", "a", [0.0, 1.0, 0.05])]
    settings = taxonomy.ClusterSettings(
        0.2, 0.2, constraints=taxonomy.STATUS_CONSTRAINTS, local_boundary_rows=local_rows
    )
    linked = taxonomy.complete_linkage(frame(spark, rows), settings).collect()
    clusters = {r.text: r.cluster for r in linked}
    assert clusters["밝음"] != clusters["어두움"]
    assert {r.cannot_link_pair_count for r in linked} == {1}


def test_nearest_clusters_with_split_clusters(spark):
    rows = expressions(80, seed=3)
    members = frame(spark, rows).withColumn(
        "cluster_id",
        F.when(F.col("embedding")[0] > -0.8, "big").otherwise(F.concat(F.lit("c"), F.col("text"))),
    ).withColumn("distance_threshold", F.lit(1.9))
    asked = frame(spark, expressions(15, seed=9)).withColumnRenamed("text", "expression_id").withColumn(
        "text", F.col("expression_id")
    )
    clusters = members.groupBy("boundary", "cluster_id").agg(
        F.min("text").alias("label"),
        F.min_by("embedding", "text").alias("canonical"),
        F.max("distance_threshold").alias("distance_threshold"),
    ).join(mapping.centroids(members, ["boundary", "cluster_id"]), ["boundary", "cluster_id"])
    small = mapping.nearest_clusters(asked, members, clusters, block_rows=8)
    large = mapping.nearest_clusters(asked, members, clusters, block_rows=10_000)
    assert sorted(small.collect()) == sorted(large.collect())
    farthest = {}
    for e in asked.collect():
        for m in members.filter(F.col("boundary") == e.boundary).collect():
            d = 1 - float(np.dot(e.embedding, m.embedding))
            key = (e.expression_id, m.cluster_id)
            farthest[key] = max(farthest.get(key, 0.0), d)
    for row in small.collect():
        options = {c: d for (x, c), d in farthest.items() if x == row.expression_id}
        best = min(options, key=lambda c: (options[c] > 1.9 + 1e-6, options[c]))
        assert row.suggested_id == best
        assert row.membership_max_distance == pytest.approx(options[best], abs=1e-7)


def test_member_distances_do_not_depend_on_blocks(spark):
    members = frame(spark, expressions(40)).withColumnRenamed("boundary", "cluster_id")
    a = taxonomy.member_distances(members, 5).orderBy("text").collect()
    b = taxonomy.member_distances(members, 5000).orderBy("text").collect()
    for x, y in zip(a, b, strict=True):
        assert (x.text, x.member_count) == (y.text, y.member_count)
        assert x.average_distance == pytest.approx(y.average_distance)
        assert x.max_distance == pytest.approx(y.max_distance)


def test_nearest_cluster_pairs_over_blocks(spark):
    rows = [(r[0], r[2]) for r in expressions(30)]
    df = spark.createDataFrame(rows, "cluster_id string, embedding array<double>")
    got = [(r.lo, r.hi) for r in evaluation.nearest_cluster_pairs(df, 5, block_rows=7).collect()]
    pairs = sorted(
        (1 - float(np.dot(a[1], b[1])), a[0], b[0]) for a in rows for b in rows if a[0] < b[0]
    )
    assert got == [(lo, hi) for _, lo, hi in pairs[:5]]


def test_similar_products_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    names = "aspect_id mention_rate support_reliability positive_value negative_value mixed_value neutral_value".split()
    rows = []
    for product in range(25):
        aspects = [
            dict(zip(names, [f"a{i}", *(float(x) for x in rng.random(6))]))
            for i in range(6)
            if rng.random() < 0.6
        ]
        rows.append((product, f"p{product}", aspects or None))
    kinds = ", ".join(f"{n}: {'string' if n == 'aspect_id' else 'double'}" for n in names)
    arrays = spark.createDataFrame(
        rows, f"product_id long, product_name string, aspects array<struct<{kinds}>>"
    )
    whole = sorted(similarity.similar_products(arrays).collect())
    original = similarity.block_pairs
    monkeypatch.setattr(
        similarity, "block_pairs", lambda *a, **k: original(*a, **{**k, "left_rows": 4, "right_rows": 3})
    )
    assert sorted(similarity.similar_products(arrays).collect()) == whole
    assert all(r.source_id != r.candidate_id for r in whole)


def test_sequential_ids_follow_the_global_order(spark):
    df = spark.range(500).selectExpr("concat('k', lpad(cast(id * 7919 % 1000 as string), 4, '0')) AS k")
    got = taxonomy.sequential_ids(df, ["k"], "id", "D-A-").orderBy("k").collect()
    assert [r.id for r in got] == [f"D-A-{i:06d}" for i in range(1, 501)]


def test_bootstrap_is_repeatable_and_centred(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK_ROWS", 32)
    values = spark.range(300).selectExpr("id", "cast(id % 5 as double) AS x")
    a = evaluation.bootstrap_means(values, "id", ["x"], resamples=400).first()
    b = evaluation.bootstrap_means(values, "id", ["x"], resamples=400).first()
    assert a == b
    assert a.lower_95 < 2.0 < a.upper_95
    assert abs(a.upper_95 - a.lower_95 - 2 * 1.96 * (2**0.5) / 300**0.5) < 0.08


def test_components_of_paths_stars_loops_and_random_graphs(spark):
    draw = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (600, 601), (601, 600)]
    edges += [(int(a), int(b)) for a, b in draw.integers(1000, 1200, (120, 2))]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = connected_components(spark.createDataFrame(edges, "lo long, hi long")).collect()
    assert len(found) == len(parent)
    assert {r.node: r.component for r in found} == {n: root(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "lo long, hi long")).count() == 0


def test_violations_of_linkage_are_found(spark):
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 0.01]), ("c", "x", [0.0, 1.0])]
    apart = frame(spark, rows).withColumn("cluster_id", F.col("text"))
    settings = taxonomy.ClusterSettings(0.2, 0.2)
    assert [tuple(r) for r in taxonomy.mergeable_clusters(apart, settings).collect()] == [("a", "b")]
    good = apart.withColumn("cluster_id", F.when(F.col("text") == "c", "c").otherwise("a"))
    assert taxonomy.mergeable_clusters(good, settings).isEmpty()
    statuses = frame(spark, [("밝음", "x", [1.0, 0.0]), ("어두움", "x", [1.0, 0.0])]).withColumn("cluster_id", F.lit("s"))
    assert taxonomy.opposed_members(statuses, taxonomy.STATUS_CONSTRAINTS).count() == 1
