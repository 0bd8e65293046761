"""What must not grow with the tables: rows of a task, copies of a row."""

from pyspark.sql import functions as F

from verdigris.sources import driver_tables as src

SMALL = "/root/testdata/sf0.01"


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_units_of_a_task_are_bounded(spark, monkeypatch):
    whole = src.catalog_units(spark, SMALL).count()
    monkeypatch.setattr(src, "ROWS_OF_TASK", 1000)
    units = src.catalog_units(spark, SMALL)
    assert units.count() == whole
    assert largest_task(units) < 2000
    assert largest_task(src.mapped_units(spark, SMALL, src.CUSTOMER)) < 2000


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_a_submission_report_is_put_together_without_a_shuffle(spark, monkeypatch):
    from verdigris.plans import queries

    monkeypatch.setattr(src, "ROWS_OF_TASK", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        reports = queries._submission_reports(spark, "/root/testdata/sf0.001")
        assert exchanges(reports) <= 2  # the excluded conditions, which come from two tables
        assert reports.count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fewer_buckets_than_shuffle_partitions_are_not_shuffled_either(spark, monkeypatch):
    from verdigris.plans import queries

    monkeypatch.setattr(src, "ROWS_OF_TASK", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        reports = queries._submission_reports(spark, "/root/testdata/sf0.001")
        assert exchanges(reports) == 0
        assert reports.count() == 1500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_of_a_row_stop_growing_with_the_table(spark, monkeypatch):
    from verdigris.operators import mapping, tiles

    monkeypatch.setattr(tiles, "MOST_BLOCKS", 3)
    rows = [(i, "all", f"t{i}", f"c{i % 5}", [float(i % 7) + 1.0, float(i % 11), 1.0], 1.2) for i in range(400)]
    names = "expression_id long, boundary string, text string, cluster_id string, embedding array<double>, distance_threshold double"
    members = spark.createDataFrame(rows, names)
    groups = []
    original = tiles.block_pairs

    def counted(left, right, kernel, schema, **more):
        found = original(left, right, lambda a, b: kernel(a, b).assign(pairs=len(a) * len(b)), schema + ", pairs long", **more)
        groups.append(found.select("pairs").distinct().count())
        return found.drop("pairs")

    whole = mapping.cluster_distances(members, members, block_rows=1000).collect()
    monkeypatch.setattr(mapping, "block_pairs", counted)
    assert mapping.cluster_distances(members, members, block_rows=4).count() > 0
    assert groups[0] <= 9
    near = {(r.expression_id, r.cluster_id): round(r.max_member_distance, 9) for r in whole}
    small = {(r.expression_id, r.cluster_id): round(r.max_member_distance, 9) for r in mapping.cluster_distances(members, members, block_rows=4).collect()}
    assert all(small[key] == value for key, value in near.items())


def test_the_search_for_components_gets_fewer_edges_than_were_found(spark, monkeypatch):
    from verdigris.operators import taxonomy

    edges = [("p", i, j, ((i * 7919 + j * 104729) % 1000) / 1000.0) for i in range(20) for j in range(i + 1, 20)]
    seen = []
    original = taxonomy.connected_components
    monkeypatch.setattr(taxonomy, "MERGE_ROUNDS", 1)
    monkeypatch.setattr(taxonomy, "connected_components", lambda df: (seen.append(df.count()), original(df))[1])
    found = taxonomy.linked_nodes(spark.createDataFrame(edges, "part string, lo long, hi long, d double"), 0)
    assert {row.cluster for row in found.collect()} == {0}
    assert seen and seen[0] < len(edges)


def test_joins_with_a_large_table_are_dealt(spark, monkeypatch):
    columns = ("review_id", "unit_position", "product_id", "raw_aspect", "raw_status")
    whole = src.catalog_units(spark, SMALL).select(*columns).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(src, "ROWS_OF_TASK", 1000)
    try:
        units = src.catalog_units(spark, SMALL).select(*columns)
        assert sorted(map(repr, units.collect())) == sorted(map(repr, whole))
        plan = units._jdf.queryExecution().executedPlan().toString()
        for key in ("l_partkey", "o_custkey"):
            shuffles = [line for line in plan.splitlines() if f"Exchange hashpartitioning({key}" in line]
            assert shuffles and all("REPARTITION_BY_NUM" in line for line in shuffles), key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_statistics_read_the_units_once(spark, monkeypatch):
    from verdigris.operators import votes
    from verdigris.plans import statistics

    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    written, original = [], statistics.cut_lineage
    monkeypatch.setattr(statistics, "cut_lineage", lambda df: (written.append(joins(df)), original(df))[1])
    units = src.mapped_units(spark, SMALL)
    found = statistics.CatalogStatistics.compute(units, src.products(spark, SMALL), src.reviews(spark, SMALL))
    assert written[0] == joins(units)
    pairs = votes.review_votes(units, votes.PAIR_KEYS)
    for counted, rows, keys in (
        (found.pair_counts, pairs, votes.PAIR_KEYS),
        (found.aspect_counts, votes.coarser_votes(pairs), votes.ASPECT_KEYS),
    ):
        expected = votes.count_votes(rows, ["product_id", *keys])
        assert counted.columns == expected.columns
        assert sorted(map(repr, counted.collect())) == sorted(map(repr, expected.collect()))


def test_requests_for_the_same_share_a_ranking(spark, monkeypatch):
    from verdigris.operators import recommend
    from verdigris.plans import queries

    ranked, original = [], recommend.rank_candidates

    def counted(requests, candidates, policy, limit):
        ranked.append((requests.count(), candidates))
        return original(requests, candidates, policy, limit)

    monkeypatch.setattr(recommend, "rank_candidates", counted)
    found = queries._scored_requests(spark, SMALL)[1]
    shared, candidates = ranked[0]
    requirements = queries._review_requirements(spark, SMALL)
    requests = queries.decision.decision_requests(requirements, queries.near_status_pairs(spark, SMALL), queries.NEAR_SETTINGS)
    assert shared < requests.count()
    single = original(requests, candidates, recommend.DECISION, 2)
    columns = ["request_id", "source_id", "candidate_id", "candidate_name", "utility", "score", "evidence_coverage", "supported_count", "rank"]
    rows = lambda df: sorted(tuple(row) for row in df.select(*columns).collect())
    assert rows(found) == rows(single)


def test_static_reports_get_units_dealt_by_review(spark, monkeypatch):
    from verdigris.operators import votes
    from verdigris.plans import queries

    given = []
    monkeypatch.setattr(queries.reports, "static_reports", lambda statistics, units, reviews: given.append(units))
    queries._static_reports(spark, "/root/testdata/sf0.001")
    assert exchanges(votes.review_votes(given[0], votes.PAIR_KEYS)) == 0


def test_invariants_read_units_dealt_by_review(spark, monkeypatch):
    from verdigris.operators import votes
    from verdigris.plans import queries

    monkeypatch.setattr(src, "ROWS_OF_TASK", 1000)
    read, voted = [], []
    evidence, unsupported = queries.summary.evidence, queries.quality.unsupported_evidence
    monkeypatch.setattr(queries.summary, "evidence", lambda units, keys, limit: (read.append(units), evidence(units, keys, limit))[1])
    monkeypatch.setattr(
        queries.quality, "unsupported_evidence", lambda selected, found, keys: (voted.append((selected, found, keys)), unsupported(selected, found, keys))[1]
    )
    checks = queries.contract_invariants(spark, SMALL).collect()
    assert len(checks) == 8 and all(row.passed for row in checks)
    for units in read:
        assert exchanges(votes.review_votes(units, votes.PAIR_KEYS)) == 0
        assert largest_task(votes.review_votes(units, votes.PAIR_KEYS)) < 2000
    for selected, found, keys in voted:
        listed = selected.select("review_id").distinct()
        assert found.select("review_id").distinct().count() == listed.count()
        assert unsupported(selected, found, keys).count() == 0
        other = F.when(F.col("review_vote_sentiment") == "mixed", "neutral").otherwise("mixed")
        assert unsupported(selected.withColumn("review_vote_sentiment", other), found, keys).count() == selected.count()


def test_integrity_checks_make_their_units_once(spark):
    from verdigris.plans import queries

    checks = queries.integrity_checks(spark, SMALL)
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert "l_linenumber" in plan and "l_partkey" not in plan  # the key of the lines; units are written
    assert checks.filter("check in ('constant_lineage', 'source_rows_preserved')").count() == 2


def test_rows_lost_or_won_are_counted_as_often_as_they_are(spark):
    from verdigris.operators import quality

    source = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k long, v string")
    result = spark.createDataFrame([("a", 1), (None, 2), ("d", 4), ("d", 4)], "v string, k long")
    assert sorted(map(tuple, quality.lost_rows(source, result).collect())) == [(1, "a"), (3, "c"), (4, "d"), (4, "d")]
    assert quality.lost_rows(source, source).isEmpty()


def test_own_votes_need_no_shuffle_by_the_submission(spark):
    from verdigris.plans import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        relations = queries.submitted_relationships(spark, "/root/testdata/sf0.001")
        plan = relations._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert shuffles and not any("(submission_id" in line for line in shuffles)
        groups = [line for line in shuffles if "(product_id" in line and "status_id" in line]
        assert len(groups) == 1  # the counts of pairs; groups meet both grains by the aspect
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_own_votes_equal_those_of_a_named_source(spark):
    from verdigris.operators import submission, votes

    rows = [
        (f"r{r}", f"p{r % 2}", aspect, status, sentiment)
        for r in range(6)
        for aspect, status, sentiment in [
            ("a", "s", ("positive", "negative", "unknown")[r % 3]),
            ("a", "t", ("negative", "mixed", "unknown")[r // 2]),
            ("a", None, ("positive", "unknown")[r % 2]),
            ("b", None, "neutral"),
            ("b", "u", ("neutral", "unknown", "positive")[r % 3]),
            (None, "v", "negative"),
        ]
    ]
    units = spark.createDataFrame(rows, "review_id string, product_id string, aspect string, status string, sentiment string").selectExpr(
        "*", "aspect aspect_id", "status status_id", "review_id submission_id", "1 unit_position", "concat(review_id, aspect, status) opinion_unit_id", "'mapped_exact' mapping_state"
    )
    groups = submission.submitted_groups(units)
    pair_votes = votes.review_votes(units, votes.PAIR_KEYS)
    aspect_votes = votes.coarser_votes(pair_votes)
    counts = [votes.count_votes(v, ["product_id", *k]) for v, k in ((aspect_votes, votes.ASPECT_KEYS), (pair_votes, votes.PAIR_KEYS))]
    reviews = spark.createDataFrame([("p0", 3), ("p1", 3)], "product_id string, review_count long")
    sources = units.select("submission_id", "review_id").distinct()
    found, named = (
        submission.relationships(groups, aspect_votes, pair_votes, *counts, given, reviews).filter("aspect is not null").collect() for given in (None, sources)
    )
    assert len(found) == 30 and sorted(map(repr, found)) == sorted(map(repr, named))
    assert {r.other_supporting_review_count for r in found} == {2}


def test_summary_rows_read_units_dealt_by_review(spark, monkeypatch):
    from verdigris.operators import votes
    from verdigris.plans import queries

    given = []
    monkeypatch.setattr(queries.summary, "summary_rows", lambda units, *more: given.append(units))
    queries.aspect_summary_rows(spark, "/root/testdata/sf0.001")
    assert exchanges(votes.review_votes(given[0])) == 0


def test_a_table_that_a_task_may_hold_is_sent(spark, monkeypatch):
    columns = ("review_id", "unit_position", "product_id", "raw_aspect", "raw_status")
    whole = src.catalog_units(spark, SMALL).select(*columns).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(src, "ROWS_OF_TASK", 2500)
    try:
        units = src.catalog_units(spark, SMALL).select(*columns)
        assert sorted(map(repr, units.collect())) == sorted(map(repr, whole))
        plan = units._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_partkey" not in plan and "hashpartitioning(o_custkey" not in plan
        assert largest_task(units) < 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
