"""The pipeline's stages, each on what the one before it wrote, against brute-force versions."""

import re
from collections import Counter

import pytest
import test_ngram_join
import test_pii
import test_tokens

import corpus_pipeline
from verdigris.llm import langid



@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(1001, None), (1002, "1234 !!"), (1003, docs.first().text + " \n"), (None, "no id at all in this text here")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    tables = [docs.unionByName(more)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, tables[-1], folder).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def rows_of(df):
    return [(row.doc_id, row.text) for row in df.collect()]


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "pii", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_stage_drops_what_it_rejects(stages):
    given, kept = rows_of(stages[0]), rows_of(stages[1])
    predicted = langid.predict(stages[0], langid.fit(stages[0])).collect()
    gone = {row.doc_id for row in predicted if row.rejected}
    assert {1001, 1002} <= gone and len(gone) <= 4
    assert Counter(kept) == Counter(r for r in given if r[0] not in gone)


def test_exact_stage_keeps_one_of_each_text(stages):
    best = {}
    for i, text in rows_of(stages[1]):
        key = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[key] = min(best.get(key, (1, 0, 0, None, None)), (-len(text), i is None, i or 0, i, text))
    assert sorted(map(str, rows_of(stages[2]))) == sorted(str(x[3:]) for x in best.values())


def test_near_stage_keeps_one_of_each_component(stages):
    rows = rows_of(stages[2])
    kept = {i for i, _, component in test_ngram_join.brute(rows) if i is None or i == component}
    assert Counter(rows_of(stages[3])) == Counter(r for r in rows if r[0] in kept)


def test_pii_stage_keeps_all_and_redacts(stages):
    given, kept = dict(rows_of(stages[3])), dict(rows_of(stages[4]))
    assert given.keys() == kept.keys()
    found = 0
    for i, text in given.items():
        spans = test_pii.brute(text)
        found += len(spans)
        assert (kept[i] != text) == bool(spans)
        assert not test_pii.brute(kept[i])
    assert found
    assert all(row.n_chars == len(row.text) for row in stages[4].where("doc_id < 1000").collect())


def test_packing_stage_packs_all(stages):
    encode = test_tokens.by_library()
    wanted = {i: len(encode(text)) + 1 for i, text in rows_of(stages[4])}
    got = Counter()
    for row in stages[5].collect():
        got[row.doc_id] += row.length
        assert row.doc_tokens == wanted[row.doc_id]
    assert got == wanted


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    names = {name.split("_")[0] for name in __spark_entry__.queries() if re.match(r"op\d+_", name)}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
