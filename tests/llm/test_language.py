import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import langid


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs, rows_per_language=60)


def test_held_out_accuracy(docs, model):
    truth = {row.doc_id: row.lang for row in docs.collect()}
    got = langid.predict(docs, model).collect()
    assert len(got) == len(truth)
    hold = [row for row in got if row.held_out]
    assert {row.doc_id for row in hold} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([row.lang_pred == truth[row.doc_id] for row in hold]) > 0.97
    assert all(0 <= row.score <= 1 for row in got)
    assert np.mean([row.rejected for row in got]) < 0.02


def test_odd_rows(make, model):
    rows = [
        (1, None), (2, ""), (3, "123 !?"), (4, "the"), (5, "é"), (6, "the of and that " * 30_000), (7, "the and"), (7, "the and"),
        (None, "the of and"), (8, "中文"),
    ]
    got = langid.predict(make(rows, clash=("score", "letter", "lang_pred")), model).collect()
    pred = {}
    for row in got:
        pred.setdefault(row.doc_id, set()).add((row.lang_pred, row.score, row.rejected, row.held_out))
    assert all(len(x) == 1 for x in pred.values()) and len(got) == len(rows)
    assert all(next(iter(pred[i]))[:3] == ("und", 0.0, True) for i in (1, 2, 3))
    assert all(next(iter(pred[i]))[0] in model.languages for i in (4, 5, 6, 7, 8, None))
    assert not next(iter(pred[None]))[3]
    assert langid.predict(make([]), model).count() == 0


def test_nothing_to_learn_from(make):
    assert langid.fit(make([])) is None
    got = langid.predict(make([(1, "some text")]), None).collect()
    assert [(row.lang_pred, row.score, row.rejected) for row in got] == [("und", 0.0, True)]
    one = langid.fit(make([(i, "a few words here") for i in range(1, 40, 2)]))
    assert one.languages == ["en"]


def test_table_gives_the_same_as_embeddings_in_plain_python(model):
    text = "The ofé  and"
    folded = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text)
    data = np.frombuffer((" " + folded + "    ").encode(), np.uint8)
    seen = []
    for size in langid.SIZES:
        grams = langid._buckets(data, size)
        for i, bucket in enumerate(grams):
            gram = data[i : i + size].tobytes()
            crosses = gram[:2] == b"  " or b" " in gram[1:-1]
            assert (bucket == 0) == crosses, gram
            if bucket:
                seen.append(bucket)
    import pyarrow as pa

    expected = model.table[seen].astype(float).mean(axis=0) + model.bias
    assert np.allclose(langid._logits(model, pa.array([text])), expected, atol=1e-5)
    several = langid._logits(model, pa.array(["", text, "x", text]))
    assert np.allclose(several[1], expected, atol=1e-5) and np.allclose(several[3], expected, atol=1e-5)


def test_rejection_filter(make, model, monkeypatch):
    rows = [(1, "the of and that"), (2, "99"), (3, None), (None, "with the of")]
    monkeypatch.setattr(langid, "fit", lambda docs: model)
    docs = make(rows, clash=("letter", "score"))
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted(str(row.doc_id) for row in kept.collect()) == ["1", "None"]


def test_without_a_model_texts_with_letters_stay(make):
    rows = [(1, "some words"), (3, "é"), (5, "12 !?"), (7, None), (None, "no id")]
    docs = make(rows).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(str(row.doc_id) for row in langid.keep_known(docs).collect()) == ["1", "3", "None"]


def test_languages_it_never_saw_are_rejected(docs):
    spoken = docs.where("lang <> 'es'")
    own = langid.fit(spoken, rows_per_language=100)
    assert own.false_accepts < 0.05
    foreign = langid.predict(docs.where("lang = 'es' and length(text) >= 200"), own).collect()
    assert len(foreign) > 20
    assert np.mean([row.rejected for row in foreign]) > 0.95
    assert np.mean([row.rejected for row in langid.predict(spoken, own).collect()]) < 0.03


def test_real_sentences_code_and_letter_salad_are_rejected(make, model):
    odd = ["De kat zit op de mat en kijkt naar buiten", "Ala ma kota a kot ma", "def f(x): return x+1", "これは日本語です", "xqz wvk jjh qpz rtx"]
    got = langid.predict(make(list(enumerate(odd))), model).collect()
    assert all(row.rejected for row in got)


def test_no_row_is_moved_by_language_before_the_share(docs, monkeypatch):
    plans = []
    monkeypatch.setattr(langid, "hash_share", lambda key, count, rows: plans.append(count) or F.lit(True))
    langid.fit(docs, rows_per_language=5)
    assert "map" in str(plans[0]).lower()  # the counts are literals, not a joined column
