import random
from itertools import permutations

import numpy as np
from pyspark.sql import types as T

from verdigris.llm import filter_audit

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failures(doc_id, text, smallest):
    words = text.encode().split()
    fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in text for c in "#$%&*|")
    return fails + "E" * (doc_id is not None and smallest.get(text, doc_id) < doc_id)


def brute(docs, labels):
    """Every order run over every document."""
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    parts = {}
    for doc_id, text, lang in docs:
        parts.setdefault(lang or "", []).append((failures(doc_id, text or "", smallest), doc_id in good, doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, start=1):
                gone = [r for r in left if name in r[0]]
                before = [r for r in rows if name in r[0] and set(order[: step - 1]) & set(r[0])]
                left = [r for r in left if name not in r[0]]
                total[name] += len(gone)
                only = sum(r[0] == name for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), len(before), only, sum(r[1] for r in gone), sum(r[2] for r in gone), name]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return out


def audited(spark, docs, labels, extra=""):
    table = spark.createDataFrame(docs, DOCS).repartition(3)
    known = spark.createDataFrame(labels, LABELS).repartition(2)
    if extra:
        table, known = table.selectExpr("*", extra), known.selectExpr("*", extra)
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(table, known).collect()}


def test_against_every_order_over_every_document(spark):
    draw = random.Random(5)
    bases = [" ".join(draw.choice(["ab", "Cd", "ef", "gh\t", "#x"]) + str(draw.randrange(4)) for _ in range(n)) for n in (0, 3, 199, 200, 250)]
    bases += [" ".join(f"w{k}" for k in range(n)) for n in (199, 200, 400)] + [None, "", "A" * 30, "é é " * 300, "x " * 20_000]
    docs = [(k % 140, draw.choice(bases), draw.choice(["en", "de", "", None])) for k in range(160)] + [(None, bases[5], "en")] * 3
    labels = [(k, draw.randrange(2), draw.randrange(2)) for k in range(0, 150, 2)] + [(4, 1, None), (6, None, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)
    assert audited(spark, docs, labels, "'x' as part") == brute(docs, labels)


def test_large_groups_of_copies_and_clashing_columns(spark):
    docs = [(k, "same text", "en" if k % 3 else None) for k in range(500)] + [(1000, "other", "fr")]
    got = audited(spark, docs, [(3, 1, 1)], "1 as n")
    assert got == brute(docs, [(3, 1, 1)])
    assert got["fr", "EABCD", 1][:2] == [1, 0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(empty, spark.createDataFrame([], LABELS)).collect() == []
    one = spark.createDataFrame([(1, None, None)], DOCS)
    rows = filter_audit.audit(one, spark.createDataFrame([], LABELS)).collect()
    assert len(rows) == 600
    assert {r.part for r in rows} == {""}


def test_the_walk_keeps_what_no_active_filter_removes():
    draw = np.random.default_rng(1)
    masks, weights = np.arange(64), draw.integers(0, 1000, (64, 3))
    states = filter_audit.gray_walk(masks, weights, 6)
    for active in range(64):
        assert (states[active] == weights[(masks & active) == 0].sum(axis=0)).all()


def test_the_report_has_its_types(spark):
    got = filter_audit.audit(spark.createDataFrame([(1, "x", "en")], DOCS), spark.createDataFrame([], LABELS))
    assert got.schema["step"].dataType == T.IntegerType()
    assert got.schema["shapley"].dataType == T.LongType()
