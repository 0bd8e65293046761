import math
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.functions import markdown as md
from verdigris.functions import text
from verdigris.functions.cannot_link import cannot_link_matrix, reaching, split_negation
from verdigris.functions.sentiment import (
    collapse_mask,
    distribution_columns,
    rounded,
    vote_counts,
    vote_mask,
    wilson_bounds,
)
from verdigris.schemas import STATUS_CONSTRAINTS

SPACES = "　\x1c 본문 글  \n"


def values(spark, rows, names, column):
    return [row[0] for row in spark.createDataFrame(rows, names).select(column).collect()]


@pytest.mark.parametrize(
    ("labels", "expected"),
    [
        (["unknown"], "unknown"),
        (["unknown", "negative"], "negative"),
        (["positive", "negative"], "mixed"),
        (["mixed", "unknown"], "mixed"),
        (["neutral", "neutral"], "neutral"),
    ],
)
def test_collapse(spark, labels, expected):
    df = spark.createDataFrame([(label,) for label in labels], ["sentiment"])
    assert df.agg(collapse_mask(vote_mask(F.col("sentiment")))).first()[0] == expected


def test_wilson_matches_formula_and_is_zero_when_empty(spark):
    lower, upper = wilson_bounds(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (3, 10), (10, 10)], ["k", "n"]).select(lower, upper)
    got = [tuple(row) for row in rows.collect()]
    z, p, n = 1.959963984540054, 0.3, 10
    centre, margin = p + z * z / (2 * n), z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    assert got[0] == (0.0, 0.0)
    assert got[1] == pytest.approx(((centre - margin) / (1 + z * z / n), (centre + margin) / (1 + z * z / n)))
    assert got[2][1] == pytest.approx(1.0) and got[2][1] <= 1.0


def test_distribution_ties_go_to_the_earlier_sentiment(spark):
    votes = spark.createDataFrame([("neutral",), ("negative",)], ["vote"])
    row = votes.agg(*vote_counts(F.col("vote"))).select("*", *distribution_columns()).first()
    assert row["dominant_sentiment"] == "negative"
    assert row["dominant_share"] == 0.5
    assert row["normalized_entropy"] == round(1 / math.log2(5), 6)


def test_rounding_is_half_even_without_negative_zero(spark):
    got = values(spark, [(0.0078125,), (-1e-9,)], ["x"], rounded(F.col("x")))
    assert got == [0.007812, 0.0]
    assert math.copysign(1, got[1]) == 1


def test_strip_and_hash_follow_unicode_white_space(spark):
    assert values(spark, [(SPACES,)], ["t"], text.strip("t")) == [SPACES.strip()]
    a, b = values(spark, [(SPACES,), (SPACES.strip(),)], ["t"], text.content_hash("t"))
    assert a == b


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("선명하지 않음", "선명하"),
        ("불량 아님", "불량"),
        ("잘 안 보임", "잘 보임"),
        ("안", None),
        ("아님", None),
        ("선명함", None),
    ],
)
def test_split_negation(raw, expected):
    assert split_negation(raw, STATUS_CONSTRAINTS) == expected


def test_cannot_link_truth_values():
    left = ["있음", "선명함", "선명함", "밝음", "소음 있음", "발생"]
    right = ["없음", "선명하지 않음", "깨끗함", "어두움", "소음 없음", "미발생"]
    matrix = cannot_link_matrix(left, right)
    assert [bool(matrix[i, i]) for i in range(len(left))] == [True, True, False, True, True, True]


words = st.lists(st.text("ab 선함", max_size=8), max_size=6)


@given(words, words, st.sampled_from([0.0, 0.3, 0.5, 0.65, 0.8, 1.0]))
def test_reaching_equals_the_ratio_of_every_pair(left, right, threshold):
    matrix = reaching(left, right, threshold)
    assert matrix.shape == (len(left), len(right))
    for row, a in enumerate(left):
        for column, b in enumerate(right):
            assert matrix[row, column] == (SequenceMatcher(None, a, b).ratio() >= threshold)


def test_reaching_keeps_the_order_of_its_sides():
    ratios = [SequenceMatcher(None, *pair).ratio() for pair in (("tide", "diet"), ("diet", "tide"))]
    assert ratios[0] != ratios[1]
    threshold = max(ratios)
    assert [bool(reaching(["tide"], ["diet"], threshold)[0, 0]), bool(reaching(["diet"], ["tide"], threshold)[0, 0])] == [
        ratio >= threshold for ratio in ratios
    ]


def opposed(left: str, right: str, rules: dict) -> bool:
    """The rules for one pair, one after the other."""

    def alike(a, b):
        return SequenceMatcher(None, a, b).ratio() >= rules["core_similarity"]

    for side_a, side_b in rules["opposition_groups"]:
        if (left in side_a and right in side_b) or (left in side_b and right in side_a):
            return True
    left, right = " ".join(left.split()), " ".join(right.split())
    for suffix_a, suffix_b in rules["suffix_pairs"]:
        for cut_l, cut_r in ((suffix_a, suffix_b), (suffix_b, suffix_a)):
            if left.endswith(cut_l) and right.endswith(cut_r):
                cores = left.removesuffix(cut_l).strip(), right.removesuffix(cut_r).strip()
                if all(cores) and alike(*cores):
                    return True
                break
    if rules["negation_enabled"]:
        core_l, core_r = split_negation(left, rules), split_negation(right, rules)
        if core_l is not None and core_r is None:
            return alike(core_l, right)
        if core_r is not None and core_l is None:
            return alike(core_r, left)
    return False


phrases = st.lists(
    st.lists(st.sampled_from(["소음", "소리", "발생", "미발생", "있음", "없음", "안", "밝음", "어두움", "선명하지 않음", "불량 아님", ""]), max_size=3).map(" ".join),
    max_size=7,
)


@given(phrases, phrases)
def test_cannot_link_equals_the_rules_pair_by_pair(left, right):
    matrix = cannot_link_matrix(left, right)
    assert matrix.tolist() == [[opposed(a, b, STATUS_CONSTRAINTS) for b in right] for a in left]


def test_field_contract(spark):
    missing, unexpected = text.field_violations("j", ["a", "b"])
    row = spark.createDataFrame([('{"a": 1, "c": 2}',)], ["j"]).select(missing, unexpected).first()
    assert [list(item) for item in row] == [["b"], ["c"]]


def test_particles_and_cells(spark):
    words = [("화면",), ("밝기",), ("글",), ("plate",), ("",)]
    assert values(spark, words, ["w"], md.topic_particle(F.col("w"))) == ["은", "는", "은", "은", "는"]
    directions = values(spark, words, ["w"], md.directional_particle(F.col("w")))
    assert directions == ["으로", "로", "로", "로", "로"]
    cells = values(spark, [("a|b\nc",), (None,)], "w string", md.cell(F.col("w")))
    assert cells == ["a\\|b<br>c", "—"]
    assert values(spark, [(0.302,)], ["x"], md.percent(F.col("x"))) == ["30.2%"]


def test_timestamps(spark):
    row = spark.sql("SELECT timestamp'2026-08-04 00:00:00' AS t, '2026-08-03T21:33:39+09:00' AS s")
    assert row.select(text.display_time("t", "Asia/Seoul")).first()[0] == "20260804-090000"
    assert row.select(text.compact_timestamp("s")).first()[0] == "20260803-213339"
    assert row.select(text.compact_timestamp(F.lit("x"))).first()[0] is None
