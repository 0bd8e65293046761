import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import whitening as w


def table(spark, vectors, extra=False):
    rows = spark.createDataFrame([(i, v) for i, v in vectors], "vec_id long, embedding array<double>").repartition(3)
    return rows.selectExpr("*", "1 as n", "2 as x", "3 as component") if extra else rows


def entry(c):
    return max(-(1 << 63), min((1 << 63) - 1, math.floor(c * 256)))


def checked(rows, vectors, dimensions):
    """Against numpy's eigenvectors and exact whole numbers; returns the explained shares."""
    kept = [(i, [entry(c) for c in v] + [0] * (dimensions - len(v))) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(dimensions)]
    centred = np.array([[float(Fraction(n * x[k] - sums[k], n)) for k in range(dimensions)] for x in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    top = sum(values[:4] > 1e-13 * values[0])
    want = sorted(((i is not None, i or 0), sum((n * x[k] - sums[k]) ** 2 for k in range(dimensions)), c) for i, x in kept for c in range(1, top + 1))
    got = sorted(((r.vec_id is not None, r.vec_id or 0), int(r.exact_deviation), r.component) for r in rows)
    assert got == want
    assert {r.n for r in rows} == {n}
    assert all(r.identity_error <= 1e-9 for r in rows)
    for c in range(top):
        shares = {r.explained for r in rows if r.component == c + 1}
        assert len(shares) == 1
        assert shares.pop() == pytest.approx(values[c] / values.sum(), rel=1e-9, abs=1e-14)
    if all(a - b > 1e-3 * values[0] for a, b in zip(values[:top], values[1 : top + 1], strict=False)):
        for c in range(top):
            by_id = {(r.vec_id, int(r.exact_deviation)): r.whitened for r in rows if r.component == c + 1}
            place = {(i, sum((n * x[k] - sums[k]) ** 2 for k in range(dimensions))): x for i, x in kept}
            direct = {i: (np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(dimensions)]) @ basis[:, c]) / math.sqrt(values[c]) for i, x in place.items()}
            ids = list(by_id)
            a, b = np.array([by_id[i] for i in ids]), np.array([direct[i] for i in ids])
            assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8


def test_the_smallest_table_against_numpy(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [(r.vec_id, list(r.embedding)) for r in source.collect()]
    checked(w.whitened(source).collect(), vectors, 64)


def test_odd_vectors(spark):
    draw = np.random.default_rng(3)
    vectors = [(k, (draw.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for k in range(60)]
    vectors += [(0, vectors[7][1]), (None, vectors[8][1]), (3, vectors[3][1])]  # repeats
    vectors += [(70, None), (71, [1.0, None, 2.0, 0.0, 0.0]), (72, [math.nan] * 5), (73, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    vectors += [(74, [1.5, 2.5]), (75, []), (76, [-0.0] * 5)]
    checked(w.whitened(table(spark, vectors, extra=True)).collect(), vectors, 5)


def test_entries_beyond_doubles_and_longs(spark):
    draw = np.random.default_rng(4)
    vectors = [(k, (draw.normal(size=3) * [1e13, 1e12, 1e11]).tolist()) for k in range(20)] + [(99, [1e300, 0.0, 0.0])]
    rows = w.whitened(table(spark, vectors)).collect()
    checked(rows, vectors, 3)
    assert all(r.deviation is None for r in rows)


def test_fewer_components_where_vectors_span_less(spark):
    assert {r.component for r in w.whitened(table(spark, [(k, [1.0 * k, 2.0 * k, 0.0]) for k in range(9)])).collect()} == {1}
    assert w.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert w.whitened(table(spark, [(1, None)])).collect() == []
    assert w.whitened(table(spark, [(1, [])])).collect() == []
    assert w.whitened(table(spark, [(1, [0.5])]).where("false")).collect() == []


def test_equal_eigenvalues_have_orthogonal_components(spark):
    corners = [(k, [(-1.0) ** (k >> b & 1) for b in range(3)]) for k in range(8)]
    rows = w.whitened(table(spark, corners)).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    assert all(r.identity_error < 1e-12 and r.explained == pytest.approx(1 / 3) for r in rows)


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [[sum(a[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(am[i][i] for i in range(d)) / k)
    return [int(v) for v in c]


def test_the_polynomial_is_exact(spark):
    draw = np.random.default_rng(8)
    for d in (1, 2, 3, 6):
        half = draw.integers(-(10**6), 10**6, (d, d)).astype(object) * 10**9
        matrix = (half @ half.T).tolist()
        assert w.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)
    blocks = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 0, 0], [0, 0, 0, 9]]  # zeros where pivots are looked for
    assert w.characteristic_polynomial(spark, blocks) == exact_polynomial(blocks)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=6), st.integers(1, 5))
def test_roots_are_counted_with_multiplicity(roots, most):
    coefficients = [1]
    for root in roots:
        coefficients = [a - root * b for a, b in zip([*coefficients, 0], [0, *coefficients], strict=True)]
    assert w.largest_roots(coefficients, sum(roots), most) == sorted((r for r in roots if r), reverse=True)[:most]
    assert w.roots_above(coefficients, 3) == sum(r > 3 for r in roots)


def test_close_eigenvalues_keep_their_components():
    turn = np.array([[3, -4, 0], [4, 3, 0], [0, 0, 5]], dtype=object)  # 5 times a rotation
    matrix = (turn @ np.diag([10**40 + 1, 10**40, 7]).astype(object) @ turn.T).tolist()
    scale = 64
    roots = [25 * v << scale for v in (10**40 + 1, 10**40)]
    one, two = w.null_vectors(matrix, roots, scale)
    unit = [v / (1 << w.FIXED_BITS) for v in map(int, one)], [v / (1 << w.FIXED_BITS) for v in map(int, two)]
    assert np.allclose(np.abs(unit[0]), [0.6, 0.8, 0], atol=1e-15)
    assert np.allclose(np.abs(unit[1]), [0.8, 0.6, 0], atol=1e-15)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 150), 1 << 150), min_size=1, max_size=5))
def test_digits_add_up(values):
    total = [0] * len(values)
    for places, level, digits in w._digits(np.array(values, dtype=object)):
        for place, digit in zip(places, digits, strict=True):
            total[place] += int(digit) << w.DIGIT_BITS * level
    assert total == values
