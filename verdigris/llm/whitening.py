"""Whitening of embeddings from the exact spectrum of their integer scatter.

Entries become integers, so that the covariance of the distinct vectors is an integer matrix over n squared, known
without rounding from one distributed pass. Its characteristic polynomial is computed modulo many primes (Hessenberg
form, one Spark row for each prime) and put together by Chinese remaindering; the number of primes follows from a
bound on the coefficients. All roots are real, so the sign changes of the polynomial shifted by a count its larger
roots exactly: that isolates the largest eigenvalues, equal ones included. Each component comes from inverse iteration
on the null space in fixed-point numbers far beyond doubles, so that close eigenvalues don't blur it.

What reaches the driver has the size of the covariance (dimensions squared), whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import small_batches
from verdigris.session import cut_lineage

#: Integer steps of one unit of an entry.
STEPS = 256
COMPONENTS = 4
#: Bits to which eigenvalues are known, relative to the trace, and of the fixed-point numbers of the components.
ROOT_BITS = 256
FIXED_BITS = 448
#: Primes are below this, so that the product of two residues fits into 63 bits.
PRIME_LIMIT = 1 << 31
#: Exact sums travel as digits to this base (as its bits).
DIGIT_BITS = 31


# ---------------------------------------------------------------- vectors and their exact moments


def _entries_are_finite(vector: Column) -> Column:
    infinite = F.lit(float("inf"))
    return ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == infinite)
    )


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, the entries in whole steps, for vectors without null and non-finite entries.

    Shorter vectors are filled up with zeros to the longest length; an entry beyond 64 bits becomes the nearest long.
    """
    valid = vectors.select("vec_id", F.col(column).alias("v")).where(F.col("v").isNotNull()).where(_entries_are_finite(F.col("v")))
    whole = valid.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * STEPS).cast("long")).alias("x"))
    longest = whole.agg(F.max(F.size("x"))).head()[0] or 0
    missing = F.lit(longest) - F.size("x")
    return whole.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), missing)))


def matrix_of(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The vectors of a batch as an int64 matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    entries = np.asarray(column.flatten(), dtype=np.int64)
    return entries.reshape(len(column), len(entries) // max(1, len(column)))


def _largest(x: np.ndarray) -> int:
    """The largest absolute entry."""
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _products(x: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Blocks of exact sums over rows of outer products, each with a bound of its entries."""
    largest = _largest(x)
    rows = (1 << 53) // max(1, largest * largest)
    if rows:  # exact in doubles, which have fast products
        for at in range(0, len(x), rows):
            part = x[at : at + rows].astype(np.float64)
            yield (part.T @ part).astype(np.int64), largest * largest * len(part)
    else:
        for row in x.astype(object):
            yield np.outer(row, row), largest * largest


def _digits(values: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(place, digit number, digit) of whole numbers, so that sums of digits are longs; the last digit has the sign."""
    places, level = np.arange(len(values)), 0
    while len(values):
        high = values >> DIGIT_BITS
        last = (high == 0) | (high == -1)
        digit = np.where(last, values, values - (high << DIGIT_BITS))
        yield places, level, digit.astype(np.int64)
        places, values, level = places[~last], high[~last], level + 1


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and upper triangle of the outer products of a task's vectors, as digits."""
    count, sums, products, bound = 0, None, None, 0

    def flush() -> Iterator[pa.RecordBatch]:
        upper = products[np.triu_indices(len(sums))]
        exact = np.concatenate([np.array([count], dtype=object), sums.astype(object), upper.astype(object)])
        small = all(-(1 << 62) < v < 1 << 62 for v in exact)
        for place, level, digit in _digits(exact.astype(np.int64) if small else exact):
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int32()), pa.array(np.full(len(place), level), pa.int32()), pa.array(digit, pa.int64())],
                ["place", "level", "digit"],
            )

    for batch in batches:
        x = matrix_of(batch)
        if not x.size:
            continue
        sums = np.zeros(x.shape[1], dtype=object) if sums is None else sums
        largest = _largest(x)
        whole = x if largest * len(x) < 1 << 62 else x.astype(object)
        sums = sums + whole.sum(axis=0).astype(object)
        count += len(x)
        for block, most in _products(x):
            bound += most
            if products is None:
                products = block
            elif bound < 1 << 62:
                products = products + block
            else:
                products = products.astype(object) + block.astype(object)
    if sums is not None:
        yield from flush()


@dataclass(frozen=True)
class Moments:
    """Number of vectors, sums by dimension, and sums of products by pair of dimensions, all exact."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n squared times the covariance: an integer matrix."""
        return [
            [self.n * p - s * t for p, t in zip(row, self.sums, strict=True)]
            for row, s in zip(self.products, self.sums, strict=True)
        ]


def moments(fit: DataFrame) -> Moments | None:
    """Exact moments of the column x; None for a table without rows or entries."""
    total = (
        small_batches(fit.select("x"))
        .mapInArrow(_partial_moments, "place int, level int, digit long")
        .groupBy("place", "level")
        .agg(F.sum("digit").alias("digit"))
        .collect()  # dimensions squared, whatever the rows
    )
    if not total:
        return None
    exact: dict[int, int] = {}
    for row in total:
        exact[row.place] = exact.get(row.place, 0) + (row.digit << DIGIT_BITS * row.level)
    d = next(k for k in range(len(exact)) if 1 + k + k * (k + 1) // 2 == len(exact))
    products = [[0] * d for _ in range(d)]
    for at, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True), start=1 + d):
        products[i][j] = products[j][i] = exact[at]
    return Moments(exact[0], [exact[1 + i] for i in range(d)], products)


# ---------------------------------------------------------------- characteristic polynomial


def _is_prime(number: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.4e14."""
    if number < 2 or any(number % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return number in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        power = pow(base, odd, number)
        if power in (1, number - 1):
            continue
        for _ in range(twos - 1):
            power = power * power % number
            if power == number - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_LIMIT whose product exceeds ``bound``."""
    found, product, number = [], 1, PRIME_LIMIT - 1
    while product <= bound:
        if _is_prime(number):
            found.append(number)
            product *= number
        number -= 2
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial is larger, for a matrix without negative eigenvalues.

    The k-th coefficient is the k-th elementary symmetric function of the eigenvalues, which is largest when all
    are equal to trace / d.
    """
    d, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    return max(math.comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))


def hessenberg_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo p with zeros below its first subdiagonal."""
    h = matrix % p
    for k in range(len(h) - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    return h


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, highest power first, of the characteristic polynomial modulo p."""
    h, d = hessenberg_mod(matrix, p), len(matrix)
    leading = np.zeros((d + 1, d + 1), dtype=np.int64)  # row k: of the first k rows and columns, lowest power first
    leading[0, 0] = 1
    for k in range(1, d + 1):
        leading[k, 1:] = leading[k - 1, :-1]
        path, weights = 1, np.zeros(k, dtype=np.int64)
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * path % p
            path = path * int(h[i, i - 1]) % p if i else 0
        leading[k] = (leading[k] - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[d, ::-1].copy()


def _residues(matrix: list[list[int]]):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact = np.array(matrix, dtype=object)
        for batch in batches:
            for p in batch["p"]:
                reduced = (exact % int(p)).astype(np.int64)
                yield pd.DataFrame({"p": [p], "residues": [polynomial_mod(reduced, int(p))]})

    return solve


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, highest power first, for a symmetric integer matrix without negative eigenvalues.

    The primes are dealt to tasks; a task's work is the cube of the dimensions for each of its primes.
    """
    primes = primes_for(2 * coefficient_bound(matrix))
    tasks = min(len(primes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = (
        spark.createDataFrame([(p,) for p in primes], "p long")
        .repartition(tasks)
        .mapInPandas(_residues(matrix), "p long, residues array<long>")
        .collect()
    )
    return chinese_remainders({row.p: row.residues for row in rows})


def chinese_remainders(residues: dict[int, list[int]]) -> list[int]:
    """The whole numbers of least size with these residues by prime."""
    product = reduce(lambda a, b: a * b, residues, 1)
    weights = {p: product // p * pow(product // p, -1, p) for p in residues}
    values = []
    for k in range(len(next(iter(residues.values())))):
        value = sum(weights[p] * int(found[k]) for p, found in residues.items()) % product
        values.append(value - product if 2 * value > product else value)
    return values


# ---------------------------------------------------------------- eigenvalues


def shifted(coefficients: list[int], a: int) -> list[int]:
    """The polynomial of x + a."""
    out = list(coefficients)
    for last in range(len(out) - 1, 0, -1):
        for k in range(1, last + 1):
            out[k] += a * out[k - 1]
    return out


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots, by multiplicity, exceed ``a``, for a polynomial with real roots only (Descartes' rule is exact)."""
    signs = [c > 0 for c in shifted(coefficients, a) if c]
    return sum(one != two for one, two in zip(signs, signs[1:], strict=False))


def _value(coefficients: list[int], a: int) -> int:
    return reduce(lambda total, c: total * a + c, coefficients)


def largest_roots(coefficients: list[int], bound: int, most: int) -> list[int]:
    """The largest positive roots by multiplicity, each as the whole number that is at most one above it.

    All roots are real and none exceeds ``bound``. Intervals are halved until each holds a single root, or roots that
    no whole number separates; a single root is then closed in by the sign of the polynomial alone.
    """
    most = min(most, roots_above(coefficients, 0))
    roots: list[int] = []
    intervals = [(0, bound, roots_above(coefficients, 0), 0)]  # (low, high], roots above low, roots above high
    while intervals and len(roots) < most:
        low, high, above_low, above_high = intervals.pop()  # the highest interval is last
        if high - low <= 1:
            roots += [high] * (above_low - above_high)
        elif above_low - above_high == 1:
            below = next(c for c in reversed(shifted(coefficients, low)) if c) > 0  # the sign right above low
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(coefficients, middle)
                if value == 0:
                    high = middle
                    break
                if (value > 0) == below:
                    low = middle
                else:
                    high = middle
            roots.append(high)
        else:
            middle = (low + high) // 2
            above = roots_above(coefficients, middle)
            if above_low > above:
                intervals.append((low, middle, above_low, above))
            if above > above_high:
                intervals.append((middle, high, above, above_high))
    return roots[:most]


# ---------------------------------------------------------------- components


def _solve(matrix: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Solution of a system in fixed-point numbers (object arrays of whole numbers), with row pivots."""
    a, b, d = matrix.copy(), sides.copy(), len(matrix)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]], b[[k, pivot]] = a[[pivot, k]], b[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # one unit of the last place: the null space is what the solution grows along
        if k + 1 < d:
            factors = (a[k + 1 :, k] << FIXED_BITS) // a[k, k]
            a[k + 1 :, k:] -= (factors[:, None] * a[k, k:]) >> FIXED_BITS
            b[k + 1 :] -= (factors[:, None] * b[k]) >> FIXED_BITS
    for k in range(d - 1, -1, -1):
        b[k] = (b[k] << FIXED_BITS) // a[k, k]
        if k:
            b[:k] -= (a[:k, k][:, None] * b[k]) >> FIXED_BITS
    return b


def _unit(vector: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    """The vector without its parts along ``earlier``, at length one."""
    size = max(abs(v) for v in vector).bit_length()
    vector = np.array([(v << 2 * FIXED_BITS) >> size for v in vector], dtype=object)
    for other in earlier:
        along = (vector * other).sum() >> FIXED_BITS
        vector = vector - ((along * other) >> FIXED_BITS)
    length = math.isqrt(int((vector * vector).sum()))
    return np.array([(v << FIXED_BITS) // length for v in vector], dtype=object)


def null_vectors(matrix: list[list[int]], roots: list[int], scale: int) -> list[np.ndarray]:
    """Unit eigenvectors, as fixed-point numbers, of ``matrix`` for its eigenvalues ``roots`` / 2^scale, falling.

    Components of equal eigenvalues are any orthonormal basis of their space, the same in every run: inverse iteration
    starts from fixed vectors and is made orthogonal to the components before. The largest entry is positive.
    """
    d = len(matrix)
    exact = np.array(matrix, dtype=object).reshape(d, d) << scale
    size = max(1, max(abs(v) for v in exact.ravel()).bit_length())
    found: list[np.ndarray] = []
    for number, root in enumerate(roots):
        moved = exact.copy()
        moved[np.diag_indices(d)] -= root
        moved = (moved << FIXED_BITS) >> size
        vector = np.array([((i + 1) * (2654435761 + 40503 * number) % 1009 - 504) << FIXED_BITS for i in range(d)], dtype=object)
        for _ in range(3):
            vector = _unit(vector, found)
            vector = _solve(moved, vector[:, None])[:, 0]
        vector = _unit(vector, found)
        largest = max(range(d), key=lambda i: (abs(vector[i]) >> 64, -i))
        found.append(vector if vector[largest] > 0 else -vector)
    return found


@dataclass(frozen=True)
class Whitening:
    """The fitted transform: exact count and sums, a weight column for each component, and the share it explains."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: list[float]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening by the leading components of the distinct vectors in column x.

    There are fewer components where the vectors span fewer dimensions; None for no vectors.
    """
    exact = moments(fit)
    if exact is None:
        return None
    scatter = exact.scatter()
    d, trace = len(scatter), sum(row[i] for i, row in enumerate(scatter))
    if not trace:
        return Whitening(exact.n, exact.sums, np.zeros((d, 0)), [])
    polynomial = characteristic_polynomial(fit.sparkSession, scatter)
    scale = max(0, ROOT_BITS - trace.bit_length())
    scaled = [c << scale * k for k, c in enumerate(polynomial)]  # of the matrix times 2^scale
    roots = largest_roots(scaled, trace << scale, components)
    weights = np.zeros((d, len(roots)))
    for k, (root, vector) in enumerate(zip(roots, null_vectors(scatter, roots, scale), strict=True)):
        deviation = math.isqrt(root << 2 * FIXED_BITS - scale)  # n times the square root of the component's variance
        weights[:, k] = [int(v) * exact.n / deviation for v in vector]
    return Whitening(exact.n, exact.sums, weights, [root / (trace << scale) for root in roots])


# ---------------------------------------------------------------- projection


def _centred(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    """n * x - S, exact: longs where they fit, whole numbers of any size elsewhere."""
    largest = _largest(x)
    if largest * fitted.n + max((abs(s) for s in fitted.sums), default=0) < 1 << 62:
        return x * fitted.n - np.array(fitted.sums, dtype=np.int64)
    return x.astype(object) * fitted.n - np.array(fitted.sums, dtype=object)


def whiten(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    """A column for each component."""
    return (_centred(x, fitted) / fitted.n).astype(np.float64) @ fitted.weights


def deviations(x: np.ndarray, fitted: Whitening) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 of each vector, exact."""
    moved = _centred(x, fitted)
    if moved.dtype != object and moved.size:
        largest = _largest(moved)
        if largest * largest * moved.shape[1] < 1 << 62:
            return (moved * moved).sum(axis=1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in moved]


def identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity."""
    k = fitted.weights.shape[1]
    names = [f"w{i}" for i in range(k)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                white = whiten(matrix_of(batch), fitted)
                yield pa.RecordBatch.from_arrays([pa.array(white[:, i]) for i in range(k)], names)

    white = small_batches(fit.select("x")).mapInArrow(project, ", ".join(f"{name} double" for name in names))
    entries = [
        F.abs(F.covar_pop(names[i], names[j]) - (1.0 if i == j else 0.0)) for i in range(k) for j in range(i, k)
    ]
    return white.agg(F.array_max(F.array(*entries)).alias("error")).head().error


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, exact_deviation for each row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped; others stay, null and repeated vec_id
    included. Equal vectors are fitted once. Vectors of different lengths count as zero in the dimensions they lack.
    Components of no variance don't exist, as nothing can be whitened along them: a table whose vectors are all equal,
    empty or invalid gives no row. ``deviation`` is null where it doesn't fit into a long; ``exact_deviation`` has it as
    text at any size. Only vec_id and the vector are read.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(integer_vectors(vectors, column))
    fit = cut_lineage(rows.select("x").distinct())
    fitted = fit_whitening(fit, components)
    fields = [
        T.StructField("vec_id", rows.schema["vec_id"].dataType),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
        T.StructField("exact_deviation", T.StringType()),
    ]
    k = fitted.weights.shape[1] if fitted else 0
    if not k:
        return spark.createDataFrame([], T.StructType(fields))
    error = identity_error(fit, fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch)
            exact = [v for v in deviations(x, fitted) for _ in range(k)]
            rows = batch.num_rows
            ids = batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, fitted.n), pa.int64()),
                    pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
                    pa.array(whiten(x, fitted).ravel()),
                    pa.array(np.tile(fitted.explained, rows)),
                    pa.array(np.full(rows * k, error)),
                    pa.array([str(v) for v in exact]),
                ],
                [field.name for field in fields],
            )

    return small_batches(rows.select("vec_id", "x")).mapInArrow(project, T.StructType(fields))
