"""Vector expressions: on the JVM for a few rows, numpy for blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column | str) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_distance(left: Column | str, right: Column | str) -> Column:
    """1 - cosine, within [0, 2]; a zero vector is at distance 1, a missing one has no distance."""
    size = norm(left) * norm(right)
    cosine = F.when(size > 0, dot(left, right) / size).otherwise(F.lit(0.0))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - cosine))
    return F.when(size.isNotNull(), clipped)


def unit_vector(vector: Column | str) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda v: v / size)).otherwise(vector)


def unit_matrix(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, sizes, out=matrix, where=sizes > 0)


def distance_matrix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows, within [0, 2]."""
    return np.clip(1.0 - left @ right.T, 0.0, 2.0)
