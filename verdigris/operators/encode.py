"""The vector table of raw expressions, encoded once each and extended as the vocabulary grows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Makes an encoder: texts to a matrix with a row for each. It is called once in a worker's life.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]
#: Texts that an encoder is given at a time.
ENCODED_AT_ONCE = 1024

_VECTORS = "text string, encoder_version string, embedding array<float>"
_loaded: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision; zero rows stay zero."""
    sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, sizes, out=np.zeros_like(matrix), where=sizes > 0).astype(np.float32)


def encode_missing(
    texts: DataFrame, vectors: DataFrame, factory: EncoderFactory, version: str, column: str = "text"
) -> DataFrame:
    """text, encoder_version, embedding of the distinct texts that ``vectors`` lacks under this encoder version.

    Appended to ``vectors``, they make it complete; a text is encoded once, however often it occurs, and again only by
    another version. Null texts have no vector. The encoder is made once in each Python worker.
    """
    known = vectors.filter(F.col("encoder_version") == version).select("text")
    missing = (
        texts.select(F.col(column).alias("text")).filter("text is not null").distinct().join(known, "text", "left_anti")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = _loaded.get(version)
            if encoder is None:
                encoder = _loaded[version] = factory()
            own = batch.column(0).to_pylist()
            for at in range(0, len(own), ENCODED_AT_ONCE):
                part = own[at : at + ENCODED_AT_ONCE]
                rows = _unit_rows(np.asarray(encoder(part), dtype=np.float64).reshape(len(part), -1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([version] * len(part)), pa.array(list(rows), pa.list_(pa.float32()))],
                    names=["text", "encoder_version", "embedding"],
                )

    return missing.mapInArrow(run, _VECTORS)


def with_new_vectors(
    texts: DataFrame, vectors: DataFrame, factory: EncoderFactory, version: str, column: str = "text"
) -> DataFrame:
    """``vectors`` (text, encoder_version, embedding) and those that the texts add."""
    kept = vectors.select("text", "encoder_version", F.col("embedding").cast("array<float>").alias("embedding"))
    return kept.unionByName(encode_missing(texts, vectors, factory, version, column))


def character_encoder(dimensions: int = 16) -> EncoderFactory:
    """An encoder without a model: how often each remainder of a character's code point occurs."""

    def make() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            matrix = np.zeros((len(texts), dimensions))
            for row, text in enumerate(texts):
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32) % dimensions
                matrix[row] = np.bincount(codes, minlength=dimensions)
            return matrix

        return encode

    return make

