import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text) pairs, with further columns whose names clash with results."""

    def build(rows, clash=()):
        fields = DOCUMENTS.fields + [T.StructField(name, T.StringType()) for name in clash]
        data = [
            (i, text, "en" if i is None or i % 2 else None, "src0", len(text) if text is not None else None, *["x"] * len(clash))
            for i, text in rows
        ]
        return spark.createDataFrame(data, T.StructType(fields)).repartition(3)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the smallest tables, and them as (doc_id, text)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [(row.doc_id, row.text) for row in docs.select("doc_id", "text").collect()]
