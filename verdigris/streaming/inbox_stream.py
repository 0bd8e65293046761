"""The inbox as a stream of files: every file is ingested once, in small committed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..plans.ingestion import Lineage, TaxonomyTables, ingest_run
from ..sources.catalog import CatalogStore, checksum
from ..sources.inbox import inbox_elements


def inbox_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON array files of an inbox folder, whole."""
    files = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(path)
    return files.select("value", F.col("_metadata.file_path").alias("inbox_file"))


def ingest_available(
    stream: DataFrame,
    store: CatalogStore,
    responses: DataFrame,
    taxonomy: TaxonomyTables,
    lineage: Lineage,
    checkpoint: str,
    on_invalid: str = "fail",
) -> StreamingQuery:
    """Ingest what is there and stop.

    A batch is one run, named by its content: a replay is a no-op, and a second stream or a new
    checkpoint cannot take the name of another batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        reviews = inbox_elements(batch)
        content = checksum(reviews).first()
        run_id = f"batch-{content['rows']}-{content['checksum']}"
        staged = ingest.stage_inbox(reviews)
        ingest_run(store, staged, responses, taxonomy, lineage, run_id, on_invalid)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
