"""Session construction and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster pass nothing: master and partition counts come from the submit command, and
    adaptive execution coalesces or splits shuffle partitions at run time.
    """
    builder = (
        SparkSession.builder.appName("verdigris")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot join key even where an aggregation reuses the join's partitioning.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Recording the Python call site of every column costs seconds on wide report plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only for local runs without it."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="verdigris-checkpoint-"))


#: Kept tables are read a few times at most, so they are packed more tightly than Spark does by itself.
PACKED = {"compression": "zstd"}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back.

    It survives executor loss, is computed once (a plain checkpoint computes its input twice), and
    its known file size lets Spark decide by size whether later joins may broadcast it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.options(**PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: While this is true, a join by several keys shuffles sides that are dealt by one of them already.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def cut_and_deal(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """``cut_lineage`` in ``tasks`` buckets of ``key``: what is grouped, ranked or joined by the key isn't shuffled again.

    That holds for joins by the key and others, too, in what a further call of this writes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"table_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        df.repartition(tasks, key).write.bucketBy(tasks, key).options(**PACKED, path=path).saveAsTable(name)
    finally:
        spark.conf.set(ALL_KEYS, before)
    return spark.table(name)


def cut_and_observe(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` and the row count (``rows``) and further aggregates of what it writes, without another job."""
    seen = Observation()
    kept = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in measures.items())))
    return kept, seen.get
