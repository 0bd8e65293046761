"""The catalog on shared storage: append-only run folders, receipts, releases with checksums.

A run writes only its own rows under ``<table>/run_id=<r>/attempt=<a>`` and then one receipt that names the attempt.
Readers see what has a receipt, so a failed or repeated run is invisible until it is complete, nothing is ever
overwritten under a reader, and adding a day costs that day, not a copy of the catalog. A taxonomy rebuild is a run like any other: it writes the units that it captured under a new mapping
version, and which ingestion runs these came from. The current units of an ingestion run are those of the latest
committed version that captured it, or its own if none did; choosing them is a join with that small table. So a run
committed while a rebuild works stays visible under its own version, and there is nothing to switch.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import TABLES

_RECEIPTS = StructType([StructField(name, StringType()) for name in ("run_id", "attempt", "payload")])
#: Tables whose rows a rebuild writes anew.
VERSIONED = ("opinion_units",)
_MANIFEST = "release_id string, name string, rows long, checksum string"
#: Folders of a report sink.
REPORT_BUCKETS = 64


def checksum(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum of all columns, in one row."""
    canonical = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws(
            "-",
            F.hex(F.coalesce(F.bit_xor(canonical), F.lit(0).cast("long"))),
            F.coalesce(F.sum(canonical.cast("decimal(38,0)")), F.lit(0)).cast("string"),
        ).alias("checksum"),
    )


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _exists(self, path: str) -> bool:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsc.hadoopConfiguration()
        return hadoop_path.getFileSystem(conf).exists(hadoop_path)

    def receipts(self) -> DataFrame:
        path = f"{self.root}/receipts"
        if not self._exists(path):
            return self.spark.createDataFrame([], _RECEIPTS)
        return self.spark.read.schema(_RECEIPTS).json(path)

    def runs(self) -> DataFrame:
        """run_id and attempt of every committed run; of a run committed twice at a time one attempt counts."""
        return self.receipts().groupBy("run_id").agg(F.min("attempt").alias("attempt"))

    def is_committed(self, run_id: str) -> bool:
        return not self.receipts().filter(F.col("run_id") == run_id).isEmpty()

    def holders(self, version: str | None = None) -> DataFrame:
        """ingestion_run_id, run_id: the committed run that holds the units of each ingestion run.

        That is the rebuild of the latest version that captured it (by time, then name), else the run itself; with
        ``version`` only what that version captured. One row for each run, however many units.
        """
        runs = self.runs()
        versions = self.read("taxonomy_versions").select("mapping_table_version_id", "created_at")
        captured = self._committed("taxonomy_captures").join(versions, "mapping_table_version_id")
        if version is not None:
            return captured.filter(F.col("mapping_table_version_id") == version).select("ingestion_run_id", "run_id")
        own = runs.select(
            F.col("run_id").alias("ingestion_run_id"),
            "run_id",
            F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("name")).alias("place"),
        )
        later = captured.select(
            "ingestion_run_id",
            "run_id",
            F.struct(F.col("created_at").alias("at"), F.col("mapping_table_version_id").alias("name")).alias("place"),
        )
        return own.unionByName(later).groupBy("ingestion_run_id").agg(F.max_by("run_id", "place").alias("run_id"))

    def commit(self, run_id: str, tables: dict[str, DataFrame], receipt: DataFrame | None = None) -> bool:
        """Write a run's rows and then its receipt; False if the run was committed before.

        What a failed attempt left stays unseen in its own folder.
        """
        if self.is_committed(run_id):
            return False
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            path = f"{self.root}/{name}/run_id={run_id}/attempt={attempt}"
            df.write.option("compression", "zstd").parquet(path)
        payload = F.lit(None).cast("string")
        source = self.spark.range(1)
        if receipt is not None:
            source, payload = receipt, F.to_json(F.struct(*receipt.columns))
        row = source.select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), payload.alias("payload"))
        row.coalesce(1).write.mode("append").json(f"{self.root}/receipts")
        return True

    def _committed(self, name: str, holders: DataFrame | None = None) -> DataFrame:
        """Rows of committed runs with their run_id, or of the runs that ``holders`` names for each ingestion run."""
        path = f"{self.root}/{name}"
        schema = TABLES.get(name)
        if schema is None and not self._exists(path):
            raise ValueError(f"no such table: {name}")
        reader = self.spark.read
        if schema is not None:
            known = [field for field in schema.fields if field.name != "run_id"]
            own = StructType([*known, StructField("run_id", StringType()), StructField("attempt", StringType())])
            if not self._exists(path):
                return self.spark.createDataFrame([], own).drop("attempt")
            reader = reader.schema(own)
        kept = self.runs() if holders is None else self.runs().join(holders, "run_id")
        rows = reader.parquet(path)
        rows = rows.withColumns({name: F.col(name).cast("string") for name in ("run_id", "attempt")})
        return rows.join(kept, kept.columns, "left_semi").drop("attempt")

    def read(self, name: str, version: str | None = None, holders: DataFrame | None = None) -> DataFrame:
        """Committed rows of a table; of a versioned one the current rows, or those that a version holds.

        ``holders`` pins the runs of a versioned table. The join with the runs prunes folders at run time.
        """
        schema = TABLES.get(name)
        if name in VERSIONED:
            holders = self.holders(version) if holders is None else holders
            return self._committed(name, holders).drop("run_id")
        visible = self._committed(name)
        return visible if schema is None or "run_id" in schema.names else visible.drop("run_id")

    def load(self) -> dict[str, DataFrame]:
        """Every catalog table by name."""
        return {name: self.read(name) for name in TABLES}

    def commits(self) -> DataFrame:
        """Receipts with their counts."""
        fields = (
            "review_count long, opinion_unit_count long, candidate_count long, delta_checksum string"
        )
        parsed = F.from_json("payload", fields)
        return self.receipts().select("run_id", parsed.alias("counts")).select("run_id", "counts.*")

    def capture(self, name: str = "opinion_units") -> DataFrame:
        """Freeze an input boundary: committed run ids with the table's row count and checksum."""
        runs = self.receipts().agg(F.sort_array(F.collect_set("run_id")).alias("run_ids"))
        one = F.lit(1).alias("one")
        return (
            checksum(self.read(name)).select("*", one).join(runs.select("*", one), "one")
        ).drop("one")

    def publish(self, release_id: str, artifacts: dict[str, DataFrame]) -> DataFrame:
        """Write artifacts and their manifest, check what was written, then add the release pointer."""
        base = f"{self.root}/releases/{release_id}"
        rows = []
        for name, df in artifacts.items():
            path = f"{base}/{name}"
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            rows.append(self._manifest_row(release_id, name, path))
        manifest = reduce(lambda a, b: a.unionByName(b), rows)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest")
        wrong = self.verify(release_id)
        if not wrong.isEmpty():
            raise ValueError(f"release {release_id} does not match its manifest")
        pointer = self.spark.range(1).select(
            F.lit(release_id).alias("release_id"), F.current_timestamp().alias("published_at")
        )
        pointer.coalesce(1).write.mode("append").json(f"{self.root}/release_pointers")
        return self.spark.read.parquet(f"{base}/manifest")

    def _manifest_row(self, release_id: str, name: str, path: str) -> DataFrame:
        return checksum(self.spark.read.parquet(path)).select(
            F.lit(release_id).alias("release_id"), F.lit(name).alias("name"), "rows", "checksum"
        )

    def verify(self, release_id: str) -> DataFrame:
        """Artifacts whose content differs from the manifest; empty for an intact release."""
        base = f"{self.root}/releases/{release_id}"
        manifest = self.spark.read.schema(_MANIFEST).parquet(f"{base}/manifest")
        names = [row["name"] for row in manifest.select("name").collect()]  # one row per artifact
        found = [self._manifest_row(release_id, name, f"{base}/{name}") for name in names]
        actual = reduce(lambda a, b: a.unionByName(b), found)
        return manifest.exceptAll(actual.select(*manifest.columns))

    def current_release(self) -> str | None:
        path = f"{self.root}/release_pointers"
        if not self._exists(path):
            return None
        pointers = self.spark.read.schema("release_id string, published_at timestamp").json(path)
        latest = pointers.agg(F.max_by("release_id", "published_at").alias("release_id"))
        return latest.first()["release_id"]

    def read_release(self, name: str, release_id: str | None = None) -> DataFrame:
        release = release_id or self.current_release()
        return self.spark.read.parquet(f"{self.root}/releases/{release}/{name}")


def write_reports(documents: DataFrame, texts: DataFrame, key: str, path: str, buckets: int = REPORT_BUCKETS) -> None:
    """JSON documents and Markdown texts by report key, in a fixed number of folders.

    A report lies in the folder of its key's bucket (``report_bucket``), with the key as a column, so that a reader of
    one report opens one folder and millions of reports don't make millions of them.
    """
    for name, df, value in (("json", documents, "payload"), ("markdown", texts, "markdown")):
        rows = df.select(report_bucket(key, buckets).alias("bucket"), key, F.col(value).alias("value"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def report_bucket(key: str | Column, buckets: int = REPORT_BUCKETS) -> Column:
    """The bucket of a report key; compare it with column ``bucket`` to read only that folder."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(buckets)).cast("int")


def write_verified(df: DataFrame, path: str) -> DataFrame:
    """Write zstd Parquet, read it back and fail if count or checksum differ."""
    expected = checksum(df).first()
    df.write.mode("error").option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    if checksum(written).first() != expected:
        raise ValueError(f"{path} differs from what was written")
    return written


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("bytes"),
        F.sha2(F.col("content"), 256).alias("sha256"),
    )


def checksum_mismatches(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries (name, bytes, sha256) without a file of the same size and hash."""
    return manifest.select("name", "bytes", "sha256").exceptAll(
        actual.select("name", "bytes", "sha256")
    )


def refuse_known_version(version: str, existing: DataFrame) -> None:
    """Fail if the mapping version was installed before."""
    same: Column = F.col("mapping_table_version_id") == version
    if not existing.filter(same).isEmpty():
        raise ValueError(f"mapping version {version} already exists")


def with_version(df: DataFrame, version: str, existing: DataFrame) -> DataFrame:
    """Stamp a mapping version; fails if the version was installed before."""
    refuse_known_version(version, existing)
    return df.withColumn("mapping_table_version_id", F.lit(version))
