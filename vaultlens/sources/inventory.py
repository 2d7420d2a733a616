"""Inventory manifests, their data files and the snapshot tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens import schemas
from vaultlens.paths import qualified
from vaultlens.sinks.reports import read_csv
from vaultlens.sources.listed_files import read_listed

SUPPORTED_FORMAT = "Parquet"


def read_manifests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Inventory manifests, one JSON document per file, with their path."""
    return (
        spark.read.schema(schemas.INVENTORY_MANIFEST)
        .option("multiLine", True)
        .json(path)
        .withColumn("manifest_path", F.col("_metadata.file_path"))
    )


def with_format_problem(manifests: DataFrame) -> DataFrame:
    """Manifests with the ``problem`` of each that is in another format."""
    wrong = F.concat(
        F.lit(f"expected inventory format {SUPPORTED_FORMAT}, got "), F.coalesce("fileFormat", F.lit("none"))
    )
    return manifests.withColumn(
        "problem", F.when(~F.col("fileFormat").eqNullSafe(F.lit(SUPPORTED_FORMAT)), wrong)
    )


def require_parquet(manifests: DataFrame) -> DataFrame:
    """Fail the job at the first manifest in another format."""
    fail = F.raise_error(F.col("problem")).cast("boolean")
    return (
        with_format_problem(manifests)
        .where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(fail))
        .drop("problem")
    )


def data_files(manifests: DataFrame) -> DataFrame:
    """Keys of the data files that manifests list."""
    return manifests.select(
        F.col("sourceBucket").alias("bucket"), F.explode("files").alias("file")
    ).select("bucket", "file.key", "file.size", F.col("file.MD5checksum").alias("md5"))


def file_paths(manifests: DataFrame, root: str) -> list[str]:
    """Paths of the data files of a few manifests, for a look at them.

    :func:`read_manifest_rows` reads any number without a list on the driver.
    """
    rows = data_files(require_parquet(manifests)).select("key").distinct()
    return sorted(f"{root.rstrip('/')}/{row.key}" for row in rows.toLocalIterator())


def read_manifest_rows(manifests: DataFrame, root: str) -> DataFrame:
    """Inventory rows of all data files that manifests list; no path passes the driver.

    A manifest in another format fails the job; a file that is listed twice is read
    once.
    """
    base = qualified(manifests.sparkSession, root)
    listed = data_files(require_parquet(manifests)).where("key IS NOT NULL")
    listed = listed.select(F.concat(F.lit(f"{base}/"), "key").alias("file"), F.col("size").alias("file_bytes"))
    return read_listed(listed, schemas.INVENTORY, "parquet", size="file_bytes")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Inventory rows of Parquet files; without files an empty table."""
    if not paths:
        return spark.createDataFrame([], schemas.INVENTORY)
    return spark.read.schema(schemas.INVENTORY).parquet(*paths)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots below ``root``: files in a folder named ``data`` only."""
    return (
        spark.read.schema(schemas.INVENTORY)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
        .where(F.col("_metadata.file_path").rlike(r"/data/[^/]+\.parquet$"))
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Bucket and key of a published inventory report."""
    return read_csv(spark, path, schemas.INVENTORY_REPORT).select("bucket", "key")
