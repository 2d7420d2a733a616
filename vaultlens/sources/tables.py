"""Remote state taken as tables, and published documents read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaultlens import schemas
from vaultlens.session import scratch_dir
from vaultlens.sinks.reports import read_csv
from vaultlens.sources.listed_files import files_in, read_ranges, with_sizes

#: Tables of remote state by name: object metadata, bucket tags, bucket
#: configuration, users, usage datapoints, costs and job status.
TABLES: dict[str, StructType] = {
    "object_head": schemas.OBJECT_HEAD,
    "bucket_tags": schemas.BUCKET_TAGS,
    "bucket_config": schemas.BUCKET_CONFIG,
    "users": schemas.USERS,
    "metric_datapoint": schemas.METRIC_DATAPOINT,
    "cost_usage": schemas.COST_USAGE,
    "job_status": schemas.JOB_STATUS,
}

#: Fixed value: bytes a bucket request file may have.
MAX_REQUEST_BYTES = 512


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A landed Parquet table of :data:`TABLES` under its fixed schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_bucket_stats(spark: SparkSession, path: str) -> DataFrame:
    """Published stats rows of all buckets."""
    return spark.read.schema(schemas.BUCKET_STATS).json(path)


def read_verification_stats(spark: SparkSession, path: str) -> DataFrame:
    """Published verification counts; the written total is not read back."""
    return spark.read.schema(schemas.VERIFICATION_STATS).json(path)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of every file below ``path``."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .withColumnRenamed("value", "line")
    )


def read_archive_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Archive inventory CSV; an empty cell is NULL."""
    return read_csv(spark, path, schemas.ARCHIVE_INVENTORY)


def read_archive_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Landed catalogue entries as JSON lines."""
    return spark.read.schema(schemas.ARCHIVE_CATALOGUE).json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of bucket request files: request, line_no, name.

    A request file has at most ``MAX_REQUEST_BYTES``, so it is read in one piece,
    which also gives its lines their numbers. Larger ones are left out before they are
    opened, see :func:`oversized_requests`.
    """
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    files = _sized(spark, path).where(F.col("size") <= MAX_REQUEST_BYTES)
    contents = read_ranges(files.select("file", "size", F.col("uri").alias("request")))
    return (
        contents.select("request", F.col("content").cast("string").alias("value"))
        .where(F.col("value") != "")
        .select("request", F.posexplode(lines).alias("line_no", "name"))
    )


def oversized_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request files that are refused for their size: request, size. None is opened."""
    return _sized(spark, path).where(F.col("size") > MAX_REQUEST_BYTES).select(F.col("path").alias("request"), "size")


def _sized(spark: SparkSession, path: str) -> DataFrame:
    """Files in a folder with their sizes, written: listed and asked once, by tasks."""
    folder = scratch_dir(spark, "request-sizes")
    sized = with_sizes(files_in(spark, path))
    sized.write.parquet(folder)
    return spark.read.schema(sized.schema).parquet(folder)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their bytes, for fixity digests."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("key"), F.col("length").alias("size"), "content")
    )
