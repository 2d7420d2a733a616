"""Which objects have a recorded checksum, and of which algorithm?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses and algorithm names of the checksum inventory.
OK = "ok"
NOT_FOUND = "not_found"
MISSING = "missing_checksum"
ERROR = "error"
CRC64 = "crc64nvme"
SHA256 = "sha256"

#: Error code of a metadata read that found no object.
NOT_FOUND_CODE = "NotFound"


def checksum_inventory(objects: DataFrame, heads: DataFrame) -> DataFrame:
    """Each listed object with the checksum recorded in its metadata.

    ``objects`` has bucket and key; ``heads`` has the metadata of each object,
    with an error code where reading it failed; of repeated rows of an object
    one counts, so that no object is counted twice. An error is looked at
    before the checksum. Fields without a value are empty text, and the size
    is NULL where there was nothing to read.
    """
    facts = heads.select(
        "bucket",
        "key",
        F.lit(True).alias("seen"),
        "error",
        "content_length",
        "content_type",
        "checksum_crc64_nvme",
        "checksum_sha256",
    ).dropDuplicates(["bucket", "key"])
    absent = F.col("seen").isNull() | (F.col("error") == NOT_FOUND_CODE)
    status = (
        F.when(F.coalesce(absent, F.lit(False)), F.lit(NOT_FOUND))
        .when(F.col("error").isNotNull(), F.lit(ERROR))
        .when(
            F.coalesce("checksum_crc64_nvme", "checksum_sha256").isNotNull(), F.lit(OK)
        )
        .otherwise(F.lit(MISSING))
    )
    known = F.col("status").isin(OK, MISSING)
    algorithm = (
        F.when(F.col("status") != OK, F.lit(""))
        .when(F.col("checksum_crc64_nvme").isNotNull(), F.lit(CRC64))
        .otherwise(F.lit(SHA256))
    )
    return (
        objects.select("bucket", "key")
        .join(facts, ["bucket", "key"], "left")
        .withColumn("status", status)
        .select(
            "bucket",
            "key",
            F.when(known, F.coalesce("content_length", F.lit(0))).alias("size"),
            F.when(known, F.coalesce("content_type", F.lit("")))
            .otherwise(F.lit(""))
            .alias("content_type"),
            F.when(
                F.col("status") == OK,
                F.coalesce("checksum_crc64_nvme", "checksum_sha256"),
            )
            .otherwise(F.lit(""))
            .alias("checksum"),
            algorithm.alias("checksum_algorithm"),
            "status",
            F.when(F.col("status") == ERROR, F.col("error"))
            .otherwise(F.lit(""))
            .alias("detail"),
        )
    )


def requested(triggers: DataFrame, reports: DataFrame) -> DataFrame:
    """Trigger files with the latest inventory report of the bucket they name.

    ``triggers`` has trigger and bucket, ``reports`` one row per bucket with
    its path.
    """
    return triggers.join(reports, "bucket").select("trigger", "bucket", "path")


def without_report(triggers: DataFrame, reports: DataFrame) -> DataFrame:
    """Trigger files that name a bucket without an inventory report."""
    return triggers.join(reports, "bucket", "left_anti").select("trigger", "bucket")


def stats(rows: DataFrame) -> DataFrame:
    """Rows, and rows that are not ok."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != OK).alias("non_ok"),
    )
