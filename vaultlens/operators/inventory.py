"""What objects are there, and how many files and bytes per top-level prefix?"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.functions.names import first_path_segment, is_folder_marker
from vaultlens.functions.text import size_or_zero, timestamp_text

STATE_COLUMNS = [
    "bucket",
    "key",
    "size",
    "last_modified_date",
    "storage_class",
    "replication_status",
]


def objects(inventory: DataFrame) -> DataFrame:
    """Inventory rows that are objects, without folder markers."""
    return inventory.where(~is_folder_marker("key"))


def report(inventory: DataFrame) -> DataFrame:
    """The six report columns; sizes filled with 0, times as text."""
    return objects(inventory).select(
        "bucket",
        "key",
        size_or_zero("size").alias("size"),
        timestamp_text("last_modified_date").alias("last_modified_date"),
        "storage_class",
        "replication_status",
    )


def prefix_stats(inventory: DataFrame) -> DataFrame:
    """Files and bytes per bucket and first path segment.

    The aggregate every other inventory figure is computed from: it combines
    before the shuffle, so a bucket with most of the rows costs no more. Write
    it once where several figures are wanted; they read it more than once.
    """
    return (
        objects(inventory)
        .groupBy("bucket", first_path_segment("key").alias("prefix"))
        .agg(
            F.count(F.lit(1)).alias("total_files"),
            F.sum(size_or_zero("size")).alias("total_size"),
        )
    )


def rollup(prefixes: DataFrame) -> DataFrame:
    """Prefix, bucket and grand totals from the prefix table.

    ``level`` is prefix, bucket or stack. Rolling up the small prefix table
    avoids expanding every object row three times.
    """
    levels = F.when(F.grouping("bucket") == 1, F.lit("stack")).when(
        F.grouping("prefix") == 1, F.lit("bucket")
    )
    return (
        prefixes.rollup("bucket", "prefix")
        .agg(
            levels.alias("level"),
            F.coalesce(F.sum("total_files"), F.lit(0)).alias("total_files"),
            F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"),
        )
        .withColumn("level", F.coalesce("level", F.lit("prefix")))
    )


def bucket_totals(prefixes: DataFrame) -> DataFrame:
    return prefixes.groupBy("bucket").agg(
        F.sum("total_files").alias("total_files"),
        F.sum("total_size").alias("total_size"),
        F.count(F.lit(1)).alias("prefix_count"),
    )


def stats_rows(prefixes: DataFrame) -> DataFrame:
    """Published stats: a row for each bucket and one for each of its prefixes.

    ``level`` is bucket or prefix; a bucket row has no prefix. The layout is the
    same however many prefixes a bucket has, and no bucket is gathered in one
    place. Bucket rows alone add up to the stack.
    """
    totals = bucket_totals(prefixes).select(
        "bucket",
        F.lit("bucket").alias("level"),
        F.lit(None).cast("string").alias("prefix"),
        "total_files",
        "total_size",
    )
    return totals.unionByName(prefixes.withColumn("level", F.lit("prefix")))


def distinct_states(snapshots: DataFrame) -> DataFrame:
    """Daily snapshots repeat unchanged objects; keep each state once."""
    return snapshots.select(*STATE_COLUMNS).distinct()


def object_list(states: DataFrame) -> DataFrame:
    """Every object, by bucket and key."""
    return states.select(
        "bucket", "key", "size", "last_modified_date", "storage_class"
    ).orderBy("bucket", "key")


def usage_by_bucket(states: DataFrame) -> DataFrame:
    """Objects and bytes per bucket; an unknown size is left out of the sum."""
    return (
        states.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("total_bytes"))
        .orderBy("bucket")
    )


def latest_snapshot(manifests: DataFrame, as_of: dt.date) -> DataFrame:
    """Today's manifest of each bucket, else yesterday's.

    ``manifests`` has bucket, snapshot_date (``YYYY-MM-DD``) and path.
    """
    days = [as_of.isoformat(), (as_of - dt.timedelta(days=1)).isoformat()]
    return (
        manifests.where(F.col("snapshot_date").isin(days))
        .groupBy("bucket")
        .agg(F.max(F.struct("snapshot_date", "path")).alias("newest"))
        .select("bucket", "newest.snapshot_date", "newest.path")
    )


def without_snapshot(buckets: DataFrame, latest: DataFrame) -> DataFrame:
    """Buckets for which neither day has a manifest."""
    return buckets.join(latest, "bucket", "left_anti")


