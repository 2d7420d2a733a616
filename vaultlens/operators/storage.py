"""Usage over all buckets, per bucket and per prefix, with shares and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions.text import bytes_text, percent, percent_text
from vaultlens.operators import inventory
from vaultlens.operators.places import numbered


def with_latest_stats(buckets: DataFrame, stats: DataFrame) -> DataFrame:
    """Buckets that have stats; ``buckets`` and ``stats`` join on bucket."""
    return buckets.join(stats, "bucket")


def without_stats(buckets: DataFrame, stats: DataFrame) -> DataFrame:
    """Buckets to warn about: no stats have been published for them."""
    return buckets.join(stats.select("bucket").distinct(), "bucket", "left_anti")


def prefixes_of_stats(stats: DataFrame) -> DataFrame:
    """Published stats back to the prefix table."""
    return stats.where(F.col("level") == "prefix").select(
        "bucket", "prefix", "total_files", "total_size"
    )


def _grand_total(prefixes: DataFrame, column: str) -> Column:
    """A total over all rows as a scalar subquery: one row, computed once."""
    return prefixes.agg(F.coalesce(F.sum(column), F.lit(0))).scalar()


def bucket_shares(prefixes: DataFrame) -> DataFrame:
    """Files and bytes of each bucket, and its percent of the stack."""
    return inventory.bucket_totals(prefixes).select(
        "bucket",
        "total_files",
        "total_size",
        "prefix_count",
        percent("total_size", _grand_total(prefixes, "total_size")).alias("pct_total_size"),
        percent("total_files", _grand_total(prefixes, "total_files")).alias(
            "pct_total_files"
        ),
    )


def prefix_shares(prefixes: DataFrame) -> DataFrame:
    """Files and bytes of each prefix, and its percent of the bucket.

    A join with the bucket totals rather than a window: Spark splits a bucket
    with very many prefixes, so none has to fit into one task.
    """
    totals = inventory.bucket_totals(prefixes).select(
        "bucket", F.col("total_size").alias("bucket_size")
    )
    return prefixes.join(totals, "bucket").select(
        "bucket",
        "prefix",
        "total_files",
        "total_size",
        percent("total_size", "bucket_size").alias("pct_bucket_size"),
    )


def summary(prefixes: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row: totals, counts, and use of the capacity where one is set."""
    per_bucket = inventory.bucket_totals(prefixes)
    limit = F.lit(capacity).cast("bigint")
    used = F.when(limit > 0, percent("total_size", limit))
    return (
        per_bucket.agg(
            F.coalesce(F.sum("total_files"), F.lit(0)).alias("total_files"),
            F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"),
            F.count(F.lit(1)).alias("bucket_count"),
            F.coalesce(F.sum("prefix_count"), F.lit(0)).alias("prefix_count"),
        )
        .withColumn("capacity_used_pct", used)
        .withColumn(
            "capacity_text",
            F.concat(
                percent_text("capacity_used_pct"), F.lit(" (of "), bytes_text(limit), F.lit(")")
            ),
        )
    )


def formatted_buckets(prefixes: DataFrame) -> DataFrame:
    """Bucket rows as the report shows them, by name."""
    return bucket_shares(prefixes).orderBy("bucket").select(
        "bucket",
        "total_files",
        bytes_text("total_size").alias("total_size"),
        percent_text("pct_total_size").alias("pct_total_size"),
        percent_text("pct_total_files").alias("pct_total_files"),
        "prefix_count",
    )


def formatted_prefixes(prefixes: DataFrame) -> DataFrame:
    """Prefix rows as the report shows them, by bucket and prefix."""
    return prefix_shares(prefixes).orderBy("bucket", "prefix").select(
        "bucket",
        "prefix",
        "total_files",
        bytes_text("total_size").alias("total_size"),
        percent_text("pct_bucket_size").alias("pct_bucket_size"),
    )


def chart_points(prefixes: DataFrame) -> DataFrame:
    """Points of the two charts: label, value, and position by bucket name."""
    point = F.explode(
        F.create_map(F.lit("size"), "total_size", F.lit("files"), "total_files")
    ).alias("chart", "value")
    return numbered(inventory.bucket_totals(prefixes), ["bucket"]).select(
        F.col("bucket").alias("label"), "position", point
    ).select("chart", "position", "label", "value")


def report_rows(stats: DataFrame, header: DataFrame) -> DataFrame:
    """The storage report: level, bucket, prefix and a JSON document for each row.

    ``stats`` are rows as from :func:`vaultlens.operators.inventory.stats_rows`;
    ``header`` is one row with owner, stack_name, generated_at,
    storage_capacity_bytes and the three data_transfer_out columns. The stack
    row has the header and the totals of all buckets; its capacity is always
    written, the transfer fields only when known.
    """
    totals = stats.where(F.col("level") == "bucket")
    fixed = F.to_json(
        F.struct(
            F.lit("stack").alias("level"), "owner", "stack_name", "generated_at", "storage_capacity_bytes"
        ),
        {"ignoreNullFields": "false"},
    )
    optional = F.to_json(
        F.struct(
            "data_transfer_out_bytes",
            "data_transfer_out_period_start",
            "data_transfer_out_period_end",
            _grand_total(totals, "total_files").alias("total_files"),
            _grand_total(totals, "total_size").alias("total_size"),
        )
    )
    none = F.lit(None).cast("string")
    stack = header.select(
        F.lit("stack").alias("level"),
        none.alias("bucket"),
        none.alias("prefix"),
        F.concat(F.lit("{"), _inside(fixed), F.lit(","), _inside(optional), F.lit("}")).alias("document"),
    )
    own = F.to_json(F.struct("level", "bucket", "prefix", "total_files", "total_size"))
    return stack.unionByName(stats.select("level", "bucket", "prefix", own.alias("document")))


def _inside(text: Column) -> Column:
    """A JSON object without its braces."""
    return F.substr(text, F.lit(2), F.length(text) - F.lit(2))
