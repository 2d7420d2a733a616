"""Latest usage datapoints per bucket and year-to-date transfer out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric and cost dimension names.
SIZE_METRIC = "BucketSizeBytes"
COUNT_METRIC = "NumberOfObjects"
ALL_STORAGE_TYPES = "AllStorageTypes"
STORAGE_SERVICE = "Amazon Simple Storage Service"
TRANSFER_OUT_GROUP = "S3: Data Transfer - Internet (Out)"

LOOKBACK_DAYS = 2
BYTES_PER_UNIT = 1_000_000_000


def latest_points(datapoints: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Newest point per bucket, metric and storage type of the last two days.

    The maximum of a struct combines before the shuffle, which a ranking
    window would not.
    """
    start = as_of - dt.timedelta(days=LOOKBACK_DAYS)
    return (
        datapoints.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(as_of)))
        .groupBy("bucket", "metric", "storage_type")
        .agg(F.max(F.struct("ts", "tie_breaker", "average")).alias("newest"))
        .select("bucket", "metric", "storage_type", "newest.ts", "newest.average")
    )


def bucket_metrics(points: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Bytes and objects per bucket from :func:`latest_points`.

    Each storage type is cut to a whole number before the sum. Buckets given
    in ``buckets`` but without points are listed with 0.
    """
    whole = F.greatest(F.floor("average").cast("bigint"), F.lit(0))
    measured = points.groupBy("bucket").agg(
        F.sum(F.when(F.col("metric") == SIZE_METRIC, whole)).alias("total_bytes"),
        F.sum(
            F.when(
                (F.col("metric") == COUNT_METRIC)
                & (F.col("storage_type") == ALL_STORAGE_TYPES),
                whole,
            )
        ).alias("total_objects"),
    )
    if buckets is not None:
        measured = buckets.select("bucket").join(measured, "bucket", "left")
    return measured.select(
        "bucket",
        F.coalesce("total_objects", F.lit(0)).alias("total_objects"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
    )


def _amount(text: Column) -> Column:
    """A decimal number, NULL for other text."""
    shape = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
    return F.when(text.rlike(shape), text.try_cast("double"))


def _whole(value: Column) -> Column:
    """A whole non-negative double as the same number, which a bigint may not hold.

    A cast to decimal goes by the digits that tell a double from the next and would
    give others than the double's own. Above 2^32 times a bigint it fails.
    """
    high = (value / F.lit(2.0**32)).cast("bigint")
    low = (value - high.cast("double") * F.lit(2.0**32)).cast("bigint")
    return (high.cast("decimal(19,0)") * F.lit(2**32).cast("decimal(10,0)") + low.cast("decimal(10,0)")).cast("decimal(38,0)")


def transfer_out(costs: DataFrame, stack: str, as_of: dt.date) -> DataFrame:
    """Bytes sent to the internet from 1 January until ``as_of``.

    One row; all columns are NULL when nothing was sent or no day has passed. The
    bytes are a decimal without places: 9.3 billion units are more than a bigint holds.
    """
    start = as_of.replace(month=1, day=1)
    quantity = (
        costs.where(
            (F.col("period") >= F.lit(start))
            & (F.col("period") < F.lit(as_of))
            & (F.col("service") == STORAGE_SERVICE)
            & (F.col("usage_group") == TRANSFER_OUT_GROUP)
            & (F.col("stack_tag") == stack)
        )
        .agg(F.sum(_amount(F.col("usage_quantity"))).alias("quantity"))
        .withColumn("known", F.col("quantity") > 0)
    )
    return quantity.select(
        F.when(
            F.col("known"),
            _whole(F.round(F.col("quantity") * F.lit(float(BYTES_PER_UNIT)))),
        ).alias("data_transfer_out_bytes"),
        F.when(F.col("known"), F.lit(start.isoformat())).alias(
            "data_transfer_out_period_start"
        ),
        F.when(F.col("known"), F.lit(as_of.isoformat())).alias(
            "data_transfer_out_period_end"
        ),
    )
