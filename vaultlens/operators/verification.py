"""Does every object in the source have an identical replica, and vice versa?

A result row is identified by (key, version_id). Equality is plain ``=``, so a
NULL version never finds a partner. The six categories are neither exclusive
nor exhaustive: an object that failed on both sides is listed twice, and one
verified on both sides without a recorded checksum is not listed at all.

Compared pairs come from an inner join and objects without a partner from two
anti-joins, all on (key, version_id). Spark splits skewed partitions of each of
them, so an object version that fills the table is spread over many tasks. Write
each parsed side once where the messages are costly to parse: the sides are read
once for each join. The counts need no pairs at all, see :func:`count`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses in report order.
STATUSES = [
    "ok",
    "mismatch",
    "missing_replica",
    "missing_source",
    "failed_source",
    "failed_replication",
]

SUCCEEDED = "succeeded"
FAILED = "failed"

REPORT_COLUMNS = [
    "bucket",
    "key",
    "version_id",
    "status",
    "checksum_algorithm",
    "checksum_source",
    "checksum_replication",
]

COUNTS = [
    "matches",
    "mismatches",
    "missing_replica",
    "missing_source",
    "failed_source",
    "failed_replication",
]

_MESSAGE = "checksum_base64 STRING, checksumAlgorithm STRING"


def with_checksums(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Job results with the checksum taken out of the JSON message.

    ``keep`` are further columns to hand on.

    The message is parsed once and dropped here, before any shuffle. One that
    is not valid JSON counts as having no checksum, see :func:`bad_messages`.
    """
    return results.withColumn("message", F.from_json("result_message", _MESSAGE)).select(
        *keep,
        "bucket",
        "key",
        "version_id",
        "task_status",
        F.col("message.checksum_base64").alias("checksum"),
        F.col("message.checksumAlgorithm").alias("checksum_algorithm"),
    )


def bad_messages(results: DataFrame) -> DataFrame:
    """Count of messages that are present but are not valid JSON."""
    message = F.from_json(
        "result_message",
        f"{_MESSAGE}, malformed STRING",
        {"columnNameOfCorruptRecord": "malformed"},
    )
    return results.agg(
        F.count_if(
            F.col("result_message").isNotNull()
            & (message.isNull() | message["malformed"].isNotNull())
        ).alias("bad_messages")
    )


def _has_identity() -> Column:
    return F.col("key").isNotNull() & F.col("version_id").isNotNull()


def compare(source: DataFrame, replication: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every report row, in no order; inputs as from :func:`with_checksums`.

    With ``by``, columns of both sides that are not null, rows are only compared where
    these are equal, and the report keeps them: many bucket pairs in one run.
    """
    return (
        compared_pairs(source, replication, by)
        .unionByName(_without_partner(source, replication, "missing_replica", by))
        .unionByName(_without_partner(replication, source, "missing_source", by))
        .unionByName(_alone(source, "failed_source", "missing_replica", by))
        .unionByName(_alone(replication, "failed_replication", "missing_source", by))
    )


def compared_pairs(source: DataFrame, replication: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of succeeded rows that both have a checksum: ok or mismatch."""
    usable = (F.col("task_status") == SUCCEEDED) & F.col("checksum").isNotNull()
    other = replication.where(usable).select(
        *by, "key", "version_id", F.col("checksum").alias("checksum_replication")
    )
    same = F.col("checksum_source") == F.col("checksum_replication")
    return (
        source.where(usable)
        .withColumnRenamed("checksum", "checksum_source")
        .join(other, [*by, "key", "version_id"])
        .withColumn("status", F.when(same, F.lit("ok")).otherwise(F.lit("mismatch")))
        .select(*by, *REPORT_COLUMNS)
    )


def _without_partner(side: DataFrame, other: DataFrame, missing: str, by: tuple[str, ...]) -> DataFrame:
    """Succeeded rows whose object version the other side does not list."""
    return (
        side.where(_has_identity() & (F.col("task_status") == SUCCEEDED))
        .join(other.where(_has_identity()).select(*by, "key", "version_id"), [*by, "key", "version_id"], "left_anti")
        .select(*by, *_listed(F.lit(missing)))
    )


def _alone(side: DataFrame, failed: str, missing: str, by: tuple[str, ...]) -> DataFrame:
    """Rows that are listed without looking for a partner.

    Failed tasks are listed as they are, and a row without a key or version has
    no partner: neither needs a shuffle, and one scan finds both.
    """
    status = F.when(F.col("task_status") == FAILED, F.lit(failed)).when(
        ~_has_identity() & (F.col("task_status") == SUCCEEDED), F.lit(missing)
    )
    return side.withColumn("status", status).where(F.col("status").isNotNull()).select(
        *by, *_listed(F.col("status"))
    )


def _listed(status: Column) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        F.col("bucket"),
        F.col("key"),
        F.col("version_id"),
        status.alias("status"),
        none.alias("checksum_algorithm"),
        none.alias("checksum_source"),
        none.alias("checksum_replication"),
    ]


def category_order() -> Column:
    """0 to 5, in the order in which the report lists the categories."""
    order = F.array(*[F.lit(status) for status in STATUSES])
    return F.array_position(order, F.col("status")).cast("int") - F.lit(1)


def report(rows: DataFrame) -> DataFrame:
    """Compared rows in category order.

    The key columns break ties, so the range partitioning stays even although
    nearly all rows share one category. A place of their own, which is not kept,
    spreads the rows of one object version too.
    """
    return (
        rows.select(*REPORT_COLUMNS, F.monotonically_increasing_id().alias("place"))
        .orderBy(category_order(), "bucket", "key", F.col("version_id").asc_nulls_last(), "place")
        .drop("place")
    )


def stats(rows: DataFrame) -> DataFrame:
    """Stats of compared rows, see :func:`with_verdict`."""
    return with_verdict(
        rows.agg(
            *[
                F.count_if(F.col("status") == status).alias(name)
                for status, name in zip(STATUSES, COUNTS)
            ]
        )
    )


def _tally(side: DataFrame, own: str, other: str, by: tuple[str, ...]) -> DataFrame:
    done = (F.col("task_status") == SUCCEEDED).cast("bigint")
    failed = (F.col("task_status") == FAILED).cast("bigint")
    none = F.lit(0).cast("bigint")
    return side.select(
        *by,
        "key",
        "version_id",
        "checksum",
        F.lit(1).cast("bigint").alias(f"{own}_rows"),
        F.coalesce(done, F.lit(0)).alias(f"{own}_done"),
        F.coalesce(failed, F.lit(0)).alias(f"{own}_failed"),
        *[none.alias(f"{other}_{name}") for name in ("rows", "done", "failed")],
    )


def count(source: DataFrame, replication: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Stats without the report, by counting instead of joining.

    With ``by``, as for :func:`compare`, one row for each value of these columns.

    The rows of a key that agree are the product of the counts of each
    checksum, those that differ are the rest of the product of both totals.
    Both aggregates combine before they shuffle, so neither a key that fills
    the table nor one with many checksums makes a large task, and no pair of
    rows is ever formed.
    """
    names = [f"{side}_{name}" for side in ("s", "r") for name in ("rows", "done", "failed")]
    per_checksum = (
        _tally(source, "s", "r", by)
        .unionByName(_tally(replication, "r", "s", by))
        .groupBy(*by, "key", "version_id", "checksum")
        .agg(*[F.sum(name).alias(name) for name in names])
    )
    known = F.col("checksum").isNotNull()
    per_object = per_checksum.groupBy(*by, "key", "version_id").agg(
        *[F.sum(name).alias(name) for name in names],
        F.sum(F.when(known, F.col("s_done"))).alias("s_known"),
        F.sum(F.when(known, F.col("r_done"))).alias("r_known"),
        F.sum(F.when(known, F.col("s_done") * F.col("r_done"))).alias("equal_pairs"),
    )
    # A key or version that is NULL has no partner.
    paired = F.col("key").isNotNull() & F.col("version_id").isNotNull()
    figures = [
        F.when(paired, F.col("equal_pairs")),
        F.when(paired, F.col("s_known") * F.col("r_known") - F.col("equal_pairs")),
        F.when(~paired | (F.col("r_rows") == 0), F.col("s_done")),
        F.when(~paired | (F.col("s_rows") == 0), F.col("r_done")),
        F.col("s_failed"),
        F.col("r_failed"),
    ]
    return with_verdict(
        per_object.groupBy(*by).agg(
            *[
                F.coalesce(F.sum(figure), F.lit(0)).alias(name)
                for figure, name in zip(figures, COUNTS)
            ]
        )
    )


def with_verdict(counts: DataFrame) -> DataFrame:
    """Add ``total_objects`` (counted report rows) and ``is_ok``."""
    total = (
        F.col("matches")
        + F.col("mismatches")
        + F.col("missing_replica")
        + F.col("missing_source")
        + F.col("failed_source")
        + F.col("failed_replication")
    )
    ok = (
        (F.col("mismatches") == 0)
        & (F.col("missing_source") == 0)
        & (F.col("failed_source") == 0)
        & (F.col("failed_replication") == 0)
    )
    return counts.withColumns({"total_objects": total, "is_ok": ok})
