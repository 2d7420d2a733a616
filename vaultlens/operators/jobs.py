"""Checksum job receipts, job status and the readiness of a verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Failure code of a job whose source listed no objects, and the
# sentinel date under which the latest version of a document is found.
EMPTY_CODE = "InvalidManifestContent"
LATEST = "0000-00-00-LATEST"

STATUS_FIELDS = ["status", "failure_codes"]

#: Statuses after which a job changes no more.
ENDED = ("complete", "failed", "cancelled")


def receipt_keys(receipts: DataFrame, today: str) -> DataFrame:
    """The four names under which a receipt can be looked up.

    Both job ids and the source bucket lead to the latest receipt, the source
    bucket also to the one of today.
    """
    keys = [
        ("source_job_id", LATEST),
        ("repl_job_id", LATEST),
        ("source_bucket", LATEST),
        ("source_bucket", today),
    ]
    entries = F.array(
        *[
            F.struct(F.col(column).alias("identifier"), F.lit(date).alias("report_date"))
            for column, date in keys
        ]
    )
    return receipts.select(F.inline(entries), "*")


def newest_receipts(lookup: DataFrame) -> DataFrame:
    """Newest receipt under each identifier and date, as a store that
    overwrites would hold it."""
    fields = ["source_bucket", "source_job_id", "repl_bucket", "repl_job_id"]
    return (
        lookup.groupBy("identifier", "report_date")
        .agg(F.max(F.struct("created_at", *fields)).alias("newest"))
        .select("identifier", "report_date", "newest.*")
    )


def events_to_status(events: DataFrame) -> DataFrame:
    """Status-change events as flat rows."""
    change = F.col("detail.serviceEventDetails")
    return events.select(
        change["jobId"].alias("job_id"),
        change["status"].alias("status"),
        change["failureCodes"].alias("failure_codes"),
        "time",
    )


def with_receipt(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Events of jobs that a receipt knows."""
    ids = receipts.select(F.explode(F.array("source_job_id", "repl_job_id")).alias("job_id"))
    return events.join(ids, "job_id", "left_semi")


def status_order(status: str = "status") -> Column:
    """What decides between events of one time: an ended job does not run again."""
    return F.lower(status).isin(*ENDED)


def newest_change() -> Column:
    """Struct whose maximum is the newest status of a job."""
    return F.struct("time", status_order().alias("ended"), *STATUS_FIELDS)


def latest_status(status: DataFrame, keep_time: bool = False) -> DataFrame:
    """Newest status of each job; of equal times, one that ends it."""
    fields = [*STATUS_FIELDS, "time"] if keep_time else STATUS_FIELDS
    return (
        status.groupBy("job_id")
        .agg(F.max(newest_change()).alias("newest"))
        .select("job_id", *[f"newest.{name}" for name in fields])
    )


def _job_state(status: Column, failure_codes: Column) -> Column:
    """complete, empty, failed, not_ready, or NULL for an unknown job."""
    failed = F.lower(status) == "failed"
    empty = F.coalesce(F.array_contains(failure_codes, EMPTY_CODE), F.lit(False))
    return (
        F.when(status.isNull(), F.lit(None).cast("string"))
        .when(status == "Complete", F.lit("complete"))
        .when(failed & empty, F.lit("empty"))
        .when(failed, F.lit("failed"))
        .otherwise(F.lit("not_ready"))
    )


def readiness_of(
    source_status: Column, source_codes: Column, repl_status: Column, repl_codes: Column
) -> Column:
    """What to do with a pair of jobs. The source side decides first.

    An empty source is nothing to report; once the source holds objects, an
    empty replica is an error.
    """
    source = _job_state(source_status, source_codes)
    repl = _job_state(repl_status, repl_codes)
    return (
        F.when(source.isNull(), F.lit("source_unknown"))
        .when(source == "empty", F.lit("empty_source"))
        .when(source == "failed", F.lit("source_failed"))
        .when(source == "not_ready", F.lit("source_not_ready"))
        .when(repl.isNull(), F.lit("repl_unknown"))
        .when(repl == "empty", F.lit("empty_replica"))
        .when(repl == "failed", F.lit("repl_failed"))
        .when(repl == "not_ready", F.lit("repl_not_ready"))
        .otherwise(F.lit("ready"))
    )


def readiness(
    receipts: DataFrame, jobs: DataFrame, manifests: DataFrame | None = None
) -> DataFrame:
    """Receipts with the readiness of their job pair.

    ``jobs`` has one row per job. With ``manifests`` (job_id), a complete job
    also needs its manifest.
    """
    if manifests is not None:
        found = manifests.select("job_id").distinct().withColumn("has_manifest", F.lit(True))
        jobs = jobs.join(found, "job_id", "left")
    else:
        jobs = jobs.withColumn("has_manifest", F.lit(True))

    def side(name: str) -> DataFrame:
        return jobs.select(
            F.col("job_id").alias(f"{name}_job_id"),
            F.col("status").alias(f"{name}_status"),
            F.col("failure_codes").alias(f"{name}_codes"),
            F.col("has_manifest").alias(f"{name}_manifest"),
        )

    state = readiness_of(
        F.col("source_status"), F.col("source_codes"), F.col("repl_status"), F.col("repl_codes")
    )
    source_lost = (F.col("source_status") == "Complete") & F.col("source_manifest").isNull()
    repl_lost = (F.col("repl_status") == "Complete") & F.col("repl_manifest").isNull()
    past_source = F.col("state").isin("ready", "repl_unknown", "empty_replica", "repl_failed", "repl_not_ready")
    return (
        receipts.join(side("source"), "source_job_id", "left")
        .join(side("repl"), "repl_job_id", "left")
        .withColumn("state", state)
        .withColumn(
            "state",
            F.when(past_source & source_lost, F.lit("source_manifest_not_found"))
            .when((F.col("state") == "ready") & repl_lost, F.lit("repl_manifest_not_found"))
            .otherwise(F.col("state")),
        )
        .select(*receipts.columns, "state")
    )


def succeeded_results(manifests: DataFrame) -> DataFrame:
    """Result files of job manifests whose task status is succeeded."""
    return _results(manifests).where(F.lower("task_status") == "succeeded")


def rejected_results(manifests: DataFrame) -> DataFrame:
    """Result files that are left out, for the warning log."""
    return _results(manifests).where(
        ~F.coalesce(F.lower("task_status") == "succeeded", F.lit(False))
    )


def _results(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.explode("Results").alias("entry")).select(
        F.col("entry.TaskExecutionStatus").alias("task_status"),
        F.col("entry.Bucket").alias("bucket"),
        F.col("entry.Key").alias("key"),
        F.col("entry.MD5Checksum").alias("md5"),
    )


def issues(results: DataFrame) -> DataFrame:
    """``name: error`` for each pair whose dispatch failed, in name order."""
    return (
        results.where(F.col("error").isNotNull())
        .select("name", F.concat("name", F.lit(": "), "error").alias("issue"))
        .orderBy("name")
    )


def dispatch_summary(results: DataFrame) -> DataFrame:
    """All pairs are tried; the run succeeded when none had an issue."""
    return results.agg(
        F.count_if(F.col("error").isNull()).alias("dispatched"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        (F.count_if(F.col("error").isNotNull()) == 0).alias("is_ok"),
    )
