"""The reports a deployment runs on schedules or on arriving files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens import schemas
from vaultlens.operators import archive, checksums, inventory, storage, verification
from vaultlens.session import scratch_dir, shuffles_dropped
from vaultlens.sinks import reports
from vaultlens.sources import inventory as inventory_source
from vaultlens.sources import jobs as job_source
from vaultlens.sources import tables

STATS_COLUMNS = [
    "total_objects",
    "matches",
    "mismatches",
    "missing_replica",
    "missing_source",
    "failed_source",
    "failed_replication",
]

#: What names a pair of jobs.
PAIR = ("source_bucket", "source_job_id", "repl_bucket", "repl_job_id")


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows through a written table, so that several outputs share one run and
    a lost executor costs a re-read, not a recomputation. Checksums are digits, which
    zstd packs and Spark's own choice does not."""
    path = scratch_dir(rows.sparkSession, purpose)
    with shuffles_dropped(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def verification_report(
    spark: SparkSession,
    name: str,
    source_manifest: str,
    replication_manifest: str,
    results_root: str,
    out: str,
    report_date: str,
) -> DataFrame:
    """Publish the verification report and stats of one bucket pair.

    ``name`` is the source bucket, under which both are published.

    Returns the one-row stats with the verdict. The result files of each side are
    parsed once.
    """

    def side(manifest: str) -> DataFrame:
        manifests = job_source.read_manifests(spark, manifest)
        results = job_source.read_manifest_results(manifests, results_root)
        return written(verification.with_checksums(results), "verification-side")

    sides = side(source_manifest), side(replication_manifest)
    # the sort looks at its input twice, so that is written before
    compared = written(verification.compare(*sides), "verification")
    reports.publish_csv(verification.report(compared), f"{out}/reports/checksums/{name}", report_date)
    counts = verification.count(*sides)
    stats = f"{out}/metadata/checksums/stats/{name}"
    reports.publish_json(counts.select(*STATS_COLUMNS), stats, report_date)
    stored = tables.read_verification_stats(spark, reports.dated_path(stats, report_date))
    return verification.with_verdict(stored)


def pair_reports(
    pairs: DataFrame, manifests_root: str, results_root: str, out: str, batch: str
) -> DataFrame:
    """Verification reports and stats of many decided pairs in one run.

    ``pairs`` are receipts whose ``state`` is decided. Of the ready ones both manifests
    are read; a pair that lacks one gets the state that says so. Reports go below
    ``reports/checksums/<batch>`` in a folder for each source bucket, and stats of the
    pairs below ``stats/<batch>``; both replace what an earlier try has written.
    Returns the stats of the pairs that were verified.
    """
    spark = pairs.sparkSession
    pairs = written(pairs, "pairs")
    ready = pairs.where(F.col("state") == "ready")
    ids = ready.select(F.explode(F.array("source_job_id", "repl_job_id")).alias("job_id")).distinct()
    manifests = written(job_source.manifests_of_jobs(ids, manifests_root), "pair-manifests")
    found = manifests.select("job_id").distinct()
    whole = ready.join(found.withColumnRenamed("job_id", "source_job_id"), "source_job_id", "left_semi").join(
        found.withColumnRenamed("job_id", "repl_job_id"), "repl_job_id", "left_semi"
    )
    whole = written(whole.select(*PAIR), "pairs-whole")

    def side(job: str) -> DataFrame:
        own = whole.join(manifests.withColumnRenamed("job_id", job), job).select(*PAIR, "Results")
        results = job_source.read_manifest_results(own, results_root, *PAIR)
        parsed = verification.with_checksums(results, keep=PAIR)
        return written(parsed, "verification-side")

    sides = side("source_job_id"), side("repl_job_id")
    compared = written(verification.compare(*sides, by=PAIR), "verification")
    order = [F.col("source_bucket"), verification.category_order(), F.col("bucket"), F.col("key"), F.col("version_id")]
    rows = compared.orderBy(*order).select("source_bucket", *verification.REPORT_COLUMNS)
    listed = rows.write.mode("overwrite").options(**reports.CSV_OPTIONS).partitionBy("source_bucket")
    with shuffles_dropped(spark):
        listed.csv(f"{out}/reports/checksums/{batch}")
    counts = verification.count(*sides, by=PAIR).select(*PAIR, *STATS_COLUMNS)
    # a pair of empty result files has counts too
    zeros = whole.join(counts, list(PAIR), "left").fillna(0, STATS_COLUMNS)
    zeros.write.mode("overwrite").parquet(f"{out}/stats/{batch}")
    return spark.read.parquet(f"{out}/stats/{batch}")


def inventory_report(
    spark: SparkSession,
    name: str,
    manifest: str | list[str],
    data_root: str,
    out: str,
    report_date: str,
) -> DataFrame:
    """Publish the inventory report and the stats of its buckets.

    ``name`` is the bucket, or any name for the manifests of several buckets
    in one run. Returns the prefix table the stats were built from.
    """
    manifests = inventory_source.read_manifests(spark, manifest)
    rows = written(inventory_source.read_manifest_rows(manifests, data_root), "inventory-rows")
    reports.publish_csv(
        inventory.report(rows), f"{out}/reports/manifests/{name}", report_date
    )
    prefixes = written(inventory.prefix_stats(rows), "prefix-stats")
    reports.publish_json(
        inventory.stats_rows(prefixes),
        f"{out}/metadata/manifests/stats/{name}",
        report_date,
    )
    return prefixes


def storage_report(
    spark: SparkSession,
    buckets: DataFrame,
    out: str,
    report_date: str,
    owner: str,
    stack: str,
    generated_at: dt.datetime,
    capacity: int | None = None,
    transfer: DataFrame | None = None,
) -> DataFrame:
    """Publish the storage report of a stack from the latest bucket stats.

    ``buckets`` (bucket) are those to report; ones without stats are left out,
    see :func:`vaultlens.operators.storage.without_stats`. ``transfer`` is the
    one-row result of the egress query, if it could be had. Returns the
    one-row summary.
    """
    latest = tables.read_bucket_stats(
        spark, reports.latest_path(f"{out}/metadata/manifests/stats/*")
    )
    stats = written(storage.with_latest_stats(buckets.select("bucket"), latest), "bucket-stats")
    if transfer is None:
        none = F.lit(None)
        transfer = spark.range(1).select(
            none.cast("bigint").alias("data_transfer_out_bytes"),
            none.cast("string").alias("data_transfer_out_period_start"),
            none.cast("string").alias("data_transfer_out_period_end"),
        )
    header = transfer.withColumns(
        {
            "owner": F.lit(owner),
            "stack_name": F.lit(stack),
            "generated_at": F.lit(generated_at.strftime("%Y-%m-%dT%H:%M:%SZ")),
            "storage_capacity_bytes": F.lit(capacity).cast("bigint"),
        }
    )
    reports.publish_text(
        storage.report_rows(stats, header).select("document"),
        f"{out}/metadata/storage/stats",
        report_date,
    )
    return storage.summary(storage.prefixes_of_stats(stats), capacity)


def checksum_inventory(
    spark: SparkSession,
    name: str,
    inventory_report_path: str,
    heads: DataFrame,
    out: str,
    report_date: str,
) -> DataFrame:
    """Publish the recorded checksums of the objects of an inventory report."""
    listed = inventory_source.read_report(spark, inventory_report_path)
    rows = written(checksums.checksum_inventory(listed, heads), "checksum-inventory")
    reports.publish_csv(rows, f"{out}/reports/checksum-inventory/{name}", report_date)
    return checksums.stats(rows)


def archive_inventory(
    spark: SparkSession, catalogue: DataFrame, totals: DataFrame, path: str
) -> DataFrame:
    """Append the new catalogue files to the archive inventory at ``path``.

    Nothing is written when there is nothing new. Returns the run stats.
    """
    rows = archive.rows_of_catalogue(catalogue)
    try:
        known = tables.read_archive_inventory(spark, path)
    except Exception as error:  # the first run has no inventory yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = spark.createDataFrame([], schemas.ARCHIVE_INVENTORY)
    known = written(known.select("collection_id", "filename"), "archive-known")
    delta = archive.collection_delta(totals, known)
    columns = schemas.ARCHIVE_INVENTORY.fieldNames()
    # Both results are written before the inventory they read is added to.
    fresh = written(archive.new_files(rows, known, delta).select(*columns), "archive-new")
    stats = written(archive.run_stats(rows, known, delta), "archive-run")
    if not fresh.isEmpty():
        reports.append_csv(fresh, path)
    return stats


def archive_audit(
    spark: SparkSession,
    inventory_path: str,
    objects: DataFrame,
    key_prefix: str,
    older_than: dt.datetime | None,
    out: str,
    report_date: str,
) -> DataFrame:
    """Audit the archive, publish the re-sync list, return the counts."""
    rows = tables.read_archive_inventory(spark, inventory_path)
    audited = written(archive.audit(rows, objects, key_prefix, older_than), "archive-audit")
    reports.publish_csv(archive.sync_list(audited), f"{out}/archive/sync", report_date)
    return archive.audit_stats(audited)
