"""Web-archive files: incremental inventory, audit against storage, re-sync."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions.text import join_locations, split_locations
from vaultlens.functions.times import rfc3339

# File type kept, metadata key of a stored digest, error code.
WARC = "warc"
SHA1_KEY = "sha1"
NOT_FOUND_CODE = "NotFound"

# Audit outcomes, and those that put a file on the sync list.
OUTCOMES = [
    "matched_sha1",
    "matched_size",
    "unmatched",
    "not_found",
    "expired",
    "errored",
    "skipped",
]
RESYNC_OUTCOMES = ["unmatched", "not_found"]

FILE_KEY = ["collection_id", "filename"]


def rows_of_catalogue(catalogue: DataFrame) -> DataFrame:
    """Nested catalogue entries as flat inventory rows, with their position."""
    return catalogue.select(
        "position",
        F.col("collection").alias("collection_id"),
        "collection_name",
        F.col("account").alias("account_id"),
        "filename",
        "filetype",
        F.col("size").alias("size_bytes"),
        F.col("crawl").alias("crawl_id"),
        "crawl_time",
        "crawl_start",
        "store_time",
        F.col("checksums.sha1").alias("sha1"),
        F.col("checksums.md5").alias("md5"),
        F.coalesce("primary_location", F.lit("")).alias("primary_location"),
        F.coalesce(join_locations("locations"), F.lit("")).alias("all_locations"),
    )


def catalogue_of_rows(rows: DataFrame) -> DataFrame:
    """Inventory rows back to nested catalogue entries."""
    return rows.select(
        "filename",
        "filetype",
        F.struct("sha1", "md5").alias("checksums"),
        F.col("account_id").alias("account"),
        F.col("size_bytes").alias("size"),
        F.col("collection_id").alias("collection"),
        F.col("crawl_id").alias("crawl"),
        "crawl_time",
        "crawl_start",
        "store_time",
        split_locations("all_locations").alias("locations"),
    )


def known_counts(known: DataFrame) -> DataFrame:
    """Distinct files already recorded per collection.

    Two plain aggregates: the first removes copies before it shuffles, the
    second counts, so one large collection does not land in one task.
    """
    return (
        known.select(*FILE_KEY)
        .distinct()
        .groupBy("collection_id")
        .agg(F.count(F.lit(1)).alias("known"))
    )


def collection_delta(totals: DataFrame, known: DataFrame) -> DataFrame:
    """Compare the catalogue count of each collection with the known files.

    ``totals`` has collection_id and total. A collection is skipped when the
    counts agree and are not zero; more known than listed files point to
    deletions upstream.
    """
    count = F.coalesce("known", F.lit(0))
    return totals.join(known_counts(known), "collection_id", "left").select(
        "collection_id",
        "total",
        count.alias("known"),
        ((F.col("total") > 0) & (count == F.col("total"))).alias("skip"),
        F.greatest(F.col("total") - count, F.lit(0)).alias("expected_new"),
        (count > F.col("total")).alias("upstream_deletions"),
    )


def _listed(rows: DataFrame, delta: DataFrame | None) -> DataFrame:
    """WARC rows of the collections to process, dealt out by file.

    Skipped collections go before anything is shuffled by file. That join is by
    collection, and Spark splits a large one; the rows are then dealt by file, as
    a grouping by file could otherwise keep all of a collection in one task.
    """
    listed = rows.where(F.col("filetype") == WARC)
    if delta is not None:
        wanted = delta.where(~F.col("skip")).select("collection_id")
        listed = listed.join(wanted, "collection_id", "left_semi")
    return listed.repartition(*FILE_KEY)


def new_files(rows: DataFrame, known: DataFrame, delta: DataFrame | None = None) -> DataFrame:
    """Rows of the catalogue to append: unknown (collection, filename) pairs.

    Of several rows for one file the first listed is kept. ``delta`` leaves out
    the collections it marks as skipped.
    """
    columns = [name for name in rows.columns if name not in ("position", *FILE_KEY)]
    return (
        _listed(rows, delta)
        .join(known.select(*FILE_KEY), FILE_KEY, "left_anti")
        .groupBy(*FILE_KEY)
        .agg(F.min_by(F.struct(*columns), "position").alias("first"))
        .select(*FILE_KEY, "first.*")
    )


def run_stats(rows: DataFrame, known: DataFrame, delta: DataFrame) -> DataFrame:
    """Collections processed and skipped, files added, files already known.

    A file counts as added once; all other rows of processed collections and
    all files of skipped collections count as known.
    """
    recorded = known.select(*FILE_KEY).distinct().withColumn("recorded", F.lit(True))
    per_collection = (
        _listed(rows, delta)
        .groupBy(*FILE_KEY)
        .agg(F.count(F.lit(1)).alias("listed"))
        .join(recorded, FILE_KEY, "left")
        .groupBy("collection_id")
        .agg(
            F.count_if(F.col("recorded").isNull()).alias("new_files"),
            F.sum("listed").alias("listed"),
        )
    )
    processed = ~F.col("skip")
    hits = F.when(F.col("skip"), F.col("known_files")).otherwise(
        F.coalesce(F.col("listed") - F.col("new_files"), F.lit(0))
    )
    return (
        delta.select("collection_id", "skip", F.col("known").alias("known_files"))
        .join(per_collection, "collection_id", "left")
        .agg(
            F.count_if(processed).alias("collections_processed"),
            F.count_if(F.col("skip")).alias("collections_skipped"),
            F.coalesce(F.sum(F.when(processed, F.col("new_files"))), F.lit(0)).alias(
                "new_files"
            ),
            F.coalesce(F.sum(hits), F.lit(0)).alias("cache_hits"),
        )
    )


def audit(
    inventory: DataFrame,
    objects: DataFrame,
    key_prefix: str,
    older_than: dt.datetime | None = None,
) -> DataFrame:
    """Inventory rows with one of seven outcomes.

    ``objects`` are the stored objects of the archive bucket: key,
    content_length, metadata and error; of repeated rows of a key one counts. The order of the
    tests matters: bad time, absent, unreadable, expired, then the match. A
    stored digest that differs wins over an equal size.
    """
    stored = objects.select(
        F.col("key").alias("object_key"),
        F.greatest(F.coalesce("content_length", F.lit(0)), F.lit(0)).alias("stored_size"),
        F.element_at("metadata", SHA1_KEY).alias("stored_sha1"),
        F.col("error").alias("stored_error"),
    ).dropDuplicates(["object_key"])
    key = F.concat(F.lit(key_prefix), F.col("filename"))
    stored_at = rfc3339("store_time")
    expired = (
        F.lit(False) if older_than is None else stored_at < F.lit(older_than)
    )
    absent = F.col("object_key").isNull() | F.coalesce(
        F.col("stored_error") == NOT_FOUND_CODE, F.lit(False)
    )
    expected = F.coalesce("sha1", F.lit(""))
    outcome = (
        F.when(F.col("stored_at").isNull(), F.lit("skipped"))
        .when(absent & F.col("is_expired"), F.lit("skipped"))
        .when(absent, F.lit("not_found"))
        .when(F.col("stored_error").isNotNull(), F.lit("errored"))
        .when(F.col("is_expired"), F.lit("expired"))
        .when(
            F.col("stored_sha1").isNotNull(),
            F.when(
                (expected != "") & (F.col("stored_sha1") == expected), F.lit("matched_sha1")
            ).otherwise(F.lit("unmatched")),
        )
        .when(F.col("stored_size") == F.col("size_bytes"), F.lit("matched_size"))
        .otherwise(F.lit("unmatched"))
    )
    return (
        inventory.withColumn("audit_key", key)
        .withColumn("stored_at", stored_at)
        .withColumn("is_expired", expired)
        .join(stored, F.col("audit_key") == F.col("object_key"), "left")
        .withColumn("outcome", outcome)
        .select(*inventory.columns, F.col("audit_key").alias("key"), "outcome")
    )


def audit_stats(audited: DataFrame) -> DataFrame:
    return audited.agg(
        *[F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES]
    )


def sync_list(audited: DataFrame) -> DataFrame:
    """Files to fetch again, as inventory rows."""
    return audited.where(F.col("outcome").isin(RESYNC_OUTCOMES)).drop("outcome", "key")


def expired_list(audited: DataFrame) -> DataFrame:
    """Stored objects past their time, to be handed to whoever tags them."""
    return audited.where(F.col("outcome") == "expired").select("key")


def sync_stats(results: DataFrame, dry_run: bool = False) -> DataFrame:
    """Counts of transfer results.

    ``results`` has outcome (downloaded, skipped, failed, stream_failed or
    progress) and error. A dry run transfers nothing and counts nothing.
    """
    rows = results.where(F.lit(not dry_run))
    failed = F.col("outcome") == "failed"
    gone = F.coalesce(F.col("error") == NOT_FOUND_CODE, F.lit(False))
    return rows.agg(
        F.count_if(F.col("outcome") == "downloaded").alias("uploaded"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(failed & gone).alias("missing_upstream"),
        F.count_if((failed & ~gone) | (F.col("outcome") == "stream_failed")).alias("failed"),
    )
