"""Queries that land a view as files and read it with the engine's own readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.governance import _RECEIPT
from checks.inventory import _STATS_ROWS
from checks.objects import _CHECKSUMS, _CRC
from checks.registry import View, query
from checks.streams import _landed_manifests
from checks.verification import _REPORT, _STATS, _oracle, _sides, _written_sides
from vaultlens import schemas
from vaultlens.functions import crc64
from vaultlens.functions.names import file_stem
from vaultlens.operators import inventory, verification
from vaultlens.paths import qualified
from vaultlens.plans import reports as plans
from vaultlens.plans.reports import STATS_COLUMNS
from vaultlens.session import scratch_dir
from vaultlens.sinks import receipts, reports
from vaultlens.sinks.named_files import write_named
from vaultlens.sources import inventory as inventory_source
from vaultlens.sources import jobs as job_source
from vaultlens.sources import tables
from vaultlens.sources.listed_files import read_ranges, with_sizes

DAY = "2024-01-31"

#: Keys with blanks around them, line breaks, quotes and commas.
_ODD = """CASE length({key}) % 5 WHEN 0 THEN concat(' ', {key}) WHEN 1 THEN concat({key}, ' ')
  WHEN 2 THEN concat('a', chr(10), {key}) WHEN 3 THEN concat(chr(34), {key}, ',') ELSE {key} END"""


def _odd(name: str):
    return F.expr(_ODD.replace("{key}", name))


@query(
    "inventory_report_csv",
    f"""WITH o AS (SELECT bucket, {_ODD.replace('{key}', 'key')} AS key, coalesce(size, 0) AS size,
  concat(CAST(last_modified_date AS VARCHAR), '+00') AS last_modified_date, storage_class, replication_status
  FROM @inventory WHERE NOT key LIKE '%/') SELECT * FROM o""",
)
def inventory_report_csv(view: View):
    """The latest copy of a report with odd keys, read back."""
    rows = inventory.report(view("inventory")).withColumn("key", _odd("key"))
    base = scratch_dir(rows.sparkSession, "report-csv")
    reports.publish_csv(rows, base, DAY)
    return reports.read_csv(rows.sparkSession, reports.latest_path(base), schemas.INVENTORY_REPORT)


@query(
    "verification_report_csv",
    _oracle(_REPORT).replace("SELECT * FROM results", f"SELECT * REPLACE ({_ODD.replace('{key}', 'key')} AS key) FROM results"),
)
def verification_report_csv(view: View):
    compared = verification.compare(*_written_sides(view)).withColumn("key", _odd("key"))
    rows = verification.report(compared)
    base = scratch_dir(rows.sparkSession, "report-csv")
    reports.publish_csv(rows, base, DAY)
    return reports.read_csv(rows.sparkSession, reports.latest_path(base), rows.schema)


@query("verification_stats_json", _oracle(_STATS))
def verification_stats_json(view: View):
    """Published counts; the verdict is worked out again from what is read."""
    counts = verification.count(*_sides(view)).select(*STATS_COLUMNS)
    spark = counts.sparkSession
    base = scratch_dir(spark, "stats-json")
    reports.publish_json(counts, base, DAY)
    return verification.with_verdict(tables.read_verification_stats(spark, reports.latest_path(base)))


@query(
    "archive_inventory_csv",
    f"""SELECT collection_id, {_ODD.replace('{key}', 'filename')} AS filename, filetype, size_bytes, sha1, store_time
  FROM @archive_inventory""",
)
def archive_inventory_csv(view: View):
    given = view("archive_inventory").withColumn("filename", _odd("filename"))
    rows = given.select(
        *[
            (F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.ARCHIVE_INVENTORY
        ]
    )
    path = scratch_dir(rows.sparkSession, "archive-csv")
    reports.append_csv(rows, path)
    return tables.read_archive_inventory(rows.sparkSession, path).select(
        "collection_id", "filename", "filetype", "size_bytes", "sha1", "store_time"
    )


_OBJECTS = "SELECT bucket, key, size, storage_class, replication_status FROM @inventory"


def _landed_inventory(view: View):
    rows = view("inventory")
    base = scratch_dir(rows.sparkSession, "inventory-files")
    rows.select(*schemas.INVENTORY.fieldNames()).write.parquet(f"{base}/snapshot/data")
    return rows.sparkSession, base


@query("inventory_files_scan", _OBJECTS)
def inventory_files_scan(view: View):
    spark, base = _landed_inventory(view)
    found = inventory_source.read_files(spark, [f"{base}/snapshot/data"])
    return found.select("bucket", "key", "size", "storage_class", "replication_status")


@query("inventory_manifest_rows", _OBJECTS)
def inventory_manifest_rows(view: View):
    """Landed manifests, and the data files they list, read by tasks."""
    spark, base = _landed_manifests(view)
    manifests = inventory_source.read_manifests(spark, f"{base}/landed/*/*/manifest.json")
    found = inventory_source.read_manifest_rows(manifests, base)
    return found.select("bucket", "key", "size", "storage_class", "replication_status")


#: The byte-wise digest of the fixity oracle, over files of ten documents.
_FILES_CRC = _CRC.replace(
    "FROM @documents",
    """FROM (SELECT doc_id // 10 AS doc_id, string_agg(concat(text, chr(10)), '' ORDER BY doc_id, text) AS text
    FROM @documents GROUP BY ALL)""",
)


@query(
    "fixity_crc64nvme_ranges",
    _FILES_CRC + "SELECT doc_id AS file_no, CAST(content_length AS BIGINT) AS content_length, checksum FROM digest",
)
def fixity_crc64nvme_ranges(view: View):
    """Digests of landed files, read in ranges and pieces of odd sizes."""
    documents = view("documents").select(F.floor(F.col("doc_id") / 10).alias("file_no"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    base = scratch_dir(spark, "fixity-files")
    name = F.concat(F.col("file_no").cast("string"), F.lit(".txt"))
    write_named(documents, base, name, "text", "doc_id", "text")
    files = documents.select("file_no", F.concat(F.lit(f"{qualified(spark, base)}/"), name).alias("file")).distinct()
    pieces = read_ranges(with_sizes(files), range_bytes=10_007, piece_bytes=4_001)
    return crc64.crc64_of_chunks(pieces, ["file_no"])


@query("inventory_snapshots_scan", _OBJECTS)
def inventory_snapshots_scan(view: View):
    spark, base = _landed_inventory(view)
    found = inventory_source.read_snapshots(spark, base)
    return found.select("bucket", "key", "size", "storage_class", "replication_status")


@query("inventory_stats_read", _STATS_ROWS + "SELECT * FROM stats_rows")
def inventory_stats_read(view: View):
    prefixes = inventory.prefix_stats(view("inventory"))
    spark = prefixes.sparkSession
    base = scratch_dir(spark, "stats-json")
    reports.publish_json(inventory.stats_rows(prefixes), base, DAY)
    return tables.read_bucket_stats(spark, reports.latest_path(base))


@query(
    "receipt_files",
    f"""WITH r AS (SELECT * FROM @receipts)
SELECT source_job_id AS identifier, '0000-00-00-LATEST' AS report_date, {_RECEIPT} FROM r
UNION ALL SELECT repl_job_id, '0000-00-00-LATEST', {_RECEIPT} FROM r
UNION ALL SELECT source_bucket, '0000-00-00-LATEST', {_RECEIPT} FROM r
UNION ALL SELECT source_bucket, '{DAY}', {_RECEIPT} FROM r""",
)
def receipt_files(view: View):
    rows = view("receipts").withColumn("created_at", F.lit(DAY))
    spark = rows.sparkSession
    base = receipts.write_receipts(rows, scratch_dir(spark, "receipts"), DAY)
    return job_source.read_receipt_lookup(spark, base).drop("created_at")


_LANDED = """
WITH l AS (SELECT * FROM @landed_requests),
sized AS (SELECT request, CAST(sum(octet_length(encode(name)) + 1) AS BIGINT) AS size FROM l GROUP BY request)
"""


def _landed_requests(view: View):
    lines = view("landed_requests")
    base = scratch_dir(lines.sparkSession, "requests")
    write_named(lines, base, F.concat("request", F.lit(".txt")), "name", "line_no", "name")
    return lines.sparkSession, base


@query(
    "request_files",
    _LANDED
    + """SELECT request, CAST(row_number() OVER (PARTITION BY request ORDER BY line_no, name) - 1 AS INTEGER) AS line_no, name
  FROM l JOIN sized USING (request) WHERE size <= 512""",
)
def request_files(view: View):
    """Lines of landed request files of an allowed size."""
    return tables.read_requests(*_landed_requests(view)).withColumn("request", file_stem("request"))


@query("request_files_refused", _LANDED + "SELECT request, size FROM sized WHERE size > 512")
def request_files_refused(view: View):
    return tables.oversized_requests(*_landed_requests(view)).withColumn("request", file_stem("request"))


@query(
    "checksum_inventory_csv",
    _CHECKSUMS
    + """SELECT bucket, key, size, nullif(content_type, '') AS content_type, nullif(checksum, '') AS checksum,
  nullif(checksum_algorithm, '') AS checksum_algorithm, status, nullif(detail, '') AS detail FROM listed""",
)
def checksum_inventory_csv(view: View):
    """From a published inventory report to the published checksum inventory, read back."""
    spark = view("inventory").sparkSession
    base = scratch_dir(spark, "checksum-csv")
    report = reports.publish_csv(inventory.report(view("inventory")), f"{base}/report", DAY, copy=False)
    plans.checksum_inventory(spark, "all", report, view("object_head"), f"{base}/out", DAY)
    return reports.read_latest_csv(spark, f"{base}/out/reports/checksum-inventory/all", schemas.CHECKSUM_INVENTORY)
