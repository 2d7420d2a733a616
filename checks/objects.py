"""Access-log, checksum, fixity and archive queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import View, query
from vaultlens.functions import crc64
from vaultlens.functions.names import file_stem
from vaultlens.functions.text import join_locations
from vaultlens.functions.times import expiry_cutoff, rfc3339
from vaultlens.operators import access_log, archive, checksums, inventory

CUTOFF = dt.datetime(2020, 1, 1)

#: Place of each field among the pieces of a line, its column and its kind.
_COLUMNS = [
    (1, "bucket_owner", "text"), (2, "bucket", "text"), (3, "event_time", "time"), (4, "remote_ip", "text"),
    (5, "requester", "text"), (6, "request_id", "text"), (7, "operation", "text"), (8, "key", "dash"),
    (9, "request_uri", "text"), (10, "http_status", "int"), (11, "error_code", "dash"), (12, "bytes_sent", "long"),
    (13, "object_size", "long"), (14, "total_time_ms", "int"), (15, "turn_around_time_ms", "int"), (16, "referer", "dash"),
    (17, "user_agent", "text"), (18, "version_id", "dash"), (19, "host_id", "text"), (20, "sig_v", "text"),
    (21, "cipher_suite", "text"), (22, "auth_type", "text"), (23, "host_header", "text"), (24, "tls_version", "text"),
    (25, "access_point_arn", "dash"),
]
_KINDS = {
    "text": "{x}",
    "dash": "CASE WHEN {x} <> '-' THEN {x} END",
    "int": "TRY_CAST({x} AS INTEGER)",
    "long": "TRY_CAST({x} AS BIGINT)",
    "time": "CAST(strptime({x}, '%d/%b/%Y:%H:%M:%S %z') AT TIME ZONE 'UTC' AS TIMESTAMP)",
}
#: A line in pieces: bracketed, quoted, or without blanks; records by where those stand.
_PIECES = """
WITH cut AS (SELECT line, regexp_extract_all(line, '"[^"]*"|\\[[^\\]]*\\]|[^ ]+') AS p FROM @{lines}),
told AS (SELECT line, list_transform(p, lambda x: trim(x, '[]"')) AS p,
  len(p) >= 25 AND starts_with(p[3], '[') AND starts_with(p[9], '"') AND starts_with(p[16], '"') AND starts_with(p[17], '"') AS is_record FROM cut)
"""


def _log(lines: str) -> str:
    columns = ", ".join(f"{_KINDS[kind].replace('{x}', f'p[{n}]')} AS {name}" for n, name, kind in _COLUMNS)
    return _PIECES.replace("{lines}", lines) + f", audit AS (SELECT {columns} FROM told WHERE is_record)\n"


_LOG = _log("access_log")
_OTHER_LINES = _PIECES.replace("{lines}", "mixed_log") + "SELECT line FROM told WHERE NOT is_record"


def _plain_time(log):
    """Both engines agree on a time without a zone."""
    return log.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query("audit_parsed", _LOG + "SELECT * FROM audit")
def audit_parsed(view: View):
    return _plain_time(access_log.parsed(view("access_log")))


@query(
    "audit_requests",
    _LOG
    + "SELECT event_time, bucket, remote_ip, operation, key, http_status, bytes_sent FROM audit ORDER BY event_time",
)
def audit_requests(view: View):
    return _plain_time(access_log.requests(access_log.parsed(view("access_log"))))


@query(
    "audit_user_operations",
    _LOG
    + """SELECT event_time, substr(requester, strpos(requester, 'assumed-role/') + 13 + strpos(substr(requester,
    strpos(requester, 'assumed-role/') + 13), '/')) AS who, bucket, operation, key, http_status FROM audit
  WHERE contains(requester, ':assumed-role/') AND NOT contains(requester, 'aws-go-sdk-')
    AND NOT contains(requester, 'assume-role-from-profile-') AND split_part(operation, '.', 3) = 'OBJECT'
    AND split_part(operation, '.', 2) IN ('GET', 'PUT', 'DELETE')""",
)
def audit_user_operations(view: View):
    return _plain_time(access_log.people_operations(access_log.parsed(view("access_log"))))


@query("audit_quarantine", _OTHER_LINES)
def audit_quarantine(view: View):
    return access_log.quarantine(view("mixed_log"))


@query("audit_mixed_records", _log("mixed_log") + "SELECT * FROM audit")
def audit_mixed_records(view: View):
    return _plain_time(access_log.parsed(view("mixed_log")))


_CHECKSUMS = """
WITH rows AS (SELECT i.bucket, i.key, CASE WHEN h.key IS NULL THEN 'not_found' WHEN h.error IS NOT NULL THEN 'error'
    WHEN coalesce(h.checksum_crc64_nvme, h.checksum_sha256) IS NOT NULL THEN 'ok' ELSE 'missing_checksum' END AS status, h.*
  EXCLUDE (bucket, key) FROM (SELECT * FROM @inventory WHERE NOT key LIKE '%/') i
  LEFT JOIN (SELECT * FROM @object_head) h ON i.bucket = h.bucket AND i.key = h.key),
listed AS (SELECT bucket, key, CASE WHEN status IN ('ok','missing_checksum') THEN coalesce(content_length,0) END AS size,
  CASE WHEN status IN ('ok','missing_checksum') THEN content_type ELSE '' END AS content_type,
  CASE WHEN status = 'ok' THEN coalesce(checksum_crc64_nvme, checksum_sha256) ELSE '' END AS checksum,
  CASE WHEN status <> 'ok' THEN '' WHEN checksum_crc64_nvme IS NOT NULL THEN 'crc64nvme' ELSE 'sha256' END AS checksum_algorithm,
  status, CASE WHEN status = 'error' THEN error ELSE '' END AS detail FROM rows)
"""


def _checksum_rows(view: View):
    return checksums.checksum_inventory(
        inventory.objects(view("inventory")), view("object_head")
    )


@query("checksum_inventory", _CHECKSUMS + "SELECT * FROM listed")
def checksum_inventory(view: View):
    return _checksum_rows(view)


@query(
    "checksum_inventory_stats",
    _CHECKSUMS
    + "SELECT count(*) AS total, count(*) FILTER (status <> 'ok') AS non_ok FROM listed",
)
def checksum_inventory_stats(view: View):
    return checksums.stats(_checksum_rows(view))


_TRIGGERS = """WITH t AS (SELECT concat('checksums/acme-main-b',CAST(o_orderkey AS STRING),'.txt') AS trigger,
  concat('acme-main-b',CAST(o_orderkey AS STRING)) AS bucket FROM @orders),
r AS (SELECT concat('acme-main-b',CAST(c_custkey AS STRING)) AS bucket, concat('reports/',CAST(c_custkey AS STRING)) AS path FROM @customer)
"""


def _triggers(view: View):
    key = F.concat(F.lit("checksums/acme-main-b"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    customer = F.col("c_custkey").cast("string")
    return (
        view("orders").select(key.alias("trigger")).withColumn("bucket", file_stem("trigger")),
        view("customer").select(
            F.concat(F.lit("acme-main-b"), customer).alias("bucket"),
            F.concat(F.lit("reports/"), customer).alias("path"),
        ),
    )


@query("checksum_requests", _TRIGGERS + "SELECT trigger, t.bucket, path FROM t, r WHERE t.bucket = r.bucket")
def checksum_requests(view: View):
    return checksums.requested(*_triggers(view))


@query(
    "checksum_requests_without_report",
    _TRIGGERS + "SELECT trigger, bucket FROM t WHERE bucket NOT IN (SELECT bucket FROM r)",
)
def checksum_requests_without_report(view: View):
    return checksums.without_report(*_triggers(view))


@query("fixity_sha256", "SELECT doc_id, sha256(text) AS checksum FROM @documents")
def fixity_sha256(view: View):
    return view("documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("fixity_md5", "SELECT page_id, md5(html) AS checksum FROM @pages")
def fixity_md5(view: View):
    return view("pages").select("page_id", F.md5("html").alias("checksum"))


# CRC-64/NVME: the reflected polynomial, and the register's start and final mask.
_POLYNOMIAL = 0x9A6C9329AC4BC9B5
_ONES = 2**64 - 1


def _crc_step(register: int) -> int:
    for _ in range(8):
        register = (register >> 1) ^ (_POLYNOMIAL if register & 1 else 0)
    return register


# Byte by byte, with a table made from the rule of the polynomial.
_CRC_TABLE = ",".join(f"{_crc_step(byte)}::UBIGINT" for byte in range(256))
_CRC = f"""
WITH bytes AS (SELECT doc_id, octet_length(encode(text)) AS content_length,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(concat('0x',x) AS UBIGINT)) AS b FROM @documents),
digest AS (SELECT doc_id, content_length, base64(unhex(lpad(hex(xor({_ONES}::UBIGINT,
    list_reduce(b, lambda c, x: xor(c >> 8, list_extract([{_CRC_TABLE}], CAST(xor(c, x) & 255 AS BIGINT) + 1)), {_ONES}::UBIGINT))),
    16, '0'))) AS checksum FROM bytes)
"""


@query("fixity_crc64nvme", _CRC + "SELECT doc_id, checksum FROM digest")
def fixity_crc64nvme(view: View):
    return view("documents").select("doc_id", crc64.crc64_base64("text").alias("checksum"))


@query(
    "fixity_crc64nvme_chunked",
    _CRC + "SELECT doc_id, CAST(content_length AS BIGINT) AS content_length, checksum FROM digest",
)
def fixity_crc64nvme_chunked(view: View):
    """The same digests from texts cut into chunk rows of 1,000 bytes."""
    size = 1000
    body = F.col("text").cast("binary")
    offsets = F.sequence(
        F.lit(0), F.greatest(F.octet_length(body) - 1, F.lit(0)), F.lit(size)
    )
    chunks = F.transform(
        offsets,
        lambda offset: F.struct(
            F.substring(body, offset + 1, F.lit(size)).alias("content"),
            offset.cast("bigint").alias("offset"),
        ),
    )
    return crc64.crc64_of_chunks(view("documents").select("doc_id", F.inline(chunks)), ["doc_id"])


def _rows(view: View):
    """The catalogue view as landed, nested entries, then as inventory rows."""
    landed = view("catalogue").select(
        "position",
        F.col("collection_id").alias("collection"),
        F.concat(F.lit("collection "), F.col("collection_id").cast("string")).alias(
            "collection_name"
        ),
        F.lit(1).cast("bigint").alias("account"),
        "filename",
        "filetype",
        F.col("size_bytes").alias("size"),
        F.lit(None).cast("bigint").alias("crawl"),
        F.lit(None).cast("string").alias("crawl_time"),
        F.lit(None).cast("string").alias("crawl_start"),
        "store_time",
        F.struct("sha1", F.lit(None).cast("string").alias("md5")).alias("checksums"),
        F.col("location_a").alias("primary_location"),
        F.array("location_a", "location_b").alias("locations"),
    )
    return archive.rows_of_catalogue(landed)


def _delta(view: View):
    return archive.collection_delta(view("collection_totals"), view("known_files"))


_DELTA = """
WITH known AS (SELECT DISTINCT collection_id, filename FROM @known_files),
counts AS (SELECT collection_id, count(*) AS n FROM known GROUP BY collection_id),
delta AS (SELECT t.collection_id, t.total, coalesce(n,0) AS known, t.total > 0 AND coalesce(n,0) = t.total AS skip,
  CASE WHEN t.total > coalesce(n,0) THEN t.total - coalesce(n,0) ELSE 0 END AS expected_new,
  coalesce(n,0) > t.total AS upstream_deletions
  FROM (SELECT * FROM @collection_totals) t LEFT JOIN counts c ON t.collection_id = c.collection_id),
listed AS (SELECT c.* FROM (SELECT * FROM @catalogue) c, delta d WHERE c.collection_id = d.collection_id AND NOT d.skip AND c.filetype = 'warc'),
fresh AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY collection_id, filename ORDER BY position) AS place FROM listed l) r
  WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.collection_id = r.collection_id AND k.filename = r.filename))
"""


@query(
    "archive_catalogue_rows",
    """SELECT position, collection_id, concat('collection ',CAST(collection_id AS VARCHAR)) AS collection_name, CAST(1 AS BIGINT) AS account_id,
  filename, filetype, size_bytes, CAST(NULL AS BIGINT) AS crawl_id, CAST(NULL AS VARCHAR) AS crawl_time, CAST(NULL AS VARCHAR) AS crawl_start,
  store_time, sha1, CAST(NULL AS VARCHAR) AS md5, location_a AS primary_location, concat(location_a,';',location_b) AS all_locations FROM @catalogue""",
)
def archive_catalogue_rows(view: View):
    return _rows(view)


@query(
    "archive_row_locations",
    """SELECT filename, 2 AS locations, location_a AS first_location, concat(location_a,';',location_b) AS rejoined, sha1, size_bytes AS size FROM @catalogue""",
)
def archive_row_locations(view: View):
    rows = _rows(view).withColumn("all_locations", F.concat(F.lit(";"), "all_locations"))
    return archive.catalogue_of_rows(rows).select(
        "filename",
        F.size("locations").alias("locations"),
        F.get("locations", F.lit(0)).alias("first_location"),
        join_locations("locations").alias("rejoined"),
        F.col("checksums.sha1").alias("sha1"),
        "size",
    )


@query(
    "archive_known_counts",
    "SELECT collection_id, count(*) AS known FROM (SELECT DISTINCT collection_id, filename FROM @known_files) GROUP BY collection_id",
)
def archive_known_counts(view: View):
    return archive.known_counts(view("known_files"))


@query("archive_collection_delta", _DELTA + "SELECT * FROM delta")
def archive_collection_delta(view: View):
    return _delta(view)


@query(
    "archive_new_files",
    _DELTA + "SELECT collection_id, filename, filetype, size_bytes, store_time, sha1 FROM fresh",
)
def archive_new_files(view: View):
    return archive.new_files(_rows(view), view("known_files"), _delta(view)).select(
        "collection_id", "filename", "filetype", "size_bytes", "store_time", "sha1"
    )


@query(
    "archive_run_stats",
    _DELTA
    + """SELECT (SELECT count(*) FROM delta WHERE NOT skip) AS collections_processed, (SELECT count(*) FROM delta WHERE skip) AS collections_skipped,
  (SELECT count(*) FROM fresh) AS new_files,
  CAST((SELECT coalesce(sum(known),0) FROM delta WHERE skip) + (SELECT count(*) FROM listed) - (SELECT count(*) FROM fresh) AS BIGINT) AS cache_hits""",
)
def archive_run_stats(view: View):
    return archive.run_stats(_rows(view), view("known_files"), _delta(view))


_AUDIT = """
WITH joined AS (SELECT i.*, concat('pre/', i.filename) AS key, o.key AS object_key, o.content_length, o.sha1_meta, o.error,
    CASE WHEN store_time LIKE '%Z' THEN CAST(replace(replace(store_time,'T',' '),'Z','') AS TIMESTAMP) END AS stored_at
  FROM (SELECT * FROM @archive_inventory) i LEFT JOIN (SELECT * FROM @archive_objects) o ON o.key = concat('pre/', i.filename)),
audited AS (SELECT collection_id, filename, filetype, size_bytes, sha1, store_time, key,
  CASE WHEN stored_at IS NULL THEN 'skipped'
    WHEN object_key IS NULL AND stored_at < TIMESTAMP '2020-01-01' THEN 'skipped' WHEN object_key IS NULL THEN 'not_found'
    WHEN error IS NOT NULL THEN 'errored' WHEN stored_at < TIMESTAMP '2020-01-01' THEN 'expired'
    WHEN sha1_meta IS NOT NULL AND sha1_meta = sha1 THEN 'matched_sha1' WHEN sha1_meta IS NOT NULL THEN 'unmatched'
    WHEN content_length = size_bytes THEN 'matched_size' ELSE 'unmatched' END AS outcome FROM joined)
"""


def _audited(view: View):
    stored = view("archive_objects").select(
        "key",
        "content_length",
        F.when(F.col("sha1_meta").isNotNull(), F.create_map(F.lit("sha1"), "sha1_meta")).alias(
            "metadata"
        ),
        "error",
    )
    return archive.audit(view("archive_inventory"), stored, "pre/", CUTOFF)


_AUDIT_OUTCOMES = ["matched_sha1", "matched_size", "unmatched", "not_found", "errored", "expired", "skipped"]


@query("archive_audit", _AUDIT + "SELECT * FROM audited")
def archive_audit(view: View):
    return _audited(view)


@query(
    "archive_audit_stats",
    _AUDIT
    + "SELECT "
    + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in _AUDIT_OUTCOMES)
    + " FROM audited",
)
def archive_audit_stats(view: View):
    return archive.audit_stats(_audited(view))


@query(
    "archive_sync_list",
    _AUDIT
    + "SELECT * EXCLUDE (outcome, key) FROM audited WHERE outcome IN ('unmatched','not_found')",
)
def archive_sync_list(view: View):
    return archive.sync_list(_audited(view))


@query("archive_expired", _AUDIT + "SELECT key FROM audited WHERE outcome = 'expired'")
def archive_expired(view: View):
    return archive.expired_list(_audited(view))


_SYNC = """SELECT count(*) FILTER (outcome = 'downloaded') AS uploaded, count(*) FILTER (outcome = 'skipped') AS skipped,
  count(*) FILTER (outcome = 'failed' AND error = 'NotFound') AS missing_upstream,
  count(*) FILTER (outcome = 'stream_failed' OR (outcome = 'failed' AND error IS DISTINCT FROM 'NotFound')) AS failed FROM @sync_results"""


@query("archive_sync_stats", _SYNC)
def archive_sync_stats(view: View):
    return archive.sync_stats(view("sync_results"))


@query(
    "archive_sync_stats_dry_run",
    f"SELECT 'run' AS mode, * FROM ({_SYNC}) UNION ALL SELECT 'dry', 0, 0, 0, 0",
)
def archive_sync_stats_dry_run(view: View):
    """The same results counted as a run and as a dry run."""
    results = view("sync_results")
    modes = [archive.sync_stats(results, dry_run=dry).withColumn("mode", F.lit(name)) for name, dry in (("run", False), ("dry", True))]
    return modes[0].unionByName(modes[1])


@query(
    "archive_expiry_cutoff",
    "SELECT o_orderkey, o_orderdate - INTERVAL 24 MONTH AS cutoff FROM @orders",
)
def archive_expiry_cutoff(view: View):
    return view("orders").select(
        "o_orderkey",
        expiry_cutoff(F.col("o_orderdate").cast("timestamp"), 2).cast("timestamp_ntz").alias("cutoff"),
    )


@query(
    "archive_store_times",
    "SELECT filename, CASE WHEN store_time LIKE '%Z' THEN CAST(replace(replace(store_time,'T',' '),'Z','') AS TIMESTAMP) END AS stored_at FROM @archive_inventory",
)
def archive_store_times(view: View):
    return view("archive_inventory").select(
        "filename", rfc3339("store_time").cast("timestamp_ntz").alias("stored_at")
    )
