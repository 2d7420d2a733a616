"""Verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import View, query
from vaultlens import schemas
from vaultlens.functions.text import base64_to_hex
from vaultlens.operators import jobs, onepass, verification
from vaultlens.plans.reports import written
from vaultlens.sources.jobs import parse_result_lines

# Both sides in one stack; a row's partners are counted over its object version.
_RESULTS = """
WITH stack AS (
  SELECT 0 AS side, * FROM @{source} UNION ALL SELECT 1, * FROM @{replication}),
tallied AS (
  SELECT *, json_extract_string(result_message, '$.checksum_base64') AS digest,
    json_extract_string(result_message, '$.checksumAlgorithm') AS algorithm,
    CASE WHEN key IS NULL OR version_id IS NULL THEN 0
      ELSE count(*) OVER own - count(*) FILTER (side = 0) OVER own * (1 - side) - count(*) FILTER (side = 1) OVER own * side
    END AS partners
  FROM stack WINDOW own AS (PARTITION BY key, version_id)),
single AS (
  SELECT bucket, key, version_id, CASE
      WHEN task_status = 'failed' THEN ['failed_source', 'failed_replication'][side + 1]
      WHEN task_status = 'succeeded' AND partners = 0 THEN ['missing_replica', 'missing_source'][side + 1]
    END AS status, NULL AS checksum_algorithm, NULL AS checksum_source, NULL AS checksum_replication
  FROM tallied),
known AS (
  SELECT * FROM tallied WHERE partners > 0 AND task_status = 'succeeded' AND digest IS NOT NULL),
results AS (
  SELECT * FROM single WHERE status IS NOT NULL
  UNION ALL
  SELECT a.bucket, key, version_id, if(a.digest = b.digest, 'ok', 'mismatch'), a.algorithm, a.digest, b.digest
  FROM (SELECT * FROM known WHERE side = 0) a JOIN (SELECT * FROM known WHERE side = 1) b USING (key, version_id))
"""

_REPORT = "SELECT * FROM results"
_STATS = """
, counts AS (SELECT count(*) FILTER (status = 'ok') AS matches, count(*) FILTER (status = 'mismatch') AS mismatches,
  count(*) FILTER (status = 'missing_replica') AS missing_replica, count(*) FILTER (status = 'missing_source') AS missing_source,
  count(*) FILTER (status = 'failed_source') AS failed_source, count(*) FILTER (status = 'failed_replication') AS failed_replication,
  count(*) AS total_objects FROM results)
SELECT *, mismatches = 0 AND missing_source = 0 AND failed_source = 0 AND failed_replication = 0 AS is_ok FROM counts
"""


def _oracle(tail: str, suffix: str = "") -> str:
    views = {"{source}": f"source{suffix}", "{replication}": f"replication{suffix}"}
    text = _RESULTS
    for token, name in views.items():
        text = text.replace(token, name)
    return text + tail


def _sides(view: View, suffix: str = ""):
    return (
        verification.with_checksums(view(f"source{suffix}")),
        verification.with_checksums(view(f"replication{suffix}")),
    )


def _written_sides(view: View, suffix: str = ""):
    """Each side parsed once, for the joins that read it several times."""
    return [written(side, "verification-side") for side in _sides(view, suffix)]


@query("verification_report", _oracle(_REPORT))
def verification_report(view: View):
    return verification.report(written(verification.compare(*_written_sides(view)), "verification"))


@query("verification_stats", _oracle(_STATS))
def verification_stats(view: View):
    return verification.count(*_sides(view))


@query("verification_compared_stats", _oracle(_STATS))
def verification_compared_stats(view: View):
    return verification.stats(verification.compare(*_written_sides(view)))


@query("verification_repeats_report", _oracle(_REPORT, "_repeats"))
def verification_repeats_report(view: View):
    return verification.report(verification.compare(*_written_sides(view, "_repeats")))


@query("verification_repeats_stats", _oracle(_STATS, "_repeats"))
def verification_repeats_stats(view: View):
    return verification.count(*_sides(view, "_repeats"))


@query("verification_onepass_report", _oracle(_REPORT))
def verification_onepass_report(view: View):
    return verification.report(written(onepass.compare(*_written_sides(view)), "verification"))


@query("verification_onepass_stats", _oracle(_STATS))
def verification_onepass_stats(view: View):
    return verification.stats(onepass.compare(*_sides(view)))


@query("verification_routed_repeats_report", _oracle(_REPORT, "_repeats"))
def verification_routed_repeats_report(view: View):
    return verification.report(written(onepass.compare(*_written_sides(view, "_repeats")), "verification"))


@query("verification_onepass_repeats_stats", _oracle(_STATS, "_repeats"))
def verification_onepass_repeats_stats(view: View):
    return verification.stats(onepass.compare(*_sides(view, "_repeats")))


@query(
    "verification_category_counts",
    _oracle(
        "SELECT CAST(CASE status WHEN 'ok' THEN 0 WHEN 'mismatch' THEN 1 WHEN 'missing_replica' THEN 2"
        " WHEN 'missing_source' THEN 3 WHEN 'failed_source' THEN 4 ELSE 5 END AS INTEGER) AS sort, status,"
        " count(*) AS listed FROM results GROUP BY status"
    ),
)
def verification_category_counts(view: View):
    compared = verification.compare(*_written_sides(view))
    return compared.groupBy(verification.category_order().alias("sort"), "status").agg(
        F.count(F.lit(1)).alias("listed")
    )


@query(
    "verification_checksums",
    "SELECT bucket, key, version_id, task_status, json_extract_string(result_message,'$.checksum_base64') AS checksum,"
    " json_extract_string(result_message,'$.checksumAlgorithm') AS checksum_algorithm FROM @source",
)
def verification_checksums(view: View):
    return verification.with_checksums(view("source"))


@query(
    "verification_bad_messages",
    "SELECT count(*) FILTER (NOT json_valid(message)) AS bad_messages FROM"
    " (SELECT CASE WHEN key LIKE '%7' THEN concat('{', result_message) ELSE result_message END AS message FROM @source)",
)
def verification_bad_messages(view: View):
    damaged = F.when(
        F.col("key").endswith("7"), F.concat(F.lit("{"), "result_message")
    ).otherwise(F.col("result_message"))
    return verification.bad_messages(view("source").withColumn("result_message", damaged))


@query(
    "batch_result_lines",
    "SELECT 'acme-main-data' AS bucket, concat('k/',CAST(o_orderkey AS STRING)) AS key,"
    " concat('v',CAST(o_custkey AS STRING)) AS version_id, 'succeeded' AS task_status,"
    " '200' AS error_code, CAST(NULL AS VARCHAR) AS http_status_code FROM @orders",
)
def batch_result_lines(view: View):
    return parse_result_lines(view("result_lines")).drop("result_message")


@query(
    "batch_result_checksums",
    "SELECT 'acme-main-data' AS bucket, concat('k/',CAST(o_orderkey AS STRING)) AS key,"
    " concat('v',CAST(o_custkey AS STRING)) AS version_id, 'succeeded' AS task_status,"
    " md5(CAST(o_orderkey AS STRING)) AS checksum, 'SHA256' AS checksum_algorithm FROM @orders",
)
def batch_result_checksums(view: View):
    return verification.with_checksums(parse_result_lines(view("result_lines")))


@query(
    "batch_manifest_files",
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Succeeded' ELSE 'succeeded' END AS task_status, 'acme-main-managed' AS bucket,"
    " concat('results/',CAST(o_orderkey AS STRING),'.csv') AS key, 'm' AS md5 FROM @orders WHERE o_orderkey % 9 <> 0",
)
def batch_manifest_files(view: View):
    return jobs.succeeded_results(_batch_manifests(view))


@query(
    "batch_manifest_rejects",
    "SELECT 'failed' AS task_status, 'acme-main-managed' AS bucket,"
    " concat('results/',CAST(o_orderkey AS STRING),'.csv') AS key, 'm' AS md5 FROM @orders WHERE o_orderkey % 9 = 0",
)
def batch_manifest_rejects(view: View):
    return jobs.rejected_results(_batch_manifests(view))


def _batch_manifests(view: View):
    return (
        view("batch_json")
        .select(F.from_json("document", schemas.BATCH_MANIFEST).alias("manifest"))
        .select("manifest.*")
    )


@query(
    "checksum_hex",
    "SELECT doc_id, base64(unhex(sha256(text))) AS checksum_base64, upper(sha256(text)) AS checksum_hex FROM @documents",
)
def checksum_hex(view: View):
    recorded = view("documents").select(
        "doc_id", F.base64(F.unhex(F.sha2("text", 256))).alias("checksum_base64")
    )
    return recorded.withColumn("checksum_hex", base64_to_hex("checksum_base64"))
