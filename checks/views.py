"""Adapter views: the given tables in the shape of the engine's inputs.

Each view is one SQL text for both engines, apart from a few marked tokens. A
name after ``@`` is a given table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Tokens that differ between the engines: (Spark, DuckDB).
TOKENS = {
    "{LOGTIME}": (
        "date_format(ts,'dd/MMM/yyyy:HH:mm:ss')",
        "strftime(ts,'%d/%b/%Y:%H:%M:%S')",
    ),
    "{DAY}": (
        "date_format(o_orderdate,'yyyy-MM-dd')",
        "strftime(o_orderdate,'%Y-%m-%d')",
    ),
}

VIEWS = {
    "inventory": """
SELECT concat('acme-main-',lower(o_orderstatus)) AS bucket,
  CASE WHEN o_orderkey % 97 = 0 THEN concat(lower(o_orderpriority),'/')
       WHEN o_orderkey % 5 = 0 THEN concat('root-',CAST(o_orderkey AS STRING),'.bin')
       ELSE concat(lower(o_orderpriority),'/',CAST(o_custkey AS STRING),'/',CAST(o_orderkey AS STRING),'.bin') END AS key,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size,
  o_orderdate AS last_modified_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'STANDARD' ELSE 'INTELLIGENT_TIERING' END AS storage_class,
  CASE WHEN o_orderkey % 7 = 0 THEN 'PENDING' ELSE 'COMPLETED' END AS replication_status
FROM @orders""",
    # The next day: most objects unchanged, some sizes and statuses new.
    "snapshots": """
SELECT bucket, key, size, last_modified_date, storage_class, replication_status FROM @inventory
UNION ALL
SELECT bucket, key, CASE WHEN size % 50 = 0 THEN size + 1 ELSE size END AS size,
  last_modified_date, storage_class, 'COMPLETED' AS replication_status FROM @inventory""",
    # Three days: sizes change and change back, every ninth object is gone on the third.
    "snapshot_days": """
SELECT '2024-01-30' AS day, bucket, key, size, last_modified_date, storage_class, replication_status FROM @inventory
UNION ALL
SELECT '2024-01-31' AS day, bucket, key, CASE WHEN size % 50 = 0 THEN size + 1 ELSE size END AS size,
  last_modified_date, storage_class, 'COMPLETED' AS replication_status FROM @inventory
UNION ALL
SELECT '2024-02-01' AS day, bucket, key, size, last_modified_date, storage_class,
  CASE WHEN size % 3 = 0 THEN replication_status ELSE 'COMPLETED' END AS replication_status FROM @inventory
WHERE size IS NULL OR size % 9 <> 1""",
    "manifests": """
SELECT concat('acme-main-b',CAST(o_custkey AS STRING)) AS bucket, {DAY} AS snapshot_date,
  concat('manifests/b',CAST(o_custkey AS STRING),'/',CAST(o_orderkey AS STRING),'/manifest.json') AS path
FROM @orders""",
    "manifest_json": """
SELECT o_orderkey AS manifest_id, concat('{"sourceBucket":"acme-main-b',CAST(o_custkey AS STRING),
  '","fileFormat":"',CASE WHEN o_orderkey % 10 = 0 THEN 'CSV' ELSE 'Parquet' END,
  '","files":[{"key":"data/',CAST(o_orderkey AS STRING),'-0.parquet","size":',CAST(o_orderkey AS STRING),
  ',"MD5checksum":"',md5(CAST(o_orderkey AS STRING)),'"},{"key":"data/',CAST(o_orderkey AS STRING),
  '-1.parquet","size":7,"MD5checksum":"x"}]}') AS document
FROM @orders""",
    "source": """
SELECT 'acme-main-data' AS bucket, concat('k/',CAST(o_orderkey AS STRING)) AS key,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat('v',CAST(o_custkey AS STRING)) END AS version_id,
  CASE WHEN o_orderkey % 29 = 0 THEN 'failed' ELSE 'succeeded' END AS task_status,
  CASE WHEN o_orderkey % 41 = 0 THEN '{}' ELSE concat('{"checksum_base64":"',md5(CAST(o_orderkey AS STRING)),'","checksumAlgorithm":"CRC64NVME"}') END AS result_message
FROM @orders WHERE o_orderkey % 13 <> 0""",
    "replication": """
SELECT 'acme-main-data-repl' AS bucket, concat('k/',CAST(o_orderkey AS STRING)) AS key,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat('v',CAST(o_custkey AS STRING)) END AS version_id,
  CASE WHEN o_orderkey % 31 = 0 THEN 'failed' ELSE 'succeeded' END AS task_status,
  CASE WHEN o_orderkey % 41 = 0 THEN '{}' ELSE concat('{"checksum_base64":"',md5(concat(CAST(o_orderkey AS STRING),CASE WHEN o_orderkey % 37 = 0 THEN 'x' ELSE '' END)),'","checksumAlgorithm":"CRC64NVME"}') END AS result_message
FROM @orders WHERE o_orderkey % 17 <> 0""",
    # Line items under the key of their order and one of two versions, orders
    # with one or two rows for each version: a few repeated rows per key.
    "source_repeats": """
SELECT 'acme-main-data' AS bucket, concat('k/',CAST(l_orderkey AS STRING)) AS key,
  concat('v',CAST(l_linenumber % 2 AS STRING)) AS version_id,
  CASE WHEN l_partkey % 29 = 0 THEN 'failed' ELSE 'succeeded' END AS task_status,
  concat('{"checksum_base64":"',l_returnflag,'","checksumAlgorithm":"SHA256"}') AS result_message
FROM @lineitem WHERE l_orderkey % 13 <> 0""",
    "replication_repeats": """
SELECT 'acme-main-data-repl' AS bucket, concat('k/',CAST(o_orderkey AS STRING)) AS key,
  CASE WHEN o_custkey % 5 = 0 THEN 'v1' ELSE 'v0' END AS version_id,
  CASE WHEN o_orderkey % 31 = 0 THEN 'failed' ELSE 'succeeded' END AS task_status,
  concat('{"checksum_base64":"',CASE WHEN o_custkey % 2 = 0 THEN 'N' ELSE 'R' END,'","checksumAlgorithm":"SHA256"}') AS result_message
FROM @orders
UNION ALL
SELECT 'acme-main-data-repl' AS bucket, concat('k/',CAST(o_orderkey AS STRING)) AS key, 'v1' AS version_id,
  'succeeded' AS task_status, '{"checksum_base64":"N","checksumAlgorithm":"SHA256"}' AS result_message
FROM @orders WHERE o_orderkey % 3 <> 0""",
    "result_lines": """
SELECT concat('acme-main-data,k/',CAST(o_orderkey AS STRING),',v',CAST(o_custkey AS STRING),',succeeded,200,,',
  '"{""checksum_base64"":""',md5(CAST(o_orderkey AS STRING)),'"",""checksumAlgorithm"":""SHA256""}"') AS line
FROM @orders""",
    "batch_json": """
SELECT concat('{"Format":"Report_CSV_20180820","Results":[{"TaskExecutionStatus":"',
  CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'Succeeded' ELSE 'succeeded' END,
  '","Bucket":"acme-main-managed","MD5Checksum":"m","Key":"results/',CAST(o_orderkey AS STRING),'.csv"}]}') AS document
FROM @orders""",
    "access_log": """
SELECT concat('owner1 acme-main-',event_type,' [',{LOGTIME},' +0000] 192.0.2.',CAST(user_id % 250 AS STRING),' ',
  CASE WHEN user_id % 3 = 0 THEN concat('arn:aws:sts::1:assumed-role/staff/user',CAST(user_id AS STRING))
       WHEN user_id % 3 = 1 THEN 'arn:aws:sts::1:assumed-role/svc/aws-go-sdk-17' ELSE '-' END,
  ' R',CAST(event_id AS STRING),' ',
  CASE event_type WHEN 'view' THEN 'REST.GET.OBJECT' WHEN 'purchase' THEN 'REST.PUT.OBJECT' WHEN 'error' THEN 'REST.DELETE.OBJECT' ELSE 'REST.HEAD.OBJECT' END,' ',
  CASE WHEN event_id % 9 = 0 THEN '-' ELSE concat('k/',CAST(event_id AS STRING)) END,
  ' "GET /k HTTP/1.1" 200 - ',CASE WHEN event_id % 4 = 0 THEN '-' ELSE CAST(event_id AS STRING) END,
  ' 113 7 - "-" "cli/1.0" - h SigV4 C AuthHeader host TLSv1.2 -') AS line
FROM @events""",
    "mixed_log": """
SELECT CASE WHEN length(line) % 10 = 3 THEN concat('damaged ',line) ELSE line END AS line FROM @access_log""",
    "archive_inventory": """
SELECT doc_id % 7 AS collection_id, concat('w-',CAST(doc_id AS STRING),'.warc.gz') AS filename, 'warc' AS filetype, n_chars AS size_bytes,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE md5(CAST(doc_id AS STRING)) END AS sha1,
  CASE WHEN doc_id % 53 = 0 THEN 'bad-date' WHEN doc_id % 5 = 0 THEN '2015-01-02T00:00:00Z' ELSE '2025-01-02T00:00:00Z' END AS store_time
FROM @documents""",
    "archive_objects": """
SELECT concat('pre/w-',CAST(doc_id AS STRING),'.warc.gz') AS key,
  n_chars + CASE WHEN doc_id % 16 = 0 THEN 1 ELSE 0 END AS content_length,
  CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN 'zzz' ELSE md5(CAST(doc_id AS STRING)) END AS sha1_meta,
  CASE WHEN doc_id % 31 = 0 THEN 'AccessDenied' ELSE NULL END AS error
FROM @documents WHERE doc_id % 12 <> 0""",
    # Every file listed once, every fourth listed again later, some not WARC.
    "catalogue": """
SELECT doc_id AS position, doc_id % 7 AS collection_id, concat('w-',CAST(doc_id AS STRING),'.warc.gz') AS filename,
  CASE WHEN doc_id % 11 = 0 THEN 'cdx' ELSE 'warc' END AS filetype, n_chars AS size_bytes,
  '2025-01-02T00:00:00Z' AS store_time, md5(CAST(doc_id AS STRING)) AS sha1,
  concat('https://a/',CAST(doc_id AS STRING)) AS location_a, concat('https://b/',CAST(doc_id AS STRING)) AS location_b
FROM @documents
UNION ALL
SELECT doc_id + 1000000000 AS position, doc_id % 7 AS collection_id, concat('w-',CAST(doc_id AS STRING),'.warc.gz') AS filename,
  'warc' AS filetype, n_chars + 1 AS size_bytes,
  '2025-02-02T00:00:00Z' AS store_time, md5(CAST(doc_id AS STRING)) AS sha1,
  concat('https://a/',CAST(doc_id AS STRING)) AS location_a, concat('https://b/',CAST(doc_id AS STRING)) AS location_b
FROM @documents WHERE doc_id % 4 = 0""",
    # Collection 2 is fully known, collection 3 knows files gone upstream.
    "known_files": """
SELECT doc_id % 7 AS collection_id, concat('w-',CAST(doc_id AS STRING),'.warc.gz') AS filename
FROM @documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 2
UNION ALL
SELECT doc_id % 7 AS collection_id, concat('gone-',CAST(doc_id AS STRING),'.warc.gz') AS filename
FROM @documents WHERE doc_id % 7 = 3
UNION ALL
SELECT doc_id % 7 AS collection_id, concat('w-',CAST(doc_id AS STRING),'.warc.gz') AS filename
FROM @documents WHERE doc_id % 9 = 0""",
    "collection_totals": """
SELECT doc_id % 7 AS collection_id, count(*) AS total FROM @documents GROUP BY doc_id % 7""",
    "sync_results": """
SELECT concat('w-',CAST(doc_id AS STRING),'.warc.gz') AS filename,
  CASE doc_id % 6 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'stream_failed' ELSE 'progress' END AS outcome,
  CASE WHEN doc_id % 6 = 2 THEN 'NotFound' WHEN doc_id % 6 = 3 THEN 'Timeout' ELSE NULL END AS error
FROM @documents""",
    "object_head": """
SELECT DISTINCT bucket, key,
  CASE WHEN length(key) % 10 = 3 THEN 'AccessDenied' ELSE NULL END AS error,
  CASE WHEN length(key) % 4 = 0 THEN NULL ELSE md5(key) END AS checksum_crc64_nvme,
  CASE WHEN length(key) % 3 = 0 THEN NULL ELSE md5(concat(key,'s')) END AS checksum_sha256,
  coalesce(size,0) AS content_length, 'application/octet-stream' AS content_type
FROM @inventory WHERE NOT key LIKE '%/' AND NOT key LIKE '%7.bin'""",
    "metric_datapoint": """
SELECT concat('bkt-',CAST(user_id AS STRING)) AS bucket,
  CASE WHEN event_type = 'error' THEN 'NumberOfObjects' ELSE 'BucketSizeBytes' END AS metric,
  CASE WHEN event_type = 'error' THEN 'AllStorageTypes' ELSE event_type END AS storage_type, ts,
  CAST(floor(value*1000) AS BIGINT) AS average, event_id AS tie_breaker
FROM @events""",
    "metric_buckets": """
SELECT DISTINCT concat('bkt-',CAST(user_id AS STRING)) AS bucket FROM @events""",
    "cost_usage": """
SELECT o_orderdate AS period, CASE WHEN o_orderkey % 2 = 0 THEN 'Amazon Simple Storage Service' ELSE 'Other' END AS service,
  CASE WHEN o_orderkey % 3 = 0 THEN 'S3: Data Transfer - Internet (Out)' ELSE 'Other' END AS usage_group,
  CASE WHEN o_custkey % 2 = 0 THEN 'acme-main' ELSE 'acme-test' END AS stack_tag,
  CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS usage_quantity
FROM @orders""",
    "buckets": """
SELECT concat('acme-s',CAST(s_suppkey % 9 AS STRING),'x-b',CAST(s_suppkey AS STRING),CASE WHEN s_suppkey % 4 = 0 THEN '-public' ELSE '' END) AS name,
  concat('acme-s',CAST(s_suppkey % 9 AS STRING),'x') AS stack_tag,
  CASE WHEN s_suppkey % 4 = 0 THEN 'public' WHEN s_suppkey % 10 = 9 THEN 'internal' ELSE 'standard' END AS bucket_type,
  CASE WHEN s_suppkey % 3 = 0 THEN 'terraform' ELSE 'bucket-request' END AS origin
FROM @supplier
UNION ALL
SELECT concat('acme-s',CAST(s_suppkey % 9 AS STRING),'x-b',CAST(s_suppkey AS STRING),CASE WHEN s_suppkey % 4 = 0 THEN '-public' ELSE '' END,'-repl') AS name,
  concat('acme-s',CAST(s_suppkey % 9 AS STRING),'x') AS stack_tag, 'replication' AS bucket_type, 'bucket-request' AS origin
FROM @supplier WHERE s_suppkey % 11 <> 0""",
    "user_groups": """
SELECT concat('user',CAST(c_custkey AS STRING)) AS user_name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('user',CAST(c_custkey AS STRING),'@example.org') END AS email,
  CASE WHEN c_custkey % 13 = 0 THEN 'admins' ELSE concat('acme-s',CAST(c_custkey % 9 AS STRING),'x-users') END AS group_name
FROM @customer""",
    "jobs": """
SELECT concat('job-',CAST(o_orderkey AS STRING)) AS job_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Active' WHEN o_orderkey % 5 = 0 THEN 'Failed' ELSE 'Complete' END AS status,
  CASE WHEN o_orderkey % 15 = 0 THEN 'InternalError' WHEN o_orderkey % 5 = 0 THEN 'InvalidManifestContent' ELSE NULL END AS failure_code,
  o_orderdate AS event_time
FROM @orders""",
    # Each job reports that it is active first, then its final status.
    "job_events": """
SELECT job_id, status, failure_code, 2 AS place FROM @jobs
UNION ALL
SELECT job_id, 'Preparing' AS status, NULL AS failure_code, 1 AS place FROM @jobs""",
    "job_manifests": """
SELECT concat('job-',CAST(o_orderkey AS STRING)) AS job_id FROM @orders WHERE o_orderkey % 16 <> 2""",
    "receipts": """
SELECT concat('job-',CAST(o_orderkey AS STRING)) AS source_job_id, concat('job-',CAST(o_orderkey + 1 AS STRING)) AS repl_job_id,
  concat('acme-main-b',CAST(o_orderkey AS STRING)) AS source_bucket, concat('acme-main-b',CAST(o_orderkey AS STRING),'-repl') AS repl_bucket
FROM @orders WHERE o_orderkey % 2 = 0""",
    # One pair of jobs for each supplier, and their results.
    "pair_jobs": """
SELECT concat('sj-',CAST(s_suppkey AS STRING)) AS source_job_id, concat('rj-',CAST(s_suppkey AS STRING)) AS repl_job_id,
  concat('acme-main-b',CAST(s_suppkey AS STRING)) AS source_bucket, concat('acme-main-b',CAST(s_suppkey AS STRING),'-repl') AS repl_bucket,
  CASE WHEN s_suppkey % 7 = 0 THEN 'Active' WHEN s_suppkey % 11 = 0 THEN 'Failed' ELSE 'Complete' END AS source_status,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Active' WHEN s_suppkey % 13 = 0 THEN 'Failed' ELSE 'Complete' END AS repl_status,
  s_suppkey % 17 = 0 AS no_manifest
FROM @supplier""",
    "pair_results": """
SELECT concat('sj-',CAST(l_suppkey AS STRING)) AS job_id, l_orderkey % 2 AS part, concat('acme-main-b',CAST(l_suppkey AS STRING)) AS bucket,
  concat('k/',CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING)) AS key, concat('v',CAST(l_partkey % 3 AS STRING)) AS version_id,
  CASE WHEN l_orderkey % 29 = 0 THEN 'failed' ELSE 'succeeded' END AS task_status, md5(CAST(l_orderkey AS STRING)) AS checksum
FROM @lineitem WHERE l_partkey % 13 <> 0
UNION ALL
SELECT concat('rj-',CAST(l_suppkey AS STRING)) AS job_id, l_orderkey % 2 AS part, concat('acme-main-b',CAST(l_suppkey AS STRING),'-repl') AS bucket,
  concat('k/',CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING)) AS key, concat('v',CAST(l_partkey % 3 AS STRING)) AS version_id,
  CASE WHEN l_orderkey % 31 = 0 THEN 'failed' ELSE 'succeeded' END AS task_status,
  md5(concat(CAST(l_orderkey AS STRING),CASE WHEN l_orderkey % 37 = 0 THEN 'x' ELSE '' END)) AS checksum
FROM @lineitem WHERE l_partkey % 17 <> 0""",
    "dispatch_results": """
SELECT concat('acme-main-b',CAST(c_custkey AS STRING)) AS name,
  CASE WHEN c_custkey % 17 = 0 THEN 'access denied' ELSE NULL END AS error
FROM @customer""",
    "request_lines": """
SELECT concat('buckets/request-',CAST(o_custkey AS STRING),'.txt') AS request, o_orderkey AS line_no,
  CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 103 = 0 THEN '-books' WHEN o_orderkey % 107 = 0 THEN 'books.'
       WHEN o_orderkey % 109 = 0 THEN 'rare_books' WHEN o_orderkey % 113 = 0 THEN 'papers-repl'
       WHEN o_orderkey % 127 = 0 THEN 'acme-main-papers' WHEN o_orderkey % 131 = 0 THEN 'a23456789b123456789c123456789d123456789e123456789f123'
       WHEN o_orderkey % 137 = 0 THEN 'a23456789b123456789c123456789d123456789e123456789f123456789g1234'
       WHEN o_orderkey % 3 = 0 THEN concat('Maps-',CAST(o_orderkey AS STRING),'-PUBLIC')
       ELSE concat('books-',CAST(o_orderkey AS STRING)) END AS name
FROM @orders""",
    # Requests of three customers each: about half are larger than a request may be.
    "landed_requests": """
SELECT concat('request-',CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS STRING)) AS request, o_orderkey AS line_no,
  CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE concat('books-',CAST(o_orderkey AS STRING)) END AS name
FROM @orders""",
    "names": """
SELECT concat('reports/latest/manifests/acme-main-b',CAST(o_orderkey AS STRING),
    CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.csv' WHEN 2 THEN '.tar.gz' ELSE '.d/x' END) AS key,
  CASE o_orderkey % 6 WHEN 0 THEN concat('acme-main-b',CAST(o_orderkey AS STRING)) WHEN 1 THEN 'acme-main' WHEN 2 THEN 'a-main-b'
       WHEN 3 THEN 'Acme-Main2-' WHEN 4 THEN '1acme-main-b' ELSE concat('acme-ma_in-b',CAST(o_orderkey AS STRING)) END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'GLACIER' WHEN 1 THEN 'STANDARD_IA' WHEN 2 THEN 'STANDARD' WHEN 3 THEN 'glacier' ELSE 'DEEP_ARCHIVE' END AS class_text,
  CASE o_orderkey % 3 WHEN 0 THEN 'replication' WHEN 1 THEN 'public' ELSE 'standard' END AS bucket_type,
  o_orderkey
FROM @orders""",
    "config_flags": """
SELECT c_custkey AS k,
  CASE c_custkey % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'public' WHEN 2 THEN 'replication' ELSE 'internal' END AS bucket_type,
  CASE c_custkey % 4 WHEN 0 THEN concat('acme-main-b',CAST(c_custkey AS STRING)) WHEN 1 THEN concat('acme-main-b',CAST(c_custkey AS STRING),'-public')
    WHEN 2 THEN CASE WHEN c_custkey % 3 <> 0 THEN concat('acme-main-b',CAST(c_custkey - 2 AS STRING),'-repl')
                     ELSE concat('acme-main-b',CAST(c_custkey - 1 AS STRING),'-public-repl') END
    ELSE concat('acme-main-b',CAST(c_custkey AS STRING),'-managed') END AS name,
  CASE WHEN c_custkey % 10 < 6 THEN 'valid' WHEN c_custkey % 10 = 6 THEN 'missing' WHEN c_custkey % 10 = 7 THEN 'invalid'
       WHEN c_custkey % 10 = 8 THEN 'NoSuchTagSet' ELSE 'AccessDenied' END AS tag_case,
  CASE c_custkey % 3 WHEN 0 THEN 'GLACIER' WHEN 1 THEN 'INTELLIGENT_TIERING' ELSE 'DEEP_ARCHIVE' END AS rule_class,
  CASE WHEN c_custkey % 11 = 1 THEN 'NoSuchLifecycleConfiguration' WHEN c_custkey % 11 = 2 THEN 'AccessDenied'
       WHEN c_custkey % 11 = 3 THEN 'days' WHEN c_custkey % 11 = 4 THEN 'two' ELSE 'good' END AS lifecycle_case,
  CASE WHEN c_custkey % 13 = 1 THEN 'off' WHEN c_custkey % 13 = 2 THEN 'AccessDenied' ELSE 'on' END AS versioning_case,
  CASE WHEN c_custkey % 17 = 1 THEN 'ReplicationConfigurationNotFoundError' WHEN c_custkey % 17 = 2 THEN 'AccessDenied'
       WHEN c_custkey % 17 = 3 THEN 'role' WHEN c_custkey % 17 = 4 THEN 'minutes' WHEN c_custkey % 17 = 5 THEN 'two' ELSE 'good' END AS replication_case,
  CASE WHEN c_custkey % 19 = 1 THEN 'off' WHEN c_custkey % 19 = 2 THEN 'AccessDenied' ELSE 'on' END AS bridge_case,
  CASE WHEN c_custkey % 7 = 1 THEN 'none' WHEN c_custkey % 7 = 2 THEN 'prefix' WHEN c_custkey % 7 = 3 THEN 'AccessDenied' ELSE 'good' END AS logging_case,
  CASE WHEN c_custkey % 23 = 1 THEN 'NoSuchConfiguration' WHEN c_custkey % 23 = 2 THEN 'fields' WHEN c_custkey % 23 = 3 THEN 'weekly'
       WHEN c_custkey % 23 = 4 THEN 'AccessDenied' ELSE 'good' END AS inventory_case,
  CASE WHEN c_custkey % 5 = 1 THEN 'NoSuchPublicAccessBlockConfiguration' WHEN c_custkey % 5 = 2 THEN 'block' WHEN c_custkey % 5 = 3 THEN 'unset' ELSE 'good' END AS access_case,
  CASE WHEN c_custkey % 9 = 1 THEN 'NoSuchBucketPolicy' WHEN c_custkey % 9 = 2 THEN 'broken' WHEN c_custkey % 9 = 3 THEN 'other' WHEN c_custkey % 9 = 4 THEN 'absent' ELSE 'good' END AS policy_case
FROM @customer""",
    "chunks": """
SELECT doc_id, text FROM @documents""",
}

GIVEN = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _expand(text: str, engine: int, given) -> str:
    for token, forms in TOKENS.items():
        text = text.replace(token, forms[engine])

    def name(match: re.Match) -> str:
        word = match.group(1)
        if word in GIVEN:
            return given(word)
        return f"({_expand(VIEWS[word], engine, given)}) AS {word}_view"

    return re.sub(r"(?<!')@(\w+)", name, text)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame over the Parquet files."""

    def given(word: str) -> str:
        return f"parquet.`{sf_dir.rstrip('/')}/{word}.parquet`"

    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spark.sql(_expand(VIEWS[name], 0, given))


def oracle_text(sql: str) -> str:
    """Oracle SQL with the views it names written out."""
    return _expand(sql, 1, lambda word: word)
