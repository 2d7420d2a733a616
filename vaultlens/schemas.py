"""Explicit schemas of every table the engine reads. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _B = StringType(), LongType(), IntegerType(), BooleanType()

INVENTORY = _struct(
    ("bucket", _S),
    ("key", _S),
    ("size", _L),
    ("last_modified_date", TimestampType()),
    ("storage_class", _S),
    ("replication_status", _S),
)

ACCESS_LOG = _struct(
    ("bucket_owner", _S),
    ("bucket", _S),
    ("event_time", TimestampType()),
    ("remote_ip", _S),
    ("requester", _S),
    ("request_id", _S),
    ("operation", _S),
    ("key", _S),
    ("request_uri", _S),
    ("http_status", _I),
    ("error_code", _S),
    ("bytes_sent", _L),
    ("object_size", _L),
    ("total_time_ms", _I),
    ("turn_around_time_ms", _I),
    ("referer", _S),
    ("user_agent", _S),
    ("version_id", _S),
    ("host_id", _S),
    ("sig_v", _S),
    ("cipher_suite", _S),
    ("auth_type", _S),
    ("host_header", _S),
    ("tls_version", _S),
    ("access_point_arn", _S),
)

#: The inventory report as written: sizes are filled, times are text.
INVENTORY_REPORT = _struct(
    ("bucket", _S),
    ("key", _S),
    ("size", _L),
    ("last_modified_date", _S),
    ("storage_class", _S),
    ("replication_status", _S),
)

INVENTORY_MANIFEST = _struct(
    ("sourceBucket", _S),
    ("destinationBucket", _S),
    ("version", _S),
    ("creationTimestamp", _S),
    ("fileFormat", _S),
    ("fileSchema", _S),
    ("files", ArrayType(_struct(("key", _S), ("size", _L), ("MD5checksum", _S)))),
)

BATCH_MANIFEST = _struct(
    ("Format", _S),
    ("ReportCreationDate", _S),
    (
        "Results",
        ArrayType(
            _struct(
                ("TaskExecutionStatus", _S),
                ("Bucket", _S),
                ("MD5Checksum", _S),
                ("Key", _S),
            )
        ),
    ),
    ("ReportSchema", _S),
)

BATCH_RESULT = _struct(
    ("bucket", _S),
    ("key", _S),
    ("version_id", _S),
    ("task_status", _S),
    ("error_code", _S),
    ("http_status_code", _S),
    ("result_message", _S),
)

VERIFICATION_REPORT = _struct(
    ("bucket", _S),
    ("key", _S),
    ("version_id", _S),
    ("status", _S),
    ("checksum_algorithm", _S),
    ("checksum_source", _S),
    ("checksum_replication", _S),
)

VERIFICATION_STATS = _struct(
    ("matches", _L),
    ("mismatches", _L),
    ("missing_replica", _L),
    ("missing_source", _L),
    ("failed_source", _L),
    ("failed_replication", _L),
)

PREFIX_STATS = _struct(("total_files", _L), ("total_size", _L))

#: Published stats: a row for each bucket and one for each of its prefixes.
BUCKET_STATS = _struct(
    ("bucket", _S),
    ("level", _S),
    ("prefix", _S),
    ("total_files", _L),
    ("total_size", _L),
)

CHECKSUM_INVENTORY = _struct(
    ("bucket", _S),
    ("key", _S),
    ("size", _L),
    ("content_type", _S),
    ("checksum", _S),
    ("checksum_algorithm", _S),
    ("status", _S),
    ("detail", _S),
)

OBJECT_HEAD = _struct(
    ("bucket", _S),
    ("key", _S),
    ("content_length", _L),
    ("content_type", _S),
    ("checksum_crc64_nvme", _S),
    ("checksum_sha256", _S),
    ("metadata", MapType(_S, _S)),
    ("error", _S),
)

ARCHIVE_INVENTORY = _struct(
    ("collection_id", _L),
    ("collection_name", _S),
    ("account_id", _L),
    ("filename", _S),
    ("filetype", _S),
    ("size_bytes", _L),
    ("crawl_id", _L),
    ("crawl_time", _S),
    ("crawl_start", _S),
    ("store_time", _S),
    ("sha1", _S),
    ("md5", _S),
    ("primary_location", _S),
    ("all_locations", _S),
)

#: A landed page entry of the web-archive catalogue; ``position`` keeps the
#: order in which the catalogue listed the files.
ARCHIVE_CATALOGUE = _struct(
    ("position", _L),
    ("collection", _L),
    ("collection_name", _S),
    ("account", _L),
    ("filename", _S),
    ("filetype", _S),
    ("size", _L),
    ("crawl", _L),
    ("crawl_time", _S),
    ("crawl_start", _S),
    ("store_time", _S),
    ("checksums", _struct(("sha1", _S), ("md5", _S))),
    ("primary_location", _S),
    ("locations", ArrayType(_S)),
)

JOB_RECEIPT = _struct(
    ("source_bucket", _S),
    ("source_job_id", _S),
    ("repl_bucket", _S),
    ("repl_job_id", _S),
    ("created_at", _S),
)

JOB_EVENT = _struct(
    ("time", TimestampType()),
    (
        "detail",
        _struct(
            (
                "serviceEventDetails",
                _struct(
                    ("jobId", _S),
                    ("jobArn", _S),
                    ("status", _S),
                    ("failureCodes", ArrayType(_S)),
                    ("statusChangeReason", ArrayType(_S)),
                ),
            )
        ),
    ),
)

JOB_STATUS = _struct(
    ("job_id", _S),
    ("status", _S),
    ("failure_codes", ArrayType(_S)),
)

BUCKET_TAGS = _struct(("name", _S), ("tags", MapType(_S, _S)))

USERS = _struct(("user_name", _S), ("email", _S), ("groups", ArrayType(_S)))

METRIC_DATAPOINT = _struct(
    ("bucket", _S),
    ("metric", _S),
    ("storage_type", _S),
    ("ts", TimestampType()),
    ("average", DoubleType()),
    ("tie_breaker", _L),
)

COST_USAGE = _struct(
    ("period", DateType()),
    ("service", _S),
    ("usage_group", _S),
    ("stack_tag", _S),
    ("usage_quantity", _S),
)

LIFECYCLE_RULE = _struct(
    ("id", _S),
    ("status", _S),
    ("abort_multipart_days", _I),
    ("noncurrent_days", _I),
    ("expired_delete_marker", _B),
    ("transitions", ArrayType(_struct(("days", _I), ("storage_class", _S)))),
)

REPLICATION_RULE = _struct(
    ("id", _S),
    ("status", _S),
    ("priority", _I),
    ("prefix", _S),
    ("destination_bucket", _S),
    ("time_status", _S),
    ("time_minutes", _I),
    ("metrics_status", _S),
    ("metrics_minutes", _I),
    ("delete_marker_status", _S),
)

#: Configuration snapshot of a bucket. Each section has an ``_error`` column
#: holding the error code met when the section was read, if any.
BUCKET_CONFIG = _struct(
    ("snapshot_date", _S),
    ("name", _S),
    ("bucket_type", _S),
    ("stack", _S),
    ("account_id", _S),
    ("replication_role", _S),
    ("tags", MapType(_S, _S)),
    ("tags_error", _S),
    ("versioning", _S),
    ("versioning_error", _S),
    ("lifecycle", ArrayType(LIFECYCLE_RULE)),
    ("lifecycle_error", _S),
    ("replication", _struct(("role", _S), ("rules", ArrayType(REPLICATION_RULE)))),
    ("replication_error", _S),
    ("event_bridge", _B),
    ("notifications_error", _S),
    ("logging", _struct(("target_bucket", _S), ("target_prefix", _S))),
    ("logging_error", _S),
    (
        "inventory",
        _struct(
            ("id", _S),
            ("enabled", _B),
            ("included_versions", _S),
            ("frequency", _S),
            ("destination_bucket", _S),
            ("format", _S),
            ("prefix", _S),
            ("account_id", _S),
            ("optional_fields", ArrayType(_S)),
        ),
    ),
    ("inventory_error", _S),
    (
        "public_access",
        _struct(
            ("block_public_acls", _B),
            ("ignore_public_acls", _B),
            ("block_public_policy", _B),
            ("restrict_public_buckets", _B),
        ),
    ),
    ("public_access_error", _S),
    ("policy", _S),
    ("policy_error", _S),
)
