"""Who did what to which object, from storage access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions.text import dash_to_null
from vaultlens.functions.times import log_time

# The log line pattern and the names of its groups.
LINE_PATTERN = (
    r'^(\S+) (\S+) \[([^\]]+)\] (\S+) (\S+) (\S+) (\S+) (\S+) "([^"]*)" '
    r"(\S+) (\S+) (\S+) (\S+) (\S+) (\S+) "
    r'"([^"]*)" "([^"]*)" (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+)'
)
FIELDS = [
    "bucket_owner",
    "bucket",
    "time_str",
    "remote_ip",
    "requester",
    "request_id",
    "operation",
    "key",
    "request_uri",
    "http_status",
    "error_code",
    "bytes_sent",
    "object_size",
    "total_time",
    "turn_around_time",
    "referer",
    "user_agent",
    "version_id",
    "host_id",
    "sig_v",
    "cipher_suite",
    "auth_type",
    "host_header",
    "tls_version",
    "access_point_arn",
]

# Operations on objects, and programmatic sessions.
OBJECT_OPERATIONS = ["REST.PUT.OBJECT", "REST.GET.OBJECT", "REST.DELETE.OBJECT"]
ROLE_REQUESTER = "%:assumed-role/%"
PROGRAM_REQUESTERS = ["%aws-go-sdk-%", "%assume-role-from-profile-%"]
SESSION_PATTERN = r"assumed-role/[^/]+/(.+)$"

_SEPARATOR = "\u0001"


def _pieces() -> Column:
    """The 25 fields of ``line`` as an array; one piece for any other line.

    The pattern runs once per line: its match is replaced by the groups with a
    separator between them, then cut there. Text after the last group belongs
    to no field.
    """
    groups = _SEPARATOR.join(f"${n}" for n in range(1, len(FIELDS) + 1))
    marked = F.regexp_replace("line", LINE_PATTERN + "(?s:.*)", groups)
    return F.when(
        ~F.contains("line", F.lit(_SEPARATOR)), F.split(marked, _SEPARATOR, len(FIELDS))
    )


def _is_record(pieces: Column) -> Column:
    return F.coalesce(F.size(pieces), F.lit(0)) == len(FIELDS)


def quarantine(lines: DataFrame) -> DataFrame:
    """Lines that are not log records. They are kept, never dropped silently."""
    return lines.where(~_is_record(_pieces())).select("line")


def parsed(lines: DataFrame, keep_others: bool = False) -> DataFrame:
    """Typed log records of a DataFrame with one text column ``line``.

    With ``keep_others`` every line gives a row: ``is_record`` tells records,
    and other rows have only ``line``.
    """
    field = {name: F.col("fields")[n] for n, name in enumerate(FIELDS)}

    def number(name: str, kind: str) -> Column:
        return dash_to_null(field[name]).try_cast(kind)

    # A generator, unlike a filter, does not evaluate the pattern a second time.
    if keep_others:
        found = lines.select("line", F.explode(F.array(_pieces())).alias("fields"))
        found = found.withColumn("is_record", _is_record(F.col("fields")))
        others = [F.when(~F.col("is_record"), F.col("line")).alias("line"), "is_record"]
        found = found.withColumn("fields", F.when(F.col("is_record"), F.col("fields")))
    else:
        records = F.explode(F.filter(F.array(_pieces()), _is_record))
        found, others = lines.select(records.alias("fields")), []
    return (
        found.select(
            field["bucket_owner"].alias("bucket_owner"),
            field["bucket"].alias("bucket"),
            log_time(field["time_str"]).alias("event_time"),
            field["remote_ip"].alias("remote_ip"),
            field["requester"].alias("requester"),
            field["request_id"].alias("request_id"),
            field["operation"].alias("operation"),
            dash_to_null(field["key"]).alias("key"),
            field["request_uri"].alias("request_uri"),
            field["http_status"].try_cast("int").alias("http_status"),
            dash_to_null(field["error_code"]).alias("error_code"),
            number("bytes_sent", "bigint").alias("bytes_sent"),
            number("object_size", "bigint").alias("object_size"),
            number("total_time", "int").alias("total_time_ms"),
            number("turn_around_time", "int").alias("turn_around_time_ms"),
            dash_to_null(field["referer"]).alias("referer"),
            field["user_agent"].alias("user_agent"),
            dash_to_null(field["version_id"]).alias("version_id"),
            field["host_id"].alias("host_id"),
            field["sig_v"].alias("sig_v"),
            field["cipher_suite"].alias("cipher_suite"),
            field["auth_type"].alias("auth_type"),
            field["host_header"].alias("host_header"),
            field["tls_version"].alias("tls_version"),
            dash_to_null(field["access_point_arn"]).alias("access_point_arn"),
            *others,
        )
    )


def requests(log: DataFrame) -> DataFrame:
    """Every request in time order.

    The request id breaks ties, so a second with very many requests is still
    spread over the range partitions of the sort.
    """
    return log.orderBy("event_time", "request_id").select(
        "event_time", "bucket", "remote_ip", "operation", "key", "http_status", "bytes_sent"
    )


def people_operations(log: DataFrame) -> DataFrame:
    """Object reads, writes and deletes by people rather than programs."""
    by_person = F.col("requester").like(ROLE_REQUESTER)
    for pattern in PROGRAM_REQUESTERS:
        by_person &= ~F.col("requester").like(pattern)
    return (
        log.where(F.col("operation").isin(OBJECT_OPERATIONS) & by_person)
        .orderBy("event_time", "request_id")
        .select(
            "event_time",
            F.regexp_extract("requester", SESSION_PATTERN, 1).alias("who"),
            "bucket",
            "operation",
            "key",
            "http_status",
        )
    )


def object_history(log: DataFrame) -> DataFrame:
    """Requests, first and last time, and the last operation of every object.

    One aggregate that combines before its shuffle, so a busy object costs no more. Of
    requests of one time the largest request id is the last. Requests without a key
    are those of their bucket.
    """
    last = F.max(F.struct("event_time", "request_id", "operation"))
    return (
        log.groupBy("bucket", "key")
        .agg(F.count(F.lit(1)).alias("requests"), F.min("event_time").alias("first_time"), last.alias("last"))
        .select("bucket", "key", "requests", "first_time", F.col("last.event_time").alias("last_time"), "last.operation")
        .withColumnRenamed("operation", "last_operation")
    )


def requests_of(log: DataFrame, bucket: str, key: str) -> DataFrame:
    """The requests of one object in time order."""
    return log.where((F.col("bucket") == bucket) & (F.col("key") == key)).orderBy("event_time", "request_id")
