"""Inventory and storage queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import View, query
from vaultlens import schemas
from vaultlens.functions.text import bytes_text, percent, percent_text
from vaultlens.operators import inventory, metrics, storage
from vaultlens.plans import intervals
from vaultlens.plans.reports import written
from vaultlens.session import scratch_dir
from vaultlens.sources.inventory import data_files, with_format_problem

SNAPSHOT_DAY = dt.date(1996, 3, 2)
METRICS_AS_OF = dt.datetime(2024, 1, 31)
COSTS_AS_OF = dt.date(1996, 6, 1)
CAPACITY = 5_000_000_000

_PREFIXES = """
WITH prefixes AS (SELECT bucket, CASE WHEN strpos(key,'/') > 0 THEN split_part(key,'/',1) ELSE '' END AS prefix,
  count(*) AS total_files, CAST(sum(coalesce(size,0)) AS BIGINT) AS total_size
  FROM @inventory WHERE NOT key LIKE '%/' GROUP BY 1, 2),
totals AS (SELECT bucket, CAST(sum(total_files) AS BIGINT) AS total_files, CAST(sum(total_size) AS BIGINT) AS total_size,
  count(*) AS prefix_count FROM prefixes GROUP BY bucket)
"""
_PERCENT = "CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100.0 END"


def _pct(a: str, b: str) -> str:
    return _PERCENT.replace("{a}", a).replace("{b}", b)


def _prefixes(view: View):
    return inventory.prefix_stats(view("inventory"))


def _stored_prefixes(view: View):
    """The prefix table, written once for queries that read it more than once."""
    return written(_prefixes(view), "prefixes")


@query(
    "inventory_report",
    "SELECT bucket, key, coalesce(size,0) AS size, concat(CAST(last_modified_date AS VARCHAR),'+00') AS last_modified_date,"
    " storage_class, replication_status FROM @inventory WHERE NOT key LIKE '%/'",
)
def inventory_report(view: View):
    return inventory.report(view("inventory"))


@query("inventory_prefix_stats", _PREFIXES + "SELECT * FROM prefixes")
def inventory_prefix_stats(view: View):
    return _prefixes(view)


@query(
    "inventory_rollup",
    _PREFIXES
    + """SELECT bucket, prefix, 'prefix' AS level, total_files, total_size FROM prefixes
UNION ALL SELECT bucket, NULL, 'bucket', total_files, total_size FROM totals
UNION ALL SELECT NULL, NULL, 'stack', CAST(sum(total_files) AS BIGINT), CAST(sum(total_size) AS BIGINT) FROM totals""",
)
def inventory_rollup(view: View):
    return inventory.rollup(_prefixes(view))


@query("inventory_bucket_totals", _PREFIXES + "SELECT * FROM totals")
def inventory_bucket_totals(view: View):
    return inventory.bucket_totals(_prefixes(view))


_STATS_ROWS = _PREFIXES + """, stats_rows AS (
  SELECT bucket, 'prefix' AS level, prefix, total_files, total_size FROM prefixes
  UNION ALL SELECT bucket, 'bucket', NULL, total_files, total_size FROM totals)
"""
_ROW_DOCUMENT = """concat('{"level":"', level, '","bucket":"', bucket, '",', CASE WHEN prefix IS NULL THEN '' ELSE
  concat('"prefix":"', prefix, '",') END, '"total_files":', total_files, ',"total_size":', total_size, '}')"""


@query("inventory_stats_rows", _STATS_ROWS + "SELECT * FROM stats_rows")
def inventory_stats_rows(view: View):
    return inventory.stats_rows(_stored_prefixes(view))


@query(
    "inventory_stats_documents",
    _STATS_ROWS + f"SELECT bucket, {_ROW_DOCUMENT} AS document FROM stats_rows",
)
def inventory_stats_documents(view: View):
    """The rows as they are published."""
    rows = inventory.stats_rows(_stored_prefixes(view))
    return rows.select(
        "bucket",
        F.to_json(F.struct("level", "bucket", "prefix", "total_files", "total_size")).alias("document"),
    )


@query(
    "inventory_distinct_states",
    "SELECT DISTINCT bucket, key, size, last_modified_date, storage_class, replication_status FROM @snapshots",
)
def inventory_distinct_states(view: View):
    return inventory.distinct_states(view("snapshots"))


#: Days as numbers; a stretch of days is numbered by what is left of the row number.
_INTERVALS = """
WITH listed AS (SELECT DISTINCT date_diff('day', DATE '2024-01-30', CAST(day AS DATE)) AS n, bucket, key, size, last_modified_date,
    storage_class, replication_status FROM @snapshot_days),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY bucket, key, size, last_modified_date, storage_class, replication_status ORDER BY n) AS r
  FROM listed)
SELECT bucket, key, size, last_modified_date, storage_class, replication_status,
  CAST(DATE '2024-01-30' + CAST(min(n) AS INTEGER) AS VARCHAR) AS valid_from,
  CASE WHEN max(n) < 2 THEN CAST(DATE '2024-01-31' + CAST(max(n) AS INTEGER) AS VARCHAR) END AS valid_to
FROM runs GROUP BY bucket, key, size, last_modified_date, storage_class, replication_status, r
"""


def _merged_days(view: View):
    days = view("snapshot_days")
    spark = days.sparkSession
    base = scratch_dir(spark, "intervals")
    for day in (dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1)):
        intervals.merge_day(days.where(F.col("day") == day.isoformat()), base, day)
    return intervals.read_intervals(spark, base)


@query("inventory_state_intervals", _INTERVALS)
def inventory_state_intervals(view: View):
    return _merged_days(view).withColumn("last_modified_date", F.col("last_modified_date").cast("timestamp_ntz"))


@query(
    "inventory_states_of_intervals",
    "SELECT DISTINCT bucket, key, size, last_modified_date, storage_class, replication_status FROM @snapshot_days",
)
def inventory_states_of_intervals(view: View):
    """Distinct states from the interval table, equal to those from all snapshots."""
    states = intervals.distinct_states(_merged_days(view))
    return states.withColumn("last_modified_date", F.col("last_modified_date").cast("timestamp_ntz"))


@query(
    "inventory_object_list",
    """SELECT bucket, key, size, last_modified_date, storage_class FROM @snapshots
  GROUP BY bucket, key, size, last_modified_date, storage_class, replication_status""",
)
def inventory_object_list(view: View):
    return inventory.object_list(inventory.distinct_states(view("snapshots")))


@query(
    "inventory_by_bucket",
    """WITH states AS (SELECT bucket, any_value(size) AS bytes FROM @snapshots
  GROUP BY bucket, key, size, last_modified_date, storage_class, replication_status)
SELECT bucket, count(*) AS objects, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM states GROUP BY bucket""",
)
def inventory_by_bucket(view: View):
    return inventory.usage_by_bucket(inventory.distinct_states(view("snapshots")))


_LATEST = """
WITH latest AS (SELECT bucket, snapshot_date, path, row_number() OVER (PARTITION BY bucket ORDER BY snapshot_date DESC, path DESC) AS place
  FROM @manifests WHERE snapshot_date IN ('1996-03-01','1996-03-02'))
"""


@query(
    "inventory_latest_snapshot",
    _LATEST + "SELECT bucket, snapshot_date, path FROM latest WHERE place = 1",
)
def inventory_latest_snapshot(view: View):
    return inventory.latest_snapshot(view("manifests"), SNAPSHOT_DAY)


@query(
    "inventory_without_snapshot",
    _LATEST + "SELECT DISTINCT bucket FROM @manifests WHERE bucket NOT IN (SELECT bucket FROM latest)",
)
def inventory_without_snapshot(view: View):
    manifests = view("manifests")
    latest = inventory.latest_snapshot(manifests, SNAPSHOT_DAY)
    return inventory.without_snapshot(manifests.select("bucket").distinct(), latest)


def _manifests(view: View):
    parsed = F.from_json("document", schemas.INVENTORY_MANIFEST).alias("manifest")
    return view("manifest_json").select(parsed).select("manifest.*")


@query(
    "inventory_manifest_files",
    """SELECT concat('acme-main-b',CAST(o_custkey AS STRING)) AS bucket, concat('data/',CAST(o_orderkey AS STRING),'-',n,'.parquet') AS key,
  CASE WHEN n = 0 THEN o_orderkey ELSE 7 END AS size, CASE WHEN n = 0 THEN md5(CAST(o_orderkey AS STRING)) ELSE 'x' END AS md5
  FROM @orders, (SELECT unnest([0, 1]) AS n)""",
)
def inventory_manifest_files(view: View):
    return data_files(_manifests(view))


@query(
    "inventory_manifest_gate",
    """SELECT concat('acme-main-b',CAST(o_custkey AS STRING)) AS bucket, concat('data/',CAST(o_orderkey AS STRING),'-0.parquet') AS first_file,
  CASE WHEN o_orderkey % 10 = 0 THEN 'expected inventory format Parquet, got CSV' END AS problem FROM @orders""",
)
def inventory_manifest_gate(view: View):
    """Every manifest with the reason for which the gate fails the job."""
    return with_format_problem(_manifests(view)).select(
        F.col("sourceBucket").alias("bucket"), F.col("files")[0]["key"].alias("first_file"), "problem"
    )


@query(
    "storage_bucket_shares",
    _PREFIXES
    + f"SELECT bucket, total_files, total_size, prefix_count, {_pct('total_size', '(SELECT sum(total_size) FROM totals)')} AS pct_total_size,"
    f" {_pct('total_files', '(SELECT sum(total_files) FROM totals)')} AS pct_total_files FROM totals",
)
def storage_bucket_shares(view: View):
    return storage.bucket_shares(_stored_prefixes(view))


@query(
    "storage_prefix_shares",
    _PREFIXES
    + f"SELECT p.bucket, p.prefix, p.total_files, p.total_size, {_pct('p.total_size', 't.total_size')} AS pct_bucket_size"
    " FROM prefixes p, totals t WHERE p.bucket = t.bucket",
)
def storage_prefix_shares(view: View):
    return storage.prefix_shares(_stored_prefixes(view))


@query(
    "storage_capacity",
    _PREFIXES
    + f""", stack AS (SELECT CAST(sum(total_files) AS BIGINT) AS total_files, CAST(sum(total_size) AS BIGINT) AS total_size,
  count(*) AS bucket_count, CAST(sum(prefix_count) AS BIGINT) AS prefix_count FROM totals)
SELECT *, {_pct('total_size', str(CAPACITY))} AS capacity_used_pct,
  concat(printf('%.1f', {_pct('total_size', str(CAPACITY))}), '% (of 5 GB)') AS capacity_text FROM stack""",
)
def storage_capacity(view: View):
    return storage.summary(_prefixes(view), CAPACITY)


_POINTS_OF_CHARTS = _PREFIXES + """, placed AS (
  SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS position FROM totals)
SELECT 'size' AS chart, position, bucket AS label, total_size AS value FROM placed
UNION ALL SELECT 'files', position, bucket, total_files FROM placed"""


@query("storage_chart_points", _POINTS_OF_CHARTS)
@query("storage_chart_series", _POINTS_OF_CHARTS)
def storage_chart_points(view: View):
    return storage.chart_points(_prefixes(view))


_REPORT_ROWS = _STATS_ROWS + f""", used AS (SELECT CAST(round(sum(TRY_CAST(usage_quantity AS DOUBLE)) * 1e9) AS BIGINT) AS sent FROM @cost_usage
  WHERE period >= TIMESTAMP '1996-01-01' AND period < TIMESTAMP '1996-06-01' AND service = 'Amazon Simple Storage Service'
    AND usage_group = 'S3: Data Transfer - Internet (Out)' AND stack_tag = 'acme-main')
SELECT level, bucket, prefix, {_ROW_DOCUMENT} AS document FROM stats_rows
UNION ALL SELECT 'stack', NULL, NULL, concat('{{"level":"stack","owner":"Acme","stack_name":"acme-main","generated_at":"2024-01-31T00:00:00Z",',
  '"storage_capacity_bytes":null,', CASE WHEN sent > 0 THEN concat('"data_transfer_out_bytes":', sent,
  ',"data_transfer_out_period_start":"1996-01-01","data_transfer_out_period_end":"1996-06-01",') ELSE '' END,
  '"total_files":', (SELECT CAST(sum(total_files) AS BIGINT) FROM totals), ',"total_size":',
  (SELECT CAST(sum(total_size) AS BIGINT) FROM totals), '}}') FROM used"""


@query("storage_report_rows", _REPORT_ROWS)
@query("storage_report_document", _REPORT_ROWS)
def storage_report_rows(view: View):
    header = metrics.transfer_out(view("cost_usage"), "acme-main", COSTS_AS_OF).select(
        F.lit("Acme").alias("owner"),
        F.lit("acme-main").alias("stack_name"),
        F.lit("2024-01-31T00:00:00Z").alias("generated_at"),
        F.lit(None).cast("bigint").alias("storage_capacity_bytes"),
        "data_transfer_out_bytes",
        "data_transfer_out_period_start",
        "data_transfer_out_period_end",
    )
    return storage.report_rows(inventory.stats_rows(_stored_prefixes(view)), header)


@query(
    "storage_buckets_with_stats",
    _STATS_ROWS
    + """SELECT bucket, level, prefix, total_files, total_size FROM stats_rows WHERE bucket IN
  (SELECT bucket FROM @inventory UNION SELECT bucket FROM @manifests)""",
)
def storage_buckets_with_stats(view: View):
    """Buckets of all inventories and manifests; those of manifests have no stats."""
    wanted = view("inventory").select("bucket").union(view("manifests").select("bucket")).distinct()
    return storage.with_latest_stats(wanted, inventory.stats_rows(_stored_prefixes(view)))


@query(
    "storage_buckets_without_stats",
    "SELECT DISTINCT bucket FROM @manifests WHERE bucket NOT IN"
    " (SELECT concat('acme-main-b',CAST(c_custkey AS STRING)) FROM @customer WHERE c_custkey % 3 <> 0)",
)
def storage_buckets_without_stats(view: View):
    published = view("customer").where("c_custkey % 3 <> 0").select(
        F.concat(F.lit("acme-main-b"), F.col("c_custkey").cast("string")).alias("bucket")
    )
    return storage.without_stats(view("manifests").select("bucket").distinct(), published)


_UNITS = "CASE {cases} ELSE concat(CAST(v AS VARCHAR),' B') END"


def _bytes_oracle() -> str:
    cases = " ".join(
        f"WHEN v >= {1000**p} THEN concat(CASE WHEN v % {1000**p} = 0 THEN CAST(v // {1000**p} AS VARCHAR)"
        f" ELSE printf('%.2f', CAST(v AS DOUBLE) / {1000**p}.0) END, ' {unit}')"
        for p, unit in [(4, "TB"), (3, "GB"), (2, "MB"), (1, "kB")]
    )
    return _UNITS.replace("{cases}", cases)


@query(
    "storage_size_text",
    f"SELECT id, v, {_bytes_oracle()} AS size_text FROM (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey"
    " WHEN 1 THEN o_custkey * 1000 WHEN 2 THEN o_orderkey * o_custkey ELSE o_orderkey * 123456789 END AS v FROM @orders)",
)
def storage_size_text(view: View):
    value = F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 1000"
        " WHEN 2 THEN o_orderkey * o_custkey ELSE o_orderkey * 123456789 END"
    )
    return view("orders").select(
        F.col("o_orderkey").alias("id"), value.alias("v"), bytes_text(value).alias("size_text")
    )


@query(
    "storage_percent_text",
    f"SELECT o_orderkey AS id, concat(printf('%.1f', {_pct('o_custkey', '(o_orderkey % 50)')}),'%') AS share FROM @orders",
)
def storage_percent_text(view: View):
    share = percent(F.col("o_custkey"), F.expr("o_orderkey % 50"))
    return view("orders").select(
        F.col("o_orderkey").alias("id"), percent_text(share).alias("share")
    )


_FORMATTED = ", shown AS (SELECT *, {size} AS size_text FROM (SELECT *, total_size AS v FROM {table}))".replace(
    "{size}", _bytes_oracle()
)


@query(
    "storage_formatted_buckets",
    _PREFIXES
    + _FORMATTED.replace("{table}", "totals")
    + f" SELECT bucket, total_files, size_text AS total_size, concat(printf('%.1f', {_pct('total_size', '(SELECT sum(total_size) FROM totals)')}),'%') AS pct_total_size,"
    f" concat(printf('%.1f', {_pct('total_files', '(SELECT sum(total_files) FROM totals)')}),'%') AS pct_total_files, prefix_count FROM shown",
)
def storage_formatted_buckets(view: View):
    return storage.formatted_buckets(_stored_prefixes(view))


@query(
    "storage_formatted_prefixes",
    _PREFIXES
    + _FORMATTED.replace("{table}", "prefixes")
    + f" SELECT p.bucket, p.prefix, p.total_files, p.size_text AS total_size, concat(printf('%.1f', {_pct('p.total_size', 't.total_size')}),'%') AS pct_bucket_size"
    " FROM shown p, totals t WHERE p.bucket = t.bucket",
)
def storage_formatted_prefixes(view: View):
    return storage.formatted_prefixes(_stored_prefixes(view))


_POINTS = """
WITH newest AS (SELECT *, row_number() OVER (PARTITION BY bucket, metric, storage_type ORDER BY ts DESC, tie_breaker DESC) AS place
  FROM @metric_datapoint WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00')
"""


@query(
    "metric_latest_points",
    _POINTS + "SELECT bucket, metric, storage_type, ts, average FROM newest WHERE place = 1",
)
def metric_latest_points(view: View):
    return metrics.latest_points(view("metric_datapoint"), METRICS_AS_OF)


@query(
    "bucket_metrics_latest",
    _POINTS
    + """SELECT b.bucket, CAST(coalesce(sum(average) FILTER (metric = 'NumberOfObjects'),0) AS BIGINT) AS total_objects,
  CAST(coalesce(sum(average) FILTER (metric = 'BucketSizeBytes'),0) AS BIGINT) AS total_bytes
  FROM @metric_buckets b LEFT JOIN newest n ON b.bucket = n.bucket AND place = 1 GROUP BY b.bucket""".replace(
        "@metric_buckets b", "(SELECT * FROM @metric_buckets) b"
    ),
)
def bucket_metrics_latest(view: View):
    points = metrics.latest_points(view("metric_datapoint"), METRICS_AS_OF)
    return metrics.bucket_metrics(points, view("metric_buckets"))


@query(
    "egress_ytd",
    """WITH used AS (SELECT sum(TRY_CAST(usage_quantity AS DOUBLE)) AS quantity FROM @cost_usage
  WHERE period >= TIMESTAMP '1996-01-01' AND period < TIMESTAMP '1996-06-01' AND service = 'Amazon Simple Storage Service'
    AND usage_group = 'S3: Data Transfer - Internet (Out)' AND stack_tag = 'acme-main')
SELECT CASE WHEN quantity > 0 THEN CAST(round(quantity * 1e9) AS BIGINT) END AS data_transfer_out_bytes,
  CASE WHEN quantity > 0 THEN '1996-01-01' END AS data_transfer_out_period_start,
  CASE WHEN quantity > 0 THEN '1996-06-01' END AS data_transfer_out_period_end FROM used""",
)
def egress_ytd(view: View):
    """The bytes are the BIGINT of the SQL wherever that can hold them, else the decimal."""
    sent = written(metrics.transfer_out(view("cost_usage"), "acme-main", COSTS_AS_OF), "egress")
    number = F.col("data_transfer_out_bytes")
    fits = sent.where(number.isNotNull() & number.try_cast("bigint").isNull()).isEmpty()
    return sent.withColumn("data_transfer_out_bytes", number.cast("bigint")) if fits else sent
