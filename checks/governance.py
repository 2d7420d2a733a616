"""Bucket, job, user and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import View, query
from vaultlens.functions import names
from vaultlens.operators import buckets, drift, jobs, users

STACK = "acme-s1x"


def _tagged(view: View):
    return view("buckets").select(
        "name",
        F.create_map(
            F.lit(names.TAG_STACK),
            "stack_tag",
            F.lit(names.TAG_TYPE),
            "bucket_type",
            F.lit(names.TAG_ORIGIN),
            "origin",
        ).alias("tags"),
    )


def _typed(view: View):
    return _tagged(view).withColumn("bucket_type", F.element_at("tags", names.TAG_TYPE))


@query(
    "stack_buckets",
    "SELECT name, bucket_type FROM @buckets WHERE name LIKE 'acme-s1x-%' AND stack_tag = 'acme-s1x'",
)
def stack_buckets(view: View):
    return buckets.of_stack(_tagged(view), STACK).drop("tags")


@query(
    "requested_buckets",
    "SELECT name, bucket_type FROM @buckets WHERE stack_tag = 'acme-s1x' AND origin = 'bucket-request'",
)
def requested_buckets(view: View):
    return buckets.requested(buckets.of_stack(_tagged(view), STACK)).drop("tags")


@query(
    "buckets_by_type",
    "SELECT name, bucket_type FROM @buckets WHERE bucket_type IN ('public','standard')",
)
def buckets_by_type(view: View):
    return buckets.of_types(_typed(view), ["public", "standard"]).drop("tags")


@query("buckets_of_no_type", "SELECT name, bucket_type FROM @buckets WHERE bucket_type = 'internal'")
def buckets_of_no_type(view: View):
    """No type asked for adds nothing to those of one type."""
    typed = _typed(view)
    return buckets.of_types(typed, ["internal"]).union(buckets.of_types(typed, [])).drop("tags")


_PAIRS = """
WITH b AS (SELECT * FROM @buckets), s AS (SELECT name FROM b WHERE bucket_type IN ('public','standard')),
r AS (SELECT name FROM b WHERE bucket_type = 'replication')
"""


@query(
    "bucket_pairs",
    _PAIRS
    + "SELECT s.name AS source, r.name AS replication FROM s LEFT JOIN r ON r.name = concat(s.name,'-repl')",
)
def bucket_pairs(view: View):
    return buckets.pairs(_typed(view))


@query(
    "bucket_pairs_strict",
    _PAIRS
    + "SELECT s.name AS source, r.name AS replication, CASE WHEN r.name IS NULL THEN"
    " concat('no replication bucket found for ', chr(39), s.name, chr(39)) END AS problem"
    " FROM s LEFT JOIN r ON r.name = concat(s.name,'-repl')",
)
def bucket_pairs_strict(view: View):
    """Every source with the reason for which the strict rule fails the job."""
    return buckets.pair_verdicts(_typed(view))


@query(
    "bucket_unpaired",
    _PAIRS + "SELECT name AS source FROM s WHERE concat(name,'-repl') NOT IN (SELECT name FROM r)",
)
def bucket_unpaired(view: View):
    return buckets.unpaired(_typed(view))


@query(
    "bucket_pair_by_name",
    "SELECT name AS source, concat(name,'-repl') AS replication FROM @buckets WHERE name = 'acme-s1x-b1'",
)
def bucket_pair_by_name(view: View):
    return buckets.pair_by_name(_typed(view), "ACME-s1x-b1")


_REQUESTS = """
WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY line_no) AS place FROM @request_lines) WHERE place <= 5),
low AS (SELECT *, lower(name) AS n FROM first),
reviewed AS (SELECT request, line_no, name, n, CASE WHEN n = '' THEN 'empty'
  WHEN left(n,1) IN ('.','-') OR right(n,1) IN ('.','-') THEN 'affix' WHEN strlen(n) > 63 THEN 'too_long'
  WHEN NOT regexp_full_match(n,'[a-z0-9-]+') THEN 'invalid_character'
  WHEN starts_with(n,'acme-main') OR n LIKE '%-managed' OR n LIKE '%-repl' OR n LIKE '%-request' THEN 'reserved'
  WHEN strlen(n) + 10 + 5 > 63 THEN 'too_long' END AS problem FROM low)
"""


@query("request_first_five", _REQUESTS + "SELECT request, line_no, name FROM first")
def request_first_five(view: View):
    return buckets.first_names(view("request_lines"))


@query("bucket_name_validation", _REQUESTS + "SELECT request, line_no, name, problem FROM reviewed")
def bucket_name_validation(view: View):
    return buckets.review(view("request_lines"), "acme-main")


@query(
    "request_expansion",
    _REQUESTS
    + """SELECT request, line_no, concat('acme-main-',n) AS source, CASE WHEN n LIKE '%-public' THEN 'public' ELSE 'standard' END AS bucket_type,
  concat('acme-main-',n,'-repl') AS replication FROM reviewed
  WHERE request NOT IN (SELECT request FROM reviewed WHERE problem IS NOT NULL)""",
)
def request_expansion(view: View):
    return buckets.expand_requests(view("request_lines"), "acme-main")


@query(
    "names_and_classes",
    """SELECT o_orderkey, nullif(regexp_extract(lower(name),'^([a-z][a-z0-9]+-[a-z][a-z0-9]+)-',1),'') AS stack,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('acme-main-b',CAST(o_orderkey AS VARCHAR))
    WHEN 2 THEN concat('acme-main-b',CAST(o_orderkey AS VARCHAR),'.tar') ELSE NULL END AS stem,
  CASE WHEN class_text IN ('GLACIER','STANDARD_IA','DEEP_ARCHIVE') THEN class_text END AS transition_class,
  CASE WHEN bucket_type = 'replication' THEN 'DEEP_ARCHIVE' ELSE 'INTELLIGENT_TIERING' END AS default_class FROM @names""",
)
def names_and_classes(view: View):
    return view("names").select(
        "o_orderkey",
        names.stack_of("name").alias("stack"),
        names.file_stem("key").alias("stem"),
        names.transition_class("class_text").alias("transition_class"),
        names.default_transition_class("bucket_type").alias("default_class"),
    )


_READY = """
WITH j AS (SELECT job_id, CASE WHEN status = 'Complete' THEN 'complete' WHEN status = 'Failed' AND failure_code = 'InvalidManifestContent' THEN 'empty'
  WHEN status = 'Failed' THEN 'failed' ELSE 'not_ready' END AS state FROM @jobs),
m AS (SELECT job_id FROM @job_manifests),
p AS (SELECT r.*, s.state AS s, t.state AS t, sm.job_id IS NOT NULL AS sm, tm.job_id IS NOT NULL AS tm FROM (SELECT * FROM @receipts) r
  LEFT JOIN j s ON s.job_id = r.source_job_id LEFT JOIN j t ON t.job_id = r.repl_job_id
  LEFT JOIN m sm ON sm.job_id = r.source_job_id LEFT JOIN m tm ON tm.job_id = r.repl_job_id)
"""
_STATE = """CASE WHEN s IS NULL THEN 'source_unknown' WHEN s = 'empty' THEN 'empty_source' WHEN s = 'failed' THEN 'source_failed'
  WHEN s = 'not_ready' THEN 'source_not_ready' {lost_source} WHEN t IS NULL THEN 'repl_unknown' WHEN t = 'empty' THEN 'empty_replica'
  WHEN t = 'failed' THEN 'repl_failed' WHEN t = 'not_ready' THEN 'repl_not_ready' {lost_repl} ELSE 'ready' END"""
_RECEIPT = "source_job_id, repl_job_id, source_bucket, repl_bucket"
_PLAIN = _STATE.replace("{lost_source}", "").replace("{lost_repl}", "")
_FULL = _STATE.replace(
    "{lost_source}", "WHEN NOT sm THEN 'source_manifest_not_found'"
).replace("{lost_repl}", "WHEN NOT tm THEN 'repl_manifest_not_found'")


def _status(view: View):
    return view("jobs").select(
        "job_id",
        "status",
        F.when(F.col("failure_code").isNotNull(), F.array("failure_code"))
        .otherwise(F.array().cast("array<string>"))
        .alias("failure_codes"),
    )


def _job_events(view: View):
    """Events as they come from the notification service."""
    return view("job_events").select(
        F.struct(
            F.struct(
                F.col("job_id").alias("jobId"),
                F.concat(F.lit("arn:"), "job_id").alias("jobArn"),
                "status",
                F.array_compact(F.array("failure_code")).alias("failureCodes"),
                F.array().cast("array<string>").alias("statusChangeReason"),
            ).alias("serviceEventDetails")
        ).alias("detail"),
        F.timestamp_seconds("place").alias("time"),
    )


@query("job_readiness", _READY + f"SELECT {_RECEIPT}, {_PLAIN} AS state FROM p")
def job_readiness(view: View):
    return jobs.readiness(view("receipts"), _status(view))


@query("job_readiness_with_manifests", _READY + f"SELECT {_RECEIPT}, {_FULL} AS state FROM p")
def job_readiness_with_manifests(view: View):
    return jobs.readiness(view("receipts"), _status(view), view("job_manifests"))


@query(
    "job_latest_status",
    "SELECT job_id, status, coalesce(failure_code,'') AS failure_codes FROM @jobs",
)
def job_latest_status(view: View):
    latest = jobs.latest_status(jobs.events_to_status(_job_events(view)))
    return latest.withColumn("failure_codes", F.concat_ws(",", "failure_codes"))


@query(
    "job_events_with_receipt",
    """SELECT e.job_id, e.status FROM (SELECT * FROM @job_events) e WHERE job_id IN
  (SELECT source_job_id FROM @receipts UNION ALL SELECT repl_job_id FROM @receipts)""",
)
def job_events_with_receipt(view: View):
    events = jobs.events_to_status(_job_events(view))
    return jobs.with_receipt(events, view("receipts")).select("job_id", "status")


@query(
    "receipt_lookup",
    f"""WITH r AS (SELECT * FROM @receipts)
SELECT source_job_id AS identifier, '0000-00-00-LATEST' AS report_date, {_RECEIPT} FROM r
UNION ALL SELECT repl_job_id, '0000-00-00-LATEST', {_RECEIPT} FROM r
UNION ALL SELECT source_bucket, '0000-00-00-LATEST', {_RECEIPT} FROM r
UNION ALL SELECT source_bucket, '2024-01-31', {_RECEIPT} FROM r""",
)
def receipt_lookup(view: View):
    return jobs.receipt_keys(view("receipts"), "2024-01-31")


@query(
    "receipt_newest",
    """WITH r AS (SELECT * FROM @receipts), d AS (SELECT unnest(['2024-01-30','2024-01-31']) AS created_at),
k AS (SELECT source_job_id AS identifier, r.* FROM r UNION ALL SELECT repl_job_id, r.* FROM r UNION ALL SELECT source_bucket, r.* FROM r)
SELECT identifier, '0000-00-00-LATEST' AS report_date, '2024-01-31' AS created_at, source_bucket, source_job_id, repl_bucket, repl_job_id FROM k
UNION ALL SELECT source_bucket, created_at, created_at, source_bucket, source_job_id, repl_bucket, repl_job_id FROM r, d""",
)
def receipt_newest(view: View):
    """Each receipt stored on two days."""
    receipts = view("receipts")
    days = [
        jobs.receipt_keys(receipts.withColumn("created_at", F.lit(day)), day)
        for day in ("2024-01-30", "2024-01-31")
    ]
    return jobs.newest_receipts(days[0].unionByName(days[1]))


@query(
    "dispatch_issues",
    "SELECT name, concat(name,': ',error) AS issue FROM @dispatch_results WHERE error IS NOT NULL",
)
def dispatch_issues(view: View):
    return jobs.issues(view("dispatch_results"))


@query(
    "dispatch_summary",
    """SELECT count(*) FILTER (error IS NULL) AS dispatched, count(*) FILTER (error IS NOT NULL) AS failed,
  count(*) FILTER (error IS NOT NULL) = 0 AS is_ok FROM @dispatch_results""",
)
def dispatch_summary(view: View):
    return jobs.dispatch_summary(view("dispatch_results"))


def _users(view: View):
    return view("user_groups").select("user_name", "email", F.array("group_name").alias("groups"))


_ENTITLED = """
WITH u AS (SELECT user_name, email, group_name, regexp_extract(group_name,'^([a-z][a-z0-9]+-[a-z][a-z0-9]+)-',1) AS stack
  FROM @user_groups WHERE email IS NOT NULL),
e AS (SELECT u.user_name, u.email, u.stack, b.name AS bucket FROM u, (SELECT * FROM @buckets) b
  WHERE b.stack_tag = u.stack AND b.bucket_type IN ('internal','public','standard'))
"""


@query("user_stacks", _ENTITLED + "SELECT * FROM u WHERE stack <> ''")
def user_stacks(view: View):
    return users.user_stacks(_users(view))


@query("user_entitlements", _ENTITLED + "SELECT * FROM e")
def user_entitlements(view: View):
    return users.entitlements(_users(view), _typed(view))


@query(
    "user_access_rights",
    _ENTITLED
    + """SELECT DISTINCT user_name, concat('/',bucket) AS path, CASE WHEN bucket LIKE '%-managed' THEN 'list,download' ELSE '*' END AS rights FROM e
UNION ALL SELECT DISTINCT user_name, '/', 'list' FROM e""",
)
def user_access_rights(view: View):
    entitled = users.entitlements(_users(view), _typed(view), once=True)
    return users.access_rights(entitled, once=True).withColumn("rights", F.concat_ws(",", "rights"))


def _config(view: View):
    """Snapshots with every section set as the flags say."""
    flag = F.col

    def code(case: str, *codes: str):
        return F.when(flag(case).isin(*codes), flag(case)).alias(case.replace("_case", "_error"))

    rule_class = flag("rule_class")
    days = F.when(flag("lifecycle_case") == "days", 4).otherwise(3)
    transition = F.struct(days.alias("days"), rule_class.alias("storage_class"))
    none_int = F.lit(None).cast("int")
    lifecycle = F.array(
        F.struct(
            F.lit(drift.EXPIRE_RULE).alias("id"),
            F.lit("Enabled").alias("status"),
            F.lit(3).alias("abort_multipart_days"),
            F.lit(14).alias("noncurrent_days"),
            F.lit(True).alias("expired_delete_marker"),
            F.filter(F.array(transition), lambda _: F.lit(False)).alias("transitions"),
        ),
        F.struct(
            rule_class.alias("id"),
            F.lit("Enabled").alias("status"),
            none_int.alias("abort_multipart_days"),
            none_int.alias("noncurrent_days"),
            F.lit(None).cast("boolean").alias("expired_delete_marker"),
            F.when(flag("lifecycle_case") == "two", F.array(transition, transition))
            .otherwise(F.array(transition))
            .alias("transitions"),
        ),
    )
    minutes = F.when(flag("replication_case") == "minutes", 30).otherwise(15)
    rule = F.struct(
        F.lit("ReplicateAll").alias("id"),
        F.lit("Enabled").alias("status"),
        F.lit(1).alias("priority"),
        F.lit("").alias("prefix"),
        F.concat(F.lit("arn:aws:s3:::"), "name", F.lit("-repl")).alias("destination_bucket"),
        F.lit("Enabled").alias("time_status"),
        minutes.alias("time_minutes"),
        F.lit("Enabled").alias("metrics_status"),
        F.lit(15).alias("metrics_minutes"),
        F.lit("Enabled").alias("delete_marker_status"),
    )
    replication = F.struct(
        F.when(flag("replication_case") == "role", F.lit("other"))
        .otherwise(F.lit("role-arn"))
        .alias("role"),
        F.when(flag("replication_case") == "two", F.array(rule, rule))
        .otherwise(F.array(rule))
        .alias("rules"),
    )
    fields = F.when(
        flag("inventory_case") == "fields", F.array(F.lit("Size"), F.lit("StorageClass"))
    ).otherwise(F.array(*[F.lit(name) for name in drift.INVENTORY_FIELDS]))
    setting = F.struct(
        F.lit("inventory").alias("id"),
        F.lit(True).alias("enabled"),
        F.lit("Current").alias("included_versions"),
        F.when(flag("inventory_case") == "weekly", F.lit("Weekly"))
        .otherwise(F.lit("Daily"))
        .alias("frequency"),
        F.lit("arn:aws:s3:::acme-main-managed").alias("destination_bucket"),
        F.lit("Parquet").alias("format"),
        F.lit("manifests").alias("prefix"),
        F.lit("123456789012").alias("account_id"),
        fields.alias("optional_fields"),
    )
    blocked = F.when(flag("access_case") == "unset", F.lit(None).cast("boolean")).otherwise(
        flag("access_case") == "block"
    )
    policy = F.concat(
        F.lit('{"Version":"2012-10-17","Statement":[{"Sid":"AllowPublicRead","Effect":"Allow","Principal":'),
        F.when(flag("policy_case") == "other", F.lit('{"AWS":"*"}')).otherwise(F.lit('"*"')),
        F.lit(',"Action":"s3:GetObject","Resource":"arn:aws:s3:::'),
        "name",
        F.lit('/*"}]}'),
    )
    return view("config_flags").select(
        "name",
        "bucket_type",
        F.lit("acme-main").alias("stack"),
        F.lit("123456789012").alias("account_id"),
        F.lit("role-arn").alias("replication_role"),
        F.when(flag("tag_case") == "valid", F.create_map(F.lit("TransitionStorageClass"), "rule_class"))
        .when(flag("tag_case") == "invalid", F.create_map(F.lit("TransitionStorageClass"), F.lit("COLD")))
        .when(flag("tag_case") == "missing", F.create_map(F.lit("Stack"), F.lit("acme-main")))
        .alias("tags"),
        F.when(flag("tag_case").isin("NoSuchTagSet", "AccessDenied"), flag("tag_case")).alias("tags_error"),
        F.when(flag("versioning_case") == "on", F.lit("Enabled"))
        .when(flag("versioning_case") == "off", F.lit("Suspended"))
        .alias("versioning"),
        code("versioning_case", "AccessDenied"),
        F.when(flag("lifecycle_case").isin("good", "days", "two"), lifecycle).alias("lifecycle"),
        code("lifecycle_case", "AccessDenied", "NoSuchLifecycleConfiguration"),
        F.when(
            flag("replication_case").isin("good", "role", "minutes", "two"), replication
        ).alias("replication"),
        code("replication_case", "AccessDenied", "ReplicationConfigurationNotFoundError"),
        (flag("bridge_case") == "on").alias("event_bridge"),
        F.when(flag("bridge_case") == "AccessDenied", flag("bridge_case")).alias(
            "notifications_error"
        ),
        F.when(
            flag("logging_case").isin("good", "prefix"),
            F.struct(
                F.lit("acme-main-managed").alias("target_bucket"),
                F.when(flag("logging_case") == "prefix", F.lit("logs/"))
                .otherwise(F.concat(F.lit("audit/"), "name", F.lit("/")))
                .alias("target_prefix"),
            ),
        ).alias("logging"),
        code("logging_case", "AccessDenied"),
        F.when(flag("inventory_case").isin("good", "fields", "weekly"), setting).alias("inventory"),
        code("inventory_case", "AccessDenied", "NoSuchConfiguration"),
        F.when(
            flag("access_case").isin("good", "block", "unset"),
            F.struct(*[blocked.alias(name) for name in drift.PUBLIC_ACCESS_FLAGS]),
        ).alias("public_access"),
        F.when(
            flag("access_case") == "NoSuchPublicAccessBlockConfiguration", flag("access_case")
        ).alias("public_access_error"),
        F.when(flag("policy_case") == "broken", F.lit("{broken"))
        .when(flag("policy_case").isin("good", "other"), policy)
        .alias("policy"),
        F.when(flag("policy_case") == "NoSuchBucketPolicy", flag("policy_case")).alias("policy_error"),
    )


def _days(view: View):
    """The same configuration on two snapshot days, the second without replicas."""
    config = _config(view)
    first = config.withColumn("snapshot_date", F.lit("1996-03-01"))
    second = config.where("bucket_type <> 'replication'").withColumn("snapshot_date", F.lit("1996-03-02"))
    return first.unionByName(second)


_DRIFT = """
WITH days AS (SELECT unnest(['1996-03-01', '1996-03-02']) AS snapshot_date),
c AS (SELECT * FROM days, (SELECT * FROM @config_flags) WHERE snapshot_date = '1996-03-01' OR bucket_type <> 'replication'),
e AS (SELECT c.*, r.name IS NOT NULL AS paired,
  CASE WHEN tag_case IN ('NoSuchTagSet','AccessDenied') THEN NULL WHEN tag_case = 'valid' THEN rule_class
       WHEN lifecycle_case IN ('NoSuchLifecycleConfiguration','AccessDenied') THEN NULL ELSE rule_class END AS wanted
  FROM c LEFT JOIN (SELECT snapshot_date AS day, name FROM c WHERE bucket_type = 'replication') r
    ON r.name = concat(c.name,'-repl') AND day = snapshot_date),
x AS (SELECT *, coalesce(wanted, CASE WHEN bucket_type = 'replication' THEN 'DEEP_ARCHIVE' ELSE 'INTELLIGENT_TIERING' END) AS expected FROM e),
steps AS (
SELECT snapshot_date, name, bucket_type, 'transition-tag' AS step, CASE WHEN tag_case = 'NoSuchTagSet' THEN 'drift' WHEN tag_case = 'AccessDenied' THEN 'error'
  WHEN tag_case = 'valid' THEN 'ok' WHEN lifecycle_case = 'AccessDenied' THEN 'error' ELSE 'drift' END AS status FROM x WHERE bucket_type <> 'internal'
UNION ALL SELECT snapshot_date, name, bucket_type, 'versioning', CASE versioning_case WHEN 'on' THEN 'ok' WHEN 'off' THEN 'drift' ELSE 'error' END FROM x WHERE bucket_type <> 'internal'
UNION ALL SELECT snapshot_date, name, bucket_type, 'lifecycle', CASE WHEN lifecycle_case = 'AccessDenied' THEN 'error' WHEN lifecycle_case = 'good' AND expected = rule_class THEN 'ok' ELSE 'drift' END
  FROM x WHERE bucket_type <> 'internal'
UNION ALL SELECT snapshot_date, name, bucket_type, 'replication', CASE WHEN NOT paired THEN 'error' WHEN replication_case = 'AccessDenied' THEN 'error' WHEN replication_case = 'good' THEN 'ok' ELSE 'drift' END
  FROM x WHERE bucket_type IN ('standard','public')
UNION ALL SELECT snapshot_date, name, bucket_type, 'notifications', CASE bridge_case WHEN 'on' THEN 'ok' WHEN 'off' THEN 'drift' ELSE 'error' END FROM x WHERE bucket_type IN ('standard','public')
UNION ALL SELECT snapshot_date, name, bucket_type, 'logging', CASE logging_case WHEN 'good' THEN 'ok' WHEN 'AccessDenied' THEN 'error' ELSE 'drift' END FROM x WHERE bucket_type IN ('standard','public')
UNION ALL SELECT snapshot_date, name, bucket_type, 'inventory', CASE inventory_case WHEN 'good' THEN 'ok' WHEN 'AccessDenied' THEN 'error' ELSE 'drift' END FROM x WHERE bucket_type IN ('standard','public')
UNION ALL SELECT snapshot_date, name, bucket_type, 'public-access', CASE access_case WHEN 'good' THEN 'ok' ELSE 'drift' END FROM x WHERE bucket_type = 'public'
UNION ALL SELECT snapshot_date, name, bucket_type, 'bucket-policy', CASE policy_case WHEN 'good' THEN 'ok' WHEN 'broken' THEN 'error' ELSE 'drift' END FROM x WHERE bucket_type = 'public'
UNION ALL SELECT snapshot_date, name, bucket_type, 'setup', 'error' FROM x WHERE bucket_type = 'internal'),
worst AS (SELECT snapshot_date, name, bucket_type, CASE max(CASE status WHEN 'error' THEN 2 WHEN 'drift' THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'drift' ELSE 'ok' END AS status
  FROM steps GROUP BY snapshot_date, name, bucket_type)
"""


@query("drift_steps", _DRIFT + "SELECT * FROM steps")
def drift_steps(view: View):
    return drift.report(drift.steps(_days(view)))


@query("drift_bucket_status", _DRIFT + "SELECT * FROM worst")
def drift_bucket_status(view: View):
    return drift.bucket_status(_days(view))


@query(
    "drift_summary",
    _DRIFT
    + """SELECT snapshot_date, count(*) AS processed, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'drift') AS drift,
  count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'drift') = 0 AS is_ok FROM worst GROUP BY snapshot_date""",
)
def drift_summary(view: View):
    return drift.summary(drift.bucket_status(_days(view)), fail_on_drift=True)
