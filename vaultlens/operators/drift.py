"""Which buckets differ from their expected configuration?

Works on a table of configuration snapshots, one row per bucket and snapshot
date, with an error code per section that could not be read. Each check yields
ok, drift or error; the code for "not configured" is drift, any other code is an
error. Dates are kept apart: a bucket is compared with its replica of that date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import names

OK, DRIFT, ERROR = "ok", "drift", "error"

# Expected settings.
EXPIRE_RULE = "ExpireOldVersions"
ABORT_MULTIPART_DAYS = 3
NONCURRENT_DAYS = 14
TRANSITION_DAYS = 3
REPLICATION_RULE = "ReplicateAll"
REPLICATION_PRIORITY = 1
REPLICATION_MINUTES = 15
LOG_PREFIX = "audit"
INVENTORY_ID = "inventory"
INVENTORY_PREFIX = "manifests"
INVENTORY_FORMAT = "Parquet"
INVENTORY_FIELDS = ["Size", "LastModifiedDate", "StorageClass", "ReplicationStatus"]
BUCKET_ARN = "arn:aws:s3:::"
PUBLIC_ACCESS_FLAGS = [
    "block_public_acls",
    "ignore_public_acls",
    "block_public_policy",
    "restrict_public_buckets",
]

# Error codes that mean "not configured".
NO_TAGS = ["NoSuchTagSet"]
NO_LIFECYCLE = ["NoSuchLifecycleConfiguration"]
NO_REPLICATION = ["ReplicationConfigurationNotFoundError", "ReplicationConfigurationNotFound"]
NO_INVENTORY = ["NoSuchConfiguration", "NoSuchInventoryConfiguration"]
NO_PUBLIC_ACCESS = [
    "NoSuchPublicAccessBlockConfiguration",
    "NoSuchPublicAccessBlockConfigurationError",
]
NO_POLICY = ["NoSuchBucketPolicy"]

# Checks by bucket type.
REPLICATION_STEPS = ["transition-tag", "versioning", "lifecycle"]
STANDARD_STEPS = [*REPLICATION_STEPS, "replication", "notifications", "logging", "inventory"]
PUBLIC_STEPS = [*STANDARD_STEPS, "public-access", "bucket-policy"]

_POLICY = (
    "Statement ARRAY<STRUCT<Sid: STRING, Effect: STRING, Principal: STRING, "
    "Action: STRING, Resource: STRING>>"
)


def _is(value: Column) -> Column:
    """NULL counts as no."""
    return F.coalesce(value, F.lit(False))


def _verdict(matches: Column) -> Column:
    return F.when(_is(matches), F.lit(OK)).otherwise(F.lit(DRIFT))


def _read(error: str, matches: Column, absent: list[str] | None = None) -> Column:
    """Verdict of a section, after the error met when it was read."""
    code = F.col(error)
    return (
        F.when(code.isin(absent or []), F.lit(DRIFT))
        .when(code.isNotNull(), F.lit(ERROR))
        .otherwise(_verdict(matches))
    )


def with_transition_class(config: DataFrame) -> DataFrame:
    """Add the tag verdict and the storage class that objects should move to.

    A valid tag decides; without one the first lifecycle rule named after a
    class does; else the default of the bucket type.
    """
    tagged = names.transition_class(F.element_at("tags", names.TAG_TRANSITION_CLASS))
    rule_classes = F.filter(
        F.transform("lifecycle", lambda rule: names.transition_class(rule["id"])),
        lambda name: name.isNotNull(),
    )
    inferred = F.when(F.col("lifecycle_error").isNull(), F.get(rule_classes, F.lit(0)))
    unreadable = F.col("lifecycle_error").isNotNull() & ~F.col("lifecycle_error").isin(
        NO_LIFECYCLE
    )
    status = (
        F.when(F.col("tags_error").isin(NO_TAGS), F.lit(DRIFT))
        .when(F.col("tags_error").isNotNull(), F.lit(ERROR))
        .when(tagged.isNotNull(), F.lit(OK))
        .when(unreadable, F.lit(ERROR))
        .otherwise(F.lit(DRIFT))
    )
    expected = F.when(F.col("tags_error").isNull(), F.coalesce(tagged, inferred))
    return config.withColumns(
        {
            "tag_status": status,
            "expected_class": F.coalesce(
                expected, names.default_transition_class("bucket_type")
            ),
        }
    )


def _lifecycle() -> Column:
    expire = F.exists(
        "lifecycle",
        lambda rule: _is(
            (rule["id"] == EXPIRE_RULE)
            & (rule["status"] == "Enabled")
            & (rule["abort_multipart_days"] == ABORT_MULTIPART_DAYS)
            & (rule["noncurrent_days"] == NONCURRENT_DAYS)
            & rule["expired_delete_marker"]
        ),
    )
    moves = F.exists(
        "lifecycle",
        lambda rule: _is(
            (rule["id"] == F.col("expected_class"))
            & (rule["status"] == "Enabled")
            & (F.size(rule["transitions"]) == 1)
            & (F.get(rule["transitions"], F.lit(0))["days"] == TRANSITION_DAYS)
            & (
                F.get(rule["transitions"], F.lit(0))["storage_class"]
                == F.col("expected_class")
            )
        ),
    )
    return _read("lifecycle_error", expire & moves, NO_LIFECYCLE)


def _replication() -> Column:
    rules = F.col("replication.rules")
    rule = F.get(rules, F.lit(0))
    destination = F.concat(F.lit(BUCKET_ARN), F.col("replica"))
    matches = (
        (F.col("replication.role") == F.col("replication_role"))
        & (F.size(rules) == 1)
        & (rule["id"] == REPLICATION_RULE)
        & (rule["status"] == "Enabled")
        & (rule["priority"] == REPLICATION_PRIORITY)
        & (rule["prefix"] == "")
        & (rule["destination_bucket"] == destination)
        & (rule["time_status"] == "Enabled")
        & (rule["time_minutes"] == REPLICATION_MINUTES)
        & (rule["metrics_status"] == "Enabled")
        & (rule["metrics_minutes"] == REPLICATION_MINUTES)
        & (rule["delete_marker_status"] == "Enabled")
    )
    return F.when(F.col("replica").isNull(), F.lit(ERROR)).otherwise(
        _read("replication_error", matches, NO_REPLICATION)
    )


def _logging() -> Column:
    return _read(
        "logging_error",
        (F.col("logging.target_bucket") == _managed_bucket())
        & (F.col("logging.target_prefix") == F.concat(F.lit(f"{LOG_PREFIX}/"), "name", F.lit("/"))),
    )


def _managed_bucket() -> Column:
    return F.concat("stack", F.lit(names.MANAGED_SUFFIX))


def _inventory() -> Column:
    setting = F.col("inventory")
    matches = (
        setting["enabled"]
        & (setting["id"] == INVENTORY_ID)
        & (setting["included_versions"] == "Current")
        & (setting["frequency"] == "Daily")
        & (setting["destination_bucket"] == F.concat(F.lit(BUCKET_ARN), _managed_bucket()))
        & (setting["format"] == INVENTORY_FORMAT)
        & (setting["prefix"] == INVENTORY_PREFIX)
        & (setting["account_id"] == F.col("account_id"))
    )
    for field in INVENTORY_FIELDS:
        matches &= F.array_contains(setting["optional_fields"], field)
    return _read("inventory_error", matches, NO_INVENTORY)


def _public_access() -> Column:
    flags = F.col("public_access")
    matches = F.lit(True)
    for flag in PUBLIC_ACCESS_FLAGS:
        matches &= ~flags[flag]
    return _read("public_access_error", matches, NO_PUBLIC_ACCESS)


def _policy() -> Column:
    resource = F.concat(F.lit(BUCKET_ARN), "name", F.lit("/*"))
    public_read = F.exists(
        F.from_json("policy", _POLICY)["Statement"],
        lambda statement: _is(
            (statement["Sid"] == "AllowPublicRead")
            & (statement["Effect"] == "Allow")
            & (statement["Principal"] == "*")
            & (statement["Action"] == "s3:GetObject")
            & (statement["Resource"] == resource)
        ),
    )
    broken = F.col("policy").isNotNull() & F.try_parse_json("policy").isNull()
    return F.when(F.col("policy_error").isNull() & broken, F.lit(ERROR)).otherwise(
        _read("policy_error", public_read, NO_POLICY)
    )


def with_replica(config: DataFrame) -> DataFrame:
    """Add the name of the replica of each source bucket where there is one.

    Repeated rows of a replica count as one.
    """
    suffix = names.REPLICATION_SUFFIX
    replicas = (
        config.where((F.col("bucket_type") == "replication") & F.col("name").endswith(suffix))
        .select(
            F.col("snapshot_date").alias("replica_date"),
            F.regexp_replace("name", f"{suffix}$", "").alias("source"),
            F.col("name").alias("replica"),
        )
        .distinct()
    )
    same = (F.col("name") == F.col("source")) & F.col("snapshot_date").eqNullSafe(F.col("replica_date"))
    return config.join(replicas, same, "left").drop("source", "replica_date")


def checked(config: DataFrame) -> DataFrame:
    """One row per bucket and date with a struct ``checks`` of statuses by check.

    Each check is worked out once; one that does not apply to the type of the
    bucket is NULL. ``setup`` is an error for types that have no checks.
    """
    kind = F.col("bucket_type")
    found = {
        "transition-tag": F.col("tag_status"),
        "versioning": _read("versioning_error", F.col("versioning") == "Enabled"),
        "lifecycle": _lifecycle(),
        "replication": _replication(),
        "notifications": _read("notifications_error", F.col("event_bridge")),
        "logging": _logging(),
        "inventory": _inventory(),
        "public-access": _public_access(),
        "bucket-policy": _policy(),
    }
    lists = {"standard": STANDARD_STEPS, "public": PUBLIC_STEPS, "replication": REPLICATION_STEPS}
    statuses = [
        F.when(kind.isin([name for name, steps in lists.items() if step in steps]), status).alias(step)
        for step, status in found.items()
    ]
    setup = F.when(~F.coalesce(kind.isin(*lists), F.lit(False)), F.lit(ERROR)).alias("setup")
    return with_transition_class(with_replica(config)).select(
        "snapshot_date", "name", "bucket_type", F.struct(*statuses, setup).alias("checks")
    )


CHECKS = [*PUBLIC_STEPS, "setup"]


def steps(config: DataFrame) -> DataFrame:
    """One row per bucket, date and check: step and status. No shuffle is needed."""
    listed = F.array(
        *[F.struct(F.lit(name).alias("step"), F.col(f"checks.`{name}`").alias("status")) for name in CHECKS]
    )
    applied = F.filter(listed, lambda check: check["status"].isNotNull())
    return (
        checked(config)
        .select("snapshot_date", "name", "bucket_type", F.explode(applied).alias("result"))
        .select("snapshot_date", "name", "bucket_type", "result.step", "result.status")
    )


def report(step_rows: DataFrame) -> DataFrame:
    """Checks by bucket name, as the drift report lists them."""
    return step_rows.orderBy("snapshot_date", "name", "step")


def bucket_status(config: DataFrame) -> DataFrame:
    """Worst status of each bucket and date, within its own row."""
    any_is = lambda status: F.coalesce(
        F.array_contains(F.array_compact(F.array(*[F.col(f"checks.`{name}`") for name in CHECKS])), status), F.lit(False)
    )
    worst = F.when(any_is(ERROR), F.lit(ERROR)).when(any_is(DRIFT), F.lit(DRIFT)).otherwise(F.lit(OK))
    return checked(config).select("snapshot_date", "name", "bucket_type", worst.alias("status"))


def summary(status_rows: DataFrame, fail_on_drift: bool = False) -> DataFrame:
    """Buckets processed, ok, with drift and with errors, and the verdict, by date.

    Only drift can fail a run, and only when asked to; errors are reported.
    """
    drift = F.count_if(F.col("status") == DRIFT)
    return status_rows.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") == OK).alias("ok"),
        drift.alias("drift"),
        F.count_if(F.col("status") == ERROR).alias("errors"),
        ((drift == 0) | F.lit(not fail_on_drift)).alias("is_ok"),
    )
