"""Rules on bucket names, stack names, object keys and storage classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultlens.functions.text import as_column

# Naming rules.
PUBLIC_SUFFIX = "-public"
REPLICATION_SUFFIX = "-repl"
MANAGED_SUFFIX = "-managed"
REQUEST_SUFFIX = "-request"
MAX_NAME_BYTES = 63
MAX_NAMES_PER_REQUEST = 5

# Bucket types and tag keys.
BUCKET_TYPES = ["internal", "public", "replication", "standard"]
TAG_STACK = "Stack"
TAG_TYPE = "BucketType"
TAG_ORIGIN = "BucketOrigin"
TAG_TRANSITION_CLASS = "TransitionStorageClass"
ORIGIN_REQUEST = "bucket-request"

# Storage classes an object may move to, and defaults by type.
TRANSITION_CLASSES = [
    "DEEP_ARCHIVE",
    "GLACIER",
    "GLACIER_IR",
    "INTELLIGENT_TIERING",
    "ONEZONE_IA",
    "STANDARD_IA",
]
DEFAULT_CLASS = "INTELLIGENT_TIERING"
DEFAULT_REPLICATION_CLASS = "DEEP_ARCHIVE"


def first_path_segment(key: Column | str) -> Column:
    """Text before the first slash, empty for a key without one."""
    key = as_column(key)
    return F.when(
        F.contains(key, F.lit("/")), F.substring_index(key, "/", 1)
    ).otherwise(F.lit(""))


def is_folder_marker(key: Column | str) -> Column:
    return as_column(key).endswith("/")


def stack_of(name: Column | str) -> Column:
    """Stack of a bucket or group name: its first two hyphen-separated parts.

    NULL unless a third part follows and both parts are two or more ASCII
    letters or digits that begin with a letter.
    """
    stack = F.regexp_extract(
        F.lower(as_column(name)), r"^([a-z][a-z0-9]+-[a-z][a-z0-9]+)-", 1
    )
    return F.nullif(stack, F.lit(""))


def file_stem(key: Column | str) -> Column:
    """Last path part without its extension, NULL when it has none."""
    last = F.substring_index(as_column(key), "/", -1)
    return F.when(
        F.contains(last, F.lit(".")), F.regexp_replace(last, r"\.[^.]*$", "")
    )


def transition_class(value: Column | str) -> Column:
    """The class itself when it is one an object can move to, else NULL."""
    value = as_column(value)
    return F.when(value.isin(TRANSITION_CLASSES), value)


def default_transition_class(bucket_type: Column | str) -> Column:
    return F.when(
        as_column(bucket_type) == "replication", F.lit(DEFAULT_REPLICATION_CLASS)
    ).otherwise(F.lit(DEFAULT_CLASS))


def replica_name(name: Column | str) -> Column:
    return F.concat(as_column(name), F.lit(REPLICATION_SUFFIX))


def name_problem(name: Column | str) -> Column:
    """Why a (lower-cased) bucket name is refused, NULL when it is fine."""
    text = F.lower(as_column(name))
    return (
        F.when(text == "", F.lit("empty"))
        .when(text.rlike(r"^[.-]|[.-]\z"), F.lit("affix"))
        .when(F.octet_length(text) > MAX_NAME_BYTES, F.lit("too_long"))
        .when(~text.rlike(r"^[\p{IsAlphabetic}\p{N}-]+\z"), F.lit("invalid_character"))
    )


def request_problem(stack: Column | str, name: Column | str) -> Column:
    """Why a requested name is refused for a stack, NULL when it is accepted.

    The byte limit is tried on the requested name and again on the full
    primary and replica names built from it.
    """
    stack = as_column(stack)
    text = F.lower(as_column(name))
    primary = F.concat(stack, F.lit("-"), text)
    reserved = (
        F.startswith(text, stack)
        | text.endswith(MANAGED_SUFFIX)
        | text.endswith(REPLICATION_SUFFIX)
        | text.endswith(REQUEST_SUFFIX)
    )
    return F.coalesce(
        name_problem(text),
        F.when(reserved, F.lit("reserved")),
        name_problem(primary),
        name_problem(replica_name(primary)),
    )


def requested_type(name: Column | str) -> Column:
    return F.when(
        F.lower(as_column(name)).endswith(PUBLIC_SUFFIX), F.lit("public")
    ).otherwise(F.lit("standard"))


def bucket_rights(name: Column | str) -> Column:
    """Rights a user gets on a bucket folder."""
    return F.when(
        as_column(name).endswith(MANAGED_SUFFIX),
        F.array(F.lit("list"), F.lit("download")),
    ).otherwise(F.array(F.lit("*")))
