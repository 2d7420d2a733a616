"""Time parsing that yields NULL, never a failure, on bad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultlens.functions.text import as_column

# Fixed value: time layout of an access-log line.
LOG_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

RFC3339_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def log_time(value: Column | str) -> Column:
    return F.try_to_timestamp(as_column(value), F.lit(LOG_TIME_FORMAT))


def rfc3339(value: Column | str) -> Column:
    """A timestamp only when the text has a full date, time and offset."""
    text = F.upper(as_column(value))
    return F.when(text.rlike(RFC3339_SHAPE), text.try_cast("timestamp"))


def expiry_cutoff(as_of: Column, years: int) -> Column:
    """``as_of`` minus ``years`` times 12 calendar months, to the instant."""
    return F.timestamp_add("MONTH", F.lit(-12 * years), as_of)
