"""Text and number formatting used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI byte units, one per power of 1000.
BYTE_UNITS = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dash_to_null(value: Column | str) -> Column:
    """The log writes ``-`` for an absent value."""
    return F.nullif(as_column(value), F.lit("-"))


def size_or_zero(size: Column | str) -> Column:
    return F.coalesce(as_column(size), F.lit(0).cast("bigint"))


def timestamp_text(ts: Column | str) -> Column:
    """``2025-01-01 00:00:00+00``; needs a session in UTC."""
    return F.concat(as_column(ts).cast("string"), F.lit("+00"))


def decimal_text(value: Column, pattern: str) -> Column:
    """Digits by pattern, rounded half to even on the exact value."""
    return F.call_function("format_number", value, F.lit(pattern))


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    """Ratio times 100, and 0.0 when there is nothing to divide by."""
    num = as_column(numerator).cast("double")
    den = as_column(denominator).cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den * F.lit(100.0))


def percent_text(value: Column | str) -> Column:
    """One decimal and a percent sign."""
    return F.concat(decimal_text(as_column(value), "0.0"), F.lit("%"))


def bytes_text(value: Column | str) -> Column:
    """SI size text: no decimals when the quotient is whole, else two."""
    amount = as_column(value)
    text = None
    for power, unit in reversed(list(enumerate(BYTE_UNITS))):
        divisor = 1000**power
        scaled = amount.cast("double") / F.lit(float(divisor))
        whole = scaled == F.floor(scaled)
        label = F.concat(
            F.when(whole, decimal_text(scaled, "0")).otherwise(
                decimal_text(scaled, "0.00")
            ),
            F.lit(f" {unit}"),
        )
        if text is None:
            text = F.when(amount >= F.lit(divisor), label)
        elif power:
            text = text.when(amount >= F.lit(divisor), label)
        else:
            text = text.when(amount.isNotNull(), label)
    return text


def base64_to_hex(value: Column | str) -> Column:
    """Checksums are recorded as base64; reports also show them as hex."""
    return F.hex(F.unbase64(as_column(value)))


def split_locations(value: Column | str) -> Column:
    """``a;b;;c`` to ``[a, b, c]``."""
    return F.filter(F.split(as_column(value), ";"), lambda part: part != "")


def join_locations(value: Column | str) -> Column:
    return F.concat_ws(";", as_column(value))
