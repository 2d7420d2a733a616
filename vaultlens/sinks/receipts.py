"""Receipts of checksum job pairs, stored under every name they are looked up by."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vaultlens.operators.jobs import receipt_keys


def write_receipts(receipts: DataFrame, base: str, today: str) -> str:
    """Append lookup rows, partitioned by their date.

    A later receipt under the same name wins on reading, see
    :func:`vaultlens.sources.jobs.read_receipt_lookup`.
    """
    receipt_keys(receipts, today).write.mode("append").partitionBy("report_date").json(base)
    return base
