"""SQL views for ad-hoc questions about requests and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vaultlens.operators import access_log, inventory


def register_views(log_lines: DataFrame | None = None, snapshots: DataFrame | None = None) -> None:
    """Make ``audit`` and ``inventory`` known to ``spark.sql``.

    ``audit`` holds typed log records, ``inventory`` each distinct state of an
    object over all snapshots. Both stay lazy: only what a query needs is read.
    """
    if log_lines is not None:
        access_log.parsed(log_lines).createOrReplaceTempView("audit")
    if snapshots is not None:
        inventory.distinct_states(snapshots).createOrReplaceTempView("inventory")
