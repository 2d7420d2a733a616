"""Positions of rows in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultlens.session import scratch_dir


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows with their place from 0 in the order of the columns.

    The rows are sorted in ranges and written once; each range counts on from
    the sizes of those before it, of which one row a range meets in a task.
    """
    folder = scratch_dir(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()).write.parquet(folder)
    stored = rows.sparkSession.read.parquet(folder)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("range")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("range").orderBy(*order)
    place = F.col("start") + F.row_number().over(within) - 1
    return stored.join(starts, "range").withColumn(name, place).drop("range", "start")
