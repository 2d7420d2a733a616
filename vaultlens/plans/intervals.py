"""States of objects as intervals of days, kept up day by day.

Daily snapshots repeat nearly all objects. The interval table holds each state once
for each stretch of days in which it was listed. A new day is merged with the states
that were open the day before, so a run shuffles two days, however long the history.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vaultlens import schemas
from vaultlens.operators.inventory import STATE_COLUMNS
from vaultlens.paths import read_document, replace_document
from vaultlens.plans.reports import written

#: Says up to which day the table is merged, and which day came before.
POINTER = "_intervals.json"

_FROM = StructField("valid_from", StringType())
_OPEN = StructType([*schemas.INVENTORY, _FROM])
_CLOSED = StructType([*schemas.INVENTORY, _FROM, StructField("closed_on", StringType())])


def merge_day(snapshot: DataFrame, base: str, day: dt.date) -> None:
    """Merge the snapshot of a day into the table at ``base``.

    A state that was open and is listed stays open, one that is not listed any more
    was valid up to this day, and a new one is valid from it. Nulls are values like
    others, and a state listed twice counts once. Running the last day again replaces
    it; an earlier day is refused. Readers see the new day when all of it is written.
    """
    spark = snapshot.sparkSession
    pointer = read_document(spark, base, POINTER) or {"as_of": None, "previous": None}
    date = day.isoformat()
    before = pointer["as_of"]
    if before is not None and date < before:
        raise ValueError(f"the table is merged up to {before}, so {date} comes too late")
    if date == before:
        before = pointer["previous"]
    states = (F.col(field.name).cast(field.dataType) for field in schemas.INVENTORY)
    today = snapshot.select(*states, F.lit(None).cast("string").alias("valid_from"), F.lit(True).alias("listed"))
    if before is not None:
        was = spark.read.schema(_OPEN).parquet(_open(base, before)).withColumn("listed", F.lit(False))
        today = was.unionByName(today)
    # states are the whole key, so rows of a state combine before the shuffle
    merged = today.groupBy(*STATE_COLUMNS).agg(F.min("valid_from").alias("valid_from"), F.max("listed").alias("listed"))
    merged = written(merged, "intervals")
    still = merged.where("listed").withColumn("valid_from", F.coalesce("valid_from", F.lit(date))).drop("listed")
    still.write.mode("overwrite").parquet(_open(base, date))
    ended = merged.where("NOT listed").drop("listed")
    ended.write.mode("overwrite").parquet(f"{base}/closed/closed_on={date}")
    replace_document(spark, base, POINTER, {"as_of": date, "previous": before})


def _open(base: str, date: str) -> str:
    return f"{base}/open/as_of={date}"


def read_intervals(spark: SparkSession, base: str) -> DataFrame:
    """All states with ``valid_from``, the first day, and ``valid_to``, the first day without.

    ``valid_to`` is null for states of the last day. A state that went and came back
    has an interval for each stretch.
    """
    pointer = read_document(spark, base, POINTER)
    if pointer is None:
        raise FileNotFoundError(f"no interval table at {base}")
    still = spark.read.schema(_OPEN).parquet(_open(base, pointer["as_of"]))
    ended = spark.read.schema(_CLOSED).parquet(f"{base}/closed").where(F.col("closed_on") <= pointer["as_of"])
    return still.withColumn("valid_to", F.lit(None).cast("string")).unionByName(
        ended.withColumnRenamed("closed_on", "valid_to")
    )


def states_on(intervals: DataFrame, day: dt.date) -> DataFrame:
    """The distinct states that the snapshot of a day listed."""
    date = F.lit(day.isoformat())
    open_then = (F.col("valid_from") <= date) & (F.col("valid_to").isNull() | (F.col("valid_to") > date))
    return intervals.where(open_then).select(*STATE_COLUMNS)


def distinct_states(intervals: DataFrame) -> DataFrame:
    """Every state once, as from all snapshots, without reading them again."""
    return intervals.select(*STATE_COLUMNS).distinct()
