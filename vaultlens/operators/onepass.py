"""The verification report with one shuffle of the rows.

Both sides are stacked and grouped by (key, version_id), so a group holds the rows
of an object version with all its partners and gives pairs, rows without a partner
and failed rows at once; nothing is read once for each category. Rows and meaning
are those of :func:`vaultlens.operators.verification.compare`.

A version with more rows than fit a group is laid out as a grid: its source rows
are dealt to lines, its replica rows to columns, and each cell meets one line with
one column. How many there are follows from the counts of the version, which are
combined before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.operators.verification import FAILED, REPORT_COLUMNS, SUCCEEDED
from vaultlens.session import scratch_dir

#: Rows of either side in a cell, about.
CELL_ROWS = 1000

_VERSION = ["key", "version_id"]


def compare(source: DataFrame, replication: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every report row, in no order; inputs as from ``verification.with_checksums``.

    A row without key or version is a group of its own. A version that is not
    listed on one side has a single line or column there. The large versions are
    written first, so Spark knows their size when it plans the join with them.
    """
    stack = _side(source, 0).unionByName(_side(replication, 1))
    folder = scratch_dir(source.sparkSession, "large-versions")
    large_versions(stack, cell_rows).write.parquet(folder)
    cells = _dealt(stack, source.sparkSession.read.parquet(folder))
    return _rows(
        cells.repartition(*_VERSION, "line", "column")
        .groupBy(*_VERSION, "line", "column").agg(
            _collected(0, F.col("column") == 0).alias("left"),
            _collected(1, F.col("line") == 0).alias("right"),
            F.coalesce(F.max("s_rows"), F.count_if(F.col("side") == 0)).alias("s_rows"),
            F.coalesce(F.max("r_rows"), F.count_if(F.col("side") == 1)).alias("r_rows"),
        )
    )


def _side(rows: DataFrame, number: int) -> DataFrame:
    return rows.select(
        F.lit(number).alias("side"), "bucket", *_VERSION, "task_status", "checksum", "checksum_algorithm"
    )


def large_versions(stack: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, version_id, s_rows, r_rows) of the versions that need more than one cell."""
    return (
        stack.where(F.col("key").isNotNull() & F.col("version_id").isNotNull())
        .groupBy(*_VERSION)
        .agg(F.count_if(F.col("side") == 0).alias("s_rows"), F.count_if(F.col("side") == 1).alias("r_rows"))
        .where(F.greatest("s_rows", "r_rows") > cell_rows)
        .withColumns({name: F.ceil(F.col(rows) / cell_rows) for name, rows in (("lines", "s_rows"), ("columns", "r_rows"))})
    )


def _dealt(stack: DataFrame, large: DataFrame) -> DataFrame:
    """Rows with the cells where they are needed.

    Only a row that can be in a pair goes to every cell of its line or column; the
    others go to the first. Versions of one cell are not in ``large``, so Spark mostly
    finds it small and leaves the stack where it is; else the join costs an exchange,
    in which Spark splits the rows of a hot version.
    """
    usable = (F.col("task_status") == SUCCEEDED) & F.col("checksum").isNotNull()
    lines, columns = (F.greatest(F.coalesce(name, F.lit(1)), F.lit(1)) for name in ("lines", "columns"))
    alone = F.col("key").isNull() | F.col("version_id").isNull()
    own, across = F.when(F.col("side") == 0, lines).otherwise(columns), F.when(F.col("side") == 0, columns).otherwise(lines)
    return (
        stack.withColumn("place", F.monotonically_increasing_id())
        .join(large, _VERSION, "left")
        .withColumn("own", F.when(alone, F.col("place")).otherwise(F.pmod("place", own)))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(usable, across - 1).otherwise(F.lit(0)).cast("bigint"))))
        .withColumns(
            {
                "line": F.when(alone | (F.col("side") == 0), F.col("own")).otherwise(F.col("other")),
                "column": F.when(~alone & (F.col("side") == 1), F.col("own")).otherwise(F.col("other")),
            }
        )
    )


def _collected(side: int, first: Column) -> Column:
    """Rows of a side in the cell; ``first`` tells the one cell that lists a row by itself."""
    row = F.struct("bucket", "task_status", "checksum", "checksum_algorithm", first.alias("first"))
    return F.collect_list(F.when(F.col("side") == side, row))


def _rows(grouped: DataFrame) -> DataFrame:
    """Report rows of the cells; an entry is exploded before it meets its partners."""
    alone = F.col("key").isNull() | F.col("version_id").isNull()

    def single(row: Column, side: int) -> Column:
        missing = alone | (F.col("r_rows" if side == 0 else "s_rows") == 0)
        names = [("failed_source", "missing_replica"), ("failed_replication", "missing_source")][side]
        return F.when(row["task_status"] == FAILED, F.lit(names[0])).when(
            (row["task_status"] == SUCCEEDED) & missing, F.lit(names[1])
        )

    def entries(side: int) -> Column:
        name = ["left", "right"][side]
        told = F.transform(name, lambda row: row.withField("status", F.when(row["first"] | alone, single(row, side))))
        # A replica row is listed by itself or as the partner of a source row.
        return told if side == 0 else F.filter(told, lambda row: row["status"].isNotNull())

    def usable(row: Column) -> Column:
        return (row["task_status"] == SUCCEEDED) & row["checksum"].isNotNull()

    entry = F.col("entry")
    partners = F.filter("right", usable)["checksum"]
    met = (
        grouped.withColumn("partners", partners)
        .select(*_VERSION, "partners", F.explode(F.concat(entries(0), entries(1))).alias("entry"))
        .select(
            *_VERSION,
            "entry",
            F.explode(
                F.when(entry["status"].isNotNull(), F.array(F.lit(None).cast("string")))
                .when(usable(entry), F.col("partners"))
            ).alias("checksum_replication"),
        )
    )
    pair = entry["status"].isNull()
    return met.select(
        entry["bucket"].alias("bucket"),
        *_VERSION,
        F.coalesce(
            entry["status"], F.when(entry["checksum"] == F.col("checksum_replication"), F.lit("ok")).otherwise(F.lit("mismatch"))
        ).alias("status"),
        F.when(pair, entry["checksum_algorithm"]).alias("checksum_algorithm"),
        F.when(pair, entry["checksum"]).alias("checksum_source"),
        "checksum_replication",
    ).select(*REPORT_COLUMNS)
