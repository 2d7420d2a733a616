"""Helpers for operators whose inner loop runs in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch: whole texts, so few enough for a worker's memory.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Another number of rows in the Arrow batches of the actions inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def binaries(column: pa.Array) -> list[bytes]:
    """Values of a string or binary column as bytes, empty for null."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [value or b"" for value in column.to_pylist()]


def in_batches(rows: Iterator[Sequence], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[Sequence] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
