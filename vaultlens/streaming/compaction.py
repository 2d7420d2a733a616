"""Compaction of the loaded access log.

The stream leaves a folder for each batch. Compaction packs finished batches into runs
whose files have disjoint ranges of keys within a day and Bloom filters on the key, so
that the history of one object opens few files. A small document says which batches
and runs count; it is replaced in one rename, so a compaction that breaks off, or is
run again, neither loses nor doubles a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DateType, StringType, StructField, StructType

from vaultlens import schemas
from vaultlens.paths import children, opened, qualified, read_document, replace_document

#: Names the batches that are packed and the runs that hold them.
DOCUMENT = "_compacted.json"
#: Bytes of a compacted file, and the runs from which on all are merged into one.
FILE_BYTES, MAX_RUNS = 256 << 20, 8
#: Rows of a compacted file, which one task sorts: log rows take many times their bytes in memory.
FILE_ROWS = 500_000
#: Keys that the Bloom filter of a file is made for.
FILTER_KEYS = 1_000_000

_ORDER = ["is_record", "event_date", "bucket", "key", "event_time", "request_id"]
_EXTRA = [("line", StringType()), ("is_record", BooleanType()), ("event_date", DateType())]
SCHEMA = StructType([*schemas.ACCESS_LOG, *(StructField(name, kind) for name, kind in _EXTRA)])


def _state(spark: SparkSession, out: str) -> dict:
    return read_document(spark, out, DOCUMENT) or {"batches": [], "runs": [], "generation": 0}


def _finished(spark: SparkSession, out: str) -> list[str]:
    """Batches whose folder is complete."""
    names = [f.base_name for f in children(spark, f"{out}/log") if f.base_name.startswith("batch=")]
    return [n for n in names if any(f.base_name == "_SUCCESS" for f in children(spark, f"{out}/log/{n}"))]


def _read(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    rows = spark.read.schema(SCHEMA).option("basePath", base).parquet(*(f"{base}/{name}" for name in folders))
    return rows.select(*SCHEMA.names)


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """All loaded rows, from runs and from the batches that no run holds yet."""
    state = _state(spark, out)
    packed = set(state["batches"])
    fresh = [name for name in _finished(spark, out) if name not in packed]
    parts = [_read(spark, f"{out}/{folder}", names) for folder, names in (("log", fresh), ("runs", state["runs"])) if names]
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _bytes(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength()


def compact(spark: SparkSession, out: str, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS) -> bool:
    """Pack the finished batches below ``out`` into a run; False where there is nothing new.

    From ``MAX_RUNS`` runs on all runs are merged with the new batches. Rows are
    range-partitioned by day, bucket, key and time, so the rows of one busy key spread
    over as many files as they fill: a file has about ``file_bytes`` and ``file_rows``
    at most. The rows are counted in the footers of the files.
    """
    state = _state(spark, out)
    new = [name for name in _finished(spark, out) if name not in set(state["batches"])]
    if not new:
        return False
    merged = state["runs"] if len(state["runs"]) >= MAX_RUNS else []
    rows, total = _read(spark, f"{out}/log", new), sum(_bytes(spark, f"{out}/log/{name}") for name in new)
    if merged:
        rows = rows.unionByName(_read(spark, f"{out}/runs", merged))
        total += sum(_bytes(spark, f"{out}/runs/{name}") for name in merged)
    run = f"run={state['generation']}"
    files = max(1, -(-total // file_bytes), -(-rows.count() // file_rows))
    parts = rows.repartitionByRange(files, *_ORDER).sortWithinPartitions(*_ORDER)
    (
        parts.write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", str(FILTER_KEYS))
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy("is_record", "event_date")
        .parquet(f"{out}/runs/{run}")
    )
    kept = [name for name in state["runs"] if name not in merged]
    document = {"batches": [*state["batches"], *new], "runs": [*kept, run], "generation": state["generation"] + 1}
    replace_document(spark, out, DOCUMENT, document)
    return True


def remove_packed(spark: SparkSession, out: str) -> None:
    """Delete batches that runs hold and runs that do not count; their readers are done."""
    state = _state(spark, out)
    files, root = opened(qualified(spark, out))
    for folder, wanted in (("log", lambda name: name not in state["batches"]), ("runs", lambda name: name in state["runs"])):
        for info in children(spark, f"{out}/{folder}"):
            if not info.is_file and "=" in info.base_name and not wanted(info.base_name):
                files.delete_dir(f"{root}/{folder}/{info.base_name}")
