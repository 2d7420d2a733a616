"""Session settings every operator relies on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime SQL settings. Time text must not depend on where an executor runs;
#: AQE sizes the shuffles, picks broadcasts from measured sizes and splits
#: skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: What one task reads, at most: a session that reads less at once keeps that. Keys, versions
#: and statuses repeat, so rows in a sort or hash map take ten to twenty times their bytes in files.
TASK_BYTES = 16 << 20
TASK_SETTINGS = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]

#: Shuffled bytes one partition should hold before AQE joins small ones.
PARTITION_BYTES = 256 << 20


def configure(spark: SparkSession, data_bytes: int | None = None) -> SparkSession:
    """Apply :data:`SETTINGS` and :data:`TASK_BYTES` to a running session and return it.

    With ``data_bytes``, the size of the largest input, shuffles get enough
    partitions for it; a session that already has more keeps them.
    """
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    for name in TASK_SETTINGS:
        if _bytes(spark, name) > TASK_BYTES:
            spark.conf.set(name, str(TASK_BYTES))
    if data_bytes:
        needed = -(-data_bytes // PARTITION_BYTES)
        if int(spark.conf.get("spark.sql.shuffle.partitions")) < needed:
            spark.conf.set("spark.sql.shuffle.partitions", str(needed))
    return spark


def _bytes(spark: SparkSession, name: str) -> int:
    """A size setting in bytes, as ``16m`` or ``16777216b``."""
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, below ``spark.checkpoint.dir``.

    The cluster names the shared folder. Where it names none, the folder is
    below the warehouse, which executors and driver share as well. The folders
    stay until :func:`release_scratch`.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._vaultlens_scratch = [*getattr(context, "_vaultlens_scratch", []), folder]
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written.

    Else they stay until the driver happens to collect its garbage, and the shuffles of
    all steps of a job are on disk together.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_scratch(spark: SparkSession) -> None:
    """Remove the folders :func:`scratch_dir` gave out; their readers are done."""
    context = spark.sparkContext
    for folder in getattr(context, "_vaultlens_scratch", []):
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._vaultlens_scratch = []


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers on every executor.

    Needed wherever functions of this package run in tasks: digests, listed and named
    files, job pairs, copies of reports. Nothing is lost where the package was handed to
    ``spark-submit --py-files`` as well. Repeated calls ship nothing new.
    """
    context = spark.sparkContext
    if not getattr(context, "_vaultlens_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="vaultlens-py-")) / "vaultlens.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for source in sorted(root.rglob("*.py")):
                bundle.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._vaultlens_shipped = True
    return spark
