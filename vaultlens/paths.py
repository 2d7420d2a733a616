"""Folders as tasks see them: local, HDFS and object stores alike."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark resolves it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = files.makeQualified(path).toUri().toString().rstrip("/")
    # one slash after the scheme is what Spark writes, three are what others read
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified URI."""
    return pafs.FileSystem.from_uri(uri)


def replace_document(spark: SparkSession, folder: str, name: str, document: dict) -> None:
    """Put a small JSON file in place in one rename: readers see the old or the new one."""
    files, root = opened(qualified(spark, folder))
    files.create_dir(root, recursive=True)
    temporary = f"{root}/.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(json.dumps(document).encode())
    files.move(temporary, f"{root}/{name}")


def read_document(spark: SparkSession, folder: str, name: str) -> dict | None:
    """The JSON file of this name, None where there is none."""
    files, root = opened(qualified(spark, folder))
    if files.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
        return None
    with files.open_input_stream(f"{root}/{name}") as stream:
        return json.loads(stream.read())


def children(spark: SparkSession, folder: str) -> list[pafs.FileInfo]:
    """What lies directly in a folder, by name; nothing where there is no folder."""
    files, root = opened(qualified(spark, folder))
    found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(found, key=lambda info: info.base_name)
