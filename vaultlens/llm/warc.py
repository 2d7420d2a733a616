"""WARC files of pages: a deterministic sharded writer, and a reader.

Pages are cut into shards by ranges of their id. A shard's records are written
in the order of id and payload digest; its files roll over at a compressed
size. Which record is in which file depends on the pages alone, not on how Spark
dealt them out. Tasks write under temporary names and return what they wrote;
that manifest is committed by Spark, and only files in it get their own names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultlens.llm.tasks import in_batches, prepare
from vaultlens.session import scratch_dir

#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 100
#: A file ends before the record that would make it larger than this.
ROLL_BYTES = 64 << 20
#: Payload bytes a shard should hold; more for larger tables.
SHARD_BYTES = 32 << 20
#: Ids looked at for the bounds of the shards, about so many at most.
BOUND_IDS = 20_000
#: Date of all records, so that reruns give the same files.
DATE = "2000-01-01T00:00:00Z"

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "shard long, part long, temporary string, file string, records long, bytes long, sha256 string"
_READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """Ids at which shards begin: even parts of ids chosen by hash, not by chance."""
    size = pages.agg(
        F.sum(F.octet_length(F.coalesce("html", F.lit("")))).alias("bytes"), F.count("page_id").alias("rows")
    ).first()
    shards = -(-(size["bytes"] or 0) // shard_bytes)
    if shards < 2 or not size["rows"]:
        return []
    every = max(1, size["rows"] // BOUND_IDS)
    ids = sorted(
        row[0]
        for row in pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)
        .filter(F.col("page_id").isNotNull())
        .select("page_id")
        .collect()
    )
    return sorted({ids[len(ids) * n // shards] for n in range(1, shards)}) if ids else []


def _shard(bounds: list[int]):
    def below(low: int, high: int):
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        return F.when(F.col("page_id") < bounds[middle], below(low, middle)).otherwise(below(middle + 1, high))

    return F.when(F.col("page_id").isNull(), F.lit(0).cast("long")).otherwise(below(0, len(bounds)))


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first_id) of pages whose payload other rows share.

    ``first_id`` is the smallest id with the payload. Only ids and digests are
    shuffled, counted within each task first.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.filter(F.octet_length(html) >= REVISIT_BYTES).select("page_id", F.sha2(html, 256).alias("digest"))
    shared = (
        digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    )
    return digests.join(shared.drop("n"), "digest").select("page_id", "digest", "first_id").distinct()


def _record(kind: str, page_id, url, payload: bytes, digest: str, order: int, first_id) -> bytes:
    """One record: regenerated headers, block and digests."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    name = lambda own, nth: uuid.uuid5(_SPACE, f"{own}/{digest}/{nth}")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name(page_id, order)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]|")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-Id", page_id),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{name(first_id, 0)}>"),
            ("X-Refers-To-Page-Id", first_id),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{key}: {value}\r\n" for key, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


class _Files:
    """The files of one task: opened under temporary names, rolled by size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.files, self.folder = pafs.FileSystem.from_uri(folder)
        self.roll_bytes, self.stream, self.shard, self.part = roll_bytes, None, None, 0

    def add(self, shard: int, record: bytes) -> Iterator[tuple]:
        packed = _member(record)
        if self.stream is not None and (
            shard != self.shard or self.records and self.size + len(packed) > self.roll_bytes
        ):
            yield self.close()
        if self.stream is None:
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard, self.records, self.size, self.sum = shard, 0, 0, hashlib.sha256()
            self.temporary = f"_temporary/{uuid.uuid4().hex}.warc.gz"
            self.stream = self.files.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.stream.write(packed)
        self.sum.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> tuple:
        self.stream.close()
        self.stream = None
        file = f"shard-{self.shard:06d}-{self.part:06d}.warc.gz"
        return self.shard, self.part, self.temporary, file, self.records, self.size, self.sum.hexdigest()


def _writer(folder: str, roll_bytes: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written() -> Iterator[tuple]:
            files = _Files(folder, roll_bytes)
            key, first, order = None, None, 0
            for shard, page_id, digest, kind, url, payload, first_id in _rows(batches):
                if (page_id, digest) != key:
                    key, first, order = (page_id, digest), None, 0
                if kind == 0:  # comes before the pages it speaks of
                    first = (first_id,)
                    continue
                again = first is not None and (page_id != first[0] or order > 0)
                record = _record(
                    "revisit" if again else "response", page_id, url, payload, digest, order, again and first[0]
                )
                order += 1
                yield from files.add(shard, record)
            if files.stream is not None:
                yield files.close()

        return in_batches(written(), schema, 100)

    return run


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, file in zip(*(batch.column(n).to_pylist() for n in ("temporary", "file")), strict=True):
                if files.get_file_info(f"{root}/{temporary}").type == pafs.FileType.File:
                    files.move(f"{root}/{temporary}", f"{root}/{file}")
                elif files.get_file_info(f"{root}/{file}").type != pafs.FileType.File:
                    raise FileNotFoundError(f"{root}/{file}")
            yield batch

    return run


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark understands it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = files.makeQualified(path).toUri().toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and full[5:7] != "//" else full


def write(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Write the pages below ``folder`` and return the manifest.

    One response for each payload of :data:`REVISIT_BYTES` or more, from the
    smallest page id; further rows with it, repeated rows too, revisit it.
    Smaller payloads are always responses. Null html is an empty payload, a null
    url or id leaves its header out; null ids go first. An empty table writes no
    files. The payload is shuffled once; a page is in memory whole, a shard is not.
    A folder whose store pyarrow's file systems cannot open is an error.
    """
    spark = prepare(pages.sparkSession)
    folder = _uri(spark, folder)
    bounds = shard_bounds(pages, shard_bytes)
    html = F.coalesce(F.col("html"), F.lit(""))
    shard = _shard(bounds).alias("shard")
    rows = pages.select(
        shard, "page_id", F.sha2(html, 256).alias("digest"), F.lit(1).alias("kind"), "url",
        html.cast("binary").alias("payload"), F.lit(None).cast("long").alias("first_id"),
    )
    known = repeated_payloads(pages).select(
        shard, "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "first_id",
    )
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(f"{root}/_temporary")
    schema = T._parse_datatype_string(_MANIFEST)
    written = (
        rows.unionByName(known)
        .repartition(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
        .mapInArrow(_writer(folder, roll_bytes, _arrow(schema)), schema)
    )
    written.write.parquet(f"{folder}/_written")
    done = spark.read.parquet(f"{folder}/_written")
    done.mapInArrow(_commit(folder), schema).write.parquet(f"{folder}/_manifest")
    files.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _records(stream) -> Iterator[bytes]:
    """The members of a gzip stream, one at a time."""
    unpacker, held = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            held.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(held)
                unpacker, held = zlib.decompressobj(31), []


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _parsed(record: bytes, keep: bool) -> tuple:
    head, block = record.split(b"\r\n\r\n", 1)
    own = _fields(head)
    block = block[: int(own["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    digest, kind = own["WARC-Payload-Digest"].removeprefix("sha256:"), own["WARC-Type"]
    if own["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block of {own['WARC-Record-ID']} differs from its digest")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {own['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(own[name]) if name in own else None
    return (
        number("X-Page-Id"), own.get("WARC-Target-URI"), int(_fields(http)["Content-Length"]), digest, kind,
        number("X-Refers-To-Page-Id"), payload if keep and kind == "response" else None,
    )


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the files in the manifest, digests checked; payloads on demand.

    One task reads a file at a time and holds one record of it.
    """
    prepare(spark)
    folder = _uri(spark, folder)
    manifest = spark.read.parquet(f"{folder}/_manifest")
    schema = T._parse_datatype_string(_READ)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)

        def parsed() -> Iterator[tuple]:
            for batch in batches:
                for file in batch.column("file").to_pylist():
                    with files.open_input_stream(f"{root}/{file}", compression=None) as stream:
                        for record in _records(stream):
                            yield _parsed(record, payloads)

        return in_batches(parsed(), arrow, 100 if payloads else 2000)

    count = max(1, manifest.count())
    return manifest.select("file").repartition(count, "file").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    write(pages, folder)
    return read(spark, folder).drop("payload", "url")
