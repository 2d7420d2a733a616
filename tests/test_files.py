"""Sources, sinks, whole reports and streams on files of their own."""

from __future__ import annotations

import datetime as dt
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vaultlens import schemas
from vaultlens.functions.names import file_stem
from vaultlens.operators import inventory, jobs, storage, verification
from vaultlens.plans import reports as plans
from vaultlens.sinks import receipts as receipt_sink
from vaultlens.sinks import reports
from vaultlens.sources import inventory as inventory_source
from vaultlens.sources import jobs as job_source
from vaultlens.sources import tables
from vaultlens.streaming import streams

DAY = "2024-01-31"


def result_line(bucket, key, version, status, checksum):
    message = json.dumps({"checksum_base64": checksum, "checksumAlgorithm": "SHA256"})
    return f'{bucket},{key},{version},{status},200,,"{message.replace(chr(34), chr(34) * 2)}"'


def write(path: Path, text: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def batch_manifest(root: Path, name: str, files: dict[str, list[str]]) -> str:
    entries = []
    for status, keys in files.items():
        entries += [
            {"TaskExecutionStatus": status, "Bucket": "m", "MD5Checksum": "x", "Key": key}
            for key in keys
        ]
    document = {"Format": "Report_CSV_20180820", "Results": entries, "ReportSchema": "Bucket, Key"}
    return write(root / f"{name}.json", json.dumps(document, indent=1))


def inventory_files(spark, root: Path, rows, file_format="Parquet") -> str:
    spark.createDataFrame(rows, schemas.INVENTORY).coalesce(1).write.parquet(str(root / "data"))
    manifest = {
        "sourceBucket": "acme-main-a",
        "fileFormat": file_format,
        "creationTimestamp": "1766538000000",
        "files": [
            {"key": f"data/{p.name}", "size": 1, "MD5checksum": "x"}
            for p in (root / "data").glob("*.parquet")
        ],
    }
    return write(root / "manifest.json", json.dumps(manifest, indent=1))


def header_lines(path: str) -> list[list[str]]:
    return [p.read_text().splitlines() for p in sorted(Path(path).glob("part-*"))]


OBJECTS = [
    ("acme-main-a", "images/a", 100, dt.datetime(2025, 1, 1), "STANDARD", "COMPLETED"),
    ("acme-main-a", "images/b", None, dt.datetime(2025, 1, 1), "STANDARD", None),
    ("acme-main-a", "images/", 0, dt.datetime(2025, 1, 1), "STANDARD", None),
    ("acme-main-a", 'ro"ot, x', 50, None, "STANDARD", None),
]


def test_inventory_manifest(spark, tmp_path, rows):
    path = inventory_files(spark, tmp_path, OBJECTS)
    manifests = inventory_source.read_manifests(spark, path)
    paths = inventory_source.file_paths(manifests, str(tmp_path))
    frame = inventory_source.read_files(spark, paths)
    assert frame.count() == 4
    assert inventory_source.data_files(manifests).first().bucket == "acme-main-a"
    assert inventory_source.read_files(spark, []).columns == frame.columns


def test_other_inventory_format_is_refused(spark, tmp_path):
    path = inventory_files(spark, tmp_path, OBJECTS, "CSV")
    manifests = inventory_source.read_manifests(spark, path)
    with pytest.raises(Exception, match="expected inventory format Parquet, got CSV"):
        inventory_source.file_paths(manifests, str(tmp_path))


def test_snapshot_tree(spark, tmp_path):
    frame = spark.createDataFrame(OBJECTS, schemas.INVENTORY).coalesce(1)
    for folder in ("acme-main-a/inventory/data", "acme-main-b/inventory/data", "other/hive"):
        frame.write.parquet(str(tmp_path / folder))
    found = inventory_source.read_snapshots(spark, str(tmp_path))
    assert found.count() == 8
    assert inventory.distinct_states(found).count() == 4


def test_result_files(spark, tmp_path, rows):
    write(tmp_path / "r/1.csv", result_line("b", "a-1", "v", "succeeded", "AA=="))
    manifest = batch_manifest(tmp_path, "m", {"Succeeded": ["r/1.csv"], "failed": ["r/2.csv"]})
    paths = job_source.result_paths(job_source.read_manifests(spark, manifest), str(tmp_path))
    assert paths == [f"{tmp_path}/r/1.csv"]
    assert job_source.read_results(spark, paths).count() == 1
    assert job_source.read_results(spark, []).count() == 0


def test_messages_with_quotes(spark, tmp_path):
    path = write(tmp_path / "r.csv", result_line("b", "k", "v", "succeeded", "AA=="))
    found = verification.with_checksums(job_source.read_results(spark, [path])).first()
    assert (found.version_id, found.checksum, found.checksum_algorithm) == ("v", "AA==", "SHA256")


def test_receipts_and_events(spark, tmp_path):
    receipt = {"source_bucket": "sb", "source_job_id": "sj", "repl_bucket": "rb", "repl_job_id": "rj", "created_at": "2024-01-31"}
    write(tmp_path / "receipts/1.json", json.dumps(receipt))
    frame = job_source.read_receipts(spark, str(tmp_path / "receipts"))
    receipt_sink.write_receipts(frame, str(tmp_path / "lookup"), DAY)
    later = frame.withColumns({"source_job_id": F.lit("sj2"), "created_at": F.lit("2024-02-01")})
    receipt_sink.write_receipts(later, str(tmp_path / "lookup"), "2024-02-01")
    found = job_source.read_receipt_lookup(spark, str(tmp_path / "lookup"))
    by_name = {(r.identifier, r.report_date): r.source_job_id for r in found.collect()}
    assert by_name == {
        ("sj", jobs.LATEST): "sj",
        ("sj2", jobs.LATEST): "sj2",
        ("rj", jobs.LATEST): "sj2",
        ("sb", jobs.LATEST): "sj2",
        ("sb", DAY): "sj",
        ("sb", "2024-02-01"): "sj2",
    }

    write(tmp_path / "events/1.json", event("sj", "Failed", ["InvalidManifestContent"], 1))
    row = jobs.events_to_status(job_source.read_events(spark, str(tmp_path / "events"))).first()
    assert (row.job_id, row.status, row.failure_codes) == ("sj", "Failed", ["InvalidManifestContent"])


def test_request_files(spark, tmp_path, rows):
    write(tmp_path / "q/buckets-1.txt", "rare-books\nmanuscripts\r\n\nnewspapers")
    write(tmp_path / "q/buckets-2.txt", "one\n")
    write(tmp_path / "q/buckets-3.txt", "")
    found = tables.read_requests(spark, str(tmp_path / "q")).withColumn("request", file_stem("request"))
    assert rows(found) == [
        ("buckets-1", 0, "rare-books"),
        ("buckets-1", 1, "manuscripts"),
        ("buckets-1", 2, ""),
        ("buckets-1", 3, "newspapers"),
        ("buckets-2", 0, "one"),
    ]


def test_contents(spark, tmp_path):
    from vaultlens.functions.crc64 import crc64_base64

    write(tmp_path / "c/x.bin", "123456789")
    row = tables.read_contents(spark, str(tmp_path / "c")).select("size", crc64_base64("content")).first()
    assert tuple(row) == (9, "rosUhgp5mIg=")


def test_landed_tables_keep_their_schema(spark, tmp_path):
    for name, schema in tables.TABLES.items():
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        assert tables.read_table(spark, name, path).columns == schema.fieldNames()


def test_empty_report_is_a_header(spark, tmp_path):
    frame = inventory.report(spark.createDataFrame([], schemas.INVENTORY))
    path = reports.publish_csv(frame, str(tmp_path / "r"), DAY)
    header = "bucket,key,size,last_modified_date,storage_class,replication_status"
    assert [lines for lines in header_lines(path) if lines] == [[header]]
    assert [x for x in header_lines(reports.latest_path(str(tmp_path / "r"))) if x] == [[header]]


def test_nulls_are_unquoted(spark, tmp_path):
    frame = spark.createDataFrame([("b", None, "", "x")], "a string, b string, c string, d string")
    path = reports.write_csv(frame, str(tmp_path / "r"), single_file=True)
    assert header_lines(path) == [["a,b,c,d", "b,,,x"]]


def test_latest_follows_the_dated_copy(spark, tmp_path, rows):
    base = str(tmp_path / "r")
    for day, name in (("2024-01-30", "old"), (DAY, "new")):
        frame = spark.createDataFrame([(name, 'quote " and, comma')], "a string, b string")
        reports.publish_csv(frame, base, day)
    read = reports.read_csv(spark, reports.latest_path(base), frame.schema)
    assert rows(read) == [("new", 'quote " and, comma')]
    assert rows(reports.read_csv(spark, reports.dated_path(base, "2024-01-30"), frame.schema))[0][0] == "old"


NASTY_KEYS = [" lead", "trail ", "a\nb", "a\r\nb", 'quo"te', "com,ma", '"', "\t", "plain", "é\n,\"x\" "]


def test_keys_come_back_as_they_are(spark, tmp_path):
    frame = spark.createDataFrame(
        [("b", key, n, "t", "c", None) for n, key in enumerate(NASTY_KEYS)], schemas.INVENTORY_REPORT
    )
    base = str(tmp_path / "r")
    dated = reports.publish_csv(frame.repartition(3), base, DAY)
    for path in (dated, reports.latest_path(base)):
        assert sorted(r.key for r in inventory_source.read_report(spark, path).collect()) == sorted(NASTY_KEYS)
    copies = {p.name: p.read_bytes() for p in Path(reports.latest_path(base)).iterdir() if not p.name.startswith(".")}
    assert copies == {p.name: p.read_bytes() for p in Path(dated).iterdir() if not p.name.startswith(".")}


def test_appended_file_names_are_known_again(spark, tmp_path):
    names = [row for row in schemas.ARCHIVE_INVENTORY.fieldNames()]
    assert "filename" in names
    for key in NASTY_KEYS:
        row = tuple(key if name == "filename" else None for name in names)
        reports.append_csv(spark.createDataFrame([row], schemas.ARCHIVE_INVENTORY), str(tmp_path / "a"))
    found = tables.read_archive_inventory(spark, str(tmp_path / "a"))
    assert sorted(r.filename for r in found.collect()) == sorted(NASTY_KEYS)


def test_publishing_as_latest_writes_once(spark, tmp_path):
    base = str(tmp_path / "r")
    frame = spark.createDataFrame([("a",)], "a string")
    assert reports.publish_csv(frame, base, jobs.LATEST) == reports.latest_path(base)
    assert [p.name for p in Path(base).iterdir()] == [f"report_date={jobs.LATEST}"]


def test_verification_run(spark, tmp_path):
    source = [("a", "AA"), ("b", "BB"), ("c", "CC")]
    replica = [("a", "AA"), ("b", "XX"), ("d", "DD")]
    for name, entries in (("s", source), ("r", replica)):
        text = "\n".join(result_line(name, k, "v", "succeeded", c) for k, c in entries)
        write(tmp_path / f"{name}.csv", text)
        batch_manifest(tmp_path, f"{name}-manifest", {"succeeded": [f"{name}.csv"]})
    out = str(tmp_path / "out")
    found = plans.verification_report(
        spark,
        "s",
        str(tmp_path / "s-manifest.json"),
        str(tmp_path / "r-manifest.json"),
        str(tmp_path),
        out,
        DAY,
    ).first()
    assert (found.matches, found.mismatches, found.missing_replica, found.missing_source) == (1, 1, 1, 1)
    assert found.total_objects == 4 and not found.is_ok
    for path in (reports.dated_path(f"{out}/reports/checksums/s", DAY), reports.latest_path(f"{out}/reports/checksums/s")):
        lines = [line for part in header_lines(path) for line in part if not line.startswith("bucket,")]
        assert lines == [
            "s,a,v,ok,SHA256,AA,AA",
            "s,b,v,mismatch,SHA256,BB,XX",
            "s,c,v,missing_replica,,,",
            "r,d,v,missing_source,,,",
        ]
    text = "".join(p.read_text() for p in Path(reports.latest_path(f"{out}/metadata/checksums/stats/s")).glob("part-*"))
    assert json.loads(text)["total_objects"] == 4


def test_inventory_and_storage_run(spark, tmp_path):
    manifest = inventory_files(spark, tmp_path / "in", OBJECTS)
    out = str(tmp_path / "out")
    prefixes = plans.inventory_report(spark, "acme-main-a", manifest, str(tmp_path / "in"), out, DAY)
    assert sorted(tuple(r) for r in prefixes.collect()) == [
        ("acme-main-a", "", 1, 50),
        ("acme-main-a", "images", 2, 100),
    ]
    report = reports.read_csv(
        spark, reports.latest_path(f"{out}/reports/manifests/acme-main-a"), schemas.INVENTORY_REPORT
    )
    assert sorted(r.key for r in report.collect()) == ["images/a", "images/b", 'ro"ot, x']
    assert inventory_source.read_report(spark, reports.latest_path(f"{out}/reports/manifests/acme-main-a")).count() == 3

    wanted = spark.createDataFrame([("acme-main-a",), ("acme-main-z",)], "bucket string")
    summary = plans.storage_report(
        spark, wanted, out, DAY, "Owner", "acme-main", dt.datetime(2024, 1, 31), capacity=300
    ).first()
    assert (summary.total_files, summary.total_size, summary.capacity_text) == (3, 150, "50.0% (of 300 B)")
    text = "".join(p.read_text() for p in Path(reports.latest_path(f"{out}/metadata/storage/stats")).glob("part-*"))
    documents = [json.loads(line) for line in text.splitlines()]
    assert {"level": "prefix", "bucket": "acme-main-a", "prefix": "images", "total_files": 2, "total_size": 100} in documents
    stack = next(d for d in documents if d["level"] == "stack")
    assert stack["storage_capacity_bytes"] == 300 and "data_transfer_out_bytes" not in stack

    heads = spark.createDataFrame(
        [("acme-main-a", "images/a", 1, "x", "crc", None, None, None)], schemas.OBJECT_HEAD
    )
    stats = plans.checksum_inventory(
        spark,
        "acme-main-a",
        reports.latest_path(f"{out}/reports/manifests/acme-main-a"),
        heads,
        out,
        DAY,
    ).first()
    assert tuple(stats) == (3, 2)


def test_archive_runs(spark, tmp_path):
    def entries(*names):
        return spark.createDataFrame(
            [
                (n, 1, "c", 1, name, "warc", 5, None, None, None, "2025-01-02T00:00:00Z", ("s", None), "p", ["x"])
                for n, name in enumerate(names)
            ],
            schemas.ARCHIVE_CATALOGUE,
        )

    def totals(n):
        return spark.createDataFrame([(1, n)], "collection_id long, total long")

    path = str(tmp_path / "inventory")
    assert tuple(plans.archive_inventory(spark, entries("a", "b"), totals(2), path).first()) == (1, 0, 2, 0)
    assert tuple(plans.archive_inventory(spark, entries("a", "b"), totals(2), path).first()) == (0, 1, 0, 2)
    assert tuple(plans.archive_inventory(spark, entries("a", "b", "c"), totals(3), path).first()) == (1, 0, 1, 2)
    assert sorted(r.filename for r in tables.read_archive_inventory(spark, path).collect()) == ["a", "b", "c"]

    stored = spark.createDataFrame(
        [("pre/a", 5, {"sha1": "s"}, None), ("pre/b", 5, {"sha1": "t"}, None)],
        "key string, content_length long, metadata map<string,string>, error string",
    )
    counts = plans.archive_audit(spark, path, stored, "pre/", None, str(tmp_path / "out"), DAY).first()
    assert (counts.matched_sha1, counts.unmatched, counts.not_found) == (1, 1, 1)
    listed = tables.read_archive_inventory(spark, reports.latest_path(f"{tmp_path}/out/archive/sync"))
    assert sorted(r.filename for r in listed.collect()) == ["b", "c"]
    assert listed.columns == schemas.ARCHIVE_INVENTORY.fieldNames()


def event(job, status, codes, second):
    return json.dumps(
        {
            "time": f"2024-01-01T00:00:{second:02d}Z",
            "detail": {
                "serviceEventDetails": {
                    "jobId": job,
                    "jobArn": "arn",
                    "status": status,
                    "failureCodes": codes,
                    "statusChangeReason": [],
                }
            },
        },
        indent=1,
    )


def finish(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_job_stream(spark, tmp_path):
    out = str(tmp_path / "out")

    def run():
        finish(
            streams.load_job_status(
                streams.job_events(spark, str(tmp_path / "events")), out, str(tmp_path / "checkpoint")
            )
        )

    def states(*receipts):
        frame = spark.createDataFrame([(*r, "now") for r in receipts], schemas.JOB_RECEIPT)
        found = jobs.readiness(frame, streams.read_job_status(spark, out)).collect()
        return {r.source_job_id: r.state for r in found}

    first, second = ("sb", "s1", "rb", "r1"), ("sb2", "s2", "rb2", "r2")
    write(tmp_path / "events/1.json", event("s1", "Complete", [], 1))
    write(tmp_path / "events/2.json", event("s2", "Failed", ["InvalidManifestContent"], 3))
    run()
    assert states(first) == {"s1": "repl_unknown"}
    write(tmp_path / "events/3.json", event("r1", "Complete", [], 2))
    write(tmp_path / "events/4.json", event("s1", "Active", [], 0))
    write(tmp_path / "events/5.json", event("s1", "Preparing", [], 1))
    run()
    # the receipt of s2 lands after its event
    assert states(first, second) == {"s1": "ready", "s2": "empty_source"}
    streams.compact_job_status(spark, out, str(tmp_path / "compacted"))
    assert spark.read.parquet(str(tmp_path / "compacted")).count() == 3


def test_manifest_stream(spark, tmp_path):
    inventory_files(spark, tmp_path / "in", OBJECTS)
    out = str(tmp_path / "out")
    finish(
        streams.load_inventory_reports(
            streams.manifest_arrivals(spark, str(tmp_path / "in")), str(tmp_path / "in"), out, DAY, str(tmp_path / "cp")
        )
    )
    read = inventory_source.read_report(spark, reports.latest_path(f"{out}/reports/manifests/batch=0"))
    assert read.count() == 3
    stats = tables.read_bucket_stats(spark, reports.latest_path(f"{out}/metadata/manifests/stats/*"))
    assert storage.prefixes_of_stats(stats).count() == 2


def test_request_stream(spark, tmp_path):
    write(tmp_path / "checksums/acme-main-a.txt", "go")
    listed = spark.createDataFrame([("acme-main-a", "k"), ("acme-main-b", "k")], "bucket string, key string")
    heads = spark.createDataFrame([("acme-main-a", "k", 1, "x", "crc", None, None, None)], schemas.OBJECT_HEAD)
    triggers = streams.request_triggers(spark, str(tmp_path / "checksums"))
    finish(
        streams.load_checksum_requests(
            triggers, listed, heads.union(heads), str(tmp_path / "out"), str(tmp_path / "checkpoint")
        )
    )
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.bucket, r.key, r.checksum) for r in found] == [("acme-main-a", "k", "crc")]


def test_log_stream(spark, tmp_path):
    from tests.test_objects import LINE

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        finish(
            streams.load_access_log(
                streams.access_log_lines(spark, str(tmp_path / "audit")), out, checkpoint
            )
        )

    write(tmp_path / "audit/b/2024/1", LINE + "\n" + "garbage\n")
    run()
    time.sleep(0.01)
    write(tmp_path / "audit/b/2024/2", LINE + "\n")
    run()
    log = streams.read_loaded_log(spark, out)
    assert log.count() == 2 and "batch" not in log.columns
    assert log.where(F.col("event_date") == dt.date(2024, 2, 5)).count() == 2
    assert [r.line for r in streams.read_quarantine(spark, out).collect()] == ["garbage"]


def test_prefix_table_of_published_documents(spark, tmp_path, rows):
    prefixes = spark.createDataFrame(
        [("a", "", 1, 2), ("a", "x", 3, 4)],
        "bucket string, prefix string, total_files long, total_size long",
    )
    base = str(tmp_path / "stats")
    reports.publish_json(inventory.stats_rows(prefixes), base, DAY)
    read = tables.read_bucket_stats(spark, reports.latest_path(base))
    assert rows(storage.prefixes_of_stats(read)) == rows(prefixes)


def test_views_for_sql(spark, tmp_path):
    from tests.test_objects import LINE
    from vaultlens.plans.views import register_views

    write(tmp_path / "audit/x/1", LINE + "\n")
    spark.createDataFrame(OBJECTS, schemas.INVENTORY).write.parquet(str(tmp_path / "inv/a/data"))
    register_views(
        tables.read_access_log(spark, str(tmp_path / "audit")),
        inventory_source.read_snapshots(spark, str(tmp_path / "inv")),
    )
    who = spark.sql(
        "SELECT regexp_extract(requester, 'assumed-role/[^/]+/(.+)$', 1) AS who, http_status"
        " FROM audit WHERE operation IN ('REST.GET.OBJECT') AND requester LIKE '%:assumed-role/%'"
        " ORDER BY event_time"
    ).collect()
    assert [tuple(r) for r in who] == [("jo/x", 200)]
    usage = spark.sql(
        "SELECT bucket, COUNT(*) AS objects, SUM(size) AS total_bytes FROM inventory"
        " GROUP BY bucket ORDER BY bucket"
    ).collect()
    assert [tuple(r) for r in usage] == [("acme-main-a", 4, 150)]


def test_shuffles_grow_with_the_data(spark):
    from vaultlens import configure
    from vaultlens.session import PARTITION_BYTES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, data_bytes=1000 * PARTITION_BYTES + 1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1001"
        configure(spark, data_bytes=5)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1001"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
