"""Access log, checksums, fixity and archive."""

from __future__ import annotations

import base64
import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultlens import schemas
from vaultlens.functions import crc64, times
from vaultlens.operators import access_log, archive, checksums

LINE = (
    "owner acme-main-data [06/Feb/2024:00:00:38 +0100] 192.0.2.3 "
    "arn:aws:sts::1:assumed-role/staff/jo/x 3E57 REST.GET.OBJECT a%20b "
    '"GET /a HTTP/1.1" 200 - 113 - 7 - "-" "cli/1.0 (x)" - hostid SigV4 C AuthHeader host '
    "TLSv1.2 -"
)


def log(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "line string")


def test_log_record(spark):
    row = access_log.parsed(log(spark, LINE)).first()
    assert row.bucket == "acme-main-data"
    assert row.event_time == dt.datetime(2024, 2, 5, 23, 0, 38) or row.event_time.minute == 0
    assert (row.http_status, row.bytes_sent, row.object_size) == (200, 113, None)
    assert (row.total_time_ms, row.turn_around_time_ms) == (7, None)
    assert row.key == "a%20b" and row.error_code is None and row.referer is None
    assert row.user_agent == "cli/1.0 (x)" and row.access_point_arn is None


def test_log_schema(spark):
    assert access_log.parsed(log(spark, LINE)).dtypes == [
        (f.name, f.dataType.simpleString()) for f in schemas.ACCESS_LOG
    ]


def test_log_time_has_its_offset(spark):
    frame = access_log.parsed(log(spark, LINE)).select(
        F.col("event_time").cast("timestamp_ntz").alias("t")
    )
    assert frame.first().t == dt.datetime(2024, 2, 5, 23, 0, 38)


def test_more_fields_at_the_end_still_match(spark):
    row = access_log.parsed(log(spark, LINE + " extra fields")).first()
    assert row.access_point_arn is None and row.tls_version == "TLSv1.2"


def test_other_lines_go_to_quarantine(spark, rows):
    bad = ["", "garbage", LINE.replace('"', ""), "owner\u0001" + LINE]
    frame = log(spark, LINE, *bad)
    assert access_log.parsed(frame).count() == 1
    assert rows(access_log.quarantine(frame)) == sorted(((b,) for b in bad), key=repr)


def test_bad_numbers_and_times_become_null(spark):
    line = LINE.replace(" 200 - 113 ", " abc - 1x ").replace("06/Feb/2024", "99/Foo/2024")
    row = access_log.parsed(log(spark, line)).first()
    assert row.http_status is None and row.bytes_sent is None and row.event_time is None


def test_people_only(spark):
    program = LINE.replace("staff/jo", "svc/aws-go-sdk-17")
    profile = LINE.replace("staff/jo", "svc/assume-role-from-profile-x")
    head = LINE.replace("REST.GET.OBJECT", "REST.HEAD.OBJECT")
    user = LINE.replace("arn:aws:sts::1:assumed-role/staff/jo/x", "arn:aws:iam::1:user/jo")
    found = access_log.people_operations(
        access_log.parsed(log(spark, LINE, program, profile, head, user))
    ).collect()
    assert [r.who for r in found] == ["jo/x"]


def test_pattern_runs_once_per_line(spark):
    plan = (
        access_log.people_operations(access_log.parsed(log(spark, LINE)))
        ._jdf.queryExecution()
        .optimizedPlan()
        .toString()
    )
    assert plan.count("regexp_replace") == 1


HEAD = (
    "bucket string, key string, content_length long, content_type string, "
    "checksum_crc64_nvme string, checksum_sha256 string, error string"
)


def test_checksum_inventory(spark, rows):
    heads = spark.createDataFrame(
        [
            ("b", "both", 9, "text/plain", "crc", "sha", None),
            ("b", "sha", None, None, None, "sha", None),
            ("b", "none", 5, "x", None, None, None),
            ("b", "gone", None, None, None, None, "NotFound"),
            ("b", "denied", 3, "x", "crc", None, "AccessDenied"),
        ],
        HEAD,
    )
    listed = spark.createDataFrame(
        [("b", k) for k in ("both", "sha", "none", "gone", "denied", "unseen")],
        "bucket string, key string",
    )
    found = checksums.checksum_inventory(listed, heads)
    assert found.columns == schemas.CHECKSUM_INVENTORY.fieldNames()
    assert rows(found) == [
        ("b", "both", 9, "text/plain", "crc", "crc64nvme", "ok", ""),
        ("b", "denied", None, "", "", "", "error", "AccessDenied"),
        ("b", "gone", None, "", "", "", "not_found", ""),
        ("b", "none", 5, "x", "", "", "missing_checksum", ""),
        ("b", "sha", 0, "", "sha", "sha256", "ok", ""),
        ("b", "unseen", None, "", "", "", "not_found", ""),
    ]
    assert tuple(checksums.stats(found).first()) == (6, 4)


def bitwise(data: bytes) -> int:
    register = crc64.ALL_ONES
    for byte in data:
        register ^= byte
        for _ in range(8):
            register = (register >> 1) ^ (crc64.POLYNOMIAL if register & 1 else 0)
    return register ^ crc64.ALL_ONES


def shown(data: bytes) -> str:
    return base64.b64encode(bitwise(data).to_bytes(8, "big")).decode()


def test_check_value(spark):
    frame = spark.createDataFrame([("123456789",)], "t string")
    assert frame.select(crc64.crc64_base64("t")).first()[0] == "rosUhgp5mIg="


def test_digest_of_any_length(spark):
    random.seed(3)
    values = [os.urandom(n) for n in (0, 1, 2, 255, 256, 257, 511, 513, 4097)]
    values += [os.urandom(random.randrange(3000)) for _ in range(40)]
    frame = spark.createDataFrame(
        [(n, v) for n, v in enumerate(values)] + [(-1, None)], "n int, v binary"
    )
    found = {r.n: r.c for r in frame.select("n", crc64.crc64_base64("v").alias("c")).collect()}
    assert found.pop(-1) is None
    assert found == {n: shown(v) for n, v in enumerate(values)}


def test_long_values_in_pieces(monkeypatch):
    data = os.urandom(5000)
    monkeypatch.setattr(crc64, "PASS_BYTES", 700)
    registers = crc64.raw_registers(
        np.frombuffer(data, dtype=np.uint8), np.array([0, 10, 10, 4000, 5000])
    )
    lengths = np.array([10, 0, 3990, 1000])
    parts = [data[:10], b"", data[10:4000], data[4000:]]
    assert [int(x) for x in crc64.finish(registers, lengths)] == [bitwise(p) for p in parts]


def test_chunks_in_any_order(spark):
    """One object with most of the chunks; none is held whole."""
    random.seed(5)
    bodies = {"big": os.urandom(9000), "small": b"123456789", "empty": b""}
    chunks = []
    for key, body in bodies.items():
        at = 0
        while at < len(body) or not body:
            size = random.randrange(1, 300)
            chunks.append((key, body[at : at + size], at))
            at += size
            if not body:
                break
    random.shuffle(chunks)
    frame = spark.createDataFrame(chunks, "key string, content binary, offset long").repartition(5)
    found = {r.key: (r.checksum, r.content_length) for r in crc64.crc64_of_chunks(frame, ["key"]).collect()}
    assert found == {k: (shown(b), len(b)) for k, b in bodies.items()}


def test_chunked_query_equals_whole(spark):
    import __spark_entry__ as contract

    run = contract.queries()
    whole = run["fixity_crc64nvme"](spark, "/root/testdata/sf0.001").collect()
    chunked = run["fixity_crc64nvme_chunked"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.checksum) for r in whole} == {(r.doc_id, r.checksum) for r in chunked}
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(5).collect()
    found = {r.doc_id: r.checksum for r in whole}
    assert all(found[r.doc_id] == shown(r.text.encode()) for r in some)


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ("2025-01-02T00:00:00Z", True),
        ("2025-01-02T00:00:00.123Z", True),
        ("2025-01-02T00:00:00+02:00", True),
        ("2025-01-02", False),
        ("2025-01-02T00:00:00", False),
        ("2025-13-02T00:00:00Z", False),
        ("bad-date", False),
        ("", False),
    ],
)
def test_store_times(spark, text, ok):
    frame = spark.createDataFrame([(text,)], "t string")
    assert (frame.select(times.rfc3339("t")).first()[0] is not None) == ok


STORED = "2025-01-02T00:00:00Z"
OLD = "2015-01-02T00:00:00Z"


def audit_rows(spark, files, objects, older_than=dt.datetime(2020, 1, 1)):
    inventory = spark.createDataFrame(
        files, "filename string, size_bytes long, sha1 string, store_time string"
    )
    stored = spark.createDataFrame(
        objects, "key string, content_length long, metadata map<string,string>, error string"
    )
    return archive.audit(inventory, stored, "pre/", older_than)


def test_seven_outcomes_and_their_order(spark):
    files = [
        ("sha", 5, "s", STORED),
        ("size", 5, None, STORED),
        ("size-no-expected", 5, "", STORED),
        ("sha-differs", 5, "s", STORED),
        ("expected-empty", 5, "", STORED),
        ("size-differs", 5, "s", STORED),
        ("absent", 5, "s", STORED),
        ("absent-code", 5, "s", STORED),
        ("absent-expired", 5, "s", OLD),
        ("error", 5, "s", STORED),
        ("error-expired", 5, "s", OLD),
        ("expired", 5, "s", OLD),
        ("bad-time", 5, "s", "never"),
    ]
    objects = [
        ("pre/sha", 9, {"sha1": "s"}, None),
        ("pre/size", 5, {"other": "x"}, None),
        ("pre/size-no-expected", 5, None, None),
        ("pre/sha-differs", 5, {"sha1": "t"}, None),
        ("pre/expected-empty", 5, {"sha1": ""}, None),
        ("pre/size-differs", 6, None, None),
        ("pre/absent-code", None, None, "NotFound"),
        ("pre/error", None, None, "AccessDenied"),
        ("pre/error-expired", None, None, "AccessDenied"),
        ("pre/expired", 5, {"sha1": "s"}, None),
        ("pre/bad-time", 5, {"sha1": "s"}, None),
    ]
    audited = audit_rows(spark, files, objects)
    assert {r.filename: r.outcome for r in audited.collect()} == {
        "sha": "matched_sha1",
        "size": "matched_size",
        "size-no-expected": "matched_size",
        "sha-differs": "unmatched",
        "expected-empty": "unmatched",
        "size-differs": "unmatched",
        "absent": "not_found",
        "absent-code": "not_found",
        "absent-expired": "skipped",
        "error": "errored",
        "error-expired": "errored",
        "expired": "expired",
        "bad-time": "skipped",
    }
    counts = archive.audit_stats(audited).first().asDict()
    assert counts == {
        "matched_sha1": 1,
        "matched_size": 2,
        "unmatched": 3,
        "not_found": 2,
        "expired": 1,
        "errored": 2,
        "skipped": 2,
    }
    assert archive.sync_list(audited).count() == 5
    assert [r.key for r in archive.expired_list(audited).collect()] == ["pre/expired"]


def test_expiry_is_strict_and_optional(spark):
    at = dt.datetime(2015, 1, 2)
    objects = [("pre/a", 5, None, None)]
    assert audit_rows(spark, [("a", 5, None, OLD)], objects, at).first().outcome == "matched_size"
    assert audit_rows(spark, [("a", 5, None, OLD)], objects, None).first().outcome == "matched_size"


def test_cutoff_counts_calendar_months(spark):
    as_of = F.lit(dt.datetime(2024, 2, 29, 1, 2, 3))
    cutoff = spark.range(1).select(times.expiry_cutoff(as_of, 1).cast("timestamp_ntz"))
    assert cutoff.first()[0] == dt.datetime(2023, 2, 28, 1, 2, 3)


def catalogue(spark, entries):
    return spark.createDataFrame(
        [
            (n, c, "name", 1, f, kind, n, None, None, None, STORED, ("s", None), None, ["x", "y"])
            for n, (c, f, kind) in enumerate(entries)
        ],
        schemas.ARCHIVE_CATALOGUE,
    )


def known(spark, *files):
    return spark.createDataFrame(list(files), "collection_id long, filename string")


def test_known_counts(spark, rows):
    frame = known(spark, (1, "a"), (1, "b"), (1, "a"), (2, "a"))
    assert rows(archive.known_counts(frame)) == [(1, 2), (2, 1)]


def test_delta(spark, rows):
    totals = spark.createDataFrame(
        [(1, 2), (2, 5), (3, 1), (4, 0)], "collection_id long, total long"
    )
    frame = known(spark, (1, "a"), (1, "b"), (3, "a"), (3, "b"), (2, "a"))
    assert rows(archive.collection_delta(totals, frame)) == [
        (1, 2, 2, True, 0, False),
        (2, 5, 1, False, 4, False),
        (3, 1, 2, False, 0, True),
        (4, 0, 0, False, 0, False),
    ]


def test_new_files(spark):
    rows = archive.rows_of_catalogue(
        catalogue(
            spark,
            [
                (1, "skipped", "warc"),
                (2, "known", "warc"),
                (2, "new", "warc"),
                (2, "new", "warc"),
                (2, "index", "cdx"),
                (3, "new", "warc"),
            ],
        )
    )
    have = known(spark, (1, "a"), (2, "known"))
    totals = spark.createDataFrame([(1, 1), (2, 3), (3, 1)], "collection_id long, total long")
    delta = archive.collection_delta(totals, have)
    found = archive.new_files(rows, have, delta).collect()
    assert sorted((r.collection_id, r.filename, r.size_bytes) for r in found) == [
        (2, "new", 2),
        (3, "new", 5),
    ]
    assert tuple(archive.run_stats(rows, have, delta).first()) == (2, 1, 2, 3)
    assert {r.filename for r in archive.new_files(rows, have).collect()} == {"skipped", "new"}


def test_large_collection_is_not_gathered(spark):
    """The catalogue is shuffled by file, never by collection alone."""
    rows = archive.rows_of_catalogue(catalogue(spark, [(1, "a", "warc")]))
    have = known(spark, (1, "b"))
    totals = spark.createDataFrame([(1, 9)], "collection_id long, total long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = archive.new_files(rows, have, archive.collection_delta(totals, have))
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # from the grouping down to the scans: by file, and below that only the skip list by collection
    exchanges = [line for line in plan[plan.index("min_by(") :].splitlines() if "Exchange" in line]
    assert "hashpartitioning(collection_id" in exchanges[0] and "filename" in exchanges[0]
    assert plan.index("min_by(") < plan.index("LeftAnti") < plan.index("LeftSemi")


def test_skipped_collections_are_not_listed(spark):
    rows = archive.rows_of_catalogue(catalogue(spark, [(1, "a", "warc"), (2, "b", "warc")]))
    have = known(spark, (1, "a"))
    totals = spark.createDataFrame([(1, 1), (2, 1)], "collection_id long, total long")
    delta = archive.collection_delta(totals, have)
    assert {r.filename for r in archive.new_files(rows, have, delta).collect()} == {"b"}


def test_catalogue_round_trip(spark):
    entries = catalogue(spark, [(1, "a", "warc")])
    flat = archive.rows_of_catalogue(entries)
    assert flat.first().all_locations == "x;y"
    assert flat.first().primary_location == ""
    back = archive.catalogue_of_rows(flat).first()
    assert back.locations == ["x", "y"] and back.checksums.sha1 == "s" and back.collection == 1


def test_sync_stats(spark):
    results = spark.createDataFrame(
        [
            ("downloaded", None),
            ("skipped", None),
            ("failed", "NotFound"),
            ("failed", "Timeout"),
            ("failed", None),
            ("stream_failed", None),
            ("progress", None),
        ],
        "outcome string, error string",
    )
    assert tuple(archive.sync_stats(results).first()) == (1, 1, 1, 3)
    assert tuple(archive.sync_stats(results, dry_run=True).first()) == (0, 0, 0, 0)
