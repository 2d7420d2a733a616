from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens import schemas, session
from vaultlens.operators import onepass
from vaultlens.operators import verification as v

FACTS = (
    "bucket string, key string, version_id string, task_status string, "
    "checksum string, checksum_algorithm string"
)


def side(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], FACTS)


def src(key, version="v1", status="succeeded", checksum="AAAA", bucket="b"):
    return (bucket, key, version, status, checksum, "SHA256")


def rep(key, version="v1", status="succeeded", checksum="AAAA"):
    return ("b-repl", key, version, status, checksum, "SHA256")


def brute(source, replication):
    """The categories, row by row."""

    def partners(row, other):
        if row[1] is None or row[2] is None:
            return []
        return [o for o in other if o[1] == row[1] and o[2] == row[2]]

    out = []
    for s in source:
        found = partners(s, replication)
        if s[3] == "succeeded" and not found:
            out.append((*s[:3], "missing_replica", None, None, None))
        for r in found:
            if s[3] == r[3] == "succeeded" and s[4] is not None and r[4] is not None:
                out.append((*s[:3], "ok" if s[4] == r[4] else "mismatch", s[5], s[4], r[4]))
        if s[3] == "failed":
            out.append((*s[:3], "failed_source", None, None, None))
    for r in replication:
        if r[3] == "succeeded" and not partners(r, source):
            out.append((*r[:3], "missing_source", None, None, None))
        if r[3] == "failed":
            out.append((*r[:3], "failed_replication", None, None, None))
    return Counter(out)


def counted(rows):
    return Counter(tuple(row) for row in rows.collect())


def check(spark, source, replication):
    s, r = side(spark, source), side(spark, replication)
    expected = brute(source, replication)
    assert counted(v.compare(s, r)) == expected
    assert counted(onepass.compare(s, r)) == expected
    assert counted(onepass.compare(s, r, cell_rows=2)) == expected
    counts = Counter()
    for row, n in expected.items():
        counts[row[3]] += n
    found = v.count(s, r).first().asDict()
    assert [found[name] for name in v.COUNTS] == [counts[status] for status in v.STATUSES]
    assert found["total_objects"] == sum(counts.values())
    return found


def test_equal_pairs(spark):
    found = check(spark, [src(k) for k in "abc"], [rep(k) for k in "abc"])
    assert found["matches"] == found["total_objects"] == 3
    assert found["is_ok"]


def test_both_sides_empty(spark):
    found = check(spark, [], [])
    assert found["total_objects"] == 0 and found["is_ok"]


def test_failed_replica_suppresses_missing(spark):
    found = check(spark, [src("a")], [rep("a", status="failed", checksum=None)])
    assert found["failed_replication"] == found["total_objects"] == 1


def test_failed_source_suppresses_missing(spark):
    found = check(spark, [src("a", status="failed", checksum=None)], [rep("a")])
    assert found["failed_source"] == found["total_objects"] == 1


def test_failed_on_both_sides_is_listed_twice(spark):
    found = check(spark, [src("a", status="failed")], [rep("a", status="failed")])
    assert found["total_objects"] == 2


def test_mismatch_shows_both_checksums(spark):
    compared = v.compare(side(spark, [src("a")]), side(spark, [rep("a", checksum="BBBB")]))
    row = v.report(compared).first()
    assert tuple(row) == ("b", "a", "v1", "mismatch", "SHA256", "AAAA", "BBBB")


def test_one_of_each_category(spark):
    source = [src("ok"), src("differs"), src("alone"), src("f1", status="failed")]
    source.append(src("f2"))
    replication = [rep("ok"), rep("differs", checksum="B"), rep("other"), rep("f1")]
    replication.append(rep("f2", status="failed"))
    found = check(spark, source, replication)
    assert [found[n] for n in v.COUNTS] == [1, 1, 1, 1, 1, 1]
    assert not found["is_ok"]


def test_versions_are_distinct(spark):
    found = check(
        spark,
        [src("a", "v1"), src("a", "v2", checksum="B")],
        [rep("a", "v1"), rep("a", "v2", checksum="B")],
    )
    assert found["matches"] == 2


def test_null_version_never_matches(spark):
    found = check(spark, [src("a", None)], [rep("a", None)])
    assert found["missing_replica"] == found["missing_source"] == 1


def test_no_checksum_gives_no_row(spark):
    found = check(spark, [src("a", checksum=None)], [rep("a")])
    assert found["total_objects"] == 0


def test_status_is_case_sensitive(spark):
    found = check(spark, [src("a", status="Succeeded")], [rep("a")])
    assert found["total_objects"] == 0


def test_only_missing_replica_is_ok(spark):
    assert check(spark, [src("a")], [])["is_ok"]
    assert not check(spark, [], [rep("a")])["is_ok"]


def test_a_third_of_all_rows_in_one_key(spark):
    """Repeats multiply as in a plain join, without forming pairs before the end."""
    source = [src("hot", checksum=c) for c in "ABCA" * 10] + [src(f"k{n}") for n in range(80)]
    replication = [rep("hot", checksum=c) for c in "AB" * 20] + [rep(f"k{n}") for n in range(70)]
    found = check(spark, source, replication)
    assert found["matches"] == 20 * 20 + 10 * 20 + 70
    assert found["mismatches"] == 40 * 40 - 600


def test_many_copies_are_spread(spark, tmp_path):
    """The pairs of one object version are joined, and sorted, in several tasks."""
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        copies = lambda row, n: (
            side(spark, [row]).join(spark.range(0, n, 1, 4), F.lit(True)).withColumn("checksum", F.col("id").cast("string")).drop("id")
        )
        source, replication = copies(src("hot"), 1200), copies(rep("hot"), 1000)
        assert v.count(source, replication).first()["mismatches"] == 1_200_000 - 1000
        pairs = v.compared_pairs(source, replication)
        assert pairs.count() == 1_200_000
        assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        v.report(pairs).write.parquet(str(tmp_path / "report"))
        sizes = spark.read.parquet(str(tmp_path / "report")).groupBy(F.input_file_name()).count().collect()
        assert len(sizes) > 3 and max(r["count"] for r in sizes) < 600_000
    finally:
        for name in (
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.autoBroadcastJoinThreshold",
        ):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_one_pass_cuts_a_hot_version_into_cells(spark):
    """No cell holds more than its rows, whatever share of the table one version has."""
    source = [src("hot", checksum=str(n)) for n in range(900)] + [src("hot", status="failed")] * 300 + [src(f"k{n}") for n in range(50)]
    replication = [rep("hot", checksum=str(n)) for n in range(100, 700)] + [rep(f"k{n}") for n in range(40)]
    s, r = side(spark, source), side(spark, replication)
    stack = onepass._side(s, 0).unionByName(onepass._side(r, 1))
    large = onepass.large_versions(stack, 100)
    assert [tuple(row) for row in large.collect()] == [("hot", "v1", 1200, 600, 12, 6)]
    cells = onepass._dealt(stack, large).where(F.col("key") == "hot").groupBy("line", "column", "side").count().collect()
    assert len({(c["line"], c["column"]) for c in cells}) == 72 and max(c["count"] for c in cells) < 200
    statuses = Counter(row["status"] for row in onepass.compare(s, r, 100).collect())
    assert statuses == {"ok": 640, "mismatch": 900 * 600 - 600, "failed_source": 300, "missing_replica": 10}


def test_one_pass_shuffles_the_rows_once(spark):
    """The large versions are counted before; the report itself has one exchange."""
    plan = onepass.compare(side(spark, [src("a")]), side(spark, [rep("a")]))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "line#" in exchanges[0] and "SortMergeJoin" not in plan, plan


def test_report_order(spark):
    source = [src("z"), src("a"), src("m", status="failed")]
    replication = [rep("z"), rep("a", checksum="B"), rep("n", status="failed"), rep("o")]
    report = v.report(v.compare(side(spark, source), side(spark, replication))).collect()
    assert [(r.status, r.key) for r in report] == [
        ("ok", "z"),
        ("mismatch", "a"),
        ("missing_source", "o"),
        ("failed_source", "m"),
        ("failed_replication", "n"),
    ]


def test_messages(spark):
    good = '{"checksum_base64":"AAAA","checksumAlgorithm":"SHA256"}'
    results = spark.createDataFrame(
        [
            ("b", str(n), "v", "succeeded", "200", None, message)
            for n, message in enumerate([good, "{}", "{broken", "", None])
        ],
        schemas.BATCH_RESULT,
    )
    found = {r.key: r.checksum for r in v.with_checksums(results).collect()}
    assert found == {"0": "AAAA", "1": None, "2": None, "3": None, "4": None}
    assert v.bad_messages(results).first().bad_messages == 2


row = st.tuples(
    st.sampled_from(["a", "b", None]),
    st.sampled_from(["v1", "v2", None]),
    st.sampled_from(["succeeded", "failed", "other"]),
    st.sampled_from(["A", "B", None]),
)


@settings(
    max_examples=4,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(source=st.lists(row, max_size=8), replication=st.lists(row, max_size=8))
def test_any_rows(spark, source, replication):
    check(
        spark,
        [("b", *r[:3], r[3], "SHA256") for r in source],
        [("b-repl", *r[:3], r[3], "SHA256") for r in replication],
    )


def test_a_task_reads_few_bytes(spark):
    """A session that reads more at once gets less; one that reads less keeps that."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        for given, wanted in (("128m", "16777216"), ("8m", "8m"), ("16777216b", "16777216b")):
            for name in names:
                spark.conf.set(name, given)
            session.configure(spark)
            assert [spark.conf.get(name) for name in names] == [wanted, wanted]
    finally:
        for name in names:
            spark.conf.set(name, before[name])
