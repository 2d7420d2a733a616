from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from checks import inventory as queries
from checks.views import spark_view
from vaultlens import schemas
from vaultlens.operators import inventory, metrics, storage


def table(spark, objects):
    return spark.createDataFrame(
        [(b, k, s, None, "STANDARD", "COMPLETED") for b, k, s in objects], schemas.INVENTORY
    )


def test_prefix_groups(spark, rows):
    frame = table(
        spark,
        [
            ("b", "images/a", 100),
            ("b", "images/b", 200),
            ("b", "docs/report", 300),
            ("b", "root", 50),
            ("b", "another_root", 25),
            ("b", "images/", 0),
            ("b", "/lead", 1),
        ],
    )
    assert rows(inventory.prefix_stats(frame)) == [
        ("b", "", 3, 76),
        ("b", "docs", 1, 300),
        ("b", "images", 2, 300),
    ]


def test_unknown_sizes_count_as_zero(spark):
    frame = table(spark, [("b", "x/a", None), ("b", "x/b", None)])
    assert tuple(inventory.prefix_stats(frame).first()) == ("b", "x", 2, 0)
    assert [r.size for r in inventory.report(frame).collect()] == [0, 0]


def test_empty_inventory(spark):
    frame = table(spark, [])
    assert inventory.prefix_stats(frame).count() == 0
    assert inventory.report(frame).count() == 0
    totals = inventory.rollup(inventory.prefix_stats(frame)).where("level = 'stack'").collect()
    assert [(r.total_files, r.total_size) for r in totals] in ([], [(0, 0)])


def test_timestamp_text(spark):
    frame = spark.createDataFrame(
        [("b", "k", 1, dt.datetime(2025, 1, 1), "S", "C")], schemas.INVENTORY
    )
    assert inventory.report(frame).first().last_modified_date == "2025-01-01 00:00:00+00"


def test_keys_are_taken_verbatim(spark):
    frame = table(spark, [("b", "a%2Fb/c d", 1)])
    assert inventory.prefix_stats(frame).first().prefix == "a%2Fb"


def test_each_bucket_total_is_listed_once(spark):
    """Also that of a bucket with very many prefixes."""
    frame = table(spark, [("b", f"p{n}/x", n) for n in range(3000)] + [("c", "x", 7)])
    found = inventory.stats_rows(inventory.prefix_stats(frame)).collect()
    totals = {r.bucket: (r.total_files, r.total_size) for r in found if r.level == "bucket"}
    assert totals == {"b": (3000, 2999 * 1500), "c": (1, 7)}
    assert sum(r.level == "bucket" for r in found) == 2
    assert {(r.bucket, r.prefix) for r in found if r.level == "prefix"} == {("b", f"p{n}") for n in range(3000)} | {("c", "")}


def test_distinct_states_and_usage(spark, rows):
    frame = table(spark, [("b", "k", 5), ("b", "k", 5), ("b", "k", 6), ("b", "l", None)])
    states = inventory.distinct_states(frame)
    assert states.count() == 3
    assert rows(inventory.usage_by_bucket(states)) == [("b", 3, 11)]


def test_latest_snapshot_prefers_today(spark, rows):
    frame = spark.createDataFrame(
        [
            ("a", "2024-01-02", "today"),
            ("a", "2024-01-01", "yesterday"),
            ("b", "2024-01-01", "yesterday"),
            ("c", "2023-12-31", "old"),
        ],
        "bucket string, snapshot_date string, path string",
    )
    latest = inventory.latest_snapshot(frame, dt.date(2024, 1, 2))
    assert rows(latest.select("bucket", "path")) == [("a", "today"), ("b", "yesterday")]
    missing = inventory.without_snapshot(frame.select("bucket").distinct(), latest)
    assert rows(missing) == [("c",)]


CHARTS = {"size": [("alpha", 60_000_000), ("beta", 40_000_000)], "files": [("alpha", 10), ("beta", 20)]}


def stack(spark):
    return spark.createDataFrame(
        [("alpha", "", 10, 60_000_000), ("beta", "x", 20, 40_000_000)],
        "bucket string, prefix string, total_files long, total_size long",
    )


def test_storage_summary(spark):
    row = storage.summary(stack(spark), 200_000_000).first()
    assert (row.total_files, row.total_size, row.bucket_count, row.prefix_count) == (
        30,
        100_000_000,
        2,
        2,
    )
    assert row.capacity_used_pct == 50.0
    assert row.capacity_text == "50.0% (of 200 MB)"


def test_no_capacity(spark):
    for capacity in (None, 0):
        assert storage.summary(stack(spark), capacity).first().capacity_text is None


def test_shares_as_shown(spark, rows):
    assert rows(storage.formatted_buckets(stack(spark))) == [
        ("alpha", 10, "60 MB", "60.0%", "33.3%", 1),
        ("beta", 20, "40 MB", "40.0%", "66.7%", 1),
    ]
    assert rows(storage.formatted_prefixes(stack(spark)))[0] == ("alpha", "", 10, "60 MB", "100.0%")


def test_shares_of_nothing_are_zero(spark):
    empty = spark.createDataFrame(
        [("a", "", 1, 0)], "bucket string, prefix string, total_files long, total_size long"
    )
    assert storage.bucket_shares(empty).first().pct_total_size == 0.0


def test_chart_points(spark, rows):
    assert rows(storage.chart_points(stack(spark))) == rows(
        spark.createDataFrame(
            [(chart, n, b, v) for chart, values in CHARTS.items() for n, (b, v) in enumerate(values)],
            "chart string, position long, label string, value long",
        )
    )


def test_positions_of_many_buckets(spark):
    many = spark.range(5000).selectExpr("concat('b', lpad(id, 5, '0')) bucket", "'' prefix", "id total_files", "1L total_size")
    found = storage.chart_points(many.repartition(9)).where("chart = 'files'").collect()
    assert sorted((r.position, r.value) for r in found) == [(n, n) for n in range(5000)]


def header(spark, capacity, transfer):
    return spark.createDataFrame(
        [("Owner", "acme-main", "2024-01-01T00:00:00Z", capacity, *transfer)],
        "owner string, stack_name string, generated_at string, storage_capacity_bytes long, "
        "data_transfer_out_bytes long, data_transfer_out_period_start string, "
        "data_transfer_out_period_end string",
    )


def stack_row(rows):
    return json.loads(next(r.document for r in rows.collect() if r.level == "stack"))


def test_report_rows(spark):
    head = header(spark, None, (7, "2024-01-01", "2024-02-01"))
    found = storage.report_rows(inventory.stats_rows(stack(spark)), head)
    document = stack_row(found)
    assert document["storage_capacity_bytes"] is None
    assert document["data_transfer_out_bytes"] == 7
    assert (document["total_files"], document["total_size"]) == (30, 100_000_000)
    others = [json.loads(r.document) for r in found.collect() if r.level != "stack"]
    assert sorted(d["bucket"] for d in others if d["level"] == "bucket") == ["alpha", "beta"]
    assert {"level": "prefix", "bucket": "beta", "prefix": "x", "total_files": 20, "total_size": 40_000_000} in others


def test_report_rows_without_transfer(spark):
    document = stack_row(storage.report_rows(inventory.stats_rows(stack(spark)), header(spark, 5, (None, None, None))))
    assert not [name for name in document if name.startswith("data_transfer")]
    assert document["storage_capacity_bytes"] == 5


def test_stats_join_and_warning(spark, rows):
    stats = inventory.stats_rows(stack(spark))
    wanted = spark.createDataFrame([("alpha",), ("gamma",)], "bucket string")
    assert storage.with_latest_stats(wanted, stats).count() == 2
    assert rows(storage.without_stats(wanted, stats)) == [("gamma",)]
    assert rows(storage.prefixes_of_stats(stats)) == rows(stack(spark))


def test_sizes_as_text(spark):
    from vaultlens.functions.text import bytes_text

    sizes = [0, 999, 1000, 1500, 200_000_000, 1_234_567_890, 5 * 10**18]
    frame = spark.createDataFrame([(n,) for n in sizes], "n long")
    shown = [r[0] for r in frame.orderBy("n").select(bytes_text("n")).collect()]
    assert shown == ["0 B", "999 B", "1 kB", "1.50 kB", "200 MB", "1.23 GB", "5 EB"]


def test_latest_metrics(spark, rows):
    at = dt.datetime
    frame = spark.createDataFrame(
        [
            ("a", "BucketSizeBytes", "Standard", at(2024, 1, 1), 10.9, 1),
            ("a", "BucketSizeBytes", "Standard", at(2024, 1, 2), 20.9, 2),
            ("a", "BucketSizeBytes", "Glacier", at(2024, 1, 1), 5.9, 3),
            ("a", "NumberOfObjects", "AllStorageTypes", at(2024, 1, 2), 3.0, 4),
            ("a", "NumberOfObjects", "Other", at(2024, 1, 2), 99.0, 5),
            ("b", "BucketSizeBytes", "Standard", at(2023, 12, 1), 7.0, 6),
        ],
        schemas.METRIC_DATAPOINT,
    )
    points = metrics.latest_points(frame, at(2024, 1, 2, 12))
    wanted = spark.createDataFrame([("a",), ("b",)], "bucket string")
    assert rows(metrics.bucket_metrics(points, wanted)) == [("a", 3, 25), ("b", 0, 0)]
    assert rows(metrics.bucket_metrics(points)) == [("a", 3, 25)]


def cost(spark, quantities):
    return spark.createDataFrame(
        [
            (
                dt.date(2024, 2, 1),
                metrics.STORAGE_SERVICE,
                metrics.TRANSFER_OUT_GROUP,
                "acme-main",
                quantity,
            )
            for quantity in quantities
        ],
        schemas.COST_USAGE,
    )


def test_transfer_out(spark):
    row = metrics.transfer_out(
        cost(spark, ["1.5", "0.25", "n/a", "1d", ""]), "acme-main", dt.date(2024, 3, 1)
    ).first()
    assert tuple(row) == (1_750_000_000, "2024-01-01", "2024-03-01")


def test_report_rows_of_more_than_a_bigint(spark):
    """Bytes stay whole and are written as digits, for all sizes."""
    for units, sent in (("11928753935", 11_928_753_935_000_000_000), ("123456789012345", 123_456_789_012_345_000_000_000)):
        found = metrics.transfer_out(cost(spark, [units]), "acme-main", dt.date(2024, 3, 1))
        head = found.selectExpr(
            "'o' AS owner", "'acme-main' AS stack_name", "'t' AS generated_at", "CAST(NULL AS BIGINT) AS storage_capacity_bytes", "*"
        )
        text = next(r.document for r in storage.report_rows(inventory.stats_rows(stack(spark)), head).collect() if r.level == "stack")
        assert f'"data_transfer_out_bytes":{int(float(sent))},"data_transfer_out_period_start"' in text


def test_transfer_out_is_the_number_of_the_double(spark):
    """Above 2^53 a decimal of the shortest digits would be another number."""
    for units in ("117000000.123", "9007199.254740993", "9223372035", "4294967296e-9", "1e-9"):
        found = metrics.transfer_out(cost(spark, [units]), "acme-main", dt.date(2024, 3, 1)).first()
        assert int(found.data_transfer_out_bytes) == int(round(float(units) * 1e9))


def test_egress_beyond_a_bigint(spark, tmp_path):
    """The query has the type of its SQL where that holds the figure, and the whole figure else."""
    for price, kind in ((5.0, "bigint"), (11928753935.0, "decimal(38,0)")):
        orders = spark.createDataFrame(
            [(6, 2, "O", price, dt.date(1996, 2, 1), "1-URGENT")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string",
        )
        orders.write.parquet(f"{tmp_path}/{price}/orders.parquet")
        found = queries.egress_ytd(lambda name: spark_view(spark, f"{tmp_path}/{price}", name))
        assert dict(found.dtypes)["data_transfer_out_bytes"] == kind
        assert int(found.first().data_transfer_out_bytes) == int(price * 1e9)


def test_transfer_out_of_nothing(spark):
    day = dt.date(2024, 3, 1)
    for costs, as_of in (
        (cost(spark, []), day),
        (cost(spark, ["0"]), day),
        (cost(spark, ["5"]), dt.date(2024, 1, 1)),
    ):
        row = metrics.transfer_out(costs, "acme-main", as_of).first()
        assert tuple(row) == (None, None, None)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "costs")
    cost(spark, ["1"]).write.parquet(path)
    costs = spark.read.schema(schemas.COST_USAGE).parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = (
        metrics.transfer_out(costs, "acme-main", dt.date(2024, 3, 1))
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "EqualTo(stack_tag,acme-main)" in plan and "GreaterThanOrEqual(period" in plan


def test_prefix_stats_reads_three_columns(spark, tmp_path):
    path = str(tmp_path / "inventory")
    table(spark, [("b", "k", 1)]).write.parquet(path)
    frame = inventory.prefix_stats(spark.read.schema(schemas.INVENTORY).parquet(path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<bucket:string,key:string,size:bigint>" in plan


def test_report_has_six_columns(spark):
    frame = inventory.report(table(spark, [("b", "k", 1)]))
    assert frame.columns == schemas.INVENTORY_REPORT.fieldNames()
    assert frame.select(F.col("size")).dtypes == [("size", "bigint")]
