"""State intervals kept up day by day, and compaction of the loaded log."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vaultlens import schemas
from vaultlens.operators import access_log, inventory
from vaultlens.plans import intervals
from vaultlens.streaming import compaction, streams

DAYS = [dt.date(2024, 1, n) for n in (1, 2, 3, 5)]


def snapshot(spark, names):
    rows = [("b", name, None if name == "null" else len(name), None, "S", None) for name in names]
    return spark.createDataFrame(rows, schemas.INVENTORY)


LISTED = [["a", "b", "null", "a"], ["a", "c", "null"], ["a", "b"], ["a", "b", "null"]]


def merged(spark, base):
    for day, names in zip(DAYS, LISTED, strict=True):
        intervals.merge_day(snapshot(spark, names), base, day)
    return intervals.read_intervals(spark, base)


def test_intervals_of_states(spark, tmp_path):
    found = merged(spark, str(tmp_path))
    assert sorted((r.key, r.valid_from, r.valid_to) for r in found.collect()) == [
        ("a", "2024-01-01", None),
        ("b", "2024-01-01", "2024-01-02"),
        ("b", "2024-01-03", None),
        ("c", "2024-01-02", "2024-01-03"),
        ("null", "2024-01-01", "2024-01-03"),
        ("null", "2024-01-05", None),
    ]
    for day, names in zip(DAYS, LISTED, strict=True):
        assert sorted(r.key for r in intervals.states_on(found, day).collect()) == sorted(set(names))
    everything = snapshot(spark, [name for names in LISTED for name in names])
    assert sorted(map(repr, intervals.distinct_states(found).collect())) == sorted(
        map(repr, inventory.distinct_states(everything).collect())
    )


def test_the_last_day_can_be_run_again_and_no_earlier_one(spark, tmp_path):
    merged(spark, str(tmp_path))
    intervals.merge_day(snapshot(spark, ["c"]), str(tmp_path), DAYS[-1])
    found = intervals.read_intervals(spark, str(tmp_path)).where("valid_to IS NULL OR valid_to = '2024-01-05'")
    assert sorted((r.key, r.valid_from, r.valid_to) for r in found.collect()) == [
        ("a", "2024-01-01", "2024-01-05"),
        ("b", "2024-01-03", "2024-01-05"),
        ("c", "2024-01-05", None),
    ]
    with pytest.raises(ValueError, match="too late"):
        intervals.merge_day(snapshot(spark, ["c"]), str(tmp_path), DAYS[0])


def test_a_merge_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    before = sorted(map(repr, merged(spark, str(tmp_path)).collect()))

    def stopped(*_):
        raise OSError("stopped")

    monkeypatch.setattr(intervals, "replace_document", stopped)
    with pytest.raises(OSError, match="stopped"):
        intervals.merge_day(snapshot(spark, ["z"]), str(tmp_path), dt.date(2024, 1, 6))
    assert sorted(map(repr, intervals.read_intervals(spark, str(tmp_path)).collect())) == before


def test_a_day_shuffles_itself_and_the_open_states_only(spark, tmp_path):
    merged(spark, str(tmp_path))
    # what was closed before is not read: the merge works without it
    for file in (tmp_path / "closed").rglob("*.parquet"):
        file.write_bytes(b"")
    intervals.merge_day(snapshot(spark, ["a"]), str(tmp_path), dt.date(2024, 1, 6))


def test_no_table_and_empty_days(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        intervals.read_intervals(spark, str(tmp_path / "none"))
    for day in DAYS[:2]:
        intervals.merge_day(snapshot(spark, []), str(tmp_path / "t"), day)
    assert intervals.read_intervals(spark, str(tmp_path / "t")).count() == 0


def log_line(n, key, day=1):
    return (
        f"owner b [0{day}/Jan/2024:00:{n // 60 % 60:02d}:{n % 60:02d} +0000] 192.0.2.1 arn R{n:05d} REST.GET.OBJECT {key} "
        '"GET /k HTTP/1.1" 200 - 5 113 7 - "-" "cli/1.0" - h SigV4 C AuthHeader host TLSv1.2 -'
    )


def load(spark, base, lines):
    spark.createDataFrame([(line,) for line in lines], "line string").write.mode("append").text(f"{base}/in")
    query = streams.load_access_log(streams.access_log_lines(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint")
    assert query.awaitTermination(120) and query.exception() is None


def requests(spark, base):
    return sorted(r.request_id for r in streams.read_loaded_log(spark, f"{base}/out").collect())


def test_compaction_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    base, out = str(tmp_path), f"{tmp_path}/out"
    monkeypatch.setattr(compaction, "MAX_RUNS", 2)
    wanted = []
    for part in range(4):
        lines = [log_line(part * 10 + n, f"k{n % 3}", day=1 + n % 2) for n in range(10)]
        load(spark, base, [*lines, f"damaged {part}"])
        wanted += [f"R{part * 10 + n:05d}" for n in range(10)]
        assert requests(spark, base) == wanted
        if part == 2:
            # a compaction that breaks off before it counts
            monkeypatch.setattr(compaction, "replace_document", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError, match="stopped"):
                compaction.compact(spark, out)
            monkeypatch.undo()
            monkeypatch.setattr(compaction, "MAX_RUNS", 2)
            assert requests(spark, base) == wanted
        assert compaction.compact(spark, out)
        assert not compaction.compact(spark, out)
        assert requests(spark, base) == wanted
        assert sorted(r.line for r in streams.read_quarantine(spark, out).collect()) == [f"damaged {n}" for n in range(part + 1)]
    compaction.remove_packed(spark, out)
    assert requests(spark, base) == wanted
    assert not list(Path(out, "log").glob("batch=*")) and len(list(Path(out, "runs").glob("run=*"))) == 2


def test_one_object_opens_few_files(spark, tmp_path):
    base, out = str(tmp_path), f"{tmp_path}/out"
    for part in range(2):
        load(spark, base, [log_line(n, f"k{n * 7919 % 997:03d}") for n in range(part, 3000, 2)])
    assert compaction.compact(spark, out, file_bytes=8_000)
    files = [f for f in Path(out, "runs").rglob("*.parquet") if "is_record=true" in str(f)]
    assert len(files) > 5
    holding = 0
    for file in files:
        groups = pq.ParquetFile(file).metadata
        column = next(n for n in range(groups.num_columns) if groups.row_group(0).column(n).path_in_schema == "key")
        stats = [groups.row_group(g).column(column).statistics for g in range(groups.num_row_groups)]
        holding += any(s.min <= "k123" <= s.max for s in stats)
    assert 1 <= holding <= 2
    found = access_log.requests_of(streams.read_loaded_log(spark, out), "b", "k123").collect()
    assert [r.request_id for r in found] == [f"R{n:05d}" for n in range(3000) if n * 7919 % 997 == 123]


def test_a_task_of_a_compaction_sorts_few_rows(spark, tmp_path):
    base, out = str(tmp_path), f"{tmp_path}/out"
    load(spark, base, [log_line(n, f"k{n % 7}") for n in range(2000)])
    assert compaction.compact(spark, out, file_rows=200)
    files = [f for f in Path(out, "runs").rglob("*.parquet") if "is_record=true" in str(f)]
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in files]
    assert sum(sizes) == 2000 and len(sizes) >= 10 and max(sizes) < 400
    assert requests(spark, base) == [f"R{n:05d}" for n in range(2000)]


def test_history_of_objects(spark, tmp_path):
    load(spark, str(tmp_path), [log_line(n, "k" if n else "-") for n in range(4)])
    found = access_log.object_history(streams.read_loaded_log(spark, f"{tmp_path}/out"))
    rows = {r["key"]: (r.requests, r.first_time.second, r.last_time.second, r.last_operation) for r in found.collect()}
    assert rows == {"k": (3, 1, 3, "REST.GET.OBJECT"), None: (1, 0, 0, "REST.GET.OBJECT")}


def test_nothing_loaded(spark, tmp_path):
    assert streams.read_loaded_log(spark, str(tmp_path / "none")).count() == 0
    assert not compaction.compact(spark, str(tmp_path / "none"))
    assert access_log.object_history(streams.read_loaded_log(spark, str(tmp_path / "none"))).where(F.lit(True)).count() == 0
