"""A ledger that looks at a window, and lines that are stored once."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from martflow import sources, streaming
from martflow.functions import with_partitions
from martflow.sinks import writers
from tests.conftest import rows_of

WINDOW = timedelta(hours=1)
NOW = 1_700_000_000


def _file(root, name, age):
    root.mkdir(exist_ok=True)
    (root / name).write_bytes(b".")
    os.utime(root / name, (NOW - age, NOW - age))


def _names(files):
    return [r["file_name"].rsplit("/", 1)[-1] for r in files.orderBy("modified", "file_name").collect()]


def _mark(spark, root, ledger, page=100):
    files = sources.next_files(spark, str(root), ledger, WINDOW, page=page)
    names = _names(files)
    sources.mark_files(files, ledger, datetime(2024, 1, 1))
    return names


def test_pages_come_oldest_first_and_old_files_leave_the_listing(spark, tmp_path):
    root, ledger = tmp_path / "inbox", str(tmp_path / "ledger")
    days = 86_400
    for i in range(5):
        _file(root, f"{i}.parquet", (9 - i) * days)
    _file(root, "note.txt", 1)
    assert [_mark(spark, root, ledger, page=2) for _ in range(4)] == [["0.parquet", "1.parquet"], ["2.parquet", "3.parquet"], ["4.parquet"], []]
    # Inside the window: found, though older than one that was read, and at its very edge.
    _file(root, "late.parquet", 5 * days + 1_800)
    _file(root, "edge.parquet", 5 * days + 3_600)
    _file(root, "new.parquet", 5 * days)
    files = sources.next_files(spark, str(root), ledger, WINDOW)
    assert _names(files) == ["edge.parquet", "late.parquet", "new.parquet"]
    # Of the nine files only those of the window are listed; of the ledger, days are pruned.
    assert len([f for f in files.inputFiles() if "/inbox/" in f]) == 4
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "modified_day" in plan and "PartitionFilters" in plan
    assert len(_mark(spark, root, ledger)) == 3 and _mark(spark, root, ledger) == []
    # Written anew: read anew.  Before the window: not looked at.
    _file(root, "late.parquet", 0)
    _file(root, "older.parquet", 6 * days)
    assert _mark(spark, root, ledger) == ["late.parquet"]


def test_an_empty_inbox(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    assert _mark(spark, tmp_path / "inbox", str(tmp_path / "ledger")) == []
    assert _mark(spark, tmp_path / "inbox", str(tmp_path / "ledger")) == []


def _lines(spark, *rows):
    frame = spark.createDataFrame([(k, v, datetime.fromisoformat(t)) for k, v, t in rows], "k long, v string, t timestamp_ntz")
    return with_partitions(frame, "t", "hour")


def test_rows_are_added_once_however_late(spark, tmp_path):
    hours = ["year", "month", "day", "hour"]
    a, b, c = ("2024-01-01T10:05", "2024-01-01T11:59", "2023-05-01T00:00")
    batches = [
        _lines(spark, (1, "x", a), (1, "x", a), (2, "y", b)),
        _lines(spark, (1, "x", a), (3, "z", c), (4, "z", a)),
        _lines(spark, (3, "z", c)),
        _lines(spark, (None, "n", a)).limit(1),
        _lines(spark, (9, "n", a)).where("false"),
    ]
    for index in (False, True):
        path = str(tmp_path / f"t{index}")
        for batch in batches:
            for _ in range(1 if batch.where("k IS NULL").count() else 2):
                streaming.add_once(batch, path, ["k"], hours, index=index)
        assert rows_of(writers.stored_rows(spark, path), "k", "v") == sorted([(1, "x"), (2, "y"), (3, "z"), (4, "z"), (None, "n")], key=repr)


def test_only_the_hours_of_a_batch_are_read(spark, tmp_path):
    hours = ["year", "month", "day", "hour"]
    path = tmp_path / "t"
    streaming.add_once(_lines(spark, (1, "x", "2024-01-01T10:05"), (2, "y", "2024-01-01T11:05")), str(path), ["k"], hours)
    for file in path.glob("year=*/month=*/day=*/hour=*10/*.parquet"):
        file.write_bytes(b"no table")
    streaming.add_once(_lines(spark, (2, "y", "2024-01-01T11:05"), (5, "y", "2024-01-01T11:06")), str(path), ["k"], hours)
    schema = "k long, v string, t timestamp_ntz"
    found = [str(f) for f in path.glob("year=*/month=*/day=*/hour=*11/*.parquet")]
    assert rows_of(spark.read.schema(schema).parquet(*found).select(F.col("k"))) == [(2,), (5,)]
