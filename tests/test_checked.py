"""Checks that are kept by partition: the results of full checks, from what has changed."""

from pathlib import Path

from pyspark.sql import functions as F

from martflow import sinks, storage
from martflow.operators import check_not_null, check_unique
from martflow.sinks import checked, writers
from tests.conftest import rows_of


def _table(spark, root):
    rows = spark.range(4_000).select(F.col("id").alias("k"), F.lit("x").alias("v"), (F.col("id") % 4).cast("int").alias("p"))
    sinks.write_partitions(rows, root, ["p"], mode="overwrite")


def _spoil(root, folder):
    for file in Path(root, folder).glob("*.parquet"):
        file.write_bytes(b"no table")


def _more(spark, root, *rows):
    sinks.write_partitions(spark.createDataFrame(rows, "k long, v string, p int"), root, ["p"], mode="append")


def test_like_full_checks_over_several_runs(spark, tmp_path):
    root = str(tmp_path / "t")
    _table(spark, root)
    steps = [
        lambda: None,
        lambda: _more(spark, root, (1, "x", 1), (1, None, 1), (5, "x", 1)),
        lambda: _more(spark, root, (2, None, 2), (None, "x", 2), (None, "x", 2)),
        lambda: storage.delete(spark, f"{root}/p=1"),
        lambda: _more(spark, root, (9_000, None, 7)),
    ]
    for step in steps:
        step()
        got = sinks.check_stored(spark, root, unique=["k"], not_null=["v", "k"])
        table = writers.stored_rows(spark, root)
        want = [check_unique(table, "k"), check_not_null(table, "v"), check_not_null(table, "k")]
        assert [tuple(r) for r in got.collect()] == [tuple(w.head()) for w in want]
        assert rows_of(sinks.check_unique_anywhere(spark, root, ["k"])) == rows_of(check_unique(table, "k"))


def test_partitions_with_the_same_files_are_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    _table(spark, root)
    sinks.check_stored(spark, root, unique=["k"], not_null=["v"])
    _spoil(root, "p=0")
    _spoil(root, "p=3")
    _more(spark, root, (1, None, 1))
    got = sinks.check_stored(spark, root, unique=["k"], not_null=["v"])
    assert [tuple(r) for r in got.collect()] == [("unique", "k", "error", 1), ("not_null", "v", "error", 1)]


def test_a_repeat_in_another_partition_is_found_through_the_index(spark, tmp_path):
    root = str(tmp_path / "t")
    _table(spark, root)
    sinks.index_keys(writers.stored_rows(spark, root), root, ["k"])
    assert sinks.check_unique_anywhere(spark, root, ["k"]).head()["status"] == "pass"
    _spoil(root, "p=0")
    _more(spark, root, (7, "x", 9), (80_001, "x", 9))
    # 7 lies in p=3; the check inside partitions cannot see it, and p=0 need not be read.
    for _ in range(2):  # a failure is found again
        assert tuple(sinks.check_unique_anywhere(spark, root, ["k"]).head()) == ("unique", "k", "error", 1)
    storage.delete(spark, f"{root}/p=9")
    assert sinks.check_unique_anywhere(spark, root, ["k"]).head()["status"] == "pass"


def test_empty_tables_and_state_of_other_checks(spark, tmp_path):
    root = str(tmp_path / "t")
    _table(spark, root)
    first = sinks.check_stored(spark, root, not_null=["v"])
    other = sinks.check_stored(spark, root, not_null=["k"], unique=["v"])
    assert [tuple(r) for r in first.collect()] == [("not_null", "v", "pass", 0)]
    assert [tuple(r) for r in other.collect()] == [("unique", "v", "error", 4), ("not_null", "k", "pass", 0)]
    assert checked._state(spark, root, "not_null:v").count() == 4
    for p in range(4):
        storage.delete(spark, f"{root}/p={p}")
    assert sinks.check_stored(spark, root, not_null=["v"]).head()["failures"] == 0
    assert sinks.check_unique_anywhere(spark, root, ["k"]).head()["failures"] == 0
