"""The index of key locations: what it leaves out, and what it may not leave out."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from martflow import sinks
from martflow.sinks import locations, writers
from tests.conftest import rows_of


def _table(spark, root, n=40_000, folders=16):
    """Keys are spread over all folders, so each folder has the whole key range."""
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit(0).alias("v"), (F.col("id") % folders).cast("int").alias("p"))
    sinks.write_partitions(rows, root, ["p"], mode="overwrite")
    return writers.stored_rows(spark, root)


def _spoil(root, folder):
    for file in Path(root, folder).glob("*.parquet"):
        file.write_bytes(b"no table")


def _batch(spark, *rows):
    return spark.createDataFrame(rows, "k long, v int, p int")


def test_only_files_that_can_hold_a_key_are_opened(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.index_keys(_table(spark, root), root, ["k"])
    batch = _batch(spark, (3, 1, 3), (39_987, 1, 3))
    for folder in ("p=1", "p=9"):
        _spoil(root, folder)
    sinks.upsert_path(spark, root, batch, ["k"], ["p"], index=True)
    with pytest.raises(Exception, match="parquet"):
        sinks.upsert_path(spark, root, batch, ["k"], ["p"])
    read = spark.read.schema("k long, v int").parquet(f"{root}/p=3")
    assert rows_of(read.where("v = 1"), "k") == [(3,), (39_987,)]
    assert read.count() == 2_500


def test_filters_admit_all_keys_and_few_others(spark, tmp_path):
    root = str(tmp_path / "t")
    target = _table(spark, root, n=300_000, folders=3)
    sinks.index_keys(target, root, ["k"])
    index = locations._read(spark, root, "k:bigint")
    assert {r["blocks"] for r in index.select("blocks").distinct().collect()} == {16}
    for low, high, share in ((0, 300_000, 1.0), (1_000_000, 1_000_003, 0.34)):
        for k in range(low, high, max((high - low) // 4, 1)):
            one = _batch(spark, (k, 1, 0))
            files = sinks.rows_that_may_match(target, root, one, ["k"]).select(F.col(writers.FILE)).distinct().count()
            assert files <= 3 * share
            assert share < 1 or files >= 1


def test_unknown_files_partial_entries_and_gone_files(spark, tmp_path):
    root = str(tmp_path / "t")
    target = _table(spark, root, n=30_000, folders=2)
    sinks.index_keys(target, root, ["k"])
    # Files that came by other means are read.
    more = _batch(spark, (50_000, 0, 5))
    sinks.write_partitions(more, root, ["p"], mode="append")
    sinks.upsert_path(spark, root, _batch(spark, (50_000, 7, 1)), ["k"], ["p"], index=True)
    assert rows_of(writers.stored_rows(spark, root).where("k = 50000"), "v", "p") == [(7, 1)]
    # A run that left half of its entries is as good as none.
    folder = locations._generations(spark, root)[-1]
    rows = [tuple(r) for r in locations._read(spark, root, "k:bigint").where("block = 0").collect()]
    spark.createDataFrame(rows, locations._SCHEMA).write.mode("overwrite").parquet(folder)
    assert locations._held(locations._read(spark, root, "k:bigint")).count() == 0
    got = sinks.rows_that_may_match(writers.stored_rows(spark, root), root, _batch(spark, (7, 1, 1)), ["k"])
    assert got.count() == 30_001
    # Entries of files that are gone are dropped when they outnumber the others.
    sinks.index_keys(writers.stored_rows(spark, root), root, ["k"])
    index = locations._read(spark, root, "k:bigint")
    gone = index.limit(1).crossJoin(spark.range(200)).withColumn("file", F.col("id").cast("string")).withColumn("own", F.col("rows"))
    gone.drop("id").write.mode("append").parquet(folder)
    sinks.index_keys(writers.stored_rows(spark, root), root, ["k"])
    after = locations._generations(spark, root)
    assert [f.rsplit("/", 1)[-1] for f in after] == ["set-2"]
    assert locations._held(locations._read(spark, root, "k:bigint")).count() == locations.listed_files(spark, root).count()


def test_text_keys_nulls_and_other_types(spark, tmp_path):
    root = str(tmp_path / "t")
    schema = "k string, n int, p int, v int"
    first = spark.createDataFrame([("a", 1, 1, 0), ("b", 2, 2, 0), (None, 3, 3, 0), ("", 4, 4, 0)], schema)
    sinks.upsert_path(spark, root, first, ["k", "n"], ["p"], index=True)
    second = spark.createDataFrame([("a", 1, 1, 9), (None, 3, 3, 9), ("", 4, 2, 9), ("c", 5, 1, 9)], schema)
    sinks.upsert_path(spark, root, second, ["k", "n"], ["p"], index=True)
    want = [("a", 1, 1, 9), ("b", 2, 2, 0), (None, 3, 3, 0), (None, 3, 3, 9), ("", 4, 2, 9), ("c", 5, 1, 9)]
    assert rows_of(writers.stored_rows(spark, root), "k", "n", "p", "v") == sorted(want, key=repr)
    # Wider whole numbers are the same keys; other types leave the index aside.
    target = writers.stored_rows(spark, root)
    wide = second.withColumn("n", F.col("n").cast("long"))
    assert sinks.rows_that_may_match(target, root, wide.where("k = 'a'"), ["k", "n"]).select("p").distinct().count() == 1
    other = second.withColumn("n", F.col("n").cast("double"))
    assert sinks.rows_that_may_match(target, root, other, ["k", "n"]).count() == 6
    with pytest.raises(ValueError):
        sinks.index_keys(target.withColumn("n", F.col("n").cast("double")), root, ["n"])
    nothing = second.where("false")
    assert sinks.rows_that_may_match(target, root, nothing, ["k", "n"]).count() == 0
