"""Joins with frequent keys and sorts with long ties: the same rows, spread over tasks."""

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from martflow import sinks
from martflow.operators import frequent_keys, skewed_join
from tests.conftest import rows_of


@pytest.fixture
def plain(spark):
    """No runtime help: what is spread is spread by the join itself."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _sides(spark, n=30_000):
    key = F.expr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 3 = 1 AND id % 2 = 0 THEN NULL ELSE id % 1000 END")
    left = spark.range(n).select(key.alias("k"), F.col("id").alias("row"))
    # Key 5 and others have no, one or several rows on the right, and there is a NULL.
    right = spark.range(1_200).where("id % 7 <> 0").select((F.col("id") % 900).alias("k"), F.col("id").alias("name"))
    nulls = spark.createDataFrame([(None, -1), (5, -5)], "k long, name long")
    return left, right.union(nulls)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [100_000, 0])
def test_rows_of_a_plain_join(spark, how, most):
    left, right = _sides(spark, 6_000)
    got = skewed_join(left, right, ["k"], how, broadcast_rows=most)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_hot_keys_are_found_and_spread(spark, plain):
    left, right = _sides(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # ``plain`` sets it back
    found = frequent_keys(left, ["k"], 0.05)
    assert len(found) == 2 and sum(found.values()) == pytest.approx(0.5, abs=0.01)
    joined = skewed_join(left, right, ["k"], "left", broadcast_rows=0)
    hot = joined.where("k = 5 OR k IS NULL")
    sizes = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    # Salts of a key can meet in a task; whole keys would put all rows in one or two.
    assert len(sizes) >= 32 and max(sizes) <= 5 * median(sizes) and max(sizes) < hot.count() / 8
    worst = left.join(right, ["k"], "left").where("k = 5").groupBy(F.spark_partition_id()).count().count()
    assert worst == 1


def test_bucketed_sides_are_not_exchanged(spark, plain, tmp_path):
    left, right = _sides(spark)
    sinks.ensure_database(spark, "skewed", str(tmp_path / "db"))
    sinks.write_bucketed(left, "skewed.l", 8, ["k"], path=str(tmp_path / "l"))
    sinks.write_bucketed(right, "skewed.r", 8, ["k"], path=str(tmp_path / "r"))
    joined = skewed_join(spark.table("skewed.l"), spark.table("skewed.r"), ["k"], "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastExchange") >= 1
    assert joined.count() == left.join(right, ["k"], "left").count()


def test_odd_cases(spark):
    left, right = _sides(spark, 300)
    none = left.where("false")
    assert skewed_join(none, right, ["k"]).count() == 0
    assert skewed_join(left, right.where("false"), ["k"], "left").count() == 300
    same = left.select(F.lit(1).cast("long").alias("k"), F.lit("x").alias("v"))
    assert skewed_join(same, same.limit(2).withColumnRenamed("v", "w"), ["k"], broadcast_rows=0).count() == 600
    with pytest.raises(ValueError):
        skewed_join(left, right, ["k"], "full")
    with pytest.raises(TypeError):
        skewed_join(left, right.withColumn("k", F.col("k").cast("int")), ["k"])
    assert rows_of(skewed_join(left, right, ["k"], "left_anti", frequent={}), "row") == rows_of(left.join(right, "k", "left_anti"), "row")


def test_a_report_of_ties_is_spread_and_keeps_its_order(spark, plain, tmp_path):
    n = 20_000
    rows = spark.range(n).select(
        F.expr("CASE WHEN id % 10 = 0 THEN concat('2024-01-0', id % 9 + 1) END").alias("d"),
        F.expr("CASE WHEN id % 10 = 0 THEN id % 50 / 2.0 ELSE 0 END").alias("rate"),
        F.xxhash64("id").alias("product"),
    )
    order = [F.col("d").desc(), F.col("rate").desc()]
    for i, ties in enumerate((["product"], [])):
        path = str(tmp_path / f"report{i}")
        sinks.write_sorted(rows, path, order, ties=ties)
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_name").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * median(sizes)
        got = sorted(map(tuple, sinks.read_sorted(spark, path).select("position", "d", "rate", "product").collect()))
        assert [g[0] for g in got] == list(range(1, n + 1))
        keys = [(g[1] is not None, g[1] or "", g[2]) for g in got]
        assert keys == sorted(keys, reverse=True)
        if ties:
            tied = [g[3] for g in got if g[1] is None]
            assert tied == sorted(tied)
    sinks.write_sorted(rows.where("false"), path, order)
    assert sinks.read_sorted(spark, path).count() == 0
