"""Physical plans: what is read, what moves, and what happens to a hot key."""

import contextlib
import io
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from martflow import sinks, sources
from martflow.functions import with_partitions
from martflow.operators import latest_changes, merge
from martflow.operators.merge import in_key_range, key_facts
from martflow.plans import marts
from martflow.sinks import writers
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def final_plan(df):
    """The plan as adaptive execution ended up running it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def test_ranked_latest_moves_rows_once_after_a_local_limit(orders):
    text = plan(latest_changes(orders, ["o_custkey"], "o_orderdate", method="rank"), "simple")
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1
    assert re.search(r"Exchange.*\n.*WindowGroupLimit.*Partial", text)


def test_one_row_per_key_is_limited_before_the_exchange(orders):
    text = plan(latest_changes(orders, ["o_custkey"], "o_orderdate", ties="one"), "simple")
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search(r"Exchange.*\n.*WindowGroupLimit.*row_number.*Partial", text)


def test_joined_latest_aggregates_key_and_time_only(orders):
    text = plan(latest_changes(orders, ["o_custkey"], "o_orderdate"), "simple")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text
    assert "partial_max" in text


def test_threshold_reaches_the_scan(orders):
    late = datetime(1999, 1, 1)
    text = plan(latest_changes(orders, ["o_custkey"], "o_orderdate", since=late, ties="one"))
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01T00:00)" in text


def test_hours_are_pruned(spark, tmp_path, orders):
    root = str(tmp_path / "t")
    with_partitions(orders, "o_orderdate").write.partitionBy("year", "month", "day", "hour").parquet(
        root
    )
    table = sources.scan_full(spark, root)
    kept = sources.prune_hours(table, datetime(1996, 1, 1, 5), datetime(1996, 3, 1, 0))
    text = plan(kept)
    assert re.search(r"PartitionFilters: \[.*year.*hour", text) and "PushedFilters" not in text
    expected = orders.where(
        "o_orderdate >= timestamp_ntz'1996-01-01 05:00:00' "
        "and o_orderdate <= timestamp_ntz'1996-03-01 00:00:00'"
    )
    assert rows_of(kept, "o_orderkey") == rows_of(expected, "o_orderkey")


def test_merge_reads_touched_partitions_only(spark, tmp_path, orders):
    root = str(tmp_path / "t")
    by = ["year"]
    sinks.write_partitions(
        with_partitions(orders, "o_orderdate", "year"), root, by, mode="overwrite"
    )
    stored = sources.scan_full(spark, root)
    touched = writers.partitions_of(stored.where("year in (1996, 1998)"), by)
    part = writers.in_partitions(stored, by, touched)
    assert "dynamicpruning" in plan(part).lower()
    assert {r[0] for r in part.select("year").distinct().collect()} == {1996, 1998}


def test_merge_without_time_reads_the_target_once(orders):
    changes = orders.withColumn("Op", F.lit("U"))
    text = plan(merge(orders, changes, ["o_orderkey"], on_duplicate="trust"), "simple")
    assert text.count("FileScan") == 3 and "LeftAnti" in text
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


def test_marts_count_before_they_join(spark):
    text = plan(entry.queries()["product_conversion_daily"](spark, SF), "simple")
    joins = [m.start() for m in re.finditer(r"HashJoin .* Inner", text)]
    # Plans read bottom-up: below each join with the dimension, facts are counted.
    assert len(joins) == 2 and all("partial_count" in text[j : j + 3000] for j in joins)


def test_bucketed_tables_join_without_exchange(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = final_plan(entry.queries()["bucketed_join"](spark, SF))
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_no_python_in_any_lazy_plan(spark):
    stored = {n for n, f in entry.queries().items() if f.__module__ == "suite.stored"}
    for name, fn in entry.queries().items():
        if name not in stored:
            assert "EvalPython" not in plan(fn(spark, SF), "simple"), name


@pytest.mark.parametrize(
    "name", ["full_moon_reviews", "listings_with_hosts", "product_conversion_daily", "merge_orders"]
)
def test_same_rows_without_broadcast(spark, name):
    query = entry.queries()[name]
    usual = rows_of(query(spark, SF))
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    ):
        df = query(spark, SF)
        assert "Broadcast" not in final_plan(df)
        assert rows_of(df) == usual


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "64k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "64k",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


@pytest.fixture
def hot(spark):
    """A third of the rows share one key and one, newest, time."""
    rows = spark.range(0, 120_000, 1, 8)
    is_hot = F.col("id") % 3 == 0
    return rows.select(
        F.when(is_hot, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"),
        F.when(is_hot, F.lit(10)).otherwise(F.col("id") % 7).alias("n"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )


def test_hot_tie_is_split_and_kept_whole(spark, hot):
    with settings(spark, **SKEW):
        latest = latest_changes(hot, ["k"], "n")
        text = final_plan(latest)
        assert "skew=true" in text
        assert latest.where("k = -1").count() == 40_000
        ranked = latest_changes(hot, ["k"], "n", method="rank")
        assert latest.exceptAll(ranked).isEmpty() and latest.count() == ranked.count()


def test_hot_key_of_a_merge_target_is_split(spark, hot):
    source = spark.range(10, 5000).selectExpr("id as k", "5L as n", "'s' as v")
    with settings(spark, **SKEW):
        merged = merge(hot, source, ["k"], on_duplicate="trust")
        assert "skew=true" in final_plan(merged)
        assert merged.where("k = -1").count() == 40_000


def test_hot_partition_is_written_by_several_tasks(spark, tmp_path, hot):
    path = str(tmp_path / "t")
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="256k"):
        sinks.write_partitions(
            hot.withColumn("p", (F.col("k") >= 0).cast("int")), path, ["p"], mode="overwrite"
        )
    files = spark.read.parquet(path).where("p = 0").select(F.input_file_name()).distinct().count()
    assert files > 1 and spark.read.parquet(path).where("p = 0").count() == 40_000


def test_conversion_of_a_repeated_dimension_key(spark, at):
    logs = spark.createDataFrame(
        [(1, at("01-01 10:00"), "/products?product_id=1")] * 2,
        "product_id int, timestamp timestamp_ntz, endpoint string",
    )
    orders = spark.createDataFrame(
        [(5, 1, at("01-01 11:00")), (6, 2, at("01-01 11:00")), (7, None, at("01-01 11:00"))],
        "order_id int, product_id int, order_dt timestamp_ntz",
    )
    products = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "product_id int, product_name string")
    got = marts.product_conversion_daily(logs, orders, products)
    assert rows_of(got, "product_id", "page_views", "orders", "conversion_rate") == [(1, 4, 2, 0.5)]
    # Orders without views that day: absent here, and lost by the percent mart.
    named = products.withColumnRenamed("product_name", "name").distinct()
    percent = marts.product_conversion_percent(logs, orders, named)
    assert rows_of(percent, "product_id", "view_count", "order_count", "order_date") == [
        (1, 2, 1, "20240101"),
        (2, 0, 0, None),
    ]


def test_key_range_reaches_the_scan(spark, orders):
    source = orders.where("o_orderkey between 100 and 120").cache()
    near = in_key_range(orders, key_facts(source, ["o_orderkey"]), "o_orderkey")
    assert "LessThanOrEqual(o_orderkey,120)" in plan(near) and near.count() == 21
    assert in_key_range(orders, key_facts(source.where("false"), ["o_orderkey"]), "o_orderkey").isEmpty()
    assert in_key_range(orders, key_facts(source, ["o_orderdate"]), "o_orderdate").count() == orders.count()
