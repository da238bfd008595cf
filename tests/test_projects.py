import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from martflow.operators.merge import DuplicateKeys
from martflow.functions import with_partitions
from martflow.plans import Project, digests, listings_project, models, projects, shop_project
from martflow.sources.catalog import discover_table, register_partitions
from suite import inputs
from tests.conftest import rows_of
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shop(spark):
    return {
        "customers": inputs.shop_customers(spark, SF),
        "products": inputs.shop_products(spark, SF),
        "orders": inputs.shop_orders(spark, SF),
        "access_log": entry.QUERIES["parse_access_log"](spark, SF).drop("event_id"),
    }


def test_whole_shop(spark, tmp_path, shop):
    project = shop_project(spark, str(tmp_path), shop, prefix="ps_")
    frames = project.run()
    assert len(frames) == 10
    again = project.run()
    for name in ("fact_orders", "fact_accesslog", "info_product_conversion_rate"):
        assert again[name].count() == frames[name].count()
    assert "password" not in again["stg_customer"].columns
    tables = {t.name for t in spark.catalog.listTables("ps_mart") if not t.isTemporary}
    assert tables == {"dim_customer", "dim_product", "fact_accesslog", "fact_orders"}


def test_updated_order_moves_day(spark, tmp_path, shop):
    project = shop_project(spark, str(tmp_path), shop, prefix="pm_")
    project.run(["fact_orders"])
    orders = shop["orders"]
    one = orders.agg(F.min("order_id")).head()[0]
    moved = orders.where(F.col("order_id") == one).withColumn(
        "order_dt", F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz")
    )
    project.source("orders", moved)
    facts = project.run(["fact_orders"])["fact_orders"]
    assert facts.count() == orders.count()
    assert rows_of(facts.where(F.col("order_id") == one), "month", "day") == [(6, 1)]


def test_repeated_order_fails_the_merge(spark, tmp_path, shop):
    shop["orders"] = shop["orders"].union(shop["orders"])
    project = shop_project(spark, str(tmp_path), shop, prefix="pr_", orders_by=())
    with pytest.raises(DuplicateKeys):
        project.run(["fact_orders"])


def test_listings(spark, tmp_path):
    given = {
        "listings": inputs.raw_listings(spark, SF),
        "hosts": inputs.raw_hosts(spark, SF),
        "reviews": inputs.raw_reviews(spark, SF),
        "full_moons": inputs.full_moons(spark, SF),
    }
    project = listings_project(spark, str(tmp_path), given, prefix="pl_")
    frames = project.run()
    con = connect(SF)
    for name, query in {
        "dim_listings_w_hosts": "listings_with_hosts",
        "full_moon_reviews": "full_moon_reviews",
    }.items():
        assert compare(frames[name], con, entry.ORACLES[query]) == []
    fresh = projects.source_freshness(project, "reviews", "date", datetime(2024, 3, 1))
    assert fresh.head()["status"] == "error"


@pytest.mark.parametrize("zone", ["Asia/Seoul", "America/New_York"])
def test_results_do_not_depend_on_the_session_zone(spark, zone):
    con = connect(SF)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in (
            "parse_access_log",
            "product_conversion_percent",
            "customer_conversion_daily",
            "hourly_partitions",
            "change_envelope",
            "latest_event_since",
            "bookmarks",
            "freshness_check",
        ):
            assert compare(entry.QUERIES[name](spark, SF), con, entry.ORACLES[name]) == [], name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


LOG = "id int, at timestamp_ntz, v double"


def _log_project(spark, root, prefix, rows):
    project = Project(spark, root, prefix)
    project.source("log", spark.createDataFrame(rows, LOG))

    @project.model("facts", refs=["log"], materialized="append", ts="at", late="all", partition_by=["month", "day"])
    def _(ctx):
        return with_partitions(ctx.ref("log"), "at", "day").drop("year")

    return project


def _files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet") if "_digests" not in str(p)}


def test_append_looks_into_days_that_differ_only(spark, tmp_path, at, monkeypatch):
    root = str(tmp_path)
    rows = [(1, at("01-01 05:00"), 1.0), (2, at("01-02 05:00"), 2.0), (2, at("01-02 05:00"), 2.0), (3, None, 0.0), (4, at("01-03 05:00"), 4.0)]
    assert _log_project(spark, root, "pd_", rows).run()["facts"].count() == 5
    first = _files(root)
    # A file that nobody must open, and no listing of all partitions after the first run.
    (untouched,) = [f for f in first if "day=1/" in f]
    whole = Path(untouched).read_bytes()
    Path(untouched).write_bytes(b"not a Parquet file")
    monkeypatch.setattr(models, "discover_table", None)
    rows += [(2, at("01-02 05:00"), 2.0), (5, at("01-02 01:00"), 5.0), (6, at("01-04 00:00"), -0.0)]
    _log_project(spark, root, "pd_", rows).run()
    Path(untouched).write_bytes(whole)
    for path, time in first.items():
        assert path == untouched or _files(root)[path] == time
    facts = spark.table("pd_mart.facts")
    spark.catalog.refreshTable("pd_mart.facts")
    assert rows_of(facts, "id") == [(1,), (2,), (2,), (2,), (3,), (4,), (5,), (6,)]
    # Nothing new: nothing is written.
    before = _files(root)
    _log_project(spark, root, "pd_", rows).run()
    assert _files(root) == before


def test_append_after_a_run_that_ended_before_its_digests(spark, tmp_path, at, monkeypatch):
    rows = [(1, at("01-01 05:00"), 1.0), (2, at("01-02 05:00"), 2.0)]
    _log_project(spark, str(tmp_path), "pl_", rows).run()
    rows += [(3, at("01-02 06:00"), 3.0), (4, at("01-05 06:00"), 4.0)]
    monkeypatch.setattr(models, "keep_digests", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        _log_project(spark, str(tmp_path), "pl_", rows).run()
    monkeypatch.undo()
    facts = _log_project(spark, str(tmp_path), "pl_", rows).run()["facts"]
    assert rows_of(facts, "id") == [(1,), (2,), (3,), (4,)]


def test_digests_tell_multisets_apart(spark):
    rows = lambda *ids: spark.createDataFrame([(i, None, float(i)) for i in ids], LOG)
    digest = lambda df: digests.row_digests(df.withColumn("p", F.lit(1)), ["p"], ["id", "v"]).first()
    assert digest(rows(1, 2, 3)) == digest(rows(3, 1, 2).repartition(3))
    assert len({digest(rows(*ids)) for ids in ((1, 2), (1, 1, 2), (1, 2, 2), (1, 3), ())}) == 5


def test_registered_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a'b"), (2, "c d/e"), (3, None), (4, "x")], "id int, p string")
    df.where("id = 4").write.partitionBy("p").parquet(path)
    discover_table(spark, path, "registered_parts")
    df.where("id < 4").write.mode("append").partitionBy("p").parquet(path)
    assert register_partitions(spark, "registered_parts", df.select("p"), page=2) == 3
    assert rows_of(spark.table("registered_parts"), "id") == [(1,), (2,), (3,), (4,)]
    spark.sql("DROP TABLE registered_parts")


def _rate_project(spark, root, prefix, seen, sold, names):
    project = Project(spark, root, prefix)
    for name, rows, schema in (("log", seen, LOG), ("orders", sold, LOG), ("names", names, "id int, name string")):
        project.source(name, spark.createDataFrame(rows, schema))
    days = ["year", "month", "day"]

    @project.model("seen", refs=["log"], materialized="append", ts="at", late="all", partition_by=days)
    def _(ctx):
        return with_partitions(ctx.ref("log"), "at", "day")

    @project.model("sold", refs=["orders"], materialized="merge", keys=["id"], partition_by=days)
    def _(ctx):
        return with_partitions(ctx.ref("orders"), "at", "day")

    @project.model("rates", refs=["seen", "sold", "names"], materialized="daily", partition_by=days)
    def _(ctx):
        count = lambda df, n: df.groupBy("id", *days).agg(F.count(F.lit(1)).alias(n))
        views = count(ctx.ref("seen"), "views").join(ctx.ref("names"), "id")
        return views.join(count(ctx.ref("sold"), "orders"), ["id", *days], "left").select("id", "name", "views", "orders", *days)

    return project


def test_rates_of_changed_days_only(spark, tmp_path, at):
    root, names = str(tmp_path), [(i, f"n{i}") for i in range(9)]
    seen = [(i, at(f"01-{d:02d} 05:00"), 0.0) for d in range(1, 6) for i in range(4)] + [(7, at("01-09 00:00"), 0.0)]
    sold = [(0, at("01-01 06:00"), 1.0), (1, at("01-02 06:00"), 1.0), (2, at("01-03 06:00"), 1.0)]

    def run(*args):
        frame = _rate_project(spark, root, "pr2_", *args).run()["rates"]
        files = _files(f"{root}/pr2_mart/rates")
        return rows_of(frame), {f: t for f, t in files.items() if "_inputs" not in f}

    _, first = run(seen, sold, names)
    # One late view on the 4th; one order moves from the 2nd to the 5th; the
    # views of the 9th are written anew by somebody else.
    (again,) = [f for f in _files(f"{root}/pr2_mart/seen") if "day=9/" in f]
    os.utime(again, ns=(10**18, 10**18))
    seen, moved = [*seen, (3, at("01-04 23:00"), 0.0)], [(1, at("01-05 06:00"), 1.0)]
    got, second = run(seen, moved, names)
    changed = [f"day={d}/" for d in (2, 4, 5, 9)]
    assert {f: t for f, t in first.items() if not any(d in f for d in changed)}.items() <= second.items()
    assert all(f not in second for f in first if any(d in f for d in changed))
    # As made from all facts at once.
    whole = _rate_project(spark, f"{root}/whole", "pw2_", seen, [sold[0], *moved, sold[2]], names)
    assert got == rows_of(whole.run()["rates"]) and len(got) == 21
    # Another name: every day is made again.
    _, third = run(seen, [], [(i, f"N{i}") for i in range(9)])
    assert len(third) == len(second) and not set(third) & set(second)
