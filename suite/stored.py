"""Queries that write to the shared folder and read back: sources, sinks, tables,
bookmarks, models, jobs, streams.  Each call uses a new folder."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from martflow import operators as op, sinks, sources, storage, streaming
from martflow.functions import parse_access_log, with_partitions
from martflow.plans import Project, jobs, listings_project, marts, shop_project
from martflow.session import scratch_dir
from martflow.sinks import writers
from suite.inputs import (
    CHANGES_SQL,
    LISTINGS_SQL,
    LOG_FIELDS_SQL,
    LOG_PARTS_SQL,
    LOGS_SQL,
    SHOP_SQL,
    access_lines,
    full_moons,
    given,
    order_changes,
    order_target,
    raw_hosts,
    raw_listings,
    raw_reviews,
    shop_customers,
    shop_orders,
    shop_products,
)
from suite.marts import (
    _ANY,
    _CLEAN_SQL,
    _DIM_CUSTOMER_SQL,
    _DIM_PRODUCT_SQL,
    _MOONS_SQL,
    _PERCENT_SQL,
    _conversion_sql,
    _staged_logs,
)
from suite.registry import query

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_HOURS = ("year", "month", "day", "hour")
_MID = datetime(2024, 1, 16)


def _span(spark, sf):
    """First and last time of the events: no query is bound to a month."""
    return tuple(given(spark, sf, "events").agg(F.min("ts"), F.max("ts")).head())


def _name(spark, label):
    """A new table name in a database of this suite, and a folder for it."""
    sinks.ensure_database(spark, "martflow_suite", scratch_dir(spark, "suite-db"))
    return f"martflow_suite.{label}_{uuid.uuid4().hex[:10]}", scratch_dir(spark, label)


def _landed_lines(spark, sf, root):
    """Raw lines in hour folders by arrival time, as a landing writes them."""
    rows = streaming.hourly_rows(access_lines(spark, sf), "ts", tz="UTC")
    rows = rows.select("@timestamp", "log", *_HOURS)
    sinks.cluster_for_write(rows, _HOURS).write.partitionBy(*_HOURS).json(root)


# --- scans -----------------------------------------------------------------


@query(
    "scan_hours_json",
    f"WITH {LOGS_SQL} SELECT log FROM lines",
)
def scan_hours_json(spark, sf):
    """SRC-1: hours without a folder are skipped here, as the data has gaps at its ends."""
    root = scratch_dir(spark, "raw-log")
    _landed_lines(spark, sf, root)
    return sources.scan_hours(spark, root, *_span(spark, sf), missing="skip").select("log")


@query("scan_hours_parquet", "SELECT event_id, user_id, event_type, ts FROM events")
def scan_hours_parquet(spark, sf):
    """SRC-2."""
    root = scratch_dir(spark, "raw-events")
    events = given(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    landed = with_partitions(events, "ts")
    sinks.write_partitions(landed, root, _HOURS, mode="overwrite")
    found = sources.scan_hours(spark, root, *_span(spark, sf), fmt="parquet", missing="skip")
    return found.drop(*_HOURS)


@query(
    "prune_hours",
    """
SELECT event_id, ts FROM events
WHERE ts >= timestamp '2024-01-10 05:00:00' AND ts < timestamp '2024-01-20 18:00:00'""",
)
def prune_hours(spark, sf):
    """SRC-1, SRC-10: range of hours of a table, by partition pruning."""
    root = scratch_dir(spark, "events")
    events = with_partitions(given(spark, sf, "events").select("event_id", "ts"), "ts")
    sinks.write_partitions(events, root, _HOURS, mode="overwrite")
    table = sources.scan_full(spark, root)
    kept = sources.prune_hours(table, datetime(2024, 1, 10, 5), datetime(2024, 1, 20, 17))
    return kept.select("event_id", "ts")


def _land_days(spark, rows, ts, root):
    """``yyyy/MM/dd`` folders: one write per level name, done by Spark in one job."""
    day = rows.withColumns(
        {p: F.date_format(ts, f) for p, f in {"y": "yyyy", "m": "MM", "d": "dd"}.items()}
    )
    staged = scratch_dir(spark, "days")
    sinks.write_partitions(day, staged, ["y", "m", "d"], mode="overwrite")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    from martflow import storage

    for folder in storage.folders(spark, f"{staged}/y=*/m=*/d=*"):
        y, m, d = (part.split("=")[1] for part in folder.split("/")[-3:])
        fs.mkdirs(path(f"{root}/{y}/{m}"))
        fs.rename(path(folder), path(f"{root}/{y}/{m}/{d}"))


@query(
    "scan_days",
    """
SELECT event_id, ts FROM events WHERE ts >= timestamp '2024-01-11 00:00:00'""",
)
def scan_days(spark, sf):
    """SRC-3: a bookmark of 12 January 07:00 in Korea starts on the 11th in UTC."""
    root = scratch_dir(spark, "day-folders")
    _land_days(spark, given(spark, sf, "events").select("event_id", "ts"), "ts", root)
    return sources.scan_days(spark, root, datetime(2024, 1, 12, 7), datetime(2024, 1, 31, 10))


@query(
    "scan_days_lookback",
    """
SELECT event_id, ts FROM events WHERE ts >= timestamp '2024-01-05 00:00:00'""",
)
def scan_days_lookback(spark, sf):
    """SRC-4, BMK-5: no bookmark, thirty days back, one zone."""
    root = scratch_dir(spark, "day-folders")
    _land_days(spark, given(spark, sf, "events").select("event_id", "ts"), "ts", root)
    return sources.scan_days(
        spark,
        root,
        None,
        datetime(2024, 2, 4, 10),
        lookback=timedelta(days=30),
        source_tz="UTC",
        local_tz="UTC",
    )


@query(
    "scan_full_declared",
    "SELECT o_orderkey, o_orderdate, year(o_orderdate)::integer AS year FROM orders",
)
def scan_full_declared(spark, sf):
    """SRC-5, SRC-6: partition discovery and a declared schema."""
    root = scratch_dir(spark, "orders")
    orders = with_partitions(given(spark, sf, "orders"), "o_orderdate", "year")
    sinks.write_partitions(orders, root, ["year"], mode="overwrite")
    schema = "o_orderkey bigint, o_orderdate timestamp_ntz, year int"
    return sources.scan_full(spark, root, schema)


@query(
    "scan_csv",
    """
SELECT o_orderkey, o_orderpriority, date_trunc('second', o_orderdate) AS o_orderdate, o_totalprice
FROM orders""",
)
def scan_csv(spark, sf):
    """SRC-11: delimited files with a header and a declared schema."""
    root = scratch_dir(spark, "csv")
    orders = given(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"
    )
    orders.write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss"
    ).csv(root)
    schema = (
        "o_orderkey bigint, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double"
    )
    return sources.scan_csv(spark, root, schema)


@query(
    "seed_days",
    """
SELECT event_id, CASE WHEN cast(ts AS date) - 1 IN
  (SELECT cast(ts AS date) FROM events WHERE dayofweek(ts) = 1) THEN 'yes' ELSE 'no' END
  AS is_flagged FROM events""",
)
def seed_days(spark, sf):
    """SRC-12: dates kept as CSV, joined by day offset."""
    root = scratch_dir(spark, "seed")
    events = given(spark, sf, "events")
    days = events.where(F.dayofweek("ts") == 2).select(F.to_date("ts").alias("day")).distinct()
    days.write.option("header", True).csv(root)
    seeds = sources.seed(spark, root, "day date")
    return op.join_on_shifted_day(events.select("event_id", "ts"), "ts", seeds, "day").drop("ts")


@query(
    "scan_catalog",
    "SELECT o_orderkey, o_totalprice, year(o_orderdate)::integer AS year FROM orders",
)
def scan_catalog(spark, sf):
    """SRC-9, SRC-10, SRC-19: files found, registered, and read by catalog facts alone."""
    name, root = _name(spark, "found")
    orders = with_partitions(given(spark, sf, "orders"), "o_orderdate", "year")
    sinks.write_partitions(orders, root, ["year"], mode="overwrite")
    sources.discover_table(spark, root, name)
    return sources.scan_catalog(spark, name).select("o_orderkey", "o_totalprice", "year")


@query("external_tables", "SELECT c_custkey, c_name FROM customer")
def external_tables(spark, sf):
    """SRC-16: folders exposed under a database."""
    label = f"customer_{uuid.uuid4().hex[:10]}"
    names = sources.register_external(
        spark,
        "martflow_ext",
        {label: f"{sf}/customer.parquet"},
        location=scratch_dir(spark, "suite-ext"),
    )
    return sources.table(spark, names[label]).select("c_custkey", "c_name")


@query(
    "unprocessed_files",
    "SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_acctbal < 0",
)
def unprocessed_files(spark, sf):
    """SRC-8: three loads of a folder, each reading only the files not yet in the ledger.

    The second load finds nothing new, the third finds the files added since.
    """
    root, ledger = scratch_dir(spark, "inbox"), scratch_dir(spark, "ledger")
    out = scratch_dir(spark, "loaded")
    customer = given(spark, sf, "customer")
    batches = [customer, None, customer.where("c_acctbal < 0")]
    for hour, batch in enumerate(batches):
        if batch is not None:
            batch.write.mode("append").parquet(root)
        new = sources.unprocessed_files(spark, root, ledger)
        sources.read_unprocessed(spark, new, customer.schema).write.mode("append").parquet(out)
        sources.mark_processed(new, ledger, datetime(2024, 1, 1, hour))
    return spark.read.parquet(out)


@query(
    "paged_files",
    """
SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_acctbal < 0
UNION ALL SELECT * FROM customer WHERE c_acctbal >= 0""",
)
def paged_files(spark, sf):
    """SRC-8: four loads of a folder in pages of two files, oldest first; each load looks at
    an hour before the newest file read only."""
    root, ledger = scratch_dir(spark, "inbox"), scratch_dir(spark, "ledger")
    out = scratch_dir(spark, "loaded")
    customer = given(spark, sf, "customer")
    customer.limit(0).write.parquet(out)
    batches = [customer.repartition(3), None, customer.where("c_acctbal < 0"), customer.where("c_acctbal >= 0")]
    for hour, batch in enumerate(batches):
        if batch is not None:
            batch.write.mode("append").parquet(root)
        while True:
            page = sources.next_files(spark, root, ledger, timedelta(hours=1), page=2).persist()
            if page.isEmpty():
                break
            sources.read_unprocessed(spark, page, customer.schema).write.mode("append").parquet(out)
            sources.mark_files(page, ledger, datetime(2024, 1, 1, hour))
            page.unpersist()
    return spark.read.parquet(out)


# --- sinks -----------------------------------------------------------------


@query(
    "overwrite_partitions",
    """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE year(o_orderdate) <= 1999
UNION ALL SELECT o_orderkey, o_orderdate, o_totalprice + 1 FROM orders
WHERE year(o_orderdate) > 1999""",
)
def overwrite_partitions(spark, sf):
    """SNK-1, SNK-4: only the batch's partitions are replaced."""
    root = scratch_dir(spark, "orders")
    orders = given(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    orders = with_partitions(orders, "o_orderdate", "year")
    sinks.write_partitions(orders, root, ["year"], mode="overwrite")
    batch = orders.where("year > 1999").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    sinks.write_partitions(batch, root, ["year"], mode="overwrite_partitions")
    return sources.scan_full(spark, root).drop("year")


@query("overwrite_all", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) > 1999")
def overwrite_all(spark, sf):
    """SNK-2: everything is replaced."""
    root = scratch_dir(spark, "orders")
    orders = given(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    orders = with_partitions(orders, "o_orderdate", "year")
    sinks.write_partitions(orders, root, ["year"], mode="overwrite")
    sinks.write_partitions(orders.where("year > 1999"), root, ["year"], mode="overwrite")
    return sources.scan_full(spark, root).drop("year")


@query("merge_partitions", "SELECT event_id, ts, event_type FROM events")
def merge_partitions(spark, sf):
    """SNK-3: late rows add to their hour.

    Purchases arrive after the rest, together with rows that were there before.
    """
    root = scratch_dir(spark, "events")
    events = with_partitions(
        given(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", "day"
    )
    days = ["year", "month", "day"]
    sinks.write_partitions(events.where("event_type <> 'purchase'"), root, days, keys=["event_id"])
    late = events.where("event_type in ('purchase', 'view')")
    sinks.write_partitions(late, root, days, keys=["event_id"])
    return sources.scan_full(spark, root).drop(*days)


@query("compacted", "SELECT event_id, ts, value FROM events")
def compacted(spark, sf):
    """Many small files per partition become few; rows stay."""
    root = scratch_dir(spark, "events")
    events = given(spark, sf, "events").select("event_id", "ts", "value")
    with_partitions(events, "ts", "month").repartition(16).write.partitionBy(
        "year", "month"
    ).parquet(root)
    sinks.compact(spark, root, ["year", "month"])
    return sources.scan_full(spark, root).drop("year", "month")


@query("created_table", f"SELECT {_ORDERS} FROM orders")
def created_table(spark, sf):
    """SNK-5, SNK-6, SNK-8: create as select; creating again writes nothing."""
    name, root = _name(spark, "created")
    orders = given(spark, sf, "orders")
    made = sinks.create_table(
        spark,
        name,
        with_partitions(orders, "o_orderdate", "year"),
        partition_by=["year"],
        sort_within=["o_orderdate"],
        properties={"layer": "stg"},
        path=root,
    )
    again = sinks.create_table(spark, name, orders.where("o_orderkey > 5"))
    assert made and not again
    return sources.table(spark, name).drop("year")


@query("inserted_rows", "SELECT c_custkey, c_name FROM customer")
def inserted_rows(spark, sf):
    """SNK-7, SNK-9, SNK-10: declared table, insert by name."""
    name, root = _name(spark, "inserted")
    sinks.create_table(spark, name, "c_custkey bigint, c_name string", path=root)
    swapped = given(spark, sf, "customer").select("c_name", "c_custkey")
    sinks.insert_into(swapped, name)
    assert name.split(".")[1] in sinks.list_tables(spark, "martflow_suite")
    rows = spark.read.parquet(root)
    gone, other = _name(spark, "dropped")
    sinks.create_table(spark, gone, "c_custkey bigint", path=other)
    sinks.drop_table(spark, gone)
    assert gone.split(".")[1] not in sinks.list_tables(spark, "martflow_suite")
    return rows


@query("published_table", "SELECT p_partkey, p_name FROM part")
def published_table(spark, sf):
    """MDL-3: a table replaced in one step, the second time by rows read from itself."""
    name, root = _name(spark, "published")
    part = given(spark, sf, "part").select("p_partkey", "p_name")
    sinks.publish(part.where("p_size > 25"), name, root)
    rest = part.where("p_size <= 25")
    sinks.publish(sources.table(spark, name).unionByName(rest), name, root)
    return sources.table(spark, name)


@query(
    "bucketed_join",
    """
SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders
JOIN lineitem ON l_orderkey = o_orderkey""",
)
def bucketed_join(spark, sf):
    """JN-8, MDL-8: both sides bucketed by the join key."""
    left, left_root = _name(spark, "orders_bucketed")
    right, right_root = _name(spark, "lines_bucketed")
    orders = given(spark, sf, "orders").select("o_orderkey", "o_custkey")
    line = given(spark, sf, "lineitem").selectExpr(
        "l_orderkey as o_orderkey", "l_linenumber", "l_quantity"
    )
    sinks.write_bucketed(orders, left, 8, ["o_orderkey"], path=left_root)
    sinks.write_bucketed(line, right, 8, ["o_orderkey"], path=right_root)
    return sources.table(spark, left).join(sources.table(spark, right), "o_orderkey")


@query(
    "skewed_join",
    """
SELECT e.event_id, e.o_custkey, c.c_name, e.value FROM (SELECT event_id, value,
    CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN NULL ELSE user_id END AS o_custkey
  FROM events) e LEFT JOIN customer c ON c.c_custkey = e.o_custkey""",
)
def skewed_join(spark, sf):
    """JN-8, MDL-8: bucketed sides; one key and NULL hold a third of the rows each."""
    left, left_root = _name(spark, "events_bucketed")
    right, right_root = _name(spark, "customers_bucketed")
    key = F.expr("CASE event_id % 3 WHEN 0 THEN 1 WHEN 2 THEN user_id END")
    events = given(spark, sf, "events").select("event_id", "value", key.cast("bigint").alias("o_custkey"))
    customers = given(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("o_custkey"), "c_name")
    sinks.write_bucketed(events, left, 8, ["o_custkey"], path=left_root)
    sinks.write_bucketed(customers, right, 8, ["o_custkey"], path=right_root)
    return op.skewed_join(sources.table(spark, left), sources.table(spark, right), ["o_custkey"], "left")


@query(
    "percent_report",
    f"""
SELECT *, row_number() OVER (ORDER BY order_date DESC NULLS LAST, conversion_rate DESC, product_id, view_count) AS position
FROM ({_PERCENT_SQL})""",
)
def percent_report(spark, sf):
    """SRT-1, MART-1: the sorted report, written and read back with each row's place."""
    logs = _staged_logs(spark, sf)
    mart = marts.product_conversion_percent(logs, shop_orders(spark, sf), shop_products(spark, sf))
    root = scratch_dir(spark, "report")
    order = [F.col("order_date").desc(), F.col("conversion_rate").desc()]
    sinks.write_sorted(mart, root, order, ties=["product_id", "view_count"])
    return sinks.read_sorted(spark, root)


_CHECKED_SQL = """
WITH t AS (SELECT o_orderkey, o_custkey FROM orders UNION ALL
  SELECT o_orderkey, nullif(o_custkey % 5, 0) FROM orders WHERE year(o_orderdate) = 1995),
n AS (SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM t GROUP BY 1 HAVING count(*) > 1)) AS twice,
  (SELECT count(*) FROM t WHERE o_custkey IS NULL) AS nulls)
SELECT 'unique' AS "check", 'o_orderkey' AS target, if(twice = 0, 'pass', 'error') AS status, twice AS failures FROM n
UNION ALL SELECT 'not_null', 'o_custkey', if(nulls = 0, 'pass', 'error'), nulls FROM n
UNION ALL SELECT 'unique', 'o_orderkey', if(twice = 0, 'pass', 'error'), twice FROM n"""


@query("checked_partitions", _CHECKED_SQL)
def checked_partitions(spark, sf):
    """CHK-1, CHK-2: a second run reads the partition that has changed, and of the others
    only files that can hold its keys."""
    root = scratch_dir(spark, "orders")
    orders = with_partitions(given(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "year")
    sinks.write_partitions(orders, root, ["year"], mode="overwrite")

    def run():
        sinks.index_keys(writers.stored_rows(spark, root), root, ["o_orderkey"])
        here = sinks.check_stored(spark, root, unique=["o_orderkey"], not_null=["o_custkey"])
        return here.union(sinks.check_unique_anywhere(spark, root, ["o_orderkey"]))

    run()
    more = orders.where("year = 1995").withColumn("o_custkey", F.expr("nullif(o_custkey % 5, 0)"))
    sinks.write_partitions(more, root, ["year"], mode="append")
    return run()


# --- merge into stored tables ----------------------------------------------

_MERGED_SQL = f"""
WITH {CHANGES_SQL}
SELECT {_ORDERS} FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL SELECT {_ORDERS} FROM changes WHERE coalesce("Op", 'I') <> 'D'"""


@query("upsert_path", _MERGED_SQL)
def upsert_path(spark, sf):
    """MRG-1, MRG-2: touched partitions rewritten; the same batch twice."""
    root = scratch_dir(spark, "orders")
    target = with_partitions(order_target(spark, sf), "o_orderdate", "month")
    parts = ["year", "month"]
    sinks.write_partitions(target, root, parts, mode="overwrite")
    changes = with_partitions(order_changes(spark, sf), "o_orderdate", "month")
    for _ in range(2):
        sinks.upsert_path(spark, root, changes, ["o_orderkey"], parts)
    return sources.scan_full(spark, root).drop(*parts)


@query("upsert_indexed", _MERGED_SQL)
def upsert_indexed(spark, sf):
    """MRG-1: spread keys are looked up in filters of the table's files; two batches, the
    first without updates, and both again."""
    root = scratch_dir(spark, "orders")
    target = with_partitions(order_target(spark, sf), "o_orderdate", "month")
    parts = ["year", "month"]
    sinks.write_partitions(target, root, parts, mode="overwrite")
    changes = with_partitions(order_changes(spark, sf), "o_orderdate", "month")
    plain = F.coalesce(F.col("Op"), F.lit("I")) == "I"
    for batch in (changes.where(plain), changes.where(~plain), changes):
        sinks.upsert_path(spark, root, batch, ["o_orderkey"], parts, index=True)
    return sources.scan_full(spark, root).drop(*parts)


@query(
    "moved_rows",
    """
SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN o_orderdate + INTERVAL 2 YEAR
  ELSE o_orderdate END AS o_orderdate FROM orders""",
)
def moved_rows(spark, sf):
    """MRG-1: updates empty one partition and fill another."""
    root = scratch_dir(spark, "orders")
    orders = given(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    sinks.write_partitions(
        with_partitions(orders, "o_orderdate", "year"), root, ["year"], mode="overwrite"
    )
    moved = orders.where("year(o_orderdate) = 1996")
    moved = moved.withColumn("o_orderdate", F.col("o_orderdate") + F.expr("interval 2 years"))
    batch = with_partitions(moved, "o_orderdate", "year")
    sinks.upsert_path(spark, root, batch, ["o_orderkey"], ["year"], batch_id=uuid.uuid4().hex)
    return sources.scan_full(spark, root).drop("year")


@query(
    "dropped_partitions",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) NOT IN (1996, 1997)",
)
def dropped_partitions(spark, sf):
    """MRG-6: partitions the source dropped leave the stored table."""
    root = scratch_dir(spark, "orders")
    orders = given(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    sinks.write_partitions(
        with_partitions(orders, "o_orderdate", "year"), root, ["year"], mode="overwrite"
    )
    sinks.drop_partitions(spark, root, ["year"], "year in (1996, 1997)")
    return sources.scan_full(spark, root).drop("year")


@query(
    "reloaded_table",
    "SELECT o_orderkey, o_orderdate, 'web' AS o_channel FROM orders",
)
def reloaded_table(spark, sf):
    """MRG-5: a full reload after the source's columns changed."""
    root = scratch_dir(spark, "orders")
    orders = with_partitions(given(spark, sf, "orders"), "o_orderdate", "year")
    sinks.write_partitions(orders, root, ["year"], mode="overwrite")
    fresh = orders.select("o_orderkey", "o_orderdate", F.lit("web").alias("o_channel"), "year")
    sinks.reload(fresh, root, ["year"])
    return sources.scan_full(spark, root).drop("year")


_TEXT_MONTHS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 OR month(o_orderdate) = 3
  THEN lpad(cast(month(o_orderdate) % 12 + 1 AS varchar), 2, '0')
  ELSE lpad(cast(month(o_orderdate) AS varchar), 2, '0') END AS o_month
FROM orders WHERE o_orderkey % 10 <> 2"""


@query("upsert_text_partitions", _TEXT_MONTHS_SQL)
def upsert_text_partitions(spark, sf):
    """MRG-1, MRG-2: rows move and go between folders named by zero-padded text; one
    folder is emptied."""
    root = scratch_dir(spark, "orders")
    month = F.lpad(F.month("o_orderdate").cast("string"), 2, "0")
    orders = given(spark, sf, "orders").select("o_orderkey", month.alias("o_month"))
    sinks.upsert_path(spark, root, orders, ["o_orderkey"], ["o_month"])
    following = F.lpad((F.col("o_month").cast("int") % 12 + 1).cast("string"), 2, "0")
    gone = F.col("o_orderkey") % 10 == 2
    changed = orders.where(gone | (F.col("o_orderkey") % 10 == 1) | (F.col("o_month") == "03"))
    batch = changed.withColumn("Op", F.when(gone, "D").otherwise("U")).withColumn("o_month", following)
    for _ in range(2):
        sinks.upsert_path(spark, root, batch, ["o_orderkey"], ["o_month"])
    return sources.scan_full(spark, root, orders.schema)


@query("upsert_after_empty", "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0")
def upsert_after_empty(spark, sf):
    """MRG-2: a table whose last row was deleted takes the next batch."""
    root = scratch_dir(spark, "customers")
    customers = given(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = customers.drop("c_acctbal")
    for batch in (rows, rows.withColumn("Op", F.lit("D")), customers.where("c_acctbal > 0").drop("c_acctbal")):
        sinks.upsert_path(spark, root, batch, ["c_custkey"], ["c_nationkey"])
    return sources.scan_full(spark, root, rows.schema)


def _out_of_order(spark, sf):
    """Three batches of order changes: inserts of one half; deletes of every fifth order,
    known or not, ten days after its insert; then all inserts again, and newer ones for half
    of the deleted."""
    orders = given(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 50 as int))").alias("changed_at"),
        F.col("o_totalprice").alias("price"),
    )
    first = orders.withColumn("Op", F.lit("I"))
    gone = first.where("id % 5 = 0").withColumn("changed_at", F.expr("changed_at + interval 10 days"))
    back = first.where("id % 10 = 0").withColumn("changed_at", F.expr("changed_at + interval 20 days"))
    back = back.withColumn("price", F.col("price") + 1)
    again = first.where("id % 10 > 0").union(back)
    return [first.where("id % 2 = 0"), gone.withColumn("Op", F.lit("D")), again]


_DELETED_STAYS_SQL = """
SELECT way, o_orderkey AS id, timestamp '2024-01-01' + (o_orderkey % 50 + CASE WHEN o_orderkey % 10 = 0 THEN 20 ELSE 0 END) * interval 1 day AS changed_at,
  CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price
FROM orders, (VALUES ('job'), ('stream')) AS w(way) WHERE o_orderkey % 5 > 0 OR o_orderkey % 10 = 0"""


@query("upsert_deleted_stays", _DELETED_STAYS_SQL)
def upsert_deleted_stays(spark, sf):
    """MRG-2, STR-1: an insert that is older than the key's delete comes in a later batch, in
    a job and in a stream; the key stays deleted, and a newer insert brings it back."""
    batches, months = _out_of_order(spark, sf), ["year", "month"]
    job, stream, landing = (scratch_dir(spark, n) for n in ("job", "stream", "landing"))
    state = sources.Bookmarks(spark, scratch_dir(spark, "bookmarks"))
    for k, batch in enumerate(batches):
        # Each batch is read as a whole: the overlap reaches back before all times.
        jobs.upsert_changes(
            batch, job, state, "orders", ["id"], "changed_at", datetime(2024, 1, 1 + k), timedelta(days=20000), by=months
        )
        with_partitions(batch, "changed_at", "month").write.mode("append").parquet(landing)
        changes = spark.readStream.schema(with_partitions(batch, "changed_at", "month").schema).parquet(landing)
        streaming.stream_upsert(
            changes, stream, f"{landing}-progress", ["id"], "changed_at", months, once=True
        ).awaitTermination()
    columns = ["id", "changed_at", "price"]
    return op.relational.union_by_name(
        sources.scan_full(spark, job).select(F.lit("job").alias("way"), *columns),
        sources.scan_full(spark, stream).select(F.lit("stream").alias("way"), *columns),
    )


@query("drop_many_partitions", "SELECT o_orderkey, o_custkey % 300 AS part FROM orders WHERE o_custkey % 300 % 3 > 0")
def drop_many_partitions(spark, sf):
    """MRG-6: any number of partitions, none of them listed on the driver."""
    root = scratch_dir(spark, "orders")
    orders = given(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey % 300 as part")
    sinks.write_partitions(orders, root, ["part"], mode="overwrite")
    sinks.drop_partitions(spark, root, ["part"], "part % 3 = 0")
    return sources.scan_full(spark, root, orders.schema)


@query(
    "merge_partitions_null_keys",
    """
SELECT CASE WHEN event_id % 7 > 0 THEN event_id END AS event_id, event_type,
  CASE WHEN event_id % 7 > 0 AND event_id % 2 = 0 THEN value + 1 ELSE value END AS value FROM events
UNION ALL SELECT NULL, event_type, value + 1 FROM events WHERE event_id % 14 = 0""",
)
def merge_partitions_null_keys(spark, sf):
    """SNK-3: the batch's row wins, and rows without a key all stay."""
    root = scratch_dir(spark, "events")
    events = given(spark, sf, "events").selectExpr(
        "case when event_id % 7 > 0 then event_id end as event_id", "event_type", "value", "event_id as n"
    )
    batch = events.where("n % 2 = 0").withColumn("value", F.col("value") + 1)
    for rows in (events, batch, batch):
        sinks.write_partitions(rows, root, ["event_type"], keys=["event_id"])
    return sources.scan_full(spark, root).select("event_id", "event_type", "value")


# --- bookmarks and jobs ----------------------------------------------------


def _shifted_lines(spark, sf):
    """Lines of which every fiftieth has a clock four hours fast."""
    lines = access_lines(spark, sf)
    fast = F.date_format(F.col("ts") + F.expr("interval 4 hours"), "yyyy-MM-dd HH:mm:ss")
    moved = F.regexp_replace("log", r"^\|[^|]+\|", F.concat(F.lit("|"), fast, F.lit("|")))
    return lines.withColumn("log", F.when(F.col("event_id") % 50 == 7, moved).otherwise(F.col("log")))


def _log_runs(spark, sf, lines, tz, cut):
    """Land lines by a local clock and parse them in two runs."""
    raw, out = scratch_dir(spark, "raw-log"), scratch_dir(spark, "parsed-log")
    rows = streaming.hourly_rows(lines, "ts", tz=tz).select("@timestamp", "log", *_HOURS)
    sinks.cluster_for_write(rows, _HOURS).write.partitionBy(*_HOURS).json(raw)
    state = sources.Bookmarks(spark, scratch_dir(spark, "bookmarks"))
    for now in (cut, _span(spark, sf)[1]):
        jobs.access_log_batch(spark, raw, out, state, "log", now, missing="skip", by=_HOURS[:3], zone=tz)
    return sources.scan_full(spark, out)


@query(
    "access_log_fast_clock",
    f"""
WITH {LOGS_SQL} SELECT CASE WHEN event_id % 50 = 7 AND log <> 'garbage'
  THEN strftime(ts + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') ELSE "timestamp" END AS "timestamp", endpoint
FROM (SELECT l.log, f.* FROM logs f JOIN lines l ON l.event_id = f.event_id)""",
)
def access_log_fast_clock(spark, sf):
    """BMK-7: no line's own clock moves the bookmark."""
    parsed = _log_runs(spark, sf, _shifted_lines(spark, sf), "UTC", datetime(2024, 1, 16, 12))
    return parsed.select("timestamp", "endpoint")


@query("access_log_local_zone", f'WITH {LOGS_SQL} SELECT "timestamp", endpoint, product_id FROM logs')
def access_log_local_zone(spark, sf):
    """BMK-7, SNK-11: folders named by a clock west of UTC."""
    parsed = _log_runs(spark, sf, access_lines(spark, sf), "America/Bogota", datetime(2024, 1, 16, 2, 30))
    return parsed.select("timestamp", "endpoint", "product_id")


_LATEST_EVENT_SQL = """
SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND event_type <> 'error'"""
_DAYS = ("year", "month", "day")


def _event_changes(spark, sf):
    code = F.when(F.col("event_type") == "error", "D").otherwise("U")
    return given(spark, sf, "events").select("user_id", "event_id", "event_type", "ts", code.alias("Op"))


@query("upsert_hours_job", _LATEST_EVENT_SQL)
def upsert_hours_job(spark, sf):
    """SRC-2, CDC-1, MRG-1, BMK-7 as one job, in two runs; the second opens the hours
    from the bookmark on."""
    raw, out = scratch_dir(spark, "raw"), scratch_dir(spark, "table")
    changes = _event_changes(spark, sf)
    sinks.write_partitions(with_partitions(changes, "ts"), raw, _HOURS, mode="overwrite")
    state = sources.Bookmarks(spark, scratch_dir(spark, "bookmarks"))
    for now in (_MID, _span(spark, sf)[1]):
        jobs.upsert_hours(
            spark, raw, out, state, "events", ["user_id"], "ts", now, schema=changes.schema, tie_break=["event_id"]
        )
    return sources.scan_full(spark, out).drop(*_DAYS)


@query("upsert_days_job", _LATEST_EVENT_SQL)
def upsert_days_job(spark, sf):
    """SRC-3 with CDC-1 and MRG-1 as one job, in two runs."""
    raw, out = scratch_dir(spark, "raw"), scratch_dir(spark, "table")
    changes = _event_changes(spark, sf)
    _land_days(spark, changes, "ts", raw)
    state = sources.Bookmarks(spark, scratch_dir(spark, "bookmarks"))
    for now in (_MID, _span(spark, sf)[1]):
        jobs.upsert_days(
            spark, raw, out, state, "events", ["user_id"], "ts", now, schema=changes.schema, tie_break=["event_id"]
        )
    return sources.scan_full(spark, out).drop(*_DAYS)


@query("upsert_files_job", _LATEST_EVENT_SQL)
def upsert_files_job(spark, sf):
    """SRC-7, CDC-4, CDC-8 and MRG-1 as one job: two deliveries, then none."""
    inbox, seen, out = (scratch_dir(spark, n) for n in ("inbox", "seen", "table"))
    changes = _event_changes(spark, sf)
    early = F.col("ts") < F.lit(_MID).cast("timestamp_ntz")
    total = 0
    for rows in (changes.where(early), changes.where(~early), None):
        if rows is not None:
            rows.write.mode("append").parquet(inbox)
        done = jobs.upsert_files(
            spark, inbox, seen, out, ["user_id"], "ts", changes.schema, tie_break=["event_id"]
        )
        total += sum(d["total"] for d in done)
    assert total == changes.count()
    return sources.scan_full(spark, out).drop(*_DAYS)


@query(
    "bookmarks",
    """
SELECT event_type AS table_name, max(ts) AS last_bookmark_time,
  timestamp '2024-01-01 00:00:00' AS started_at,
  timestamp '2024-02-02 00:00:00' AS last_update_time FROM events GROUP BY event_type""",
)
def bookmarks(spark, sf):
    """BMK-1 to BMK-4, BMK-7: two settings per table; the later one is in force."""
    events = given(spark, sf, "events")
    state = sources.Bookmarks(spark, scratch_dir(spark, "bookmarks"))
    newest = events.groupBy(F.col("event_type").alias("table_name")).agg(F.max("ts").alias("ts"))
    start = datetime(2024, 1, 1)
    earlier = newest.withColumn("ts", F.col("ts") - F.expr("interval 1 day"))
    state.set_many(earlier, datetime(2024, 2, 1), start)
    state.set_many(newest, datetime(2024, 2, 2), start)
    state.advance("view", None, datetime(2024, 2, 3))
    state.compact()
    return state.current()


@query(
    "access_log_job",
    f"WITH {LOGS_SQL} SELECT {LOG_FIELDS_SQL}, {LOG_PARTS_SQL} FROM logs",
)
def access_log_job(spark, sf):
    """The log batch, run twice: to mid-month, then from its bookmark to the end.
    The second run reads its first hour again and replaces it by itself."""
    raw, out = scratch_dir(spark, "raw-log"), scratch_dir(spark, "parsed-log")
    _landed_lines(spark, sf, raw)
    state = sources.Bookmarks(spark, scratch_dir(spark, "bookmarks"))
    for now in (datetime(2024, 1, 16, 12), _span(spark, sf)[1]):
        jobs.access_log_batch(
            spark,
            raw,
            out,
            state,
            "access_log",
            now,
            missing="skip",
            by=_HOURS[:3],
        )
    return sources.scan_full(spark, out).drop("arrived")


@query(
    "change_upsert_job",
    f"""
WITH {CHANGES_SQL},
known AS (SELECT *, 'I' AS "Op", 0 AS late FROM target UNION ALL SELECT *, 1 AS late FROM changes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY late DESC) AS n FROM known)
SELECT {_ORDERS}, timestamp '2024-02-01 00:00:00' AS last_applied_date FROM ranked
WHERE n = 1 AND coalesce("Op", 'I') <> 'D' AND late = 1
UNION ALL SELECT {_ORDERS}, timestamp '2024-01-31 00:00:00' FROM ranked WHERE n = 1 AND late = 0""",
)
def change_upsert_job(spark, sf):
    """Initial load, then changes since a bookmark, one of them read twice."""
    root = scratch_dir(spark, "orders")
    parts = ["year", "month"]
    jobs.initial_load(
        order_target(spark, sf),
        root,
        ["o_orderkey"],
        "o_orderdate",
        applied_at=datetime(2024, 1, 31),
        by=parts,
    )
    state = sources.Bookmarks(spark, scratch_dir(spark, "bookmarks"))
    state.set("orders", datetime(1998, 1, 2), datetime(2024, 1, 31))
    changes = order_changes(spark, sf)
    for _ in range(2):
        jobs.upsert_changes(
            changes,
            root,
            state,
            "orders",
            ["o_orderkey"],
            "o_orderdate",
            datetime(2024, 2, 1),
            overlap=timedelta(days=1),
            by=parts,
            applied_at=True,
        )
    return sources.scan_full(spark, root).drop(*parts)


def _shop(spark, sf, mart, first_orders=None, first_logs=None):
    """The shop's models, run twice as data arrives: by default to mid-month, then all."""
    logs, orders = parse_access_log(access_lines(spark, sf)), shop_orders(spark, sf)
    if first_orders is None:
        first_orders = orders.where(F.col("order_dt") < F.lit(_MID).cast("timestamp_ntz"))
        first_logs = logs.where(F.col("timestamp") < str(_MID))
    project = None
    for orders_now, logs_now in ((first_orders, first_logs), (orders, logs)):
        sources_now = {
            "customers": shop_customers(spark, sf),
            "products": shop_products(spark, sf),
            "orders": orders_now,
            "access_log": logs_now,
        }
        if project is None:
            root, run = scratch_dir(spark, "models"), uuid.uuid4().hex[:8]
            project = shop_project(spark, root, sources_now, prefix=f"mf_{run}_")
        for name, df in sources_now.items():
            project.source(name, df)
        frames = project.run([mart])
    return frames[mart].drop("year", "month", "day")


@query(
    "shop_models_product",
    f"WITH {LOGS_SQL}, {SHOP_SQL}, {_DIM_PRODUCT_SQL},"
    + _conversion_sql("product_id", "product_name", "dim_product", "product_name", _ANY),
)
def shop_models_product(spark, sf):
    """MDL-1 to MDL-3, MDL-5, MDL-6, MDL-9, CHK-1, CHK-2."""
    return _shop(spark, sf, "info_product_conversion_rate")


@query(
    "shop_models_customer",
    f"WITH {LOGS_SQL}, {SHOP_SQL}, {_DIM_CUSTOMER_SQL},"
    + _conversion_sql("customer_id", "customer_name", "dim_customer", "full_name", _ANY),
)
def shop_models_customer(spark, sf):
    """As above, by customer."""
    return _shop(spark, sf, "info_customer_conversion_rate")


@query(
    "shop_models_late_rows",
    f"WITH {LOGS_SQL}, {SHOP_SQL}, {_DIM_PRODUCT_SQL},"
    + _conversion_sql("product_id", "product_name", "dim_product", "product_name", _ANY),
)
def shop_models_late_rows(spark, sf):
    """MDL-5, MDL-6: the second run brings rows of times, and instants, stored before."""
    logs, orders = parse_access_log(access_lines(spark, sf)), shop_orders(spark, sf)
    return _shop(
        spark,
        sf,
        "info_product_conversion_rate",
        orders.where("order_id % 3 > 0"),
        logs.where("coalesce(product_id, 0) % 3 > 0"),
    )


@query(
    "shop_models_moved_orders",
    f"WITH {LOGS_SQL}, {SHOP_SQL}, {_DIM_PRODUCT_SQL},"
    + _conversion_sql("product_id", "product_name", "dim_product", "product_name", _ANY),
)
def shop_models_moved_orders(spark, sf):
    """MDL-3, MART-2: the rates are kept by day.  The first run has every fifth order on
    another day, so the second takes orders out of days, and has late log rows."""
    logs, orders = parse_access_log(access_lines(spark, sf)), shop_orders(spark, sf)
    away = F.when(F.col("order_id") % 5 == 0, F.expr("order_dt + interval 3 days")).otherwise(F.col("order_dt"))
    earlier = F.expr("last_update_time - interval 1 day")
    return _shop(
        spark,
        sf,
        "info_product_conversion_rate",
        orders.withColumns({"order_dt": away, "last_update_time": earlier}),
        logs.where("coalesce(product_id, 0) % 4 > 0"),
    )


@query("merge_model_repeated_keys", f"WITH {SHOP_SQL} SELECT * FROM shop_orders")
def merge_model_repeated_keys(spark, sf):
    """MDL-6: a first load with several versions of a key stores the newest; an older
    one that comes later is ignored."""
    project = Project(spark, scratch_dir(spark, "models"), prefix=f"mf_{uuid.uuid4().hex[:8]}_")
    rules = {"newer_than": "last_update_time", "on_duplicate": "latest"}

    @project.model("fact_orders", refs=["orders"], materialized="merge", keys=["order_id"], options=rules)
    def _(ctx):
        return marts.fact_orders(ctx.ref("orders"))

    orders = shop_orders(spark, sf)
    older = orders.withColumn("order_price", F.lit(-1)).withColumn(
        "last_update_time", F.col("last_update_time") - F.expr("interval 1 day")
    )
    for rows in (orders.unionByName(older), older):
        project.source("orders", rows)
        frames = project.run()
    return frames["fact_orders"]


@query("conversion_percent_stored", _PERCENT_SQL)
def conversion_percent_stored(spark, sf):
    """MART-1 as a table partitioned by text dates, rows without a date included."""
    root = scratch_dir(spark, "percent")
    logs = marts.stg_accesslog(parse_access_log(access_lines(spark, sf)))
    mart = marts.product_conversion_percent(logs, shop_orders(spark, sf), shop_products(spark, sf))
    sinks.write_partitions(mart, root, ["year", "month", "day"], mode="overwrite_partitions")
    return writers.stored_rows(spark, root)


@query(
    "listings_models",
    f"""
WITH {LISTINGS_SQL}, {_CLEAN_SQL}
{_MOONS_SQL}""",
)
def listings_models(spark, sf):
    """MDL-4, MDL-5, MDL-7, MART-4 to MART-6: reviews stored in two runs."""
    reviews = raw_reviews(spark, sf)
    given_now = {
        "listings": raw_listings(spark, sf),
        "hosts": raw_hosts(spark, sf),
        "reviews": reviews.where("date < timestamp_ntz'2024-01-16 00:00:00'"),
        "full_moons": full_moons(spark, sf),
    }
    root, run = scratch_dir(spark, "models"), uuid.uuid4().hex[:8]
    project = listings_project(spark, root, given_now, prefix=f"mf_{run}_")
    project.run()
    project.source("reviews", reviews)
    return project.run()["full_moon_reviews"]


@query(
    "layered_models",
    f"WITH {SHOP_SQL} SELECT * FROM shop_orders",
)
def layered_models(spark, sf):
    """MDL-6, MDL-8: orders merged into a partitioned, laid out table in two runs."""
    run = uuid.uuid4().hex[:8]
    project = Project(spark, scratch_dir(spark, "models"), prefix=f"mf_{run}_")

    @project.model(
        "fact_orders",
        refs=["orders"],
        materialized="merge",
        keys=["order_id"],
        partition_by=["product_id"],
        checks=[lambda df: op.check_unique(df, "order_id")],
    )
    def _(ctx):
        return ctx.ref("orders") if ctx.is_incremental else marts.fact_orders(ctx.ref("orders"))

    @project.model(
        "orders_by_time",
        refs=["fact_orders"],
        materialized="table",
        layer="info",
        cluster=["customer_id"],
        sort=["customer_id", "order_dt"],
    )
    def _(ctx):
        return ctx.ref("fact_orders")

    orders = shop_orders(spark, sf)
    for rows in (orders.where(F.col("order_dt") < F.lit(_MID).cast("timestamp_ntz")), orders):
        project.source("orders", rows)
        frames = project.run()
    return frames["orders_by_time"]


# --- streams ---------------------------------------------------------------


@query(
    "scan_new_files",
    """
SELECT event_id, user_id, 1 AS run FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, user_id, 2 FROM events WHERE event_type = 'view'""",
)
def scan_new_files(spark, sf):
    """SRC-7: the second run reads only the files added since the first; the third none."""
    root, checkpoint = scratch_dir(spark, "inbox"), scratch_dir(spark, "seen")
    out = scratch_dir(spark, "loaded")
    events = given(spark, sf, "events").select("event_id", "user_id", "event_type")
    schema = "event_id bigint, user_id bigint"
    parts = [events.where("event_type <> 'view'"), events.where("event_type = 'view'"), None]
    for run, rows in enumerate(parts, start=1):
        if rows is not None:
            rows.drop("event_type").write.parquet(f"{root}/drop={run}")

        def handle(batch, batch_id, run=run):
            batch.withColumn("run", F.lit(run)).write.mode("append").parquet(out)

        sources_query = streaming.scan_new_files(spark, root, checkpoint, handle, schema)
        assert not sources_query.isActive
    return spark.read.parquet(out)


@query(
    "stream_upsert",
    """
SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND event_type <> 'error'""",
)
def stream_upsert(spark, sf):
    """STR-1, SRC-15: a change stream after a snapshot equals the latest change per key."""
    root, checkpoint = scratch_dir(spark, "table"), scratch_dir(spark, "progress")
    landing = scratch_dir(spark, "landing")
    code = F.when(F.col("event_type") == "error", F.lit("D")).otherwise(F.lit("U"))
    changes = with_partitions(
        given(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "ts", "day"
    ).withColumn("Op", code)
    days = ["year", "month", "day"]
    mid = "ts < timestamp_ntz'2024-01-11 00:00:00'"
    late = "ts >= timestamp_ntz'2024-01-21 00:00:00'"
    for rows in (changes.where(f"not ({mid}) and not ({late})"), changes.where(late)):
        rows.write.mode("append").parquet(landing)
    stream = (
        spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    )
    streaming.stream_upsert(
        stream,
        root,
        checkpoint,
        ["user_id"],
        "ts",
        days,
        snapshot=changes.where(mid),
        tie_break=["event_id"],
        once=True,
    ).awaitTermination()
    return sources.scan_full(spark, root).drop(*days)


@query(
    "sink_hourly",
    """
SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS local_hour FROM events""",
)
def sink_hourly(spark, sf):
    """SNK-11, SNK-12, STR-3: a stream landed in hour folders of Korea time."""
    out, checkpoint = scratch_dir(spark, "landed"), scratch_dir(spark, "progress")
    landing = scratch_dir(spark, "landing")
    events = given(spark, sf, "events").select("event_id", "ts")
    events.repartitionByRange(8, "ts").write.parquet(landing)
    stream = spark.readStream.schema(events.schema).parquet(landing)
    streaming.sink_hourly(
        stream, out, checkpoint, "ts", fmt="parquet", once=True
    ).awaitTermination()
    parts = "event_id bigint, ts timestamp_ntz, year string, month string, day string, hour string"
    landed = sources.scan_full(spark, out, parts)
    hour = F.concat_ws(
        " ", F.concat_ws("-", "year", "month", "day"), F.col("hour")
    )
    return landed.select("event_id", hour.alias("local_hour"))


@query(
    "routed_tables",
    """
SELECT event_id AS "offset", user_id, event_type FROM events WHERE event_type = 'purchase'""",
)
def routed_tables(spark, sf):
    """SNK-13: all topics written at once; one table read back with its types."""
    root, checkpoint = scratch_dir(spark, "routed"), scratch_dir(spark, "progress")
    landing = scratch_dir(spark, "topics")
    topics = given(spark, sf, "events").select(
        F.concat(F.lit("rdb.shop."), "event_type").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.to_json(F.struct("user_id", "event_type")).alias("value"),
    )
    topics.write.parquet(landing)
    stream = spark.readStream.schema(topics.schema).parquet(landing)
    streaming.route_to_tables(
        stream, root, checkpoint, r"rdb\.shop\.(.*)", once=True
    ).awaitTermination()
    rows = streaming.routed_table(spark, root, "purchase", "user_id bigint, event_type string")
    return rows.select("offset", "user_id", "event_type")


@query(
    "routed_second_checkpoint",
    """
SELECT event_id AS "offset", user_id, event_type FROM events WHERE event_type = 'purchase'""",
)
def routed_second_checkpoint(spark, sf):
    """SNK-13: topics read again from the start under a new checkpoint, then compacted."""
    root, landing = scratch_dir(spark, "routed"), scratch_dir(spark, "topics")
    topics = given(spark, sf, "events").select(
        F.concat(F.lit("rdb.shop."), "event_type").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.to_json(F.struct("user_id", "event_type")).alias("value"),
    )
    for part in (topics.where("offset % 2 = 0"), topics.where("offset % 2 = 1")):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(topics.schema).parquet(landing)
        streaming.route_to_tables(
            stream, root, scratch_dir(spark, "progress"), r"rdb\.shop\.(.*)", once=True
        ).awaitTermination()
    streaming.compact_routed(spark, root, "purchase")
    rows = streaming.routed_table(spark, root, "purchase", "user_id bigint, event_type string")
    return rows.select("offset", "user_id", "event_type")


@query(
    "routed_new_checkpoint",
    """
SELECT event_id AS "offset", user_id, event_type FROM events WHERE event_type = 'purchase'""",
)
def routed_new_checkpoint(spark, sf):
    """SNK-13: the checkpoint is lost and made anew under the same path, the topics are read
    again with what came since; then everything is compacted."""
    root, landing, progress = (scratch_dir(spark, n) for n in ("routed", "topics", "progress"))
    topics = given(spark, sf, "events").select(
        F.concat(F.lit("rdb.shop."), "event_type").alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.to_json(F.struct("user_id", "event_type")).alias("value"),
    )
    for part in (topics.where("hash(offset) % 2 = 0"), topics.where("hash(offset) % 2 != 0")):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(topics.schema).parquet(landing)
        streaming.route_to_tables(stream, root, progress, r"rdb\.shop\.(.*)", once=True).awaitTermination()
        storage.delete(spark, progress)
    streaming.compact_routed(spark, root, "purchase")
    rows = streaming.routed_table(spark, root, "purchase", "user_id bigint, event_type string")
    return rows.select("offset", "user_id", "event_type")


@query(
    "change_stream_tables",
    """
SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 > 0
UNION ALL SELECT 'part', p_partkey, upper(p_name) FROM part WHERE p_partkey % 5 > 0
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 > 0""",
)
def change_stream_tables(spark, sf):
    """SRC-15: a snapshot and the envelopes of three tables, merged continuously; every
    fifth row is deleted, and the names of parts change."""
    tables = {
        "customer": given(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as name"),
        "part": given(spark, sf, "part").selectExpr("p_partkey as id", "p_name as name"),
        "supplier": given(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_name as name"),
    }
    stored = []
    for source, rows in tables.items():
        root, landing = scratch_dir(spark, source), scratch_dir(spark, "landing")
        image = F.struct("id", "name")
        after = F.struct("id", (F.upper("name") if source == "part" else F.col("name")).alias("name"))
        gone, none = F.col("id") % 5 == 0, F.lit(None).cast("struct<id:bigint,name:string>")
        envelope = F.struct(
            image.alias("before"),
            F.when(gone, none).otherwise(after).alias("after"),
            F.when(gone, "d").otherwise("u").alias("op"),
            F.lit(1_704_067_200_000).alias("ts_ms"),
        )
        rows.select(F.to_json(envelope).alias("value")).write.parquet(landing)
        stream = spark.readStream.schema("value string").parquet(landing)
        slot = (F.col("id") % 4).cast("int")
        changes = streaming.stream_changes(stream, "id bigint, name string").withColumn("slot", slot)
        first = F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")
        snapshot = rows.select("id", "name", F.lit("I").alias("Op"), first.alias("changed_at"), slot.alias("slot"))
        streaming.stream_upsert(
            changes, root, scratch_dir(spark, "progress"), ["id"], "changed_at", ["slot"], snapshot=snapshot, once=True
        ).awaitTermination()
        stored.append(sources.scan_full(spark, root).select(F.lit(source).alias("source"), "id", "name"))
    return op.union_frames(stored)


@query(
    "topic_rows",
    """
SELECT event_id AS kafka_offset, ts AS kafka_timestamp,
  try_cast(json_extract_string(props, '$.k') AS integer) AS k FROM events""",
)
def topic_rows(spark, sf):
    """SRC-13, FN-14: a topic as a refreshed view with its value parsed."""
    landing, out = scratch_dir(spark, "topic"), scratch_dir(spark, "view")
    checkpoint = scratch_dir(spark, "progress")
    rows = given(spark, sf, "events").select(
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.lit(0).alias("timestampType"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
    )
    rows.write.parquet(landing)
    stream = streaming.topic_rows(spark.readStream.schema(rows.schema).parquet(landing))
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    view = spark.read.parquet(out)
    k = F.try_variant_get("data", "$.k", "int").alias("k")
    return view.select("kafka_offset", "kafka_timestamp", k)


@query("tailed_lines", f"WITH {LOGS_SQL} SELECT log FROM lines")
def tailed_lines(spark, sf):
    """SRC-14: the lines of a log directory, as they appear."""
    landing, out = scratch_dir(spark, "log-files"), scratch_dir(spark, "tailed")
    access_lines(spark, sf).select("log").write.text(landing)
    lines = streaming.stream_text(spark, landing, glob="*.txt").select("log")
    lines.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_dir(spark, "progress")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_late_lines",
    f"""
WITH {LOGS_SQL} SELECT event_id, endpoint, product_id, stamp AS event_time FROM logs
WHERE stamp IS NOT NULL""",
)
def stream_late_lines(spark, sf):
    """STR-2: half of the lines come weeks after later ones, all of them twice; none is lost
    and none doubled, without a state that grows."""
    landing, out = scratch_dir(spark, "lines"), scratch_dir(spark, "once")
    checkpoint = scratch_dir(spark, "progress")
    lines = access_lines(spark, sf).select("event_id", "log")
    for part in (lines.where("event_id % 2 = 0"), lines):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(lines.schema).parquet(landing)
        parsed = streaming.timed_lines(stream, ["event_id"])
        parsed = parsed.withColumn("event_time", F.to_timestamp_ntz("timestamp"))
        streaming.lines_once(parsed, out, ["event_id"], checkpoint, index=True).awaitTermination()
    return writers.stored_rows(spark, out).select("event_id", "endpoint", "product_id", "event_time")


@query(
    "stream_access_log",
    f"""
WITH {LOGS_SQL} SELECT event_id, endpoint, product_id, stamp AS event_time FROM logs
WHERE stamp IS NOT NULL""",
)
def stream_access_log(spark, sf):
    """STR-2, SRC-14: every line delivered twice, kept once."""
    landing, out = scratch_dir(spark, "lines"), scratch_dir(spark, "parsed")
    checkpoint = scratch_dir(spark, "progress")
    lines = access_lines(spark, sf).select("event_id", "log")
    lines.write.parquet(landing)
    lines.write.mode("append").parquet(landing)
    stream = spark.readStream.schema(lines.schema).parquet(landing)
    parsed = streaming.stream_access_log(stream, ["event_id"], lateness="2 hours")
    parsed = parsed.withColumn("event_time", F.to_timestamp_ntz("timestamp"))
    parsed.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "endpoint", "product_id", "event_time")
