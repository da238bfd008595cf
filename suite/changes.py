"""Change-data and merge queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from martflow.functions import with_applied_at, with_partitions
from martflow.operators import (
    change_counts,
    duplicate_keys,
    latest_changes,
    merge,
    split_changes,
    touched_partitions,
    ts_range,
    unwrap_envelope,
    without_partitions,
)
from suite.inputs import CHANGES_SQL, given, order_changes, order_target
from suite.registry import query

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

_LATEST_SQL = """
SELECT * FROM orders WHERE (o_custkey, o_orderdate) IN
  (SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY o_custkey)"""


@query("latest_order_per_customer", _LATEST_SQL)
def latest_order_per_customer(spark, sf):
    """CDC-1, AGG-3, FLT-5, JN-5: ties kept."""
    return latest_changes(given(spark, sf, "orders"), ["o_custkey"], "o_orderdate")


@query("latest_order_ranked", _LATEST_SQL)
def latest_order_ranked(spark, sf):
    """CDC-1 in one scan and one exchange."""
    orders = given(spark, sf, "orders")
    return latest_changes(orders, ["o_custkey"], "o_orderdate", method="rank")


@query(
    "latest_order_one_row",
    f"""
SELECT {_ORDERS} FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
WHERE n = 1""",
)
def latest_order_one_row(spark, sf):
    """CDC-2."""
    orders = given(spark, sf, "orders")
    return latest_changes(
        orders, ["o_custkey"], "o_orderdate", ties="one", tie_break=["o_orderkey"]
    )


@query(
    "latest_event_since",
    """
SELECT * FROM events WHERE (user_id, ts) IN (SELECT user_id, max(ts) FROM events
  WHERE ts >= timestamp '2024-01-15 00:00:00' GROUP BY user_id)""",
)
def latest_event_since(spark, sf):
    """CDC-3, FLT-4, BMK-6."""
    return latest_changes(
        given(spark, sf, "events"), ["user_id"], "ts", since=datetime(2024, 1, 15)
    )


@query(
    "duplicate_lineitems",
    """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_lineitems(spark, sf):
    """CDC-7, AGG-5."""
    return duplicate_keys(given(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_OP = "case event_type when 'signup' then 'I' when 'error' then 'D' when 'view' then null else 'U' end"


@query(
    "change_counts",
    f"""
SELECT count(*) FILTER (op = 'I') AS inserted, count(*) FILTER (op = 'U') AS updated,
  count(*) FILTER (op = 'D') AS deleted, count(*) AS total
FROM (SELECT {_OP} AS op FROM events)""",
)
def counts(spark, sf):
    """CDC-4, AGG-6, AGG-7."""
    return change_counts(given(spark, sf, "events").withColumn("Op", F.expr(_OP)))


@query(
    "split_upserts",
    f"SELECT * FROM events WHERE coalesce({_OP}, 'I') <> 'D'",
)
def split_upserts(spark, sf):
    """CDC-5: rows without an operation are inserts."""
    events = given(spark, sf, "events").withColumn("Op", F.expr(_OP))
    return split_changes(events.withColumn("dms_update_time", F.col("ts")))[0]


@query("split_deletes", f"SELECT * FROM events WHERE {_OP} = 'D'")
def split_deletes(spark, sf):
    """CDC-5, FLT-1."""
    return split_changes(given(spark, sf, "events").withColumn("Op", F.expr(_OP)))[1]


@query(
    "partitioned_events",
    """
SELECT event_id, ts, cast(year(ts) AS integer) AS year, cast(month(ts) AS integer) AS month,
  cast(day(ts) AS integer) AS day, timestamp '2024-02-01 00:00:00' AS last_applied_date
FROM events""",
)
def partitioned_events(spark, sf):
    """CDC-6, FN-9, FN-16."""
    events = given(spark, sf, "events").select("event_id", "ts")
    return with_applied_at(with_partitions(events, "ts", "day"), datetime(2024, 2, 1))


@query("event_ts_range", "SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def event_ts_range(spark, sf):
    """CDC-8, AGG-4."""
    return ts_range(given(spark, sf, "events"), "ts")


@query(
    "change_envelope",
    """
SELECT event_id, user_id, event_type, value,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' WHEN 'view' THEN 'I'
    ELSE 'U' END AS "Op",
  date_trunc('millisecond', ts) AS changed_at FROM events""",
)
def change_envelope(spark, sf):
    """SRC-15: unwrap before/after images."""
    op = F.expr(
        "case event_type when 'signup' then 'c' when 'error' then 'd' when 'view' then 'r' else 'u' end"
    )
    row = F.struct("event_id", "user_id", "event_type", "value")
    gone = F.col("event_type") == "error"
    epoch = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    envelope = F.to_json(
        F.struct(
            F.when(gone, row).alias("before"),
            F.when(~gone, row).alias("after"),
            op.alias("op"),
            epoch.alias("ts_ms"),
        )
    )
    wrapped = given(spark, sf, "events").select(envelope.alias("value"))
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    return unwrap_envelope(wrapped, "value", schema)


@query(
    "merge_orders",
    f"""
WITH {CHANGES_SQL}
SELECT {_ORDERS} FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL SELECT {_ORDERS} FROM changes WHERE coalesce("Op", 'I') <> 'D'""",
)
def merge_orders(spark, sf):
    """MRG-1, MRG-2, MRG-3, JN-6, JN-7."""
    return merge(order_target(spark, sf), order_changes(spark, sf), ["o_orderkey"])


@query(
    "merge_orders_ignore_deletes",
    f"""
WITH {CHANGES_SQL}, upserts AS (SELECT * FROM changes WHERE coalesce("Op", 'I') <> 'D')
SELECT {_ORDERS} FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM upserts)
UNION ALL SELECT {_ORDERS} FROM upserts""",
)
def merge_orders_ignore_deletes(spark, sf):
    """MRG-1 with deletes left out."""
    changes = order_changes(spark, sf)
    return merge(order_target(spark, sf), changes, ["o_orderkey"], deletes="ignore")


@query(
    "merge_keep_newer",
    f"""
WITH shifted AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate - INTERVAL 1 DAY
    WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY
    ELSE o_orderdate END AS o_orderdate, o_orderpriority FROM orders)
SELECT {", ".join(
    f"CASE WHEN s.o_orderdate >= t.o_orderdate THEN s.{c} ELSE t.{c} END AS {c}"
    for c in _ORDERS.split(", ")
)} FROM orders t JOIN shifted s ON s.o_orderkey = t.o_orderkey""",
)
def merge_keep_newer(spark, sf):
    """MRG-4: older rows of a re-read do not overwrite."""
    orders = given(spark, sf, "orders")
    day = F.expr("interval 1 day")
    source = orders.withColumn(
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") - day)
        .when(F.col("o_orderstatus") == "O", F.col("o_orderdate") + day)
        .otherwise(F.col("o_orderdate")),
    ).withColumn("o_orderstatus", F.lit("X"))
    return merge(orders, source, ["o_orderkey"], newer_than="o_orderdate")


@query(
    "merge_latest_of_source",
    """
SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey""",
)
def merge_latest_of_source(spark, sf):
    """MRG-3: a source with several rows per key, reduced to its newest."""
    orders = given(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").alias("newest"))
    old = orders.where("newest < timestamp_ntz'1996-01-01 00:00:00'")
    old = old.groupBy("o_custkey").agg(F.max("newest").alias("newest"))
    return merge(old, orders, ["o_custkey"], on_duplicate="latest", newer_than="newest")


@query(
    "merge_evolved",
    f"""
WITH {CHANGES_SQL}
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  NULL::varchar AS o_channel
FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL SELECT o_orderkey, o_custkey, NULL AS o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority, 'web' AS o_channel
FROM changes WHERE coalesce("Op", 'I') <> 'D'""",
)
def merge_evolved(spark, sf):
    """MRG-5: the source lost one column and gained another."""
    changes = order_changes(spark, sf).drop("o_orderstatus").withColumn("o_channel", F.lit("web"))
    return merge(order_target(spark, sf), changes, ["o_orderkey"], schema="evolve")


@query(
    "touched_days",
    f"""
WITH {CHANGES_SQL}
SELECT DISTINCT cast(o_orderdate AS date) AS order_day FROM (
  SELECT t.o_orderdate FROM target t JOIN changes c ON c.o_orderkey = t.o_orderkey
  UNION ALL SELECT o_orderdate + INTERVAL 1 DAY FROM changes)""",
)
def touched_days(spark, sf):
    """MRG-1: partitions a merge rewrites when updates move rows by a day."""
    target = order_target(spark, sf).withColumn("order_day", F.to_date("o_orderdate"))
    moved = order_changes(spark, sf).withColumn(
        "order_day", F.date_add(F.to_date("o_orderdate"), 1)
    )
    return touched_partitions(target, moved, ["o_orderkey"], ["order_day"])


@query("partitions_dropped", "SELECT * FROM orders WHERE year(o_orderdate) NOT BETWEEN 1996 AND 1997")
def partitions_dropped(spark, sf):
    """MRG-6 as a filter: the source dropped two years."""
    orders = with_partitions(given(spark, sf, "orders"), "o_orderdate", "year")
    return without_partitions(orders, "year between 1996 and 1997").drop("year")
