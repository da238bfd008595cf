"""Scalar functions, logs, relational steps, models, checks and marts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from martflow.functions import (
    as_timestamp,
    clean_price,
    day_of,
    full_name,
    json_field,
    non_zero,
    parse_access_log,
    route_name,
    with_local_partitions,
)
from martflow.operators import (
    cast_columns,
    check_columns,
    check_freshness,
    check_not_null,
    check_not_nulls,
    check_unique,
    join_on_shifted_day,
    join_single_value,
    project_public,
    rename_columns,
    run_checks,
    union_frames,
)
from martflow.plans import incremental_append, incremental_merge, marts
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
from suite.registry import query


def _logs(spark, sf):
    return parse_access_log(access_lines(spark, sf))


def _staged_logs(spark, sf):
    return marts.stg_accesslog(_logs(spark, sf))


def _dim_product(spark, sf):
    return marts.dim_product(marts.stg_product(shop_products(spark, sf)))


def _dim_customer(spark, sf):
    return marts.dim_customer(marts.stg_customer(shop_customers(spark, sf)))


# --- functions -------------------------------------------------------------


@query(
    "parse_access_log",
    f"WITH {LOGS_SQL} SELECT event_id, {LOG_FIELDS_SQL}, {LOG_PARTS_SQL} FROM logs",
)
def parsed(spark, sf):
    """LOG-1, LOG-2, LOG-3, LOG-4, FN-4, FN-9."""
    return parse_access_log(access_lines(spark, sf), keep=["event_id"])


@query(
    "json_props",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS integer) AS k FROM events",
)
def json_props(spark, sf):
    """FN-14."""
    events = given(spark, sf, "events")
    return events.select("event_id", json_field("props", "$.k", "int").alias("k"))


@query(
    "cleansed_parts",
    """
SELECT p_partkey, CASE WHEN p_size - 1 = 0 THEN 1 ELSE p_size - 1 END AS nights,
  cast(p_retailprice AS decimal(10,2)) AS price, coalesce(nullif(p_type, 'SMALL'), 'none') AS kind
FROM part""",
)
def cleansed_parts(spark, sf):
    """FN-1, FN-2, FN-3, FN-4."""
    part = given(spark, sf, "part")
    text = F.concat(F.lit("$"), F.format_number(F.col("p_retailprice").cast("decimal(10,2)"), 2))
    return part.select(
        "p_partkey",
        non_zero(F.col("p_size") - 1).alias("nights"),
        clean_price(text).alias("price"),
        F.coalesce(F.expr("nullif(p_type, 'SMALL')"), F.lit("none")).alias("kind"),
    )


@query(
    "dim_customer_name",
    "SELECT c_custkey, c_name || ' ' || nullif(c_mktsegment, 'BUILDING') AS full_name FROM customer",
)
def dim_customer_name(spark, sf):
    """FN-5: NULL if either part is."""
    name = full_name("c_name", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return given(spark, sf, "customer").select("c_custkey", name.alias("full_name"))


@query(
    "date_functions",
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd,
  substr(strftime(o_orderdate, '%Y%m%d'), 5, 2) AS month_text,
  cast(o_orderdate + INTERVAL 1 DAY AS date) AS next_day,
  date_trunc('day', o_orderdate) AS order_day,
  try_cast(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp) AS parsed_at,
  greatest(o_orderdate, timestamp '1998-01-01 00:00:00') AS at_least,
  round(o_orderkey / 8.0, 2) AS eighth FROM orders""",
)
def date_functions(spark, sf):
    """FN-6, FN-7, FN-8, FN-10, FN-11, FN-12, FN-13, PRJ-3."""
    ymd = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return given(spark, sf, "orders").select(
        "o_orderkey",
        ymd.alias("ymd"),
        F.substring(ymd, 5, 2).alias("month_text"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("next_day"),
        day_of("o_orderdate").alias("order_day"),
        as_timestamp(text).alias("parsed_at"),
        F.greatest("o_orderdate", F.expr("timestamp_ntz'1998-01-01 00:00:00'")).alias("at_least"),
        F.round(F.col("o_orderkey") / F.lit(8.0), 2).alias("eighth"),
    )


@query(
    "hourly_partitions",
    """
SELECT cast(year(t) AS integer) AS year, cast(month(t) AS integer) AS month,
  cast(day(t) AS integer) AS day, cast(hour(t) AS integer) AS hour, count(*) AS n_events
FROM (SELECT ts + INTERVAL 9 HOUR AS t FROM events) GROUP BY ALL""",
)
def hourly_partitions(spark, sf):
    """CDC-6, SNK-11, STR-3, FN-9: folders of a local wall clock."""
    parts = with_local_partitions(given(spark, sf, "events"), "ts")
    return parts.groupBy("year", "month", "day", "hour").agg(
        F.count(F.lit(1)).alias("n_events")
    )


@query(
    "route_topics",
    """
SELECT event_type AS "table", count(*) AS n_rows FROM events WHERE event_type <> 'error'
GROUP BY event_type""",
)
def route_topics(spark, sf):
    """SNK-13, FN-15: topics that match a pattern, renamed to tables."""
    topic = F.when(F.col("event_type") == "error", F.lit("schema.rdb")).otherwise(
        F.concat(F.lit("rdb.shop."), F.col("event_type"))
    )
    routed = given(spark, sf, "events").select(
        route_name(topic, r"rdb\.shop\.(.*)").alias("table")
    )
    known = routed.where(F.col("table").isNotNull())
    return known.groupBy("table").agg(F.count(F.lit(1)).alias("n_rows"))


# --- relational ------------------------------------------------------------


@query("distinct_staging", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def distinct_staging(spark, sf):
    """DST-1."""
    return given(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()


@query(
    "lineitem_with_order",
    """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey, o.o_orderstatus,
  greatest(l.l_shipdate, o.o_orderdate) AS updated_at
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey""",
)
def lineitem_with_order(spark, sf):
    """JN-2, FN-7."""
    line, order = given(spark, sf, "lineitem"), given(spark, sf, "orders")
    joined = line.join(order, line["l_orderkey"] == order["o_orderkey"], "left")
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "o_custkey",
        "o_orderstatus",
        F.greatest("l_shipdate", "o_orderdate").alias("updated_at"),
    )


@query(
    "flagged_day_after",
    f"""
WITH {LISTINGS_SQL}
SELECT event_id, ts, CASE WHEN full_moon_date IS NULL THEN 'no' ELSE 'yes' END AS is_flagged
FROM events LEFT JOIN full_moons ON cast(ts AS date) = full_moon_date + 1""",
)
def flagged_day_after(spark, sf):
    """JN-4, FN-12."""
    events = given(spark, sf, "events").select("event_id", "ts")
    return join_on_shifted_day(events, "ts", full_moons(spark, sf), "full_moon_date")


@query(
    "orders_with_customer",
    """
SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def orders_with_customer(spark, sf):
    """JN-1, JN-8: Spark broadcasts the dimension when its size check agrees."""
    customer = given(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = given(spark, sf, "orders").join(customer, "o_custkey")
    return joined.select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "customers_without_orders",
    "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def customers_without_orders(spark, sf):
    """JN-7."""
    customer, orders = given(spark, sf, "customer"), given(spark, sf, "orders")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti")


@query(
    "orders_per_customer_day",
    """
SELECT o_custkey, cast(o_orderdate AS date) AS order_day, count(*) AS n_orders,
  count(nullif(o_orderstatus, 'P')) AS n_settled FROM orders GROUP BY ALL""",
)
def orders_per_customer_day(spark, sf):
    """AGG-1, AGG-2."""
    orders = given(spark, sf, "orders")
    return orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count(F.expr("nullif(o_orderstatus, 'P')")).alias("n_settled"),
    )


@query(
    "events_of_last_day",
    "SELECT * FROM events WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
)
def events_of_last_day(spark, sf):
    """FLT-6: a scalar subquery in a predicate."""
    events = given(spark, sf, "events")
    newest = events.select(F.max("ts") - F.expr("interval 1 day")).scalar()
    return events.where(F.col("ts") > newest)


@query(
    "orders_with_newest",
    "SELECT o_orderkey, o_orderdate, (SELECT max(o_orderdate) FROM orders) AS newest FROM orders",
)
def orders_with_newest(spark, sf):
    """AGG-4, FLT-6: a global aggregate next to each row."""
    orders = given(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return join_single_value(orders, orders.agg(F.max("o_orderdate").alias("newest")))


@query(
    "union_by_name",
    """
SELECT o_custkey AS customer, o_orderdate AS at, NULL::varchar AS kind FROM orders
UNION ALL SELECT user_id, ts, event_type FROM events""",
)
def union_by_name(spark, sf):
    """SET-1: column order and count differ."""
    orders = given(spark, sf, "orders").selectExpr("o_orderdate as at", "o_custkey as customer")
    events = given(spark, sf, "events").selectExpr(
        "user_id as customer", "event_type as kind", "ts as at"
    )
    return union_frames([orders, events])


@query(
    "newest_orders",
    "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
)
def newest_orders(spark, sf):
    """SRT-1, SRT-3: the first rows shown."""
    orders = given(spark, sf, "orders")
    return orders.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(10)


@query(
    "public_customers",
    """
SELECT customer_id, username, first_name, last_name, sha256(email) AS email, age, is_active
FROM (WITH """
    + SHOP_SQL
    + """ SELECT * FROM shop_customers)""",
)
def public_customers(spark, sf):
    """PRJ-1, PRJ-2."""
    public = project_public(shop_customers(spark, sf), mask=["email"])
    names = ("customer_id", "username", "first_name", "last_name", "email", "age", "is_active")
    return rename_columns(public, {n: n for n in names})


@query(
    "typed_lineitem",
    """
SELECT l_orderkey, l_linenumber, try_cast(l_quantity AS integer) AS l_quantity,
  cast(l_shipdate AS date) AS l_shipdate, try_cast(l_returnflag AS integer) AS l_returnflag
FROM lineitem""",
)
def typed_lineitem(spark, sf):
    """FN-4: a value that does not fit becomes NULL."""
    line = given(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag"
    )
    return cast_columns(line, {"l_quantity": "int", "l_shipdate": "date", "l_returnflag": "int"})


# --- staging, dimensions, facts --------------------------------------------

_STG_CUSTOMER = """customer_id, username, first_name, last_name, email, phone_number, age, gender,
  address, date_joined, last_login, is_active, last_update_time"""
_DIM_CUSTOMER_SQL = """dim_customer AS (SELECT customer_id, first_name || ' ' || last_name
  AS full_name, email, phone_number, age, gender, address, date_joined
  FROM shop_customers WHERE is_active = 1)"""
_DIM_PRODUCT_SQL = """dim_product AS (SELECT product_id, name AS product_name, category, price,
  img_path FROM shop_products)"""
_STG_LOGS = """stamp AS "timestamp", ip_address, http_method, endpoint, service, protocol,
  status_code, response_size, product_id, customer_id, order_id"""


@query(
    "stg_customer",
    f"WITH {SHOP_SQL} SELECT {_STG_CUSTOMER} FROM shop_customers WHERE is_active = 1",
)
def stg_customer(spark, sf):
    """FLT-1, PRJ-2."""
    return marts.stg_customer(shop_customers(spark, sf))


@query("stg_orders", f"WITH {SHOP_SQL} SELECT DISTINCT * FROM shop_orders")
def stg_orders(spark, sf):
    """DST-1 over a log that holds every order twice."""
    orders = shop_orders(spark, sf)
    return marts.stg_orders(union_frames([orders, orders]))


@query("stg_product", f"WITH {SHOP_SQL} SELECT * FROM shop_products")
def stg_product(spark, sf):
    return marts.stg_product(shop_products(spark, sf))


@query("stg_accesslog", f"WITH {LOGS_SQL} SELECT {_STG_LOGS} FROM logs")
def stg_accesslog(spark, sf):
    """PRJ-3."""
    return _staged_logs(spark, sf)


@query("dim_customer", f"WITH {SHOP_SQL}, {_DIM_CUSTOMER_SQL} SELECT * FROM dim_customer")
def dim_customer(spark, sf):
    """MART-7."""
    return _dim_customer(spark, sf)


@query("dim_product", f"WITH {SHOP_SQL}, {_DIM_PRODUCT_SQL} SELECT * FROM dim_product")
def dim_product(spark, sf):
    """MART-7."""
    return _dim_product(spark, sf)


@query("fact_orders", f"WITH {SHOP_SQL} SELECT * FROM shop_orders")
def fact_orders(spark, sf):
    """MART-7, MDL-6: stored orders up to mid-month, then a merge of all of them."""
    orders = shop_orders(spark, sf)
    first = marts.fact_orders(orders.where("order_dt < timestamp_ntz'2024-01-16 00:00:00'"))
    later = orders.withColumn("channel", F.lit("web"))
    return incremental_merge(first, later, ["order_id"])


@query(
    "fact_accesslog",
    f"""WITH {LOGS_SQL} SELECT {_STG_LOGS} FROM logs WHERE stamp IS NOT NULL""",
)
def fact_accesslog(spark, sf):
    """MART-7, MDL-5: stored rows up to mid-month, then those newer than the newest."""
    facts = marts.fact_accesslog(_staged_logs(spark, sf))
    stored = facts.where("timestamp < timestamp_ntz'2024-01-16 00:00:00'")
    return union_frames([stored, incremental_append(stored, facts, "timestamp")])


@query(
    "incremental_append",
    """
SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events
  WHERE ts < timestamp '2024-01-16 00:00:00')""",
)
def append(spark, sf):
    """MDL-5, FLT-6."""
    events = given(spark, sf, "events")
    stored = events.where("ts < timestamp_ntz'2024-01-16 00:00:00'")
    return incremental_append(stored, events, "ts")


@query("incremental_append_empty", "SELECT * FROM events")
def append_empty(spark, sf):
    """MDL-5: an existing but empty target admits everything."""
    events = given(spark, sf, "events")
    return incremental_append(events.where("false"), events, "ts")


@query(
    "incremental_merge",
    f"""
WITH {CHANGES_SQL}
SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL SELECT * EXCLUDE ("Op") FROM changes""",
)
def incremental_merged(spark, sf):
    """MDL-6: merge without deletes."""
    changes = order_changes(spark, sf).drop("Op").withColumn("extra", F.lit(1))
    return incremental_merge(order_target(spark, sf), changes, ["o_orderkey"])


# --- conversion ------------------------------------------------------------


def _conversion_sql(key: str, name: str, dim: str, dim_name: str, view: str) -> str:
    """Counts of both kinds of fact from one list of them, by key and day."""
    return f"""
facts AS (SELECT l.{key} AS k, cast(l.stamp AS date) AS d, 1 AS seen, 0 AS sold FROM logs l WHERE {view}
  UNION ALL SELECT {key}, cast(order_dt AS date), 0, 1 FROM shop_orders),
days AS (SELECT k, d, sum(seen)::bigint AS seen, sum(sold)::bigint AS sold FROM facts
  GROUP BY k, d HAVING sum(seen) > 0)
SELECT k AS {key}, any_value({dim}.{dim_name}) AS {name}, d::timestamp AS view_date,
  any_value(seen) AS page_views, any_value(sold) AS orders,
  any_value(sold)::double / any_value(seen) AS conversion_rate
FROM days, {dim} WHERE {dim}.{key} = k GROUP BY k, d"""


_ANY = "l.endpoint LIKE '%product%'"


@query(
    "product_conversion_daily",
    f"WITH {LOGS_SQL}, {SHOP_SQL}, {_DIM_PRODUCT_SQL},"
    + _conversion_sql("product_id", "product_name", "dim_product", "product_name", _ANY),
)
def product_conversion_daily(spark, sf):
    """MART-2, JN-1, JN-3, FN-10, FLT-3."""
    return marts.product_conversion_daily(
        _staged_logs(spark, sf), shop_orders(spark, sf), _dim_product(spark, sf)
    )


@query(
    "product_conversion_strict",
    f"WITH {LOGS_SQL}, {SHOP_SQL}, {_DIM_PRODUCT_SQL},"
    + _conversion_sql(
        "product_id", "product_name", "dim_product", "product_name", "l.service = 'products'"
    ),
)
def product_conversion_strict(spark, sf):
    """MART-2 with product pages only."""
    return marts.product_conversion_daily(
        _staged_logs(spark, sf),
        shop_orders(spark, sf),
        _dim_product(spark, sf),
        view=marts.is_product_view(),
    )


@query(
    "customer_conversion_daily",
    f"WITH {LOGS_SQL}, {SHOP_SQL}, {_DIM_CUSTOMER_SQL},"
    + _conversion_sql("customer_id", "customer_name", "dim_customer", "full_name", _ANY),
)
def customer_conversion_daily(spark, sf):
    """MART-3: active customers only."""
    return marts.customer_conversion_daily(
        _staged_logs(spark, sf), shop_orders(spark, sf), _dim_customer(spark, sf)
    )


_PERCENT_SQL = f"""
WITH {LOGS_SQL}, {SHOP_SQL},
tally AS (SELECT k, d, count(*) FILTER (kind = 'v') AS v, count(*) FILTER (kind = 'o') AS o FROM (
    SELECT product_id AS k, strftime(stamp, '%Y%m%d') AS d, 'v' AS kind FROM logs
    UNION ALL SELECT product_id, strftime(order_dt, '%Y%m%d'), 'o' FROM shop_orders)
  GROUP BY k, d),
-- A day without views is no row of its own; a product without viewed days has one row.
shown AS (SELECT k, v, o, CASE WHEN o > 0 THEN d END AS d FROM tally WHERE v > 0
  UNION ALL SELECT product_id, 0, 0, NULL FROM shop_products
  WHERE NOT EXISTS (SELECT 1 FROM tally WHERE k = product_id AND v > 0))
SELECT product_id, name, v AS view_count, o AS order_count,
  CASE v WHEN 0 THEN 0 ELSE round(100 * (o / v::double), 2) END AS conversion_rate,
  d AS order_date, left(d, 4) AS year, d[5:6] AS month, right(d, 2) AS day
FROM shown, shop_products WHERE product_id = k"""


@query(
    "product_conversion_percent",
    f"""
{_PERCENT_SQL}""",
)
def product_conversion_percent(spark, sf):
    """MART-1, FN-6, FN-8, FN-11."""
    return marts.product_conversion_percent(
        _staged_logs(spark, sf), shop_orders(spark, sf), shop_products(spark, sf)
    )


# --- listings --------------------------------------------------------------

# Column lists are those of the cleansed models; the rest is this check's own.
_CLEAN_SQL = """
listings AS (SELECT id AS listing_id, name AS listing_name, room_type,
  greatest(minimum_nights, (minimum_nights = 0)::integer) AS minimum_nights, host_id,
  ltrim(price, '$')::decimal(10,2) AS price, created_at, updated_at FROM raw_listings),
hosts AS (SELECT id AS host_id, ifnull(name, 'Anonymous') AS host_name, is_superhost,
  created_at, updated_at FROM raw_hosts),
reviews AS (SELECT listing_id, date AS review_date, reviewer_name, comments AS review_text,
  sentiment AS review_sentiment FROM raw_reviews WHERE NOT comments IS NULL)"""
_MOONS_SQL = """
SELECT reviews.*, CASE WHEN EXISTS (SELECT 1 FROM full_moons
    WHERE datediff('day', full_moon_date, cast(review_date AS date)) = 1)
  THEN 'full moon' ELSE 'not full moon' END AS is_full_moon FROM reviews"""


def _listings(spark, sf):
    return marts.cleansed_listings(marts.src_listings(raw_listings(spark, sf)))


def _hosts(spark, sf):
    return marts.cleansed_hosts(marts.src_hosts(raw_hosts(spark, sf)))


def _reviews(spark, sf):
    return marts.fct_reviews(marts.src_reviews(raw_reviews(spark, sf)))


@query("cleansed_listings", f"WITH {LISTINGS_SQL}, {_CLEAN_SQL} SELECT * FROM listings")
def cleansed_listings(spark, sf):
    """MART-6."""
    return _listings(spark, sf)


@query("cleansed_hosts", f"WITH {LISTINGS_SQL}, {_CLEAN_SQL} SELECT * FROM hosts")
def cleansed_hosts(spark, sf):
    """MART-6, FN-1."""
    return _hosts(spark, sf)


@query(
    "listings_with_hosts",
    f"""
WITH {LISTINGS_SQL}, {_CLEAN_SQL}
-- Fixed values: the columns of the mart.
SELECT l.listing_id, l.listing_name, l.room_type, l.minimum_nights, l.price, l.host_id, h.host_name,
  h.is_superhost AS host_is_superhost, l.created_at, greatest(l.updated_at, h.updated_at) AS updated_at
FROM listings l LEFT JOIN hosts h ON h.host_id = l.host_id""",
)
def listings_with_hosts(spark, sf):
    """MART-5, JN-2, FN-7."""
    return marts.listings_with_hosts(_listings(spark, sf), _hosts(spark, sf))


@query("fct_reviews", f"WITH {LISTINGS_SQL}, {_CLEAN_SQL} SELECT * FROM reviews")
def fct_reviews(spark, sf):
    """FLT-2, MDL-5."""
    reviews = _reviews(spark, sf)
    stored = reviews.where("review_date < timestamp_ntz'2024-01-16 00:00:00'")
    return union_frames([stored, incremental_append(stored, reviews, "review_date")])


@query(
    "full_moon_reviews",
    f"""
WITH {LISTINGS_SQL}, {_CLEAN_SQL}
{_MOONS_SQL}""",
)
def full_moon_reviews(spark, sf):
    """MART-4, JN-4."""
    return marts.full_moon_reviews(_reviews(spark, sf), full_moons(spark, sf))


# --- checks ----------------------------------------------------------------


@query(
    "freshness_check",
    """
SELECT 'freshness' AS "check", 'ts' AS target, CASE WHEN age > 86400 THEN 'error'
  WHEN age > 3600 THEN 'warn' ELSE 'pass' END AS status, age AS failures
FROM (SELECT datesub('second', max(ts), timestamp '2024-01-31 12:00:00') AS age FROM events)""",
)
def freshness_check(spark, sf):
    """CHK-3."""
    now = datetime(2024, 1, 31, 12)
    return check_freshness(
        given(spark, sf, "events"), "ts", now, timedelta(hours=1), timedelta(hours=24)
    )


@query(
    "unique_check",
    """
WITH a AS (SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)),
b AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))
SELECT 'unique' AS "check", 'o_orderkey' AS target,
  CASE WHEN n = 0 THEN 'pass' ELSE 'error' END AS status, n AS failures FROM a
UNION ALL SELECT 'unique', 'o_custkey', CASE WHEN n = 0 THEN 'pass' ELSE 'error' END, n FROM b""",
)
def unique_check(spark, sf):
    """CHK-1."""
    orders = given(spark, sf, "orders")
    return run_checks([check_unique(orders, "o_orderkey"), check_unique(orders, "o_custkey")])


@query(
    "not_null_check",
    f"""
WITH {LISTINGS_SQL}, c AS (SELECT count(*) FILTER (id IS NULL) AS a,
  count(*) FILTER (name IS NULL) AS b FROM raw_hosts)
SELECT 'not_null' AS "check", 'id' AS target,
  CASE WHEN a = 0 THEN 'pass' ELSE 'error' END AS status, a AS failures FROM c
UNION ALL SELECT 'not_null', 'name', CASE WHEN b = 0 THEN 'pass' ELSE 'error' END, b FROM c""",
)
def not_null_check(spark, sf):
    """CHK-2, FLT-2."""
    hosts = raw_hosts(spark, sf)
    return check_not_nulls(hosts, ["id", "name"])


@query(
    "columns_check",
    f"""
WITH {SHOP_SQL}
SELECT 'columns' AS "check", 'order_date' AS target, 'error' AS status, cast(1 AS bigint) AS failures
UNION ALL SELECT 'not_null', 'customer_id', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'error' END,
  count(*) FROM shop_orders WHERE customer_id IS NULL""",
)
def columns_check(spark, sf):
    """CHK-4: a declared column the model lacks."""
    facts = marts.fact_orders(shop_orders(spark, sf))
    declared = ["order_id", "customer_id", "product_id", "order_date"]
    return run_checks([check_columns(facts, declared), check_not_null(facts, "customer_id")])
