"""Shop, log and listing inputs, derived by Spark from the given tables.

``*_SQL`` are the same derivations for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from martflow.functions.logs import LOG_PATTERNS, NUMERIC_FIELDS, QUERY_IDS


def given(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- access log ------------------------------------------------------------

_LINE = """
case when event_id % 100 = 99 then 'garbage' else concat(
  '|', date_format(ts,'yyyy-MM-dd HH:mm:ss'), '| 10.0.',
  cast(user_id div 256 as string), '.', cast(user_id % 256 as string), ' - - "',
  case when event_type = 'signup' then 'POST /signup' else concat(
    'GET /',
    case event_type when 'view' then 'products?' when 'click' then 'basket?'
      when 'purchase' then concat('order?order_id=', cast(event_id as string), '&')
      else 'error?' end,
    'product_id=', cast(event_id % 20 + 1 as string),
    '&customer_id=', cast(user_id as string)) end,
  ' HTTP/1.1" ', case when event_type = 'error' then '500' else '200' end, ' 1576') end
"""

LINES_SQL = """
lines AS (SELECT event_id, ts, CASE WHEN event_id % 100 = 99 THEN 'garbage' ELSE concat(
  '|', strftime(ts,'%Y-%m-%d %H:%M:%S'), '| 10.0.',
  cast(user_id // 256 AS varchar), '.', cast(user_id % 256 AS varchar), ' - - "',
  CASE WHEN event_type = 'signup' THEN 'POST /signup' ELSE concat(
    'GET /',
    CASE event_type WHEN 'view' THEN 'products?' WHEN 'click' THEN 'basket?'
      WHEN 'purchase' THEN concat('order?order_id=', cast(event_id AS varchar), '&')
      ELSE 'error?' END,
    'product_id=', cast(event_id % 20 + 1 AS varchar),
    '&customer_id=', cast(user_id AS varchar)) END,
  ' HTTP/1.1" ', CASE WHEN event_type = 'error' THEN '500' ELSE '200' END, ' 1576') END AS log
  FROM events)"""

def _field_sql(name: str) -> str:
    """A field by the patterns that define the format (``LOG_PATTERNS``), for this engine."""
    text = f"regexp_extract(log, '{LOG_PATTERNS[name]}', 1)"
    return f'try_cast({text} AS bigint) AS {name}' if name in NUMERIC_FIELDS else f'{text} AS "{name}"'


def _id_sql(name: str) -> str:
    return f"try_cast(regexp_extract(endpoint, '[?&]{name}=(\\d+)', 1) AS bigint) AS {name}"


LOGS_SQL = f"""{LINES_SQL},
fields AS (SELECT event_id, ts, {", ".join(map(_field_sql, LOG_PATTERNS))} FROM lines),
logs AS (SELECT *, {", ".join(map(_id_sql, QUERY_IDS))}, try_cast("timestamp" AS timestamp) AS stamp
  FROM fields)"""
LOG_FIELDS_SQL = """"timestamp", ip_address, http_method, endpoint, service, protocol,
  status_code, response_size, product_id, customer_id, order_id"""
LOG_PARTS_SQL = """cast(year(stamp) AS integer) AS year, cast(month(stamp) AS integer) AS month,
  cast(day(stamp) AS integer) AS day, cast(hour(stamp) AS integer) AS hour"""


def access_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One raw line per event, with arrival time and the shipper's epoch stamp."""
    events = given(spark, sf, "events")
    epoch = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D")
    return events.select("event_id", "ts", epoch.alias("@timestamp"), F.expr(_LINE).alias("log"))


# --- shop ------------------------------------------------------------------

SHOP_SQL = """
shop_orders AS (SELECT event_id AS order_id, user_id AS customer_id,
  cast(event_id % 20 + 1 AS integer) AS product_id,
  cast(1 AS integer) AS order_cnt, cast(floor(value * 100) AS integer) AS order_price,
  ts AS order_dt, ts AS last_update_time FROM events WHERE event_type = 'purchase'),
shop_products AS (SELECT cast(p_partkey AS integer) AS product_id, p_name AS name,
  p_type AS category, cast(floor(p_retailprice) AS integer) AS price, p_brand AS img_path,
  timestamp '2024-01-01 00:00:00' AS last_update_time FROM part),
shop_customers AS (SELECT c_custkey AS customer_id, lower(c_name) AS username,
  c_name AS first_name, c_mktsegment AS last_name, concat(lower(c_name), '@example.org') AS email,
  CASE WHEN c_nationkey > 0 THEN cast(c_nationkey AS varchar) END AS phone_number,
  c_nationkey + 20 AS age, CASE WHEN c_acctbal > 5000 THEN 'f' ELSE 'm' END AS gender,
  concat(c_mktsegment, ' street') AS address,
  timestamp '2024-01-01 00:00:00' AS date_joined, timestamp '2024-01-02 00:00:00' AS last_login,
  cast(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS smallint) AS is_active,
  timestamp '2024-01-03 00:00:00' AS last_update_time FROM customer)"""


def shop_orders(spark: SparkSession, sf: str) -> DataFrame:
    return (
        given(spark, sf, "events")
        .where("event_type = 'purchase'")
        .selectExpr(
            "event_id as order_id",
            "user_id as customer_id",
            "cast(event_id % 20 + 1 as int) as product_id",
            "1 as order_cnt",
            "cast(floor(value * 100) as int) as order_price",
            "ts as order_dt",
            "ts as last_update_time",
        )
    )


def shop_products(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, "part").selectExpr(
        "cast(p_partkey as int) as product_id",
        "p_name as name",
        "p_type as category",
        "cast(floor(p_retailprice) as int) as price",
        "p_brand as img_path",
        "timestamp_ntz'2024-01-01 00:00:00' as last_update_time",
    )


def shop_customers(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, "customer").selectExpr(
        "c_custkey as customer_id",
        "sha2(c_name, 256) as password",
        "lower(c_name) as username",
        "c_name as first_name",
        "c_mktsegment as last_name",
        "concat(lower(c_name), '@example.org') as email",
        "case when c_nationkey > 0 then cast(c_nationkey as string) end as phone_number",
        "c_nationkey + 20 as age",
        "case when c_acctbal > 5000 then 'f' else 'm' end as gender",
        "concat(c_mktsegment, ' street') as address",
        "timestamp_ntz'2024-01-01 00:00:00' as date_joined",
        "timestamp_ntz'2024-01-02 00:00:00' as last_login",
        "cast(0 as smallint) as is_superuser",
        "cast(0 as smallint) as is_staff",
        "cast(case when c_acctbal >= 0 then 1 else 0 end as smallint) as is_active",
        "timestamp_ntz'2024-01-03 00:00:00' as last_update_time",
    )


# --- listings --------------------------------------------------------------

LISTINGS_SQL = """
raw_listings AS (SELECT p_partkey AS id, p_brand AS listing_url, p_name AS name,
  p_type AS room_type, p_size - 1 AS minimum_nights, p_size % 12 AS host_id,
  concat('$', cast(cast(p_retailprice AS decimal(10,2)) AS varchar)) AS price,
  timestamp '2024-01-01 00:00:00' AS created_at,
  timestamp '2024-01-01 00:00:00' + to_days(p_size) AS updated_at FROM part),
raw_hosts AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey > 4 THEN s_name END AS name,
  CASE WHEN s_acctbal > 5000 THEN 't' ELSE 'f' END AS is_superhost,
  timestamp '2024-01-01 00:00:00' AS created_at,
  timestamp '2024-01-01 00:00:00' + to_days(s_nationkey) AS updated_at FROM supplier),
raw_reviews AS (SELECT event_id % 20 AS listing_id, ts AS date, concat('user ', user_id)
  AS reviewer_name, CASE WHEN event_type <> 'error' THEN props END AS comments,
  event_type AS sentiment FROM events),
full_moons AS (SELECT DISTINCT cast(ts AS date) AS full_moon_date FROM events
  WHERE dayofweek(ts) = 1)"""


def raw_listings(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, "part").selectExpr(
        "p_partkey as id",
        "p_brand as listing_url",
        "p_name as name",
        "p_type as room_type",
        "p_size - 1 as minimum_nights",
        "p_size % 12 as host_id",
        "concat('$', cast(cast(p_retailprice as decimal(10,2)) as string)) as price",
        "timestamp_ntz'2024-01-01 00:00:00' as created_at",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(p_size) as updated_at",
    )


def raw_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, "supplier").selectExpr(
        "s_suppkey as id",
        "case when s_nationkey > 4 then s_name end as name",
        "case when s_acctbal > 5000 then 't' else 'f' end as is_superhost",
        "timestamp_ntz'2024-01-01 00:00:00' as created_at",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(s_nationkey) as updated_at",
    )


def raw_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, "events").selectExpr(
        "event_id % 20 as listing_id",
        "ts as date",
        "concat('user ', cast(user_id as string)) as reviewer_name",
        "case when event_type <> 'error' then props end as comments",
        "event_type as sentiment",
    )


def full_moons(spark: SparkSession, sf: str) -> DataFrame:
    """Mondays that have events stand in for full moons."""
    days = given(spark, sf, "events").select(F.to_date("ts").alias("full_moon_date"))
    return days.where(F.dayofweek("full_moon_date") == 2).distinct()


# --- order changes ---------------------------------------------------------

# Changes of the orders since 1998: urgent ones are deleted, high ones inserted,
# those of low priority carry no operation, the rest are updated.
CHANGES_SQL = """
changes AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice,
  o_orderdate, o_orderpriority,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'D' WHEN '2-HIGH' THEN 'I'
    WHEN '5-LOW' THEN NULL ELSE 'U' END AS "Op"
  FROM orders WHERE o_orderdate >= timestamp '1998-01-01 00:00:00'),
target AS (SELECT * FROM orders WHERE o_orderdate < timestamp '2000-01-01 00:00:00')"""


def order_changes(spark: SparkSession, sf: str) -> DataFrame:
    return (
        given(spark, sf, "orders")
        .where("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'")
        .withColumn("o_totalprice", F.col("o_totalprice") + 1)
        .withColumn(
            "Op",
            F.expr(
                "case o_orderpriority when '1-URGENT' then 'D' when '2-HIGH' then 'I' "
                "when '5-LOW' then null else 'U' end"
            ),
        )
    )


def order_target(spark: SparkSession, sf: str) -> DataFrame:
    return given(spark, sf, "orders").where("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'")
