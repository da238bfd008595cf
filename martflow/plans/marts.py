"""Staging models, dimensions, facts and conversion marts.

Inputs have the shop's column names (``product_id``, ``order_dt`` ...) or the
listings' (``listing_id``, ``host_id`` ...).

The conversion marts count facts per key and day *before* they meet a dimension:
the count is combined map-side, so a product with most of the traffic costs one
row per task, and the join sees counts instead of facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from martflow.functions.times import as_timestamp, day_of
from martflow.functions.values import (
    clean_price,
    fraction,
    full_name,
    non_zero,
    percent,
    text_date_part,
)
from martflow.operators.relational import join_on_shifted_day, rename_columns

# Columns of the staging models and dimensions, and their names.
STG_CUSTOMER = (
    "customer_id",
    "username",
    "first_name",
    "last_name",
    "email",
    "phone_number",
    "age",
    "gender",
    "address",
    "date_joined",
    "last_login",
    "is_active",
    "last_update_time",
)
STG_PRODUCT = ("product_id", "name", "category", "price", "img_path", "last_update_time")
STG_ORDERS = (
    "order_id",
    "customer_id",
    "product_id",
    "order_cnt",
    "order_price",
    "order_dt",
    "last_update_time",
)
STG_ACCESSLOG = (
    "timestamp",
    "ip_address",
    "http_method",
    "endpoint",
    "service",
    "protocol",
    "status_code",
    "response_size",
    "product_id",
    "customer_id",
    "order_id",
)
DIM_CUSTOMER = (
    "customer_id",
    "full_name",
    "email",
    "phone_number",
    "age",
    "gender",
    "address",
    "date_joined",
)
DIM_PRODUCT = {
    "product_id": "product_id",
    "name": "product_name",
    "category": "category",
    "price": "price",
    "img_path": "img_path",
}
SRC_LISTINGS = {
    "id": "listing_id",
    "name": "listing_name",
    "listing_url": "listing_url",
    "room_type": "room_type",
    "minimum_nights": "minimum_nights",
    "host_id": "host_id",
    "price": "price_str",
    "created_at": "created_at",
    "updated_at": "updated_at",
}
SRC_REVIEWS = {
    "listing_id": "listing_id",
    "date": "review_date",
    "reviewer_name": "reviewer_name",
    "comments": "review_text",
    "sentiment": "review_sentiment",
}
SRC_HOSTS = {
    "id": "host_id",
    "name": "host_name",
    "is_superhost": "is_superhost",
    "created_at": "created_at",
    "updated_at": "updated_at",
}
# Labels and defaults that appear in results.
NO_NAME = "Anonymous"
FULL_MOON, NOT_FULL_MOON = "full moon", "not full moon"
PRODUCT_PAGE = "product"


# --- staging ---------------------------------------------------------------


def stg_customer(customers: DataFrame) -> DataFrame:
    """Active customers, without account columns.  The flag is a number."""
    return customers.where(F.col("is_active") == 1).select(*STG_CUSTOMER)


def stg_product(products: DataFrame) -> DataFrame:
    return products.select(*STG_PRODUCT)


def stg_orders(orders: DataFrame) -> DataFrame:
    """Distinct rows.  This repairs identical copies only: differing versions of one
    order need ``latest_changes``."""
    return orders.select(*STG_ORDERS).distinct()


def stg_accesslog(logs: DataFrame) -> DataFrame:
    """Parsed log rows with a real timestamp, NULL where the text was malformed."""
    return logs.select(
        as_timestamp("timestamp").alias("timestamp"),
        *(c for c in STG_ACCESSLOG if c != "timestamp"),
    )


def src_listings(raw: DataFrame) -> DataFrame:
    return rename_columns(raw, SRC_LISTINGS)


def src_reviews(raw: DataFrame) -> DataFrame:
    return rename_columns(raw, SRC_REVIEWS)


def src_hosts(raw: DataFrame) -> DataFrame:
    return rename_columns(raw, SRC_HOSTS)


# --- dimensions and facts --------------------------------------------------


def dim_customer(staged: DataFrame) -> DataFrame:
    named = staged.withColumn("full_name", full_name("first_name", "last_name"))
    return named.select(*DIM_CUSTOMER)


def dim_product(staged: DataFrame) -> DataFrame:
    return rename_columns(staged, DIM_PRODUCT)


def fact_orders(orders: DataFrame) -> DataFrame:
    """Order facts; stored with ``incremental_merge`` on ``order_id``."""
    return orders.select(*STG_ORDERS)


def fact_accesslog(staged: DataFrame) -> DataFrame:
    """Log facts; stored with ``incremental_append`` on ``timestamp``."""
    return staged.select(*STG_ACCESSLOG)


def fct_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews that have a text; stored with ``incremental_append`` on the date."""
    return reviews.where(F.col("review_text").isNotNull())


def cleansed_listings(listings: DataFrame) -> DataFrame:
    """At least one night, and the price as a number."""
    return listings.select(
        "listing_id",
        "listing_name",
        "room_type",
        non_zero("minimum_nights").alias("minimum_nights"),
        "host_id",
        clean_price("price_str").alias("price"),
        "created_at",
        "updated_at",
    )


def cleansed_hosts(hosts: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("host_name"), F.lit(NO_NAME))
    return hosts.withColumn("host_name", name).select(*SRC_HOSTS.values())


def listings_with_hosts(listings: DataFrame, hosts: DataFrame) -> DataFrame:
    """Every listing with its host, if known, and the later of the two updates."""
    h = hosts.select(
        "host_id",
        "host_name",
        F.col("is_superhost").alias("host_is_superhost"),
        F.col("updated_at").alias("_host_updated"),
    )
    return listings.join(h, "host_id", "left").select(
        "listing_id",
        "listing_name",
        "room_type",
        "minimum_nights",
        "price",
        "host_id",
        "host_name",
        "host_is_superhost",
        "created_at",
        F.greatest("updated_at", "_host_updated").alias("updated_at"),
    )


def full_moon_reviews(reviews: DataFrame, full_moons: DataFrame) -> DataFrame:
    """Reviews, flagged if written the day after a full moon."""
    return join_on_shifted_day(
        reviews,
        "review_date",
        full_moons,
        "full_moon_date",
        shift=1,
        flag="is_full_moon",
        hit=FULL_MOON,
        miss=NOT_FULL_MOON,
    )


# --- conversion ------------------------------------------------------------


def is_product_request(endpoint: str = "endpoint") -> Column:
    """Any request that names a product, baskets and orders included."""
    return F.col(endpoint).contains(PRODUCT_PAGE)


def is_product_view(service: str = "service") -> Column:
    """Product pages only."""
    return F.col(service) == "products"


def _daily(facts: DataFrame, keys: Sequence[str], day: Column, count: Column) -> DataFrame:
    """Counts per key and day; facts without a key can join nothing."""
    known = facts
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys, day).agg(count)


def _conversion_daily(
    logs: DataFrame,
    orders: DataFrame,
    dimension: DataFrame,
    key: str,
    name: str,
    view: Column | None,
) -> DataFrame:
    seen = logs.where(is_product_request() if view is None else view)
    views = _daily(
        seen, [key], day_of("timestamp").alias("view_date"), F.count(F.lit(1)).alias("page_views")
    )
    bought = _daily(
        orders, [key], day_of("order_dt").alias("_day"), F.count("order_id").alias("_orders")
    )
    names = dimension.select(key, name)
    # A key that the dimension repeats counts once per repeat, as a join of the
    # facts would; so counts are added up again after the join.
    per_name = [key, name]
    views = views.join(names, key).groupBy(*per_name, "view_date")
    views = views.agg(F.sum("page_views").alias("page_views"))
    bought = bought.join(names, key).groupBy(*per_name, "_day")
    # Joined on key and day: names of one key share its orders, as each name's
    # orders are a row of their own.
    bought = bought.agg(F.sum("_orders").alias("_orders")).select(
        F.col(key), F.col("_day").alias("view_date"), "_orders"
    )
    joined = views.join(bought, [key, "view_date"], "left")
    return joined.select(
        key,
        name,
        "view_date",
        "page_views",
        F.coalesce("_orders", F.lit(0)).alias("orders"),
        fraction("_orders", "page_views").alias("conversion_rate"),
    )


def product_conversion_daily(
    logs: DataFrame, orders: DataFrame, products: DataFrame, view: Column | None = None
) -> DataFrame:
    """Orders per page view, by product and day; days with views only.

    ``view`` decides what counts as a page view (default: ``is_product_request``).
    """
    return _conversion_daily(logs, orders, products, "product_id", "product_name", view)


def customer_conversion_daily(
    logs: DataFrame, orders: DataFrame, customers: DataFrame, view: Column | None = None
) -> DataFrame:
    """Orders per page view, by customer and day; customers of the dimension only."""
    named = customers.withColumnRenamed("full_name", "customer_name")
    return _conversion_daily(logs, orders, named, "customer_id", "customer_name", view)


def product_conversion_percent(
    logs: DataFrame, orders: DataFrame, products: DataFrame, ordered: bool = False
) -> DataFrame:
    """Percent of requests that became orders, by product and day.

    Every product is kept.  The date is the orders' date: a day with requests and
    no orders has none, and orders of a day without requests do not appear.
    ``ordered`` sorts by date and rate, both descending, for a report; a sort
    before a partitioned write would be undone by it.  Products and views break ties:
    rows without a date, all at rate 0, are otherwise one range of the sort.
    """
    date = F.date_format(F.to_date("timestamp"), "yyyyMMdd").alias("_date")
    views = _daily(logs, ["product_id"], date, F.count(F.lit(1)).alias("_views"))
    date = F.date_format(F.to_date("order_dt"), "yyyyMMdd").alias("_date")
    bought = _daily(orders, ["product_id"], date, F.count(F.lit(1)).alias("_orders"))
    bought = bought.withColumn("order_date", F.col("_date"))
    joined = products.join(views, "product_id", "left").join(
        bought, ["product_id", "_date"], "left"
    )
    mart = joined.select(
        "product_id",
        "name",
        F.coalesce("_views", F.lit(0)).alias("view_count"),
        F.coalesce("_orders", F.lit(0)).alias("order_count"),
        percent("_orders", "_views").alias("conversion_rate"),
        "order_date",
        *(text_date_part("order_date", p).alias(p) for p in ("year", "month", "day")),
    )
    if ordered:
        return mart.orderBy(F.col("order_date").desc(), F.col("conversion_rate").desc(), "product_id", "view_count")
    return mart
