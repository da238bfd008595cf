"""The two ready-made sets of models: the shop's and the listings'."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from martflow.functions.times import with_partitions
from martflow.operators.checks import check_freshness, check_not_nulls, check_unique
from martflow.plans import marts
from martflow.plans.models import Project

# The checks declared for each model.
SHOP_CHECKS = {
    "dim_customer": {"unique": ["customer_id"], "not_null": ["customer_id", "email"]},
    "dim_product": {"unique": ["product_id"], "not_null": ["product_id"]},
    "fact_orders": {
        "unique": ["order_id"],
        "not_null": ["order_id", "customer_id", "product_id"],
    },
    "info_customer_conversion_rate": {"not_null": ["customer_id"]},
    "info_product_conversion_rate": {"not_null": ["product_id"]},
}
SHOP_SOURCES = ("customers", "products", "orders", "access_log")
DAY_PARTS = ("year", "month", "day")
LISTING_SOURCES = ("listings", "hosts", "reviews", "full_moons")

def declared_checks(name: str, declared: Mapping = SHOP_CHECKS) -> list:
    """The checks of a model, as functions of its frame: one pass for all columns that
    may not be NULL, and one for each unique column."""
    wanted = declared.get(name, {})
    checks = [lambda df, col=col: check_unique(df, col) for col in wanted.get("unique", ())]
    if "not_null" in wanted:
        checks.append(lambda df: check_not_nulls(df, wanted["not_null"]))
    return checks


def shop_project(
    spark: SparkSession,
    root: str,
    sources: Mapping[str, DataFrame],
    prefix: str = "",
    orders_by: Sequence[str] = ("year", "month", "day"),
    log_by: Sequence[str] = ("year", "month", "day"),
) -> Project:
    """Staging, dimensions, facts and conversion rates of the shop.

    ``sources`` has ``customers``, ``products``, ``orders`` and the parsed
    ``access_log``.  Orders merge by id, and a row older than the stored one is ignored;
    the log appends what is not stored yet, however late it comes.
    Order facts are partitioned by ``orders_by``, taken from the order time, so that a
    merge rewrites the days it touches; empty, they are one table rewritten whole.  Log
    facts are partitioned by ``log_by`` in the same way, and a run looks into the days
    that differ from the log only.
    """
    project = Project(spark, root, prefix)
    for name in SHOP_SOURCES:
        project.source(name, sources[name])

    def add(name, refs, build, materialized="table", layer="mart", **settings):
        project.model(
            name, refs, materialized, layer, checks=declared_checks(name), **settings
        )(lambda ctx: build(*(ctx.ref(r) for r in refs)))

    add("stg_customer", ["customers"], marts.stg_customer, "view", "stg")
    add("stg_product", ["products"], marts.stg_product, "view", "stg")
    add("stg_orders", ["orders"], marts.stg_orders, "table", "stg")
    add("stg_accesslog", ["access_log"], marts.stg_accesslog, "view", "stg")
    add("dim_customer", ["stg_customer"], marts.dim_customer)
    add("dim_product", ["stg_product"], marts.dim_product)

    def fact_accesslog(staged: DataFrame) -> DataFrame:
        facts = marts.fact_accesslog(staged)
        return with_partitions(facts, "timestamp", log_by[-1]) if log_by else facts

    add(
        "fact_accesslog",
        ["stg_accesslog"],
        fact_accesslog,
        "append",
        ts="timestamp",
        late="all",
        partition_by=log_by,
    )

    def fact_orders(orders: DataFrame) -> DataFrame:
        facts = marts.fact_orders(orders)
        return with_partitions(facts, "order_dt", orders_by[-1]) if orders_by else facts

    add(
        "fact_orders",
        ["orders"],
        fact_orders,
        "merge",
        keys=["order_id"],
        options={"newer_than": "last_update_time"},
        partition_by=orders_by,
        sort=["order_id"],
        cluster=["order_id"],
    )
    facts = ["fact_accesslog", "fact_orders"]
    # Both facts lie by day, and so do the rates made from them: only days with new facts
    # are made again.  Otherwise the rates are one table, made whole.
    by_day = tuple(orders_by) == tuple(log_by) == DAY_PARTS

    def add_rates(name, dimension, build):
        def rates(*frames: DataFrame) -> DataFrame:
            rows = build(*frames)
            return with_partitions(rows, "view_date", "day") if by_day else rows

        settings = {"partition_by": DAY_PARTS} if by_day else {}
        add(name, [*facts, dimension], rates, "daily" if by_day else "table", "info", **settings)

    add_rates("info_product_conversion_rate", "dim_product", marts.product_conversion_daily)
    add_rates("info_customer_conversion_rate", "dim_customer", marts.customer_conversion_daily)
    return project


def listings_project(
    spark: SparkSession, root: str, sources: Mapping[str, DataFrame], prefix: str = ""
) -> Project:
    """Cleansed listings and hosts, their join, and reviews flagged by full moon.

    ``sources`` has ``listings``, ``hosts``, ``reviews`` and the seed ``full_moons``.
    """
    project = Project(spark, root, prefix)
    for name in LISTING_SOURCES:
        project.source(name, sources[name])

    def add(name, refs, build, materialized, layer="core", **settings):
        project.model(name, refs, materialized, layer, **settings)(
            lambda ctx: build(*(ctx.ref(r) for r in refs))
        )

    add("src_listings", ["listings"], marts.src_listings, "ephemeral")
    add("src_hosts", ["hosts"], marts.src_hosts, "ephemeral")
    add("src_reviews", ["reviews"], marts.src_reviews, "ephemeral")
    add("dim_listings_cleansed", ["src_listings"], marts.cleansed_listings, "view")
    add("dim_hosts_cleansed", ["src_hosts"], marts.cleansed_hosts, "view")
    dims = ["dim_listings_cleansed", "dim_hosts_cleansed"]
    add("dim_listings_w_hosts", dims, marts.listings_with_hosts, "table")
    add(
        "fct_reviews",
        ["src_reviews"],
        marts.fct_reviews,
        "append",
        ts="review_date",
        late="all",
        on_schema_change="fail",
    )
    moons = ["fct_reviews", "full_moons"]
    add("full_moon_reviews", moons, marts.full_moon_reviews, "table", "mart")
    return project


def source_freshness(project: Project, name: str, ts: str, now) -> DataFrame:
    """Age of a source against the limits of one hour (warn) and a day (error)."""
    return check_freshness(project.frames[name], ts, now)
