from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martflow.functions import (
    clean_price,
    fraction,
    full_name,
    json_field,
    local_time,
    parse_access_log,
    percent,
    query_params,
    route_name,
    with_local_partitions,
    with_partitions,
)
from martflow.operators import (
    assert_checks,
    check_columns,
    check_freshness,
    check_not_null,
    check_unique,
    join_on_shifted_day,
    project_public,
    union_frames,
)
from tests.conftest import rows_of

LINES = {
    "order": "|2024-06-20 14:27:27| 10.1.2.3 - - "
    '"GET /order?order_id=9&product_id=2&customer_id=61 HTTP/1.1" 200 1576',
    "no query": '|2024-06-20 14:27:28| 10.1.2.3 - - "POST /signup HTTP/1.1" 201 12',
    "method": '|2024-06-20 14:27:29| 10.1.2.3 - - "PATCH /x?a=1 HTTP/1.1" 404 1',
    "garbage": "garbage",
    "empty": "",
    "null": None,
    "other id": '|2024-06-20 14:27:29| 10.1.2.3 - - "GET /b?xproduct_id=7 HTTP/1.1" 200 1',
    "huge": '|x| 1.1.1.1 - - "GET /b?product_id=99999999999 HTTP/1.1" 200 99999999999',
}


@pytest.fixture(scope="module")
def logs(spark):
    df = spark.createDataFrame(list(LINES.items()), "name string, log string")
    return {r["name"]: r for r in parse_access_log(df, keep=["name"]).collect()}


def test_full_line(logs):
    r = logs["order"].asDict()
    assert r["timestamp"] == "2024-06-20 14:27:27" and r["ip_address"] == "10.1.2.3"
    assert (r["http_method"], r["service"], r["protocol"]) == ("GET", "order", "HTTP/1.1")
    assert r["endpoint"] == "/order?order_id=9&product_id=2&customer_id=61"
    assert (r["status_code"], r["response_size"]) == (200, 1576)
    assert (r["product_id"], r["customer_id"], r["order_id"]) == (2, 61, 9)
    assert (r["year"], r["month"], r["day"], r["hour"]) == (2024, 6, 20, 14)


def test_no_query_has_no_service(logs):
    r = logs["no query"]
    assert (r["service"], r["endpoint"], r["order_id"]) == ("", "/signup", None)


def test_unknown_method(logs):
    assert (logs["method"]["http_method"], logs["method"]["service"]) == ("", "x")


@pytest.mark.parametrize("name", ["garbage", "empty"])
def test_malformed_line(logs, name):
    r = logs[name]
    assert r["timestamp"] == "" and r["status_code"] is None and r["year"] is None


def test_null_line(logs):
    assert logs["null"]["timestamp"] is None and logs["null"]["day"] is None


def test_ids_are_anchored_and_bounded(spark, logs):
    assert logs["other id"]["product_id"] is None
    assert logs["huge"]["product_id"] == 99_999_999_999
    one = spark.range(1).select(F.lit("/b?xproduct_id=7").alias("u"))
    loose = query_params("u", ["product_id"], anchored=False)["product_id"]
    assert one.select(loose).head()[0] == 7


def test_price(spark):
    texts = ["$1,200.00", "$0.00", "", None, "12.5", "$x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(clean_price("t")).collect()]
    assert got == [Decimal("1200.00"), Decimal("0.00"), None, None, Decimal("12.50"), None]


def test_rates(spark):
    df = spark.createDataFrame([(1, 3), (None, 4), (2, 0), (2, None)], "p int, w int")
    assert [r[0] for r in df.select(percent("p", "w")).collect()] == [33.33, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(fraction("p", "w")).collect()] == [1 / 3, 0.0, 0.0, 0.0]


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("a", "b", '{"k": 5}', "rdb.shop.orders"), ("a", None, "{broken", "schema.rdb")],
        "f string, l string, j string, t string",
    )
    got = df.select(
        full_name("f", "l"), json_field("j", "$.k", "int"), route_name("t", r"rdb\.shop\.(.*)")
    ).collect()
    assert [tuple(r) for r in got] == [("a b", 5, "orders"), (None, None, None)]


def test_late_evening_is_next_day_in_korea(spark, at):
    df = spark.createDataFrame([(at("01-31 23:30"),)], "ts timestamp_ntz")
    assert df.select(local_time("ts")).head()[0] == at("02-01 08:30")
    assert with_local_partitions(df, "ts").head()[1:] == (2024, 2, 1, 8)
    assert with_partitions(df, "ts").head()[1:] == (2024, 1, 31, 23)


def test_partition_text(spark):
    df = spark.createDataFrame([("2024-03-04 05:06:07",), ("",), ("no",)], "ts string")
    got = [tuple(r)[1:] for r in with_partitions(df, "ts").collect()]
    assert got == [(2024, 3, 4, 5), (None,) * 4, (None,) * 4]


def test_public_projection(spark):
    df = spark.createDataFrame(
        [("p", 1, 0, "e")], "password string, is_superuser int, is_staff int, email string"
    )
    assert project_public(df).columns == ["email"]
    assert project_public(df, mask=["email"]).head()[0] != "e"


def test_union_matches_names(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", 2)], "t string, n int")
    c = spark.createDataFrame([(3, 4.0)], "n int, extra double")
    assert rows_of(union_frames([a, b, c]), "n", "t") == [(1, "x"), (2, "y"), (3, None)]


def test_repeated_seed_date_does_not_multiply(spark, at):
    facts = spark.createDataFrame([(1, at("01-02 10:00")), (2, at("01-03 10:00"))], "k int, ts timestamp_ntz")
    days = spark.createDataFrame([(at("01-01 00:00"),)] * 2, "d timestamp_ntz")
    got = join_on_shifted_day(facts, "ts", days, "d")
    assert rows_of(got, "k", "is_flagged") == [(1, "yes"), (2, "no")]


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "y"), (None, "z")], "k int, v string")
    assert check_unique(df, "k").head()[2:] == ("error", 1)
    assert check_unique(df, "v").head()[2:] == ("pass", 0)
    assert check_not_null(df, "v").head()[2:] == ("error", 1)
    assert check_columns(df, ["k", "w"]).head()[1:] == ("w", "error", 1)
    assert_checks([check_unique(df, "v")])
    with pytest.raises(AssertionError, match="not_null"):
        assert_checks([check_unique(df, "v"), check_not_null(df, "v")])


@pytest.mark.parametrize(
    "age, status",
    [(timedelta(minutes=59), "pass"), (timedelta(hours=2), "warn"), (timedelta(hours=25), "error")],
)
def test_freshness(spark, age, status):
    now = datetime(2024, 1, 2)
    df = spark.createDataFrame([(now - age,)], "ts timestamp_ntz")
    assert check_freshness(df, "ts", now).head()[2] == status
    assert check_freshness(df.where("false"), "ts", now).head()[2] == "error"
