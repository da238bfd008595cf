import pytest
from pyspark.sql import functions as F

from martflow import storage, streaming
from martflow.functions import with_partitions
from martflow.operators import latest_changes
from martflow.streaming import offsets
from tests.conftest import rows_of

SCHEMA = "k int, ts timestamp_ntz, v string, Op string"


def _drop(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def dirs(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "ck")}


def test_new_files_are_read_once(spark, dirs):
    seen = []

    def run():
        streaming.scan_new_files(
            spark,
            dirs["in"],
            dirs["ck"],
            lambda b, i: seen.append(b.count()),
            "id bigint",
            max_files=1,
        )

    spark.range(3).coalesce(1).write.parquet(dirs["in"] + "/a")
    spark.range(4).coalesce(1).write.parquet(dirs["in"] + "/deep/b")
    run()
    assert sorted(seen) == [3, 4]
    run()
    assert len(seen) == 2
    spark.range(5).coalesce(1).write.parquet(dirs["in"] + "/c")
    run()
    assert seen[2:] == [5]


def test_failed_batch_is_delivered_again(spark, dirs):
    spark.range(3).coalesce(1).write.parquet(dirs["in"])
    got = []

    def fail(batch, batch_id):
        raise RuntimeError("stop")

    with pytest.raises(Exception):
        streaming.scan_new_files(spark, dirs["in"], dirs["ck"], fail, "id bigint")
    streaming.scan_new_files(
        spark, dirs["in"], dirs["ck"], lambda b, i: got.append(b.count()), "id bigint"
    )
    assert got == [3]


def test_stream_upsert_equals_batch(spark, dirs, at):
    first = [(1, at("01-01 00:00"), "a", "I"), (2, at("01-01 00:00"), "b", "I")]
    second = [(1, at("01-03 00:00"), "moved", "U"), (2, at("01-02 00:00"), None, "D")]
    third = [(1, at("01-02 00:00"), "stale", "U"), (3, at("01-02 00:00"), "c", "I")]
    days = ["year", "month", "day"]

    def run():
        stream = with_partitions(
            spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(dirs["in"]),
            "ts",
            "day",
        )
        streaming.stream_upsert(
            stream, dirs["out"], dirs["ck"], ["k"], "ts", days, once=True
        ).awaitTermination()
        return rows_of(spark.read.parquet(dirs["out"]), "k", "v", "day")

    for rows in (first, second, third):
        _drop(spark, dirs["in"], rows)
        got = run()
    everything = spark.createDataFrame(first + second + third, SCHEMA)
    batch = latest_changes(everything, ["k"], "ts", ties="one").where("Op <> 'D'")
    assert got == rows_of(with_partitions(batch, "ts", "day"), "k", "v", "day")
    assert run() == got


def test_repeated_batch_changes_nothing(spark, dirs, at):
    handle = streaming.merge_batches(dirs["out"], ["k"], "ts", ["k"])
    batch = spark.createDataFrame([(1, at("01-01 00:00"), "a", "I")], SCHEMA)
    newer = spark.createDataFrame([(1, at("01-02 00:00"), "b", "U")], SCHEMA)
    for n, b in enumerate([batch, newer, batch]):
        handle(b, n)
    assert rows_of(spark.read.parquet(dirs["out"]), "v") == [("b",)]


def test_snapshot_then_changes(spark, dirs):
    row = "id int, v string, p int"
    lines = ['{"after":{"id":1,"v":"new","p":1},"op":"u","ts_ms":1704067200000}',
             '{"before":{"id":2,"v":"old","p":1},"op":"d","ts_ms":1704067200000}']
    spark.createDataFrame([(s,) for s in lines], "value string").coalesce(1).write.parquet(dirs["in"])
    stream = streaming.stream_changes(
        spark.readStream.schema("value string").parquet(dirs["in"]), row
    )
    snapshot = spark.createDataFrame(
        [(1, "old", 1), (2, "old", 1), (3, "old", 1)], row
    ).selectExpr("*", "'I' as Op", "timestamp_ntz'2023-01-01 00:00:00' as changed_at")
    streaming.stream_upsert(
        stream, dirs["out"], dirs["ck"], ["id"], "changed_at", ["p"], snapshot=snapshot, once=True
    ).awaitTermination()
    assert rows_of(spark.read.parquet(dirs["out"]), "id", "v") == [(1, "new"), (3, "old")]


def test_hourly_landing_in_korea_time(spark, dirs, at):
    _drop(spark, dirs["in"], [(1, at("01-31 23:30"), "x", "I")])
    stream = spark.readStream.schema(SCHEMA).parquet(dirs["in"])
    streaming.sink_hourly(stream, dirs["out"], dirs["ck"], "ts", once=True).awaitTermination()
    found = spark.read.schema("k int").json(dirs["out"] + "/year=2024/month=02/day=01/hour=08")
    assert rows_of(found) == [(1,)]


def test_landing_limits_rows_per_file_when_asked(spark, dirs, at):
    _drop(spark, dirs["in"], [(i, at("01-31 23:30"), "x", "I") for i in range(25)])
    stream = spark.readStream.schema(SCHEMA).parquet(dirs["in"])
    streaming.sink_hourly(
        stream, dirs["out"], dirs["ck"], "ts", fmt="parquet", max_records=10, once=True
    ).awaitTermination()
    landed = spark.read.parquet(dirs["out"])
    assert landed.count() == 25 and len(landed.inputFiles()) == 3


def test_routing(spark, dirs):
    rows = [
        ("rdb.shop.orders", 0, 1, '{"id":1}'),
        ("rdb.shop.product", 0, 1, '{"name":"n"}'),
        ("schema.rdb", 0, 1, "{}"),
    ]
    schema = "topic string, partition int, offset int, value string"
    _drop(spark, dirs["in"], rows, schema)
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(dirs["in"])
        streaming.route_to_tables(
            stream, dirs["out"], dirs["ck"], r"rdb\.shop\.(.*)", once=True
        ).awaitTermination()
    got = streaming.routed_table(spark, dirs["out"], "orders", "id int")
    assert rows_of(got) == [("rdb.shop.orders", 0, 1, 1)]
    assert spark.read.parquet(dirs["out"]).count() == 2


PLACED = "topic string, partition int, offset long, value string"


def _route(spark, dirs, checkpoint, **options):
    stream = spark.readStream.schema(PLACED).parquet(dirs["in"])
    streaming.route_to_tables(stream, dirs["out"], checkpoint, r"(.*)", once=True, **options).awaitTermination()
    return rows_of(streaming.routed_table(spark, dirs["out"], "t", "id long"), "partition", "offset")


def _places(*runs):
    return [("t", p, o, f'{{"id":{o}}}') for p, low, high in runs for o in range(low, high + 1)]


def test_new_checkpoint_of_the_same_name(spark, dirs):
    _drop(spark, dirs["in"], _places((0, 0, 4)), PLACED)
    assert _route(spark, dirs, dirs["ck"]) == [(0, o) for o in range(5)]
    storage.delete(spark, dirs["ck"])
    _drop(spark, dirs["in"], _places((0, 5, 7), (1, 2, 3)), PLACED)
    assert _route(spark, dirs, dirs["ck"]) == [(0, o) for o in range(8)] + [(1, 2), (1, 3)]


def test_rows_without_an_entry_do_not_count(spark, dirs, monkeypatch):
    """A run that ends after the rows and before their ranges; then one that repeats it."""
    _drop(spark, dirs["in"], _places((0, 0, 2)), PLACED)
    _route(spark, dirs, dirs["ck"])
    _drop(spark, dirs["in"], _places((0, 3, 4)), PLACED)
    monkeypatch.setattr(offsets, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        _route(spark, dirs, dirs["ck"])
    monkeypatch.undo()
    assert _route(spark, dirs, dirs["ck"]) == [(0, o) for o in range(5)]
    assert spark.read.parquet(dirs["out"]).count() == 7  # what the lost run wrote lies there


def test_compaction_lost_in_between(spark, dirs, monkeypatch):
    for k in range(3):
        _drop(spark, dirs["in"], _places((0, 3 * k, 3 * k + 2)), PLACED)
        _route(spark, dirs, dirs["ck"])
    want = [(0, o) for o in range(9)]
    real = offsets.commit
    for lost in (offsets.__dict__["commit"], storage.delete):
        name, owner = ("commit", offsets) if lost is real else ("delete", storage)
        monkeypatch.setattr(owner, name, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            streaming.compact_routed(spark, dirs["out"], "t")
        monkeypatch.undo()
        assert rows_of(streaming.routed_table(spark, dirs["out"], "t", "id long"), "partition", "offset") == want
    assert streaming.compact_routed(spark, dirs["out"], "t") == 0  # deletes what was left
    entries = offsets.ledger(spark, dirs["out"])
    assert rows_of(entries.where("low is not null"), "low", "high") == [(0, 8)]
    assert _route(spark, dirs, str(dirs["ck"]) + "2") == want


def test_folder_without_a_ledger_is_taken_over(spark, dirs):
    rows = spark.createDataFrame(_places((0, 0, 3), (1, 7, 9)), PLACED).selectExpr("*", "'t' as table", "'x-0' as batch")
    rows.write.partitionBy("table", "batch").parquet(dirs["out"])
    _drop(spark, dirs["in"], _places((0, 2, 5)), PLACED)
    assert _route(spark, dirs, dirs["ck"]) == [(0, o) for o in range(6)] + [(1, 7), (1, 8), (1, 9)]


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(offsets, "BLOCK", 8)
    places = [(0, o) for o in [*range(3, 40), *range(50, 56), 70, *range(72, 90, 2), 90]] + [(1, o) for o in range(8)]
    rows = spark.createDataFrame([("t", p, o) for p, o in places * 2], "topic string, partition int, offset long")
    found = rows_of(offsets.ranges(rows), "partition", "low", "high")
    want = [(0, 3, 39), (0, 50, 55), (0, 70, 70), *((0, o, o) for o in range(72, 90, 2)), (0, 90, 90), (1, 0, 7)]
    assert found == sorted(want, key=repr)
    entries = offsets.ranges(rows).selectExpr("'x' as table", "*")
    batch = spark.createDataFrame([("t", p, o) for p in (0, 1, 2) for o in range(100)], "topic string, partition int, offset long")
    left = offsets.not_held(batch.selectExpr("'x' as table", "*"), entries)
    assert rows_of(left, "partition", "offset") == sorted({(p, o) for p in (0, 1, 2) for o in range(100)} - set(places), key=repr)
    assert offsets.not_held(batch.selectExpr("'y' as table", "*"), entries).count() == 300


def test_stored_rows_are_not_read_for_a_batch(spark, dirs):
    _drop(spark, dirs["in"], _places((0, 0, 4)), PLACED)
    _route(spark, dirs, dirs["ck"])
    batch = spark.createDataFrame(_places((0, 3, 9)), PLACED).withColumn("table", F.lit("t"))
    left = offsets.not_held(batch, offsets.held_ledger(spark, dirs["out"]))
    assert left.count() == 5 and all("_ledger" in f for f in left.inputFiles())


def test_topic_rows(spark):
    df = spark.createDataFrame(
        [("t", 0, 5, bytearray(b'{"k": 3}')), ("t", 0, 6, bytearray(b"{bad"))],
        "topic string, partition int, offset long, value binary",
    )
    got = streaming.topic_rows(df).select("kafka_offset", F.try_variant_get("data", "$.k", "int"))
    assert rows_of(got) == [(5, 3), (6, None)]


def test_kafka_needs_its_connector(spark):
    if streaming.kafka_available(spark):
        pytest.skip("connector present")
    with pytest.raises(RuntimeError):
        streaming.stream_topic(spark, "nowhere:9092", "t")


def test_stream_access_log_drops_repeats(spark, dirs):
    line = '|2024-06-20 14:27:27| 1.1.1.1 - - "GET /products?product_id=2 HTTP/1.1" 200 1'
    rows = [(1, line), (1, line), (2, line), (3, "garbage")]
    _drop(spark, dirs["in"], rows, "place int, log string")
    stream = spark.readStream.schema("place int, log string").parquet(dirs["in"])
    streaming.stream_access_log(stream, ["place"]).writeStream.format("parquet").option(
        "checkpointLocation", dirs["ck"]
    ).option("path", dirs["out"]).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.parquet(dirs["out"]), "place", "product_id") == [(1, 2), (2, 2)]


def test_stream_text(spark, tmp_path, dirs):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "access.log.1").write_text("a\nb\n")
    stream = streaming.stream_text(spark, dirs["in"], glob="access.log.*")
    stream.writeStream.format("parquet").option("checkpointLocation", dirs["ck"]).option(
        "path", dirs["out"]
    ).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.parquet(dirs["out"]), "log") == [("a",), ("b",)]
