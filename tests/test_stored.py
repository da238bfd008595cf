from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from martflow import sinks, sources, storage
from martflow.functions import with_partitions
from martflow.operators import latest_changes, merge
from martflow.operators.merge import DuplicateKeys, SchemaMismatch
from martflow.plans import (
    Project,
    check_schema,
    incremental_append,
    incremental_merge,
    jobs,
    missing_rows,
)
from martflow.session import shared_dir
from martflow.sinks import tombstones, writers
from tests.conftest import rows_of

HOURS = ["year", "month", "day", "hour"]


def _line(stamp, product=1):
    return f'|{stamp}| 10.0.0.1 - - "GET /products?product_id={product} HTTP/1.1" 200 10'


def _land(spark, root, hour, *lines):
    folder = f"{root}/year=2024/month=06/day=15/hour={hour:02d}"
    rows = [(1.0, s) for s in lines]
    spark.createDataFrame(rows, "`@timestamp` double, log string").coalesce(1).write.mode(
        "append"
    ).json(folder)


# --- scans -----------------------------------------------------------------


def test_hours_partition_time(at):
    a, b, c = at("01-01 10:59"), at("01-01 12:00"), at("01-02 00:30")
    assert sources.hours_between(a, b) == [at(f"01-01 {h}:00") for h in (10, 11, 12)]
    joined = sources.hours_between(a, b) + sources.hours_between(b + timedelta(hours=1), c)
    assert joined == sources.hours_between(a, c)
    assert sources.hours_between(c, a) == []


def test_scan_hours_missing_folder(spark, tmp_path, at):
    root = str(tmp_path / "raw")
    _land(spark, root, 13, "a")
    _land(spark, root, 15, "b")
    since, until = datetime(2024, 6, 15, 13, 30), datetime(2024, 6, 15, 15, 1)
    with pytest.raises(sources.files.MissingFolders):
        sources.scan_hours(spark, root, since, until)
    got = sources.scan_hours(spark, root, since, until, missing="skip")
    assert rows_of(got, "log", "hour") == [("a", 13), ("b", 15)]
    one = sources.scan_hours(spark, root, since, datetime(2024, 6, 15, 13, 59))
    assert rows_of(one, "log") == [("a",)]
    none = sources.scan_hours(spark, root, at("01-01 00:00"), at("01-01 05:00"), missing="skip")
    assert none.isEmpty() and none.columns == ["@timestamp", "log", *HOURS]


def test_scan_hours_matches_columns_by_name(spark, tmp_path):
    root = str(tmp_path / "raw")
    folder = root + "/year=2024/month=1/day=2/hour={}"
    spark.createDataFrame([(1, "x")], "n int, t string").write.parquet(folder.format(3))
    spark.createDataFrame([("y", 2, 0)], "t string, n int, extra int").write.parquet(
        folder.format("04")
    )
    since, until = datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 4)
    got = sources.scan_hours(spark, root, since, until, fmt="parquet")
    assert rows_of(got, "n", "t", "extra", "hour") == [(1, "x", None, 3), (2, "y", 0, 4)]


def test_day_folders():
    now = datetime(2024, 4, 25, 11)
    # 07:00 in Korea is still the day before in UTC.
    assert sources.day_folders(datetime(2024, 4, 24, 7), now) == [
        "2024/04/23",
        "2024/04/24",
        "2024/04/25",
    ]
    assert sources.day_folders(datetime(2024, 4, 24, 13), now)[0] == "2024/04/24"
    same = {"source_tz": "UTC", "local_tz": "UTC"}
    assert sources.day_folders(datetime(2024, 4, 25, 23, 59), now, **same) == ["2024/04/25"]
    assert len(sources.day_folders(None, now, timedelta(days=365))) == 366
    with pytest.raises(ValueError):
        sources.day_folders(None, now)
    assert sources.day_folders(None, now, timedelta(days=30), **same)[0] == "2024/03/26"
    assert sources.day_folders(datetime(2024, 5, 1), now, **same) == []


def test_scan_days_skips_missing(spark, tmp_path):
    root = str(tmp_path / "cdc")
    for day in ("2024/02/28", "2024/03/01"):
        spark.createDataFrame([(day,)], "d string").write.parquet(f"{root}/{day}")
    got = sources.scan_days(spark, root, datetime(2024, 2, 28, 10), datetime(2024, 3, 2))
    assert rows_of(got) == [("2024/02/28",), ("2024/03/01",)]
    with pytest.raises(sources.files.MissingFolders):
        sources.scan_days(spark, root, datetime(2025, 1, 1), datetime(2025, 1, 2))
    empty = sources.scan_days(
        spark, root, datetime(2025, 1, 1), datetime(2025, 1, 2), schema="d string"
    )
    assert empty.isEmpty()


def test_csv(spark, tmp_path):
    path = tmp_path / "hosts.csv"
    path.write_text(
        'id,name,created_at\n1,"Kim, ""K""",2024-01-02T03:04:05\n2,,2024-01-02T03:04:05\n'
    )
    got = sources.scan_csv(spark, str(path), "id int, name string, created_at timestamp")
    assert rows_of(got, "id", "name") == [(1, 'Kim, "K"'), (2, None)]
    assert got.head()["created_at"] == datetime(2024, 1, 2, 3, 4, 5)


def test_catalog(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(root)
    names = sources.register_external(spark, "ext_test", {"t": root})
    assert sources.table(spark, names["t"]).where("p = 1").count() == 2
    assert sources.scan_catalog(spark, names["t"], partition="p=0").count() == 2
    assert sources.scan_catalog(spark, names["t"], schemes={"s3": "s3a"}).count() == 4
    assert sources.describe_files(spark, root).fieldNames() == ["id", "p"]


# --- writes ----------------------------------------------------------------


@pytest.fixture
def hourly(spark, at):
    df = spark.createDataFrame(
        [(1, at("01-01 13:05")), (2, at("01-01 13:30")), (3, at("01-01 14:01"))],
        "id int, ts timestamp_ntz",
    )
    return with_partitions(df, "ts")


@pytest.fixture
def late(spark, at):
    """One row stamped 13:59 that arrives with the 14h rows, and one repeat."""
    df = spark.createDataFrame(
        [(4, at("01-01 13:59")), (3, at("01-01 14:01")), (5, at("01-01 14:10"))],
        "id int, ts timestamp_ntz",
    )
    return with_partitions(df, "ts")


def test_late_row_adds_to_its_hour(spark, tmp_path, hourly, late):
    path = str(tmp_path / "t")
    sinks.write_partitions(hourly, path, HOURS)
    sinks.write_partitions(late, path, HOURS, distinct=True)
    assert rows_of(spark.read.parquet(path), "id") == [(i,) for i in (1, 2, 3, 4, 5)]
    sinks.write_partitions(late, path, HOURS, keys=["id"], ts="ts")
    assert spark.read.parquet(path).count() == 5


def test_late_row_replaces_its_hour_when_asked(spark, tmp_path, hourly, late):
    path = str(tmp_path / "t")
    sinks.write_partitions(hourly, path, HOURS, mode="overwrite_partitions")
    sinks.write_partitions(late, path, HOURS, mode="overwrite_partitions")
    assert rows_of(spark.read.parquet(path), "id") == [(3,), (4,), (5,)]


def test_text_and_null_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "01"), (2, None), (3, "a b/c%")], "id int, m string")
    sinks.write_partitions(df, path, ["m"], mode="overwrite")
    more = spark.createDataFrame([(4, "01"), (5, None), (6, "a b/c%")], "id int, m string")
    sinks.write_partitions(more, path, ["m"])
    got = sources.scan_full(spark, path, df.schema)
    assert rows_of(got, "id", "m") == rows_of(df.union(more), "id", "m")
    sinks.drop_partitions(spark, path, ["m"], "m = 'a b/c%'")
    assert rows_of(sources.scan_full(spark, path, df.schema), "id") == [(1,), (2,), (4,), (5,)]


def test_newest_version_wins_and_unknown_keys_stay(spark, tmp_path, at):
    path = str(tmp_path / "t")
    rows = [(1, at("01-01 00:00"), "old", 1), (None, at("01-01 00:00"), "nokey", 1)]
    schema = "k int, ts timestamp_ntz, v string, p int"
    sinks.write_partitions(spark.createDataFrame(rows, schema), path, ["p"], keys=["k"], ts="ts")
    new = [(1, at("01-02 00:00"), "new", 1), (1, at("01-01 12:00"), "between", 1)]
    sinks.write_partitions(spark.createDataFrame(new, schema), path, ["p"], keys=["k"], ts="ts")
    assert rows_of(spark.read.parquet(path), "v") == [("new",), ("nokey",)]


def test_interrupted_commit_is_finished_from_the_stage(spark, tmp_path, hourly):
    path, batch = str(tmp_path / "t"), "batch-1"
    sinks.write_partitions(hourly, path, HOURS, mode="overwrite_partitions")
    stage = writers.commit_stage(spark, path, batch)
    changed = hourly.withColumn("id", F.col("id") + 10)
    writers.declare_schema(spark, stage, changed.schema)
    changed.write.mode("append").parquet(stage)
    # The table lost a folder while it was replaced; what the retry is given no
    # longer has those rows either.
    sinks.drop_partitions(spark, path, HOURS, "hour = 13")
    sinks.replace_partitions(spark.read.parquet(path), path, HOURS, batch_id=batch)
    assert rows_of(spark.read.parquet(path), "id") == [(11,), (12,), (13,)]
    assert not storage.exists(spark, stage)


def test_one_batch_id_on_two_tables(spark, tmp_path):
    """A stage that a lost driver left belongs to its table, and to its columns."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    left = spark.createDataFrame([(1, "of a", 1)], "id int, v string, p int")
    stage = writers.commit_stage(spark, a, "job-1")
    writers.declare_schema(spark, stage, left.schema)
    left.write.mode("append").parquet(stage)
    sinks.replace_partitions(left.withColumn("v", F.lit("of b")), b, ["p"], batch_id="job-1")
    assert rows_of(spark.read.parquet(b), "v") == [("of b",)]
    # Other columns than the stage has: the stage is of an older form of the batch.
    sinks.replace_partitions(left.withColumn("w", F.lit(2)), a, ["p"], batch_id="job-1")
    assert rows_of(spark.read.parquet(a), "v", "w") == [("of a", 2)]
    assert not storage.exists(spark, stage)


def test_text_put_in_place_halfway(spark, tmp_path):
    path = str(tmp_path / "x.json")
    storage.write_text(spark, path, "one")
    storage.write_text(spark, f"{path}.new", "two")
    assert storage.read_text(spark, path) == "one"
    storage.delete(spark, path)
    assert storage.read_text(spark, path) == "two"


def test_every_partition_moves(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("p", F.col("id"))
    sinks.write_partitions(df, path, ["p"], mode="overwrite")
    batch = df.withColumn("p", F.col("id") + 100)
    sinks.upsert_path(spark, path, batch, ["id"], ["p"])
    assert rows_of(spark.read.parquet(path), "id", "p") == [(i, i + 100) for i in range(10)]
    sinks.write_partitions(batch, path, ["p"], keys=["id"])
    assert spark.read.parquet(path).count() == 10


def test_upsert_empties_and_creates_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, v string, p int")
    sinks.upsert_path(spark, path, first, ["k"], ["p"])
    batch = spark.createDataFrame(
        [(1, "moved", 9, "U"), (2, None, 2, "D"), (7, "new", 7, "I"), (8, None, 8, "D")],
        "k int, v string, p int, Op string",
    )
    untouched = f"{path}/p=3"
    before = storage.folders(spark, untouched)
    for _ in range(2):
        sinks.upsert_path(spark, path, batch, ["k"], ["p"])
        got = spark.read.parquet(path)
        assert rows_of(got, "k", "v", "p") == [(1, "moved", 9), (3, "c", 3), (7, "new", 7)]
    assert before and not storage.exists(spark, f"{path}/p=1")
    twice = batch.union(batch)
    with pytest.raises(DuplicateKeys):
        sinks.upsert_path(spark, path, twice, ["k"], ["p"])


@pytest.mark.parametrize("kind", ["string", "date"])
def test_partitions_keep_their_types_in_a_merge(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    months = {"string": ("'01'", "'02'"), "date": ("date'2024-01-01'", "date'2024-02-01'")}[kind]

    def rows(*given):
        return spark.sql(" union all ".join(f"select {k} k, {m} m, '{o}' Op" for k, m, o in given))

    first = rows((1, months[0], "I"), (2, months[1], "I"), (3, f"cast(null as {kind})", "I"))
    sinks.upsert_path(spark, path, first, ["k"], ["m"])
    sinks.upsert_path(spark, path, rows((1, months[1], "U"), (3, months[1], "U")), ["k"], ["m"])
    assert rows_of(sources.scan_full(spark, path), "k") == [(1,), (2,), (3,)]
    assert len(storage.folders(spark, f"{path}/m=*")) == 1
    for k in (1, 2, 3):
        sinks.upsert_path(spark, path, rows((k, months[1], "D")), ["k"], ["m"])
    assert storage.folders(spark, f"{path}/m=*") == []
    # The emptied table goes on, with its columns.
    sinks.upsert_path(spark, path, rows((9, months[0], "U")), ["k"], ["m"])
    assert rows_of(spark.read.parquet(path), "k") == [(9,)]


def test_upsert_into_a_folder_without_a_kept_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1)], "k int, v string, p int").write.partitionBy("p").parquet(path)
    spark.createDataFrame([(2, 5, 1)], "k int, w int, p int").write.mode("append").partitionBy("p").parquet(path)
    sinks.upsert_path(
        spark, path, spark.createDataFrame([(3, "c", 7, 1)], "k int, v string, w int, p int"), ["k"], ["p"]
    )
    got = sources.scan_full(spark, path, evolved=True)
    assert rows_of(got, "k", "v", "w") == [(1, "a", None), (2, None, 5), (3, "c", 7)]


def test_the_batch_wins_and_null_keys_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, v string, p int"
    old = [(1, "old", 1), (None, "n1", 1), (None, "n2", 1), (1, "elsewhere", 2)]
    sinks.write_partitions(spark.createDataFrame(old, schema), path, ["p"], keys=["k"])
    new = spark.createDataFrame([(1, "new", 1), (None, "n3", 1)], schema)
    for _ in range(2):
        sinks.write_partitions(new, path, ["p"], keys=["k"])
        got = rows_of(spark.read.parquet(path), "k", "v", "p")
        assert got == [(1, "elsewhere", 2), (1, "new", 1), (None, "n1", 1), (None, "n2", 1), (None, "n3", 1)]
    sinks.write_partitions(new.union(new).where("k = 1"), path, ["p"])
    assert spark.read.parquet(path).count() == 7


def test_upsert_with_a_new_column(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_path(
        spark,
        path,
        spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int"),
        ["k"],
        ["p"],
    )
    wider = spark.createDataFrame([(1, 5, 1)], "k int, w int, p int")
    with pytest.raises(SchemaMismatch):
        sinks.upsert_path(spark, path, wider, ["k"], ["p"])
    sinks.upsert_path(spark, path, wider, ["k"], ["p"], schema="evolve")
    got = sources.scan_full(spark, path, evolved=True)
    assert rows_of(got, "k", "v", "w") == [(1, None, 5), (2, "b", None)]
    # Old and new files differ now: a rewrite keeps the columns of both.
    full = spark.createDataFrame([(3, "c", 7, 1)], "k int, v string, w int, p int")
    sinks.upsert_path(spark, path, full, ["k"], ["p"])
    sinks.compact(spark, path, ["p"])
    with pytest.raises(SchemaMismatch):
        sinks.write_partitions(wider, path, ["p"], keys=["k"])
    sinks.write_partitions(
        full.withColumn("k", F.lit(4)).withColumn("x", F.lit("y")), path, ["p"], keys=["k"]
    )
    got = sources.scan_full(spark, path, evolved=True)
    assert rows_of(got, "k", "v", "w", "x") == [
        (1, None, 5, None),
        (2, "b", None, None),
        (3, "c", 7, None),
        (4, "c", 7, "y"),
    ]


def test_a_wider_batch_takes_the_tables_types(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "k int, n int, p int")
    sinks.upsert_path(spark, path, first, ["k"], ["p"])
    longs = spark.createDataFrame([(1, 11, 1), (3, 30, 2)], "k long, n long, p int")
    sinks.upsert_path(spark, path, longs, ["k"], ["p"])
    sinks.write_partitions(longs, path, ["p"], keys=["k"])
    got = spark.read.parquet(path)
    assert got.schema["n"].dataType.simpleString() == "int"
    assert rows_of(got, "k", "n") == [(1, 11), (2, 20), (3, 30)]


def test_bookmarks_compact_themselves(spark, tmp_path, at):
    root = tmp_path / "marks"
    marks = sources.Bookmarks(spark, str(root), keep=3)
    for i in range(1, 9):
        marks.advance("a b/c", at(f"01-0{i} 00:00"), at(f"02-0{i} 00:00"))
        assert marks.get("a b/c") == at(f"01-0{i} 00:00")
        marks.set("late", at("01-01 00:00"), at("02-01 00:00"))
        assert len(list(root.glob("table_name=*/*.json"))) <= 6
    # The bookmark in force stays, though an older run has set another since.
    marks.set("a b/c", at("01-03 00:00"), at("02-03 00:00"))
    marks.compact()
    assert marks.get("a b/c") == at("01-08 00:00") and marks.get("late") == at("01-01 00:00")
    assert marks.history().count() == 2


def test_compact_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).withColumn("p", F.col("id") % 3)
    rows.repartition(9).write.partitionBy("p").parquet(path)
    many = len(spark.read.parquet(path).inputFiles())
    sinks.compact(spark, path, ["p"])
    after = spark.read.parquet(path)
    assert after.count() == 100 and len(after.inputFiles()) < many


def test_native_merge_is_refused_by_parquet(spark):
    sinks.ensure_database(spark, "native_test")
    sinks.create_table(spark, "native_test.t", "k int, v string")
    source = spark.createDataFrame([(1, "a", "U")], "k int, v string, Op string")
    with pytest.raises(Exception, match="MERGE|UNSUPPORTED"):
        sinks.native_merge(source, "native_test.t", ["k"])


def test_tables(spark, tmp_path):
    sinks.ensure_database(spark, "tables_test")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.create_table(spark, "tables_test.t", df, properties={"kind": "x"})
    assert not sinks.create_table(spark, "tables_test.t", df)
    with pytest.raises(ValueError):
        sinks.create_table(spark, "tables_test.t", df, if_exists="error")
    sinks.insert_into(df.select("v", "k"), "tables_test.t")
    assert spark.table("tables_test.t").where("k = 1").count() == 2
    shown = spark.sql("SHOW TBLPROPERTIES tables_test.t").collect()
    assert ("kind", "x") in [tuple(r) for r in shown]
    assert "tables_test" in sinks.list_databases(spark)
    sinks.drop_table(spark, "tables_test.t")
    assert sinks.list_tables(spark, "tables_test") == []


def test_publish_swaps_and_survives_a_failed_run(spark, tmp_path):
    sinks.ensure_database(spark, "publish_test")
    name, root = "publish_test.t", str(tmp_path)
    sinks.publish(spark.range(3), name, root)
    held = spark.table(name)
    with pytest.raises(Exception):
        sinks.publish(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")), name, root)
    assert spark.table(name).count() == 3
    sinks.publish(spark.table(name).union(spark.range(3, 5)), name, root)
    assert spark.table(name).count() == 5 and held.count() == 3
    sinks.publish(spark.range(2).withColumn("more", F.lit("x")), name, root)
    assert spark.table(name).columns == ["id", "more"]
    # The failed run left a folder too.
    assert len(sinks.drop_old_versions(spark, name, root, keep=1)) == 3
    assert sinks.drop_old_versions(spark, name, root, keep=0) == []
    assert spark.table(name).count() == 2


# --- bookmarks and jobs ----------------------------------------------------


def test_bookmarks(spark, tmp_path, at):
    marks = sources.Bookmarks(spark, str(tmp_path / "marks"))
    assert marks.get("orders") is None
    assert marks.get("orders", at("01-01 00:00")) == at("01-01 00:00")
    marks.set("orders", at("01-05 00:00"), updated_at=at("01-06 00:00"))
    marks.set("a/b=c", at("01-02 00:00"), at("01-06 00:00"), started_at=at("01-01 00:00"))
    marks.advance("orders", None, at("01-07 00:00"))
    assert marks.get("orders") == at("01-05 00:00") and marks.get("a/b=c") == at("01-02 00:00")
    marks.advance("orders", at("01-03 00:00"), at("01-08 00:00"))
    assert marks.get("orders") == at("01-03 00:00")
    assert marks.history().count() == 3
    marks.compact()
    assert marks.history().count() == 2 and marks.get("orders") == at("01-03 00:00")


@pytest.mark.parametrize("mode", ["by_arrival", "merge_partitions", "overwrite_partitions"])
def test_log_job_and_late_rows(spark, tmp_path, mode):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    marks = sources.Bookmarks(spark, str(tmp_path / "marks"))
    twice = _line("2024-06-15 13:20:00")
    _land(spark, raw, 13, _line("2024-06-15 13:10:00"), twice, twice, "garbage")
    start = datetime(2024, 6, 15, 13)
    # Rows after each of three runs: first, one hour on with a late line, repeated.
    expected = {
        "by_arrival": [4, 6, 6],
        "merge_partitions": [3, 5, 5],
        "overwrite_partitions": [4, 6, 3],
    }[mode]

    def run(hour):
        now = datetime(2024, 6, 15, hour, 59)
        jobs.access_log_batch(spark, raw, out, marks, "log", now, start, mode=mode)
        return spark.read.parquet(out).count()

    assert run(13) == expected[0]
    assert marks.get("log") == datetime(2024, 6, 15, 13)
    _land(spark, raw, 14, _line("2024-06-15 13:59:00"), _line("2024-06-15 14:05:00"))
    assert run(14) == expected[1]
    assert marks.get("log") == datetime(2024, 6, 15, 14)
    assert run(14) == expected[2]
    assert marks.get("log") == datetime(2024, 6, 15, 14)


def test_first_log_run_begins_at_the_oldest_folder(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    marks = sources.Bookmarks(spark, str(tmp_path / "marks"))
    now = datetime(2024, 6, 15, 14, 30)
    _land(spark, raw, 13, _line("2024-06-15 13:10:00"))
    _land(spark, raw, 14, _line("2024-06-15 14:10:00"))
    jobs.access_log_batch(spark, raw, out, marks, "log", now)
    assert rows_of(spark.read.parquet(out), "hour") == [(13,), (14,)]


def test_a_fast_clock_and_a_landing_zone_lose_no_line(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    marks = sources.Bookmarks(spark, str(tmp_path / "marks"))
    # The landing is five hours behind UTC; one line's clock is four hours fast.
    for hour, stamps in ((8, ["13:10", "17:20"]), (9, ["14:05"]), (10, ["15:01"])):
        _land(spark, raw, hour, *(_line(f"2024-06-15 {s}:00") for s in stamps))
        now = datetime(2024, 6, 15, hour + 5, 59)
        jobs.access_log_batch(spark, raw, out, marks, "log", now, zone="Etc/GMT+5")
    assert spark.read.parquet(out).count() == 4 and marks.get("log") == datetime(2024, 6, 15, 10)


def test_scan_to_upsert_jobs(spark, tmp_path, at):
    marks = sources.Bookmarks(spark, str(tmp_path / "marks"))
    schema = "k int, ts timestamp_ntz, v string, Op string"
    first = spark.createDataFrame(
        [(1, at("06-15 13:10", 1985), "old", "I"), (2, at("06-15 13:20"), "b", "I")], schema
    )
    second = spark.createDataFrame(
        [(1, at("06-15 14:10"), "new", "U"), (2, at("06-15 14:20"), None, "D")], schema
    )
    hours, days, inbox = (str(tmp_path / n) for n in ("hours", "days", "inbox"))
    for n, rows in ((13, first), (14, second)):
        rows.write.parquet(f"{hours}/year=2024/month=6/day=15/hour={n}")
        rows.write.parquet(f"{days}/2024/06/{n}")
        rows.write.parquet(f"{inbox}/{n}")
        now = datetime(2024, 6, 15, n, 30)
        done = jobs.upsert_hours(spark, hours, str(tmp_path / "a"), marks, "a", ["k"], "ts", now)
        other = jobs.upsert_days(
            spark, days, str(tmp_path / "b"), marks, "b", ["k"], "ts", datetime(2024, 6, n)
        )
        files = jobs.upsert_files(
            spark, inbox, str(tmp_path / "seen"), str(tmp_path / "c"), ["k"], "ts", schema
        )
        expected = [(1, "old"), (2, "b")] if n == 13 else [(1, "new")]
        for table in ("a", "b", "c"):
            assert rows_of(spark.read.parquet(str(tmp_path / table)), "k", "v") == sorted(expected)
    assert (done["inserted"], done["updated"], done["deleted"], done["total"]) == (2, 1, 1, 4)
    assert done["min_ts"] == at("06-15 13:10", 1985) and other["max_ts"] == at("06-15 14:20")
    assert [f["total"] for f in files] == [2] and marks.get("a") == datetime(2024, 6, 15, 14)


def test_upsert_job_with_overlap(spark, tmp_path, at):
    path = str(tmp_path / "orders")
    marks = sources.Bookmarks(spark, str(tmp_path / "marks"))
    schema = "order_id int, order_dt string, v string, Op string"
    log = [(1, "2024-01-01 10:00:00", "a", "I"), (2, "2024-01-01 11:00:00", "b", "I")]

    def run(overlap=timedelta(0)):
        jobs.upsert_changes(
            spark.createDataFrame(log, schema),
            path,
            marks,
            "orders",
            ["order_id"],
            "order_dt",
            now=at("02-01 00:00"),
            overlap=overlap,
        )

    run()
    assert marks.get("orders") == at("01-01 11:00")
    log += [(1, "2024-01-03 10:00:00", "moved", "U"), (2, "2024-01-03 11:00:00", None, "D")]
    run()
    run(timedelta(minutes=1))
    got = spark.read.parquet(path)
    assert rows_of(got, "order_id", "v", "day") == [(1, "moved", 3)]
    assert marks.get("orders") == at("01-03 11:00")


def test_initial_load(spark, tmp_path, at):
    path = str(tmp_path / "t")
    rows = [(1, at("01-01 00:00"), "I"), (1, at("01-02 00:00"), "U"), (2, at("01-02 00:00"), "D")]
    log = spark.createDataFrame(rows, "k int, ts timestamp_ntz, Op string")
    jobs.initial_load(log, path, ["k"], "ts", applied_at=at("02-01 00:00"))
    got = spark.read.parquet(path)
    assert rows_of(got, "k", "day") == [(1, 2)] and "Op" not in got.columns


# --- incremental models ----------------------------------------------------


def test_incremental_append_is_strict(spark, at):
    schema = "ts timestamp_ntz, v string"
    stored = spark.createDataFrame([(at("01-02 00:00"), "x")], schema)
    new = spark.createDataFrame(
        [(at("01-01 00:00"), "late"), (at("01-02 00:00"), "same"), (at("01-03 00:00"), "new")],
        schema,
    )
    assert rows_of(incremental_append(stored, new, "ts"), "v") == [("new",)]
    assert incremental_append(stored, new, "ts", inclusive=True).count() == 2
    assert incremental_append(stored.where("false"), new, "ts").count() == 3


def test_missing_rows_count_equal_rows_on_both_sides(spark):
    """No window over all columns, so equal rows never meet in one task."""
    hot = spark.range(10_000).select(F.lit("a").alias("k"), F.lit(None).cast("int").alias("n"))
    source = hot.union(spark.createDataFrame([("b", 1), ("b", 1), ("c", 2), (None, None)], "k string, n int"))
    target = hot.limit(1000).union(spark.createDataFrame([("b", 1), ("c", 2), ("c", 2), ("d", 4)], "k string, n int"))
    new = missing_rows(target, source)
    assert "Window" not in new._jdf.queryExecution().executedPlan().toString()
    got = {(r["k"], r["n"]): r["count"] for r in new.groupBy("k", "n").count().collect()}
    assert got == {("a", None): 9000, ("b", 1): 1, (None, None): 1}
    # Both zeros and NaN: as many as are missing, as they stand.
    real = spark.createDataFrame([(0.0,), (-0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    rows = [str(r["x"]) for r in missing_rows(real.where("false"), real).collect()]
    assert sorted(rows) == ["-0.0", "-0.0", "0.0", "None", "nan"]
    assert len(missing_rows(real.where("x = 0").limit(2), real).collect()) == 3
    assert missing_rows(real, real).isEmpty()


def test_missing_rows_of_any_time(spark, at):
    schema = "ts timestamp_ntz, v string"
    stored = spark.createDataFrame([(at("01-02 00:00"), "a"), (at("01-02 00:00"), "b")], schema)
    source = [(at("01-02 00:00"), "a"), (at("01-02 00:00"), "c"), (at("01-01 00:00"), "late")]
    source += [(None, "null"), (at("01-02 00:00"), "b"), (at("01-02 00:00"), "b")]
    source = spark.createDataFrame(source, schema)
    new = missing_rows(stored, source)
    assert rows_of(new, "v") == [("b",), ("c",), ("late",), ("null",)]
    assert missing_rows(stored.union(new), source).isEmpty()
    near = missing_rows(stored, source, "ts", at("01-02 00:00"), timedelta(hours=1))
    assert rows_of(near, "v") == [("b",), ("c",), ("null",)]


def test_incremental_merge_takes_the_targets_columns(spark):
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    later = spark.createDataFrame([(1, 5, "b"), (2, 6, "c")], "k int, extra int, v string")
    assert rows_of(incremental_merge(stored, later, ["k"])) == [(1, "b"), (2, "c")]


def test_schema_policies(spark):
    have = spark.createDataFrame([], "k int, v string")
    new = spark.createDataFrame([(1, 2.0)], "k int, w double")
    with pytest.raises(SchemaMismatch):
        check_schema(have, new)
    assert check_schema(have, new, "ignore").columns == ["k", "v"]
    assert check_schema(have, new, "append").columns == ["k", "v", "w"]
    assert check_schema(have, have.select("v", "k")).columns == ["k", "v"]


def test_project(spark, tmp_path):
    project = Project(spark, str(tmp_path), prefix="pt_")
    runs = []

    @project.model("b", refs=["a"], materialized="table")
    def _(ctx):
        return ctx.ref("a").where("id > 0")

    @project.model("a", refs=["raw"], layer="stg")
    def _(ctx):
        return ctx.ref("raw")

    @project.model("facts", refs=["a"], materialized="append", ts="id")
    def _(ctx):
        runs.append(ctx.is_incremental)
        return ctx.ref("a")

    project.source("raw", spark.range(3))
    assert project.order().index("a") < project.order().index("b")
    assert project.order(["b"]) == ["a", "b"]
    assert project.run()["b"].count() == 2
    project.source("raw", spark.range(5))
    frames = project.run()
    assert (frames["b"].count(), frames["facts"].count(), runs) == (4, 5, [False, True])
    project.source("raw", spark.range(2))
    assert project.run(["facts"], full_refresh=True)["facts"].count() == 2
    project.source("raw", spark.range(9).withColumn("more", F.lit(1)))
    with pytest.raises(SchemaMismatch):
        project.run(["facts"])

    @project.model("bad", refs=["nowhere"])
    def _(ctx):
        return None

    with pytest.raises(KeyError):
        project.order()


def test_partitioned_models(spark, tmp_path):
    project = Project(spark, str(tmp_path), prefix="pp_")
    setting = {"partition_by": ["p"], "keys": ["k"]}

    @project.model("merged", refs=["raw"], materialized="merge", **setting)
    def _(ctx):
        return ctx.ref("raw")

    @project.model("appended", refs=["raw"], materialized="append", ts="k", **setting)
    def _(ctx):
        return ctx.ref("raw")

    schema = "k int, v string, p int"
    project.source("raw", spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema))
    project.run()
    project.source("raw", spark.createDataFrame([(1, "moved", 3), (3, "c", 2)], schema))
    frames = project.run()
    assert rows_of(frames["merged"]) == [(1, "moved", 3), (2, "b", 2), (3, "c", 2)]
    assert rows_of(frames["appended"]) == [(1, "a", 1), (2, "b", 2), (3, "c", 2)]
    parts = spark.sql("SHOW PARTITIONS pp_mart.merged").collect()
    assert sorted(r[0] for r in parts) == ["p=2", "p=3"]


def test_append_from_a_bookmark_reaches_the_scan(spark, at, tmp_path):
    path = str(tmp_path / "t")
    rows = [(at("01-01 00:00"),), (at("01-03 00:00"),)]
    spark.createDataFrame(rows, "ts timestamp_ntz").write.parquet(path)
    source = spark.read.parquet(path)
    got = incremental_append(source.where("false"), source, "ts", high=at("01-01 00:00"))
    assert rows_of(got) == [(at("01-03 00:00"),)]


# --- properties ------------------------------------------------------------

CHANGES = st.lists(
    st.tuples(
        st.integers(0, 4), st.integers(0, 6), st.sampled_from("IUD"), st.integers(0, 99)
    ),
    max_size=12,
)


@settings(
    max_examples=6,
    deadline=None,
    phases=[Phase.explicit, Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(first=CHANGES, second=CHANGES)
def test_merging_twice_changes_nothing(spark, first, second):
    schema = "k int, n int, Op string, v int"
    target = latest_changes(
        spark.createDataFrame(first, schema), ["k"], "n", ties="one", tie_break=["v", "Op"]
    ).drop("Op")
    batch = latest_changes(
        spark.createDataFrame(second, schema), ["k"], "n", ties="one", tie_break=["v", "Op"]
    )
    once = merge(target, batch, ["k"], newer_than="n", on_duplicate="trust")
    again = merge(once, batch, ["k"], newer_than="n", on_duplicate="trust")
    assert rows_of(once) == rows_of(again)
    held = {r["k"]: r for r in target.collect()}
    for r in batch.collect():
        if r["k"] not in held or r["n"] >= held[r["k"]]["n"]:
            held.pop(r["k"], None)
            if r["Op"] != "D":
                held[r["k"]] = r
    assert rows_of(once, "k", "v") == sorted(((k, r["v"]) for k, r in held.items()), key=repr)


def test_empty_batches(spark, tmp_path, at):
    path = str(tmp_path / "t")
    schema = "k int, ts timestamp_ntz, v string, p int"
    rows = spark.createDataFrame([(1, at("01-01 00:00"), "a", 1)], schema)
    none = spark.createDataFrame([], schema)
    sinks.upsert_path(spark, path, rows, ["k"], ["p"])
    for batch in (none, rows.where("k > 5"), rows.where("false")):
        sinks.upsert_path(spark, path, batch, ["k"], ["p"], newer_than="ts")
        sinks.write_partitions(batch, path, ["p"])
        sinks.write_partitions(batch, path, ["p"], keys=["k"], ts="ts")
        sinks.write_partitions(batch, path, ["p"], mode="overwrite_partitions")
        sinks.replace_partitions(batch, path, ["p"], batch_id="empty")
    assert rows_of(spark.read.parquet(path), "v") == [("a",)]
    sinks.upsert_path(spark, str(tmp_path / "new"), none, ["k"], ["p"])


def test_log_job_without_lines(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    marks = sources.Bookmarks(spark, str(tmp_path / "marks"))
    now = datetime(2024, 6, 15, 14, 30)
    jobs.access_log_batch(spark, raw, out, marks, "log", now, missing="skip")
    assert marks.get("log") is None
    _land(spark, raw, 14, "garbage")
    jobs.access_log_batch(spark, raw, out, marks, "log", now, missing="skip")
    assert marks.get("log") == datetime(2024, 6, 15, 14) and spark.read.parquet(out).count() == 1


CHANGES = "id int, ts timestamp_ntz, v string, Op string, p int"


def _merge(spark, path, *rows, **options):
    batch = spark.createDataFrame([(i, t, v, o, i % 2) for i, t, v, o in rows], CHANGES)
    return sinks.upsert_path(spark, path, batch, ["id"], ["p"], newer_than="ts", **options)


def _ids(spark, path):
    return rows_of(sources.scan_full(spark, path, "id int, ts timestamp_ntz, v string, p int"), "id", "v")


def test_deletes_stay(spark, tmp_path, at):
    path = str(tmp_path / "t")
    _merge(spark, path, (1, at("01-01 00:00"), "a", "I"), (2, at("01-01 00:00"), "b", "I"), (3, at("01-05 00:00"), None, "D"))
    _merge(spark, path, (1, at("01-03 00:00"), None, "D"))
    late = [(1, at("01-02 00:00"), "a2", "U"), (3, at("01-05 00:00"), "same", "I"), (2, at("01-02 00:00"), "b2", "U")]
    for _ in range(2):
        _merge(spark, path, *late)
        assert _ids(spark, path) == [(2, "b2")]
    # A repeated delete is kept once, and a newer row brings the key back.
    for _ in range(2):
        _merge(spark, path, (1, at("01-03 00:00"), None, "D"))
    assert spark.read.parquet(f"{path}/{tombstones.FOLDER}").count() == 2
    _merge(spark, path, (1, at("01-04 00:00"), "back", "I"), (3, at("01-04 00:00"), "no", "I"))
    assert _ids(spark, path) == [(1, "back"), (2, "b2")]
    assert "deleted_month" not in sources.scan_full(spark, path).columns
    _merge(spark, path, (3, at("01-04 00:00"), "asked for", "I"), remember=False)
    assert (3, "asked for") in _ids(spark, path)


def test_deletes_survive_a_run_that_ends_before_the_write(spark, tmp_path, at, monkeypatch):
    from martflow.sinks import merging

    path = str(tmp_path / "t")
    _merge(spark, path, (1, at("01-01 00:00"), "a", "I"))
    monkeypatch.setattr(merging, "replace_partitions", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        _merge(spark, path, (1, at("01-03 00:00"), None, "D"))
    monkeypatch.undo()
    assert _ids(spark, path) == [(1, "a")]
    _merge(spark, path, (1, at("01-03 00:00"), None, "D"))
    _merge(spark, path, (1, at("01-02 00:00"), "a", "I"))
    assert _ids(spark, path) == []


def test_deletes_are_forgotten_after_the_lateness(spark, tmp_path, at):
    path, week = str(tmp_path / "t"), timedelta(days=7)
    _merge(spark, path, (1, at("01-01 00:00"), None, "D"), (2, at("03-20 00:00"), None, "D"), lateness=week)
    _merge(spark, path, (4, at("03-21 00:00"), "x", "I"), lateness=week)
    held = spark.read.parquet(f"{path}/{tombstones.FOLDER}")
    assert rows_of(held, "id") == [(2,)]


def test_only_months_from_the_oldest_row_on_are_asked(spark, tmp_path, at):
    path = str(tmp_path / "t")
    _merge(spark, path, *((month, at(f"{month:02d}-05 12:00"), None, "D") for month in range(1, 7)))
    batch = spark.createDataFrame([(5, at("05-02 00:00"), "x", "I", 1), (2, at("05-02 00:00"), "y", "I", 0)], CHANGES)
    held = tombstones.held_deletes(spark, path, batch, ["id"], "ts", at("05-02 00:00"))
    assert rows_of(held, "id") == [(5,)]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "deleted_month" in plan.split("PartitionFilters:")[1].split("]")[0]


def _tables_read(df):
    """Folders that a frame reads by itself; cached frames are none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    found = [leaf for leaf in found if leaf.getClass().getSimpleName() == "LogicalRelation"]
    return [leaf.relation().location().rootPaths().head().toUri().getPath() for leaf in found]


def test_a_merge_by_time_reads_the_table_once(spark, tmp_path, at, monkeypatch):
    from martflow.sinks import merging

    path, read, replace = str(tmp_path / "t"), [], merging.replace_partitions
    _merge(spark, path, (1, at("01-01 00:00"), "a", "I"), (2, at("01-05 00:00"), "b", "I"), (3, at("01-01 00:00"), "c", "I"))
    monkeypatch.setattr(merging, "replace_partitions", lambda df, *a: read.extend(_tables_read(df)) or replace(df, *a))
    _merge(spark, path, (1, at("01-02 00:00"), "a2", "U"), (2, at("01-04 00:00"), "old", "U"), (4, at("01-02 00:00"), "d", "I"))
    assert read.count(path) == 1 and _ids(spark, path) == [(1, "a2"), (2, "b"), (3, "c"), (4, "d")]


def test_a_merge_takes_one_row_of_each_file(spark, tmp_path, monkeypatch):
    path, aggregated, write_list = str(tmp_path / "t"), [], writers._kept_list
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "id % 3 as p")
    for _ in range(2):  # two files in each partition and task
        rows.write.mode("append").partitionBy("p").parquet(path)

    def counted(names, label):
        aggregated.append(names.count())
        return write_list(names, label)

    monkeypatch.setattr(writers, "_kept_list", counted)
    batch = rows.where("p < 2").withColumn("Op", F.when(F.col("p") == 0, "D").otherwise("U"))
    done = sinks.upsert_path(spark, path, batch, ["id"], ["p"])
    assert done["emptied"] == 1 and max(aggregated) <= 2 * 2 * 4
    assert rows_of(spark.read.parquet(path).groupBy("p").count()) == [(1, 333), (2, 666)]


def test_partitions_of_fractions_keep_their_folders(spark):
    frame = spark.sql("select * from values (0.0D), (-0.0D), (null), (1.5D), (1.5D) as t(p)")
    assert sorted(r["_p"] for r in writers._parts(frame, ["p"]).select(writers._name(["p"]).alias("_p")).collect()) == ["\0", "-0.0", "0.0", "1.5"]


def test_versions_that_are_no_times(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, n long, Op string, p int")
    for batch in (rows((1, 5, "I", 0), (2, 9, "D", 0)), rows((2, 8, "I", 0), (1, 7, "D", 0)), rows((1, 6, "U", 0), (3, None, "D", 0))):
        sinks.upsert_path(spark, path, batch, ["id"], ["p"], newer_than="n")
    assert not storage.has_data(spark, path)
    source = rows((1, 5, "I", 0))
    with pytest.raises(ValueError):
        merge(source.drop("Op"), source, ["id"], deleted=source.select("id", "n"))
