from datetime import datetime, timedelta

import pytest

from martflow.operators import (
    change_counts,
    duplicate_keys,
    latest_changes,
    merge,
    since_threshold,
    split_changes,
    touched_partitions,
    unwrap_envelope,
    without_partitions,
)
from martflow.operators.merge import DuplicateKeys, SchemaMismatch
from tests.conftest import rows_of

SCHEMA = "k int, ts timestamp_ntz, v string"


@pytest.fixture
def log(spark, at):
    return spark.createDataFrame(
        [
            (1, at("01-01 10:00"), "old"),
            (1, at("01-02 10:00"), "a"),
            (1, at("01-02 10:00"), "b"),
            (2, at("01-01 09:00"), "only"),
            (3, None, "no time"),
            (None, at("01-03 00:00"), "no key"),
        ],
        SCHEMA,
    )


@pytest.mark.parametrize("method", ["join", "rank"])
def test_latest_keeps_ties_and_drops_unknown(log, method):
    got = latest_changes(log, ["k"], "ts", method=method)
    assert rows_of(got, "k", "v") == [(1, "a"), (1, "b"), (2, "only")]


def test_latest_one_row_uses_tie_break(log):
    got = latest_changes(log, ["k"], "ts", ties="one", tie_break=["v"])
    assert rows_of(got, "k", "v") == [(1, "b"), (2, "only")]
    assert rows_of(latest_changes(log, ["k"], "ts", ties="one"), "k", "v") == rows_of(got, "k", "v")


def test_latest_one_is_a_subset_of_keep(log):
    keep = set(rows_of(latest_changes(log, ["k"], "ts")))
    assert set(rows_of(latest_changes(log, ["k"], "ts", ties="one"))) <= keep


def test_since_drops_keys_older_than_the_bookmark(log, at):
    got = latest_changes(log, ["k"], "ts", since=at("01-01 12:00"))
    assert rows_of(got, "k") == [(1,), (1,)]
    exact = at("01-02 10:00")
    assert latest_changes(log, ["k"], "ts", since=exact).count() == 2
    assert latest_changes(log, ["k"], "ts", since=exact, inclusive=False).count() == 0


def test_since_equals_the_filter_on_the_inner_side(log, at):
    log.createOrReplaceTempView("change_log")
    inner = log.sparkSession.sql(
        "select * from change_log where (k, ts) in (select k, max(ts) from change_log "
        "where ts >= timestamp_ntz'2024-01-01 09:30:00' group by k)"
    )
    assert rows_of(latest_changes(log, ["k"], "ts", since=at("01-01 09:30"))) == rows_of(inner)


def test_wrong_arguments(log):
    with pytest.raises(ValueError):
        latest_changes(log, ["k"], "ts", ties="some")


def test_threshold():
    mark = datetime(2024, 1, 1, 12)
    assert since_threshold(mark) == mark
    assert since_threshold(mark, timedelta(minutes=1)) == datetime(2024, 1, 1, 11, 59)
    assert since_threshold(None) is None


def test_counts_and_split(spark):
    df = spark.createDataFrame(
        [(1, "I"), (2, "U"), (3, "D"), (4, None)], "k int, Op string"
    ).selectExpr("*", "1 as dms_update_time")
    assert change_counts(df).head() == (1, 1, 1, 4)
    upserts, deletes = split_changes(df)
    assert rows_of(upserts) == [(1,), (2,), (4,)] and rows_of(deletes) == [(3,)]


def test_duplicates(log):
    assert rows_of(duplicate_keys(log, ["k", "ts"]), "k", "n_rows") == [(1, 2)]


def test_envelope(spark):
    lines = [
        '{"before":null,"after":{"id":1,"v":"x"},"op":"c","ts_ms":1704067200123}',
        '{"before":{"id":2,"v":"y"},"after":null,"op":"d","ts_ms":1704067200123}',
        '{"before":{"id":3,"v":"p"},"after":{"id":3,"v":"q"},"op":"u","ts_ms":1704067200123}',
        "broken",
    ]
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    got = unwrap_envelope(df, "value", "id int, v string")
    assert rows_of(got, "id", "v", "Op") == [(1, "x", "I"), (2, "y", "D"), (3, "q", "U")]
    assert got.head()["changed_at"] == datetime(2024, 1, 1, 0, 0, 0, 123000)


# --- merge -----------------------------------------------------------------


@pytest.fixture
def target(spark, at):
    return spark.createDataFrame(
        [
            (1, at("01-01 00:00"), "t1"),
            (2, at("01-01 00:00"), "t2"),
            (3, at("01-05 00:00"), "t3"),
            (None, at("01-01 00:00"), "nokey"),
        ],
        SCHEMA,
    )


def _changes(spark, rows):
    return spark.createDataFrame(rows, f"{SCHEMA}, Op string")


def test_merge_inserts_updates_deletes(spark, target, at):
    changes = _changes(
        spark,
        [
            (1, at("01-02 00:00"), "s1", "U"),
            (2, at("01-02 00:00"), "s2", "D"),
            (9, at("01-02 00:00"), "s9", "I"),
            (8, at("01-02 00:00"), "unknown", "D"),
            (7, at("01-02 00:00"), "no op", None),
        ],
    )
    got = merge(target, changes, ["k"])
    assert rows_of(got, "k", "v") == sorted(
        [(1, "s1"), (3, "t3"), (7, "no op"), (9, "s9"), (None, "nokey")], key=repr
    )
    kept = merge(target, changes, ["k"], deletes="ignore")
    assert (2, "t2") in rows_of(kept, "k", "v")
    assert rows_of(merge(got, changes, ["k"])) == rows_of(got)


def test_merge_rejects_repeated_keys(spark, target, at):
    twice = _changes(spark, [(1, at("01-02 00:00"), x, "U") for x in "ab"])
    with pytest.raises(DuplicateKeys):
        merge(target, twice, ["k"])
    got = merge(target, twice, ["k"], on_duplicate="latest", newer_than="ts", tie_break=["v"])
    assert (1, "b") in rows_of(got, "k", "v") and got.count() == 4


@pytest.mark.parametrize(
    "ops, left", [(["I", "D"], []), (["D", "I"], [(5, "second")])], ids=["deleted", "recreated"]
)
def test_insert_and_delete_in_one_batch(spark, target, at, ops, left):
    batch = _changes(
        spark,
        [(5, at("01-02 00:00"), "first", ops[0]), (5, at("01-03 00:00"), "second", ops[1])],
    )
    newest = latest_changes(batch, ["k"], "ts", ties="one")
    got = merge(target.where("k = 1"), newest, ["k"])
    assert rows_of(got, "k", "v") == [(1, "t1"), *left]


def test_newer_than_ignores_stale_rows(spark, target, at):
    changes = _changes(
        spark,
        [
            (3, at("01-04 00:00"), "stale", "U"),
            (2, at("01-01 00:00"), "same time", "U"),
            (1, at("01-01 12:00"), "newer", "U"),
        ],
    )
    got = rows_of(merge(target, changes, ["k"], newer_than="ts").where("k > 0"), "k", "v")
    assert got == [(1, "newer"), (2, "same time"), (3, "t3")]
    stale_delete = _changes(spark, [(3, at("01-04 00:00"), None, "D")])
    assert merge(target, stale_delete, ["k"], newer_than="ts").count() == 4


def test_two_merges_equal_one_of_both(spark, target, at):
    a = _changes(spark, [(1, at("01-03 00:00"), "a1", "U"), (4, at("01-02 00:00"), "a4", "I")])
    b = _changes(spark, [(1, at("01-02 00:00"), "b1", "U"), (4, at("01-05 00:00"), "b4", "U")])
    options = {"newer_than": "ts"}
    stepwise = merge(merge(target, a, ["k"], **options), b, ["k"], **options)
    both = latest_changes(a.union(b), ["k"], "ts", ties="one")
    assert rows_of(stepwise) == rows_of(merge(target, both, ["k"], **options))


def test_schema_rules(spark, target, at):
    wider = spark.createDataFrame([(1, at("01-02 00:00"), 5)], "k int, ts timestamp_ntz, w int")
    with pytest.raises(SchemaMismatch):
        merge(target, wider, ["k"])
    got = merge(target, wider, ["k"], schema="evolve")
    assert got.columns == ["k", "ts", "v", "w"]
    assert rows_of(got.where("k = 1"), "v", "w") == [(None, 5)]
    swapped = target.select("v", "ts", "k").where("k = 1")
    assert rows_of(merge(target, swapped, ["k"]), "k", "v") == rows_of(target, "k", "v")


def test_touched_partitions(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, p int")
    s = spark.createDataFrame([(1, 11), (9, 90)], "k int, p int")
    assert rows_of(touched_partitions(t, s, ["k"], ["p"])) == [(10,), (11,), (90,)]
    assert rows_of(without_partitions(t, "p >= 20"), "k") == [(1,)]
