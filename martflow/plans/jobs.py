"""The recurring jobs, end to end: initial load, change upsert, log batch.

Each writes its data first and its bookmark last.  A crash in between repeats the
last batch, which the merge absorbs.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from martflow.functions.logs import parse_access_log
from martflow.functions.times import as_timestamp, with_applied_at, with_partitions
from martflow.operators.changes import (
    CONTROL_COLUMNS,
    changed_since,
    latest_changes,
    since_threshold,
)
from martflow.sinks.merging import upsert_path
from martflow.sinks.tombstones import keep_deletes
from martflow.sinks.writers import write_partitions
from martflow.sources.bookmarks import Bookmarks
from martflow.sources.files import (
    local_clock,
    newest_day,
    newest_hour,
    oldest_hour,
    scan_days,
    scan_hours,
)
from martflow.streaming.sources import scan_new_files

LOG_PARTS = ("year", "month", "day", "hour")
DAY_PARTS = ("year", "month", "day")


def initial_load(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    ts: str,
    applied_at: datetime | None = None,
    by: Sequence[str] = DAY_PARTS,
    tie_break: Sequence[str] = (),
) -> None:
    """Load a whole change log as a table: one row per key, partitioned by event day.
    Deleted keys are left out, and stay out (see ``sinks.tombstones``)."""
    newest = changes = latest_changes(rows, keys, ts, ties="one", tie_break=tie_break)
    if "Op" in rows.columns:
        newest = newest.where(F.coalesce("Op", F.lit("I")) != "D").drop(*CONTROL_COLUMNS)
    table = with_partitions(newest, ts, by[-1])
    if applied_at is not None:
        table = with_applied_at(table, applied_at)
    write_partitions(table, path, by, mode="overwrite")
    if "Op" in rows.columns:
        keep_deletes(changes, path, keys, ts, "Op")


def _merge_newest(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    ts: str,
    by: Sequence[str],
    tie_break: Sequence[str],
    applied_at: datetime | None,
    options: dict,
) -> dict:
    """Merge the newest change of each key; returns the rows written, and of the changes
    read the counts by operation and the range of times, taken in the same pass."""
    seen = Observation()
    code = F.col("Op") if "Op" in changes.columns else F.lit(None).cast("string")
    at = as_timestamp(ts)
    changes = changes.observe(
        seen,
        F.count_if(code == "I").alias("inserted"),
        F.count_if(code == "U").alias("updated"),
        F.count_if(code == "D").alias("deleted"),
        F.count(F.lit(1)).alias("total"),
        F.min(at).alias("min_ts"),
        F.max(at).alias("max_ts"),
    )
    # A key counts in the bookmark even if its change was a delete.
    newest = latest_changes(changes, keys, ts, ties="one", tie_break=tie_break)
    batch = with_partitions(newest, ts, by[-1])
    if applied_at is not None:
        batch = with_applied_at(batch, applied_at)
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rules = {"newer_than": ts, "on_duplicate": "trust", "keep": False, **options}
        written = upsert_path(changes.sparkSession, path, batch, keys, by, **rules)
        return {**written, **seen.get}
    finally:
        batch.unpersist()


def upsert_changes(
    changes: DataFrame,
    path: str,
    bookmarks: Bookmarks,
    name: str,
    keys: Sequence[str],
    ts: str,
    now: datetime,
    overlap: timedelta = timedelta(0),
    tie_break: Sequence[str] = (),
    by: Sequence[str] = DAY_PARTS,
    applied_at: bool = False,
    **options,
) -> dict:
    """Merge the changes since the table's bookmark and advance it.

    The latest change per key is chosen with its deletes, which apply after the
    choice.  A row older than the table's is ignored, so an overlap is safe.  Without
    a bookmark all changes are read.
    """
    since = since_threshold(bookmarks.get(name), overlap)
    recent = changes if since is None else changes.where(changed_since(as_timestamp(ts), since))
    done = _merge_newest(recent, path, keys, ts, by, tie_break, now if applied_at else None, options)
    bookmarks.advance(name, done["max_ts"], now)
    return done


def upsert_hours(
    spark: SparkSession,
    raw: str,
    path: str,
    bookmarks: Bookmarks,
    name: str,
    keys: Sequence[str],
    ts: str,
    now: datetime,
    zone: str = "UTC",
    overlap: timedelta = timedelta(0),
    fmt: str = "parquet",
    schema=None,
    tie_break: Sequence[str] = (),
    by: Sequence[str] = DAY_PARTS,
    **options,
) -> dict | None:
    """Merge the changes of the hour folders since the bookmark, which is the last hour
    read by the landing's clock; ``now`` is UTC.  Only the range's folders are opened.
    None if there is no folder yet."""
    until = local_clock(now, zone)
    since = since_threshold(bookmarks.get(name), overlap) or oldest_hour(spark, raw)
    last = None if since is None else newest_hour(spark, raw, since, until)
    if last is None:
        return None
    changes = scan_hours(spark, raw, since, last, fmt, schema, missing="skip")
    changes = changes.drop(*(c for c in LOG_PARTS if c in changes.columns))
    done = _merge_newest(changes, path, keys, ts, by, tie_break, None, options)
    bookmarks.set(name, last, now)
    return done


def upsert_days(
    spark: SparkSession,
    raw: str,
    path: str,
    bookmarks: Bookmarks,
    name: str,
    keys: Sequence[str],
    ts: str,
    now: datetime,
    zone: str = "UTC",
    overlap: timedelta = timedelta(0),
    schema=None,
    tie_break: Sequence[str] = (),
    by: Sequence[str] = DAY_PARTS,
    **options,
) -> dict | None:
    """As ``upsert_hours``, for ``yyyy/MM/dd`` folders; the last day is read again."""
    until = local_clock(now, zone)
    since = since_threshold(bookmarks.get(name), overlap)
    clock = {"source_tz": zone, "local_tz": zone}
    last = newest_day(spark, raw, since, until, **clock)
    if last is None:
        return None
    changes = scan_days(spark, raw, since, until, schema=schema, **clock)
    done = _merge_newest(changes, path, keys, ts, by, tie_break, None, options)
    bookmarks.set(name, last, now)
    return done


def upsert_files(
    spark: SparkSession,
    inbox: str,
    checkpoint: str,
    path: str,
    keys: Sequence[str],
    ts: str,
    schema,
    tie_break: Sequence[str] = (),
    by: Sequence[str] = DAY_PARTS,
    **options,
) -> list[dict]:
    """Merge the files that are new since the last run; what was read is kept in the
    checkpoint.  Returns what each batch did."""
    done: list[dict] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        done.append(_merge_newest(batch, path, keys, ts, by, tie_break, None, options))

    scan_new_files(spark, inbox, checkpoint, handle, schema)
    return done


def access_log_batch(
    spark: SparkSession,
    raw: str,
    parsed: str,
    bookmarks: Bookmarks,
    name: str,
    now: datetime,
    default_start: datetime | None = None,
    missing: str = "error",
    mode: str = "by_arrival",
    by: Sequence[str] = LOG_PARTS,
    zone: str = "UTC",
    overlap: timedelta = timedelta(0),
) -> dict | None:
    """Parse the log hours from the bookmark's hour to now, and advance it.

    Hours are read by arrival, on the landing's clock (``zone``; ``now`` is UTC), and
    written by event time.  The bookmark is the last arrival hour read, so no line's own
    clock can move it; that hour is read again, and ``overlap`` reads more.  Three ways
    to write:

    - ``by_arrival`` (default): each event hour is divided further by the hour its
      lines arrived in (``arrived``, ``yyyyMMddHH``), and a run replaces exactly what
      it read again.  Late lines add to their hour, a repeated run changes nothing,
      equal lines all stay, and no stored row is read.
    - ``merge_partitions``: no ``arrived`` column; event hours become *existing union
      new*, and equal lines count as one.
    - ``overwrite_partitions``: event hours are replaced by what was read, so a late
      line removes the rest of its hour.

    Without a bookmark the run starts at ``default_start``, or at the oldest folder.
    None if there is no folder to read.
    """
    until = local_clock(now, zone)
    since = since_threshold(bookmarks.get(name), overlap) or default_start or oldest_hour(spark, raw)
    last = None if since is None else newest_hour(spark, raw, since, until)
    if last is None:
        if missing == "error" and since is not None:
            scan_hours(spark, raw, since, until, missing=missing)
        return None
    lines = scan_hours(spark, raw, since, until if missing == "error" else last, missing=missing)
    parts = [F.lpad(F.col(p).cast("string"), 4 if p == "year" else 2, "0") for p in LOG_PARTS]
    lines = lines.select("log", F.concat(*parts).alias("arrived"))
    if mode == "by_arrival":
        keep, by, how = ["arrived"], [*by, "arrived"], "overwrite_partitions"
    else:
        keep, how = [], mode
    rows = parse_access_log(lines, keep=keep)
    # Lines of one arrival hour come from the same files, so they need no exchange.
    together = mode == "by_arrival"
    written = write_partitions(
        rows, parsed, by, mode=how, cluster=not together, distinct=mode == "merge_partitions"
    )
    bookmarks.set(name, last, now)
    return written
