"""Continuous upsert of a change stream, and continuous log parsing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from martflow import storage
from martflow.functions.logs import parse_access_log
from martflow.functions.times import as_timestamp
from martflow.operators.changes import latest_changes
from martflow.sinks.merging import upsert_path


def merge_batches(
    path: str,
    keys: Sequence[str],
    ts: str,
    by: Sequence[str],
    tie_break: Sequence[str | Column] = (),
    **options,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: latest change per key, then merge.

    A batch may be delivered twice.  The merge ignores rows older than the table's
    and replaces rows by themselves, so the second time changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = latest_changes(batch, keys, ts, ties="one", tie_break=tie_break)
        upsert_path(
            batch.sparkSession,
            path,
            newest,
            keys,
            by,
            newer_than=ts,
            on_duplicate="trust",
            **options,
        )

    return handle


def stream_upsert(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    ts: str,
    by: Sequence[str],
    snapshot: DataFrame | None = None,
    every: str = "5 minutes",
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Keep a partitioned table equal to a change stream.

    ``snapshot`` is loaded first, if the table does not exist yet.
    """
    handle = merge_batches(path, keys, ts, by, **options)
    if snapshot is not None and not storage.exists(stream.sparkSession, path):
        handle(snapshot, -1)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def stream_access_log(
    lines: DataFrame, keys: Sequence[str], lateness: str | None = None, col: str = "log"
) -> DataFrame:
    """Parsed log stream without repeats.

    ``keys`` identify a line (its place in the log).  By default a line counts as a
    repeat however late it comes, and its key is kept for good; ``lateness`` bounds that
    state by event time, and a line later than that is dropped; ``lines_once`` keeps such
    lines too, and no state.  Malformed lines have no
    time: ``malformed_lines`` gives them, for an output of their own.  The state is best
    held on disk (``session.DEFAULTS`` says how).
    """
    timed = timed_lines(lines, keys, col)
    if lateness is None:
        return timed.dropDuplicates([*keys])
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([*keys])


def timed_lines(lines: DataFrame, keys: Sequence[str], col: str = "log") -> DataFrame:
    """Parsed lines that have a time, repeats included."""
    return _timed(lines, keys, col).where(F.col("event_time").isNotNull())


def malformed_lines(lines: DataFrame, keys: Sequence[str], col: str = "log") -> DataFrame:
    """The lines that ``stream_access_log`` leaves out because no time can be read."""
    return _timed(lines, [*keys, col], col).where(F.col("event_time").isNull()).select(*keys, col)


def _timed(lines: DataFrame, keep: Sequence[str], col: str) -> DataFrame:
    parsed = parse_access_log(lines, col, keep=keep)
    return parsed.withColumn("event_time", as_timestamp("timestamp").cast("timestamp"))
