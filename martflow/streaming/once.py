"""Log lines stored once each, however late they are delivered again.

State of a stream that knows every key grows for ever; state that forgets drops lines that
come later than it remembers.  Here the stored table is what remembers: a line lies in the
folder of its event hour, so a batch is compared with the hours it has lines of, and with
``index`` only with those of their files that can hold one of its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from martflow.functions.times import with_partitions
from martflow.operators.relational import union_by_name
from martflow.sinks.locations import index_keys, rows_that_may_match
from martflow.sinks.writers import in_partitions, is_empty_table, partitions_of, stored_like, write_partitions

HOURS = ("year", "month", "day", "hour")


def add_once(batch: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], index: bool = False) -> None:
    """Append the rows of a batch whose key is not stored in their own partition yet.

    A key decides its row, and so its partition.  Of rows of one key in the batch one stays.
    The same batch again adds nothing, so a stream may repeat it.  A key with a NULL is no
    key: its rows are compared with none and all added.
    """
    spark = batch.sparkSession
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        one = rows.where(known).dropDuplicates(list(keys))
        if not is_empty_table(spark, path):
            target = stored_like(batch, path, by)
            if index:
                target = rows_that_may_match(target, path, one, keys)
            held = in_partitions(target, by, partitions_of(one, by, "hours")).select(*keys)
            one = one.join(held, list(keys), "left_anti")
        fresh = union_by_name(one.select(*rows.columns), rows.where(~known))
        write_partitions(fresh, path, by, mode="append")
        if index:
            index_keys(stored_like(batch, path, by), path, keys)
    finally:
        rows.unpersist()


def lines_once(
    parsed: DataFrame,
    path: str,
    keys: Sequence[str],
    checkpoint: str,
    time: str = "event_time",
    index: bool = False,
    once: bool = True,
    every: str = "1 minute",
):
    """Start a query that stores each line of a parsed stream once, by the hour of ``time``.

    ``timed_lines`` gives the parsed lines.  Nothing is dropped for being late, and no state is kept beside the table."""
    handle = _handler(path, keys, time, index)
    writer = parsed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _handler(path: str, keys: Sequence[str], time: str, index: bool) -> Callable[[DataFrame, int], None]:
    def handle(batch: DataFrame, _: int) -> None:
        add_once(with_partitions(batch, time, "hour"), path, keys, HOURS, index)

    return handle
