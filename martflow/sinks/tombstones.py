"""What was deleted from a stored table, and when: so that it stays deleted.

Changes are read with an overlap, and change streams can come out of order, so an insert
that is older than its key's delete can follow it in a later batch.  The table itself has no
trace of the key then.  ``_deleted`` beside its files has: the key and the time of each
delete, in a folder for each month of the time.  A batch looks at the months from its own
oldest row on only, since an earlier delete cannot hold back any of its rows, and months
older than the lateness that is promised are dropped whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from martflow import storage
from martflow.operators.changes import DELETE

FOLDER, MONTH = "_deleted", "deleted_month"
_TIMES = (DateType, TimestampType, TimestampNTZType)


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/{FOLDER}"


def _month(time: datetime) -> str:
    """The month of the day before a time: zones of the session and the driver may differ."""
    return f"{time - timedelta(days=1):%Y-%m}"


def deletes_of(source: DataFrame, keys: Sequence[str], ts: str, op: str) -> DataFrame:
    """Keys and times of the deletes of a batch; those without either are none."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*keys, ts]))
    return source.where(known & (F.col(op) == DELETE)).select(*keys, ts)


def held_deletes(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], ts: str, since=None) -> DataFrame | None:
    """Stored deletes of the keys of ``source``, from the month of ``since`` on; None if the
    table has never had any."""
    folder = _folder(path)
    if not storage.has_data(spark, folder):
        return None
    schema = StructType([*(source.schema[c] for c in [*keys, ts]), StructField(MONTH, StringType())])
    held = spark.read.schema(schema).parquet(folder)
    if isinstance(since, datetime):
        held = held.where(F.col(MONTH) >= _month(since))
    return held.join(source.select(*keys), list(keys), "left_semi").select(*keys, ts)


def keep_deletes(source: DataFrame, path: str, keys: Sequence[str], ts: str, op: str, held: DataFrame | None = None) -> None:
    """Add the deletes of a batch that are not ``held`` yet.  To be done before the table
    is written: should the run end in between, the batch is merged again."""
    gone = deletes_of(source, keys, ts, op)
    if held is not None:
        gone = gone.join(held, [*keys, ts], "left_anti")
    timed = isinstance(source.schema[ts].dataType, _TIMES)
    month = F.date_format(F.col(ts), "yyyy-MM") if timed else F.lit("all")
    rows = gone.withColumn(MONTH, month).hint("rebalance", MONTH)
    rows.write.mode("append").partitionBy(MONTH).parquet(_folder(path))


def expire_deletes(spark: SparkSession, path: str, newest: datetime, lateness: timedelta) -> int:
    """Drop the months that no row of the promised lateness can ask for.  Returns how many."""
    last = _month(newest - lateness)
    months = {f.rsplit("=", 1)[-1]: f for f in storage.folders(spark, f"{_folder(path)}/{MONTH}=*-*")}
    doomed = [folder for month, folder in months.items() if month < last]
    for folder in doomed:
        storage.delete(spark, folder)
    return len(doomed)
