"""A ledger of read files that asks about a window of time only.

An inbox and its ledger grow for ever, and ``unprocessed_files`` compares all of both.  Here
files are taken in the order of their modification times, and a run looks at those from a
``window`` before the newest one read: the time goes into Spark's listing, and of the
ledger's day folders those before it are not opened.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from martflow import storage

_SCHEMA = "file_name string, modified bigint, processed_at timestamp_ntz, modified_day int"
_DAY = 86_400_000_000  # microseconds


def _newest(spark: SparkSession, ledger: str) -> int | None:
    """Modification time of the newest file read, from the last day's folder."""
    days = storage.folders(spark, f"{ledger.rstrip('/')}/modified_day=*")
    if not days:
        return None
    last = max(int(d.rsplit("=", 1)[-1]) for d in days)
    rows = spark.read.schema(_SCHEMA).parquet(ledger).where(F.col("modified_day") == last)
    return rows.agg(F.max("modified")).head()[0]


def next_files(
    spark: SparkSession,
    root: str,
    ledger: str,
    window: timedelta,
    page: int = 10_000,
    pattern: str = "*.parquet",
) -> DataFrame:
    """The oldest ``page`` files under ``root`` that the ledger does not name: ``file_name,
    modified`` (microseconds).  Call again, after ``mark_files``, until there are none.

    ``window`` says how much older than a file already read a file can be that shows up
    later: clocks differ, and some stores show files late.  Older ones are not found.  A file
    that was written anew is a new file.  The listing is taken when this is called, so what is
    read and what is marked are the same files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    newest = _newest(spark, ledger)
    since = None if newest is None else newest - int(window / timedelta(microseconds=1))
    if since is not None:
        # The option is exclusive and of whole seconds here.
        at = datetime.fromtimestamp(since // 1_000_000 - 1, timezone.utc)
        files = files.option("modifiedAfter", f"{at:%Y-%m-%dT%H:%M:%S}").option("timeZone", "UTC")
    listed = files.load(root).select(F.col("path").alias("file_name"), F.unix_micros("modificationTime").alias("modified"))
    if since is not None:
        done = spark.read.schema(_SCHEMA).parquet(ledger).where(F.col("modified_day") >= since // _DAY)
        listed = listed.where(F.col("modified") >= since).join(done, ["file_name", "modified"], "left_anti")
    return listed.orderBy("modified", "file_name").limit(page)


def mark_files(files: DataFrame, ledger: str, at: datetime) -> None:
    """Add files to the ledger.  To be done after their rows are stored."""
    stamp = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("processed_at")
    day = F.floor(F.col("modified") / _DAY).cast("int").alias("modified_day")
    rows = files.select("file_name", "modified", stamp, day)
    rows.write.mode("append").partitionBy("modified_day").parquet(ledger)
