"""Where each table's last run stopped.

State is a small append-only JSON folder, one partition per table.  A crash while
writing leaves the previous bookmark in place.  When a hundred files a table have come
together, ``set`` brings them into one each.  Times are ``datetime`` in the API
and ISO text on disk.
"""

from __future__ import annotations

from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from martflow import storage
from martflow.operators.changes import latest_changes

_STATE = "last_bookmark_time string, started_at string, last_update_time string, table_name string"
_TIMES = ("last_bookmark_time", "started_at", "last_update_time")


class Bookmarks:
    """Bookmarks of all tables under one folder, which the first ``set`` creates."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 100):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def history(self) -> DataFrame:
        """Every bookmark ever set."""
        if not storage.exists(self.spark, self.path):
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).json(self.path)

    def current(self) -> DataFrame:
        """The bookmark in force, one row per table, as timestamps."""
        return self._newest(self.history()).withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in _TIMES})

    def _newest(self, history: DataFrame) -> DataFrame:
        return latest_changes(
            history, ["table_name"], "last_update_time", ties="one", tie_break=["last_bookmark_time"]
        )

    def get(self, name: str, default_start: datetime | None = None) -> datetime | None:
        """The table's bookmark, or ``default_start`` if it has none."""
        row = self.current().where(F.col("table_name") == name).head()
        return row["last_bookmark_time"] if row else default_start

    def set(
        self,
        name: str,
        ts: datetime,
        updated_at: datetime,
        started_at: datetime | None = None,
    ) -> None:
        """Record where a run stopped, and optionally when it started."""
        iso = [t.isoformat(sep=" ") if t else None for t in (ts, started_at, updated_at)]
        row = self.spark.createDataFrame([(*iso, name)], _STATE)
        row.coalesce(1).write.mode("append").partitionBy("table_name").json(self.path)
        self._compact_if_due()

    def set_many(self, rows: DataFrame, updated_at: datetime, started_at: datetime | None = None) -> None:
        """Record the bookmarks of many tables, ``(table_name, ts)`` rows, in one job."""
        iso = [F.lit(t.isoformat(sep=" ") if t else None).cast("string") for t in (started_at, updated_at)]
        state = rows.select(
            F.col("ts").cast("string").alias("last_bookmark_time"),
            iso[0].alias("started_at"),
            iso[1].alias("last_update_time"),
            "table_name",
        )
        state.hint("rebalance", "table_name").write.mode("append").partitionBy("table_name").json(self.path)
        self._compact_if_due()

    def advance(self, name: str, newest: datetime | None, updated_at: datetime) -> None:
        """Move to the newest time of a batch; an empty batch changes nothing."""
        if newest is not None:
            self.set(name, newest, updated_at)

    def _compact_if_due(self) -> None:
        files, tables = storage.size_of_tree(self.spark, self.path)
        if files > self.keep * max(tables, 1):
            self.compact()

    def compact(self) -> None:
        """Keep only the bookmark in force of each table.  It is written once more before
        the files that were there are deleted, so a crash in between loses none."""
        history = self.history()
        found = history.select(F.col("_metadata.file_path").alias("f")).distinct()
        old = [r["f"] for r in found.toLocalIterator()]  # ``keep`` files a table
        rows = self._newest(history).hint("rebalance", "table_name")
        rows.write.mode("append").partitionBy("table_name").json(self.path)
        for file in old:
            storage.delete(self.spark, unquote(file))  # file paths come percent-encoded


def observe_newest(df: DataFrame, ts: str) -> tuple[DataFrame, Observation]:
    """The frame, and its newest time as a side result of the action that consumes
    it: no second pass over the input."""
    seen = Observation()
    return df.observe(seen, F.max(ts).alias("newest"), F.count(F.lit(1)).alias("rows")), seen
