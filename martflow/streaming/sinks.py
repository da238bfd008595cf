"""Streaming sinks: hourly landing, routing of topics to tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from martflow import storage
from martflow.functions.times import with_local_partitions
from martflow.functions.values import route_name
from martflow.streaming import offsets

HOUR_PARTS = ("year", "month", "day", "hour")
# Landing zone, and how often files are closed, by format.
LANDING_TZ = "Asia/Seoul"
ROTATION = {"json": "60 seconds", "parquet": "10 seconds"}
_PLACED = "topic string, partition int, offset bigint, table string, batch string"


def _trigger(writer, every: str, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def hourly_rows(df: DataFrame, ts: str, tz: str = LANDING_TZ) -> DataFrame:
    """Rows with the zero-padded folder columns of an hourly landing."""
    parts = with_local_partitions(df, ts, tz)
    return parts.withColumns(
        {p: F.lpad(F.col(p).cast("string"), 4 if p == "year" else 2, "0") for p in HOUR_PARTS}
    )


def sink_hourly(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    ts: str,
    tz: str = LANDING_TZ,
    fmt: str = "json",
    every: str | None = None,
    max_records: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Land a stream in ``year=/month=/day=/hour=`` folders of a local time zone.

    A timer starts each batch, so a quiet source still flushes.  ``max_records``
    limits the rows of a file (1000 for JSON or 10 for Parquet would be the sizes of a
    small landing); by default there is no limit, as tiny files cost every later scan.
    ``once`` lands what is there and ends.
    """
    writer = (
        hourly_rows(stream, ts, tz)
        .writeStream.format(fmt)
        .partitionBy(*HOUR_PARTS)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", max_records or 0)
        .outputMode("append")
    )
    return _trigger(writer, every or ROTATION[fmt], once).start()


def route_to_tables(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    pattern: str,
    replacement: str = "$1",
    every: str = "1 minute",
    once: bool = False,
) -> StreamingQuery:
    """Append each topic's rows to the table its name maps to.

    Topics that ``pattern`` does not match are left out.  A row is known by its topic,
    partition and offset, and a batch has each of them once, as a log does.  The folder
    keeps the ranges of offsets it holds (see ``streaming.offsets``): a row inside them is
    not written again, so neither a repeated batch nor a new checkpoint that reads a topic
    once more doubles a row or replaces one.  Every attempt writes a folder of its own,
    which counts once its ranges are written; all tables are written by one job.
    ``compact_routed`` brings the folders of a table together.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        routed = batch.withColumn("table", route_name("topic", pattern, replacement))
        routed = routed.where(F.col("table").isNotNull())
        fresh = offsets.not_held(routed, offsets.held_ledger(spark, root))
        name = f"b{batch_id}-{uuid.uuid4().hex[:12]}"
        rows = fresh.select(*batch.columns, "table").withColumn("batch", F.lit(name))
        rows.write.mode("append").partitionBy("table", "batch").parquet(root)
        written = spark.read.schema(_PLACED).parquet(root).where(F.col("batch") == name)
        found = offsets.ranges(written, ("table", "topic", "partition"))
        offsets.commit(spark, root, name, found.withColumn("replaces", F.lit(None).cast("string")))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every, once).start()


def compact_routed(spark: SparkSession, root: str, table: str) -> int:
    """Bring all batches of a routed table together in one folder.

    The new folder counts, and the old ones no longer, from the moment its entry in the
    ledger appears; a run that ends before or after it loses and doubles nothing, and the
    next one deletes what is left.  Returns how many folders were brought together."""
    root = root.rstrip("/")
    entries = offsets.held_ledger(spark, root).where(F.col("table") == table)
    live = [r["batch"] for r in offsets.live_batches(entries).collect()]  # batches since the last time
    if len(live) > 1:
        name = f"compact-{uuid.uuid4().hex[:12]}"
        folder = f"{root}/table={table}"
        paths = [f"{folder}/batch={b}" for b in live]
        rows = spark.read.option("basePath", folder).option("mergeSchema", "true").parquet(*paths).drop("batch")
        rows.hint("rebalance").write.parquet(f"{folder}/batch={name}")
        spans = offsets.merged(entries.where("low is not null"), ("table", "topic", "partition"))
        gone = entries.select("table", F.col("batch").alias("replaces")).distinct()
        offsets.commit(spark, root, name, spans.unionByName(gone, allowMissingColumns=True))
        entries = offsets.ledger(spark, root).where(F.col("table") == table)
    for row in entries.where("replaces is not null").select("replaces").distinct().collect():
        for kept in ("", f"/{offsets.LEDGER}"):
            storage.delete(spark, f"{root}{kept}/table={table}/batch={row['replaces']}")
    return len(live) if len(live) > 1 else 0


def routed_table(
    spark: SparkSession, root: str, table: str, schema: str, options: Mapping | None = None
) -> DataFrame:
    """One routed table with its value as typed columns, and its place in the log.  Only
    batches that count are read."""
    live = offsets.live_batches(offsets.held_ledger(spark, root)).where(F.col("table") == table)
    rows = spark.read.parquet(root).where(F.col("table") == table).withColumn("batch", F.col("batch").cast("string"))
    rows = rows.join(live.select("batch"), "batch", "left_semi")
    value = F.from_json(F.col("value").cast("string"), schema, dict(options or {}))
    places = [c for c in offsets.PLACE if c in rows.columns]
    return rows.select(*places, value.alias("_v")).select(*places, "_v.*")
