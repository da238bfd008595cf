"""Ranges of log offsets that a routed folder holds, and which of its batches count.

Beside the rows, in ``_ledger``, every table has one small file for each batch: the ranges
of offsets in it, by topic and partition.  The file is written after the rows and appears
in one step, so it is the commit: rows of a batch without it are not read.  A compacted
batch also names those it replaces, which stop to count at that moment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from martflow import storage

PLACE = ("topic", "partition", "offset")
LEDGER = "_ledger"
# Offsets are compared within blocks of so many, so that a hot partition of a topic is
# compared by several tasks.
BLOCK = 1 << 16
_SCHEMA = "topic string, partition int, low bigint, high bigint, replaces string, table string, batch string"
_LOG = ("topic", "partition")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """All entries; empty for a folder without any."""
    path = f"{root.rstrip('/')}/{LEDGER}"
    if not storage.has_data(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).option("basePath", path).parquet(path)


def live_batches(entries: DataFrame) -> DataFrame:
    """``table, batch`` of the batches that count."""
    gone = entries.where("replaces is not null").select("table", F.col("replaces").alias("batch"))
    return entries.select("table", "batch").distinct().join(gone.distinct(), ["table", "batch"], "left_anti")


def ranges(rows: DataFrame, by: Sequence[str] = _LOG) -> DataFrame:
    """``by, low, high``: the runs of consecutive offsets of ``rows``.

    Runs are found inside blocks, in parallel, and joined where they meet at the edges of
    blocks; that last step sees the runs of one topic's partition, not its rows."""
    block = F.expr(f"offset div {BLOCK}").alias("_block")
    found = rows.select(*by, block, "offset").distinct()
    number = F.row_number().over(Window.partitionBy(*by, "_block").orderBy("offset"))
    runs = (
        found.withColumn("_run", F.col("offset") - number)
        .groupBy(*by, "_block", "_run")
        .agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    )
    return merged(runs.select(*by, "low", "high"), by)


def merged(intervals: DataFrame, by: Sequence[str] = _LOG) -> DataFrame:
    """Intervals that overlap or touch as one."""
    order = Window.partitionBy(*by).orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("low") > before + 1), 1).otherwise(0)
    return (
        intervals.withColumn("_starts", starts)
        .withColumn("_group", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_group")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("_group")
    )


def not_held(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows whose place in the log lies in no range of ``entries``; both have ``table``.

    Only ranges that meet the batch's own span are taken; they are cut to it and compared
    by equal blocks, so the stored rows are never looked at."""
    spans = rows.groupBy("table", *_LOG).agg(F.min("offset").alias("_first"), F.max("offset").alias("_last"))
    near = (
        entries.where("low is not null")
        .select("table", *_LOG, "low", "high")
        .join(spans, ["table", *_LOG])
        .where("low <= _last and high >= _first")
        .select("table", *_LOG, F.greatest("low", "_first").alias("low"), F.least("high", "_last").alias("high"))
        .distinct()
    )
    blocks = F.explode(F.expr(f"sequence(low div {BLOCK}, high div {BLOCK})")).alias("_block")
    held = near.select(*(F.col(c).alias(f"_{c}") for c in ("table", *_LOG)), "low", "high", blocks)
    same = [F.col(c) == F.col(f"_{c}") for c in ("table", *_LOG)]
    same += [F.expr(f"offset div {BLOCK}") == F.col("_block"), F.col("offset").between(F.col("low"), F.col("high"))]
    return rows.join(held, same, "left_anti")


def commit(spark: SparkSession, root: str, batch: str, entries: DataFrame) -> None:
    """Write the entries ``table, topic, partition, low, high, replaces`` of a batch: one
    file for each table, which makes its rows count."""
    rows = entries.withColumn("batch", F.lit(batch))
    rows = rows.select(*(c.split()[0] for c in _SCHEMA.split(", "))).repartition("table").sortWithinPartitions("table", *_LOG, "low")
    rows.write.mode("append").partitionBy("table", "batch").parquet(f"{root.rstrip('/')}/{LEDGER}")


def adopt(spark: SparkSession, root: str) -> None:
    """Make a ledger for a folder that was written without one: all its batches count."""
    schema = "topic string, partition int, offset bigint, table string, batch string"
    stored = spark.read.schema(schema).parquet(root)
    found = ranges(stored, ("table", "batch", *_LOG)).withColumn("replaces", F.lit(None).cast("string"))
    rows = found.select(*(c.split()[0] for c in _SCHEMA.split(", "))).repartition("table", "batch")
    rows.write.mode("append").partitionBy("table", "batch").parquet(f"{root.rstrip('/')}/{LEDGER}")


def held_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The ledger of a folder, made first if rows lie there without one."""
    if not storage.has_data(spark, f"{root.rstrip('/')}/{LEDGER}") and storage.has_data(spark, root):
        adopt(spark, root)
    return ledger(spark, root)
