"""Digests of the rows of each partition: to compare only partitions that differ.

A digest is a number of rows and two sums of row hashes, so it holds for any order and
counts equal rows.  The digests of a stored table are kept in ``_digests`` beside its files;
each run adds those of the partitions it looked at, taken from the rows that then lie there,
and the newest of a partition counts.  Should a run end between its rows and its digests,
the partition differs from its digest, and is compared once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from martflow import storage
from martflow.sinks.writers import _kept_list, _name

FOLDER = "_digests"
_SCHEMA = "_p string, n bigint, first decimal(38,0), second decimal(38,0), version bigint"
_PARTS = ("n", "first", "second")


def row_digests(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``_p, n, first, second`` for each partition of ``rows``; sums are map-side."""
    names = sorted(columns)
    values = [F.lit(",".join(names)), *(F.col(c) for c in names)]
    total = [F.sum(F.xxhash64(F.lit(k), *values).cast("decimal(38,0)")) for k in (1, 2)]
    return rows.groupBy(_name(by).alias("_p")).agg(
        F.count(F.lit(1)).alias("n"), total[0].alias("first"), total[1].alias("second")
    )


def held_digests(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest digest of each partition, or None if none was ever kept."""
    folder = f"{path.rstrip('/')}/{FOLDER}"
    if not storage.has_data(spark, folder):
        return None
    newest = F.max_by(F.struct(*_PARTS), "version").alias("d")
    held = spark.read.schema(_SCHEMA).parquet(folder).groupBy("_p").agg(newest, F.max("version").alias("version"))
    return held.select("_p", "d.*", "version")


def changed_partitions(source: DataFrame, path: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The partitions of ``source`` whose rows are not those of the stored table, as a
    written list for ``in_partitions``."""
    ours = row_digests(source, by, columns)
    held = held_digests(source.sparkSession, path)
    if held is not None:
        ours = ours.join(held.select("_p", *_PARTS), ["_p", *_PARTS], "left_anti")
    return _kept_list(ours.select("_p"), "changed-partitions")


def keep_digests(rows: DataFrame, path: str, by: Sequence[str], columns: Sequence[str]) -> None:
    """Keep the digests of the partitions of stored ``rows``: all rows of each."""
    spark = rows.sparkSession
    held = held_digests(spark, path)
    last = None if held is None else held.agg(F.max("version")).head()[0]
    version = F.lit(0 if last is None else last + 1).cast("bigint").alias("version")
    found = row_digests(rows, by, columns).select("_p", *_PARTS, version)
    found.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{FOLDER}")
