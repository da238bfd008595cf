"""Catalog tables: create, insert, publish, list, drop, bucketed layout."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from martflow import storage
from martflow.sinks.writers import cluster_for_write
from martflow.sources.catalog import describe_table


def ensure_database(spark: SparkSession, db: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{where}")


def list_databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def list_tables(spark: SparkSession, db: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(db) if not t.isTemporary)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def temp_view(df: DataFrame, name: str) -> DataFrame:
    """Name a frame for SQL text; the build itself passes frames along."""
    df.createOrReplaceTempView(name)
    return df


def create_table(
    spark: SparkSession,
    name: str,
    source: DataFrame | StructType | str,
    partition_by: Sequence[str] = (),
    sort_within: Sequence[str] = (),
    if_exists: str = "skip",
    properties: Mapping[str, str] | None = None,
    path: str | None = None,
    fmt: str = "parquet",
) -> bool:
    """Create a table from a frame (as select) or from a schema (empty).

    Returns False when the table was there and ``if_exists="skip"``: nothing is
    written then.  Rows are clustered by partition first, or sorted by
    ``sort_within`` inside each task.
    """
    if spark.catalog.tableExists(name):
        if if_exists == "error":
            raise ValueError(f"table {name} exists")
        return False
    if not isinstance(source, DataFrame):
        schema = StructType.fromDDL(source) if isinstance(source, str) else source
        df = spark.createDataFrame([], schema)
    elif partition_by:
        df = cluster_for_write(source, partition_by)
    else:
        df = source
    if sort_within:
        df = df.sortWithinPartitions(*partition_by, *sort_within)
    writer = df.writeTo(name).using(fmt)
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionedBy(*(F.col(c) for c in partition_by))
    for key, value in (properties or {}).items():
        writer = writer.tableProperty(key, value)
    writer.create()
    return True


def insert_into(df: DataFrame, name: str) -> None:
    """Append by column name, whatever the column order."""
    target = df.sparkSession.table(name)
    df.select(*target.columns).write.insertInto(name)


def publish(
    df: DataFrame,
    name: str,
    root: str,
    check: Callable[[DataFrame], None] | None = None,
) -> str:
    """Replace an unpartitioned table in one step.

    The rows go to a new folder under ``root``; then the catalog entry is pointed
    at it.  Readers see the old rows or the new ones, and a failed run changes
    nothing; ``check`` sees the written rows first and may raise.  Old folders stay until ``drop_old_versions``.
    """
    spark = df.sparkSession
    location = f"{_versions(name, root)}/v{time.time_ns():020d}"
    df.write.parquet(location)
    staged = spark.read.parquet(location)
    if check is not None:
        check(staged)
    written = staged.schema
    if spark.catalog.tableExists(name):
        if spark.table(name).schema == written:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
            spark.catalog.refreshTable(name)
            return location
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{location}'")
    return location


def _versions(name: str, root: str) -> str:
    return f"{root.rstrip('/')}/{name.replace('.', '/')}"


def drop_old_versions(spark: SparkSession, name: str, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` folders of a published table, and never the
    one in use.  Keep enough for the readers that may still run."""
    current = describe_table(spark, name)["Location"].rstrip("/").rsplit("/", 1)[-1]
    folders = storage.folders(spark, f"{_versions(name, root)}/v*")
    doomed = [f for f in folders[: max(len(folders) - keep, 0)] if not f.endswith(current)]
    for folder in doomed:
        storage.delete(spark, folder)
    return doomed


def layout(
    df: DataFrame, sort: Sequence[str] = (), cluster: Sequence[str] = ()
) -> DataFrame:
    """Bring rows of equal ``cluster`` columns together and sort inside each task, so
    that files have narrow value ranges.  A hot value is split over several tasks."""
    rows = df.hint("rebalance", *cluster) if cluster else df
    return rows.sortWithinPartitions(*sort) if sort else rows


def write_bucketed(
    df: DataFrame,
    name: str,
    buckets: int,
    by: Sequence[str],
    sort: Sequence[str] = (),
    path: str | None = None,
) -> None:
    """Table bucketed by ``by``: joins and aggregations on these columns need no
    exchange.  For the two sides of a large, repeated merge."""
    writer = df.repartition(buckets, *by).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, *by).sortBy(*(sort or by))
    (writer.option("path", path) if path else writer).saveAsTable(name)
