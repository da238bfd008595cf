"""Scans through the session catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def describe_table(spark: SparkSession, name: str) -> dict[str, str]:
    """Catalog facts of a table: ``Location``, ``Provider``, ``Type`` and so on."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where(F.col("data_type") != "").collect()
    return {r["col_name"]: r["data_type"] for r in rows}


def scan_catalog(
    spark: SparkSession,
    name: str,
    schemes: Mapping[str, str] | None = None,
    partition: str | None = None,
) -> DataFrame:
    """Read a table's files using only its catalog entry.

    Schema, format and location come from the catalog.  ``schemes`` rewrites the
    location's scheme (``{"s3": "s3a"}``); ``partition`` reads one folder below it
    (``year=2024/month=6``) and keeps the partition columns.
    """
    facts = describe_table(spark, name)
    location = facts["Location"].rstrip("/")
    for old, new in (schemes or {}).items():
        if location.startswith(f"{old}://"):
            location = f"{new}{location[len(old):]}"
    target = f"{location}/{partition}" if partition else location
    return (
        spark.read.format(facts["Provider"].lower())
        .schema(spark.table(name).schema)
        .option("basePath", location)
        .load(target)
    )


def register_external(
    spark: SparkSession,
    db: str,
    tables: Mapping[str, str],
    fmt: str = "parquet",
    location: str | None = None,
) -> dict[str, str]:
    """Expose folders as tables of a database: ``{table: folder}``.  Returns the
    full name of each; the files stay where they are."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{where}")
    for name, location in tables.items():
        discover_table(spark, location, f"{db}.{name}", fmt)
    return {name: f"{db}.{name}" for name in tables}


def discover_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> None:
    """Create a table over existing files, or bring its list of partitions up to date.

    Schema and partition columns are read from the folder; marker files are ignored.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING {fmt} LOCATION '{root}'")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(name)


def register_partitions(spark: SparkSession, name: str, parts: DataFrame, page: int = 200) -> int:
    """Add the partitions in ``parts``, a frame of the table's partition columns, to a
    table's list, ``page`` at a time; nothing is listed.  A NULL partition has no name to
    add it by: the list is then brought up to date as a whole.  Returns how many."""
    columns = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    count, held = 0, []

    def add() -> None:
        if held:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(held)}")
            held.clear()

    for row in parts.select(*columns).distinct().toLocalIterator():
        if any(v is None for v in row):
            spark.sql(f"MSCK REPAIR TABLE {name} ADD PARTITIONS")
            continue
        values = [str(v).replace("\\", "\\\\").replace("'", "\\'") for v in row]
        held.append(f"PARTITION ({', '.join(f"`{c}` = '{v}'" for c, v in zip(columns, values, strict=True))})")
        count += 1
        if len(held) == page:
            add()
    add()
    spark.catalog.refreshTable(name)
    return count
