"""Sorted reports: written in one order over all files, and read back in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import AtomicType, StructType
from pyspark.sql.window import Window

from martflow.sinks.writers import declare_schema, declared_schema


def write_sorted(df: DataFrame, path: str, order: Sequence[Column], ties: Sequence[str] = ()) -> None:
    """Write a report as Parquet, sorted within and across its files.

    Rows go to tasks by ranges of the whole ``order`` and of the ``ties`` after it.  A range
    cannot be cut inside equal values: if much of a report has no date and rate 0, only the
    tie-breaking columns spread it.  By default these are all other columns that can be
    sorted, after a hash of them, so that only rows equal in all of them stay together.
    """
    others = list(ties)
    if not others:
        flat = [f.name for f in df.schema if isinstance(f.dataType, AtomicType)]
        others = [F.xxhash64(*flat), *flat] if flat else []
    df.orderBy(*order, *others).write.mode("overwrite").parquet(path)
    declare_schema(df.sparkSession, path, df.schema, replace=True)


def read_sorted(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A report with each row's place in it, counted from 1.

    Files are named in the order of their ranges, and a row knows its number inside its
    file; so only the number of rows in each file, from its footer, has to be summed up: a
    row for each file, not for each row of the report."""
    schema = declared_schema(spark, path)
    rows = _report(spark, path, schema).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = _report(spark, path, schema).select(F.col("_metadata.file_name").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")
    starts = sizes.select("_file", before.alias("_before"))
    return rows.join(starts, "_file").withColumn(position, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def _report(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)
