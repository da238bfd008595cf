"""Marts whose rows of a day come from the facts of that day: only days whose facts have
changed are computed again.

A day's version is a sum of hashes over the names, sizes and times of its files, taken from
a listing; no row is read for it.  Dimensions have no days: a digest of their rows tells
whether all days must be made anew.  What a mart was made from is kept in ``_inputs`` beside
its files, after the rows, so a run that ends in between makes the same days once more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from martflow import storage
from martflow.plans.digests import row_digests
from martflow.session import plan_unions_safely, scratch_dir
from martflow.sinks.writers import (
    _kept_list,
    delete_unwritten,
    held_partitions,
    in_partitions,
    replace_partitions,
    stored_rows,
    write_partitions,
)

FOLDER = "_inputs"
_SCHEMA = "_p string, input string, version decimal(38,0), run bigint"
_ALL = "*"
_NULL = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder name of NULL


def partition_versions(spark: SparkSession, path: str, by: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """``_p, version`` of each partition that has files, from a listing of the folder."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    parts = []
    for c in by:
        text = F.url_decode(F.regexp_extract("path", f"/{c}=([^/]*)/", 1))
        value = F.when(text != _NULL, text).cast(types[c]).cast("string")
        parts.append(F.coalesce(value, F.lit("\0")))
    hashed = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return files.groupBy(F.concat_ws("/", *parts).alias("_p")).agg(F.sum(hashed).alias("version"))


def current_inputs(facts: Mapping[str, tuple[str, DataFrame]], others: Mapping[str, DataFrame], by: Sequence[str]) -> DataFrame:
    """``_p, input, version`` of all days of the facts (name: folder and frame), and of the
    other inputs as wholes."""
    found = []
    for name, (path, frame) in facts.items():
        versions = partition_versions(frame.sparkSession, path, by, {c: frame.schema[c].dataType.simpleString() for c in by})
        found.append(versions.select("_p", F.lit(name).alias("input"), "version"))
    for name, frame in others.items():
        digest = row_digests(frame.withColumn("_one", F.lit(1)), ["_one"], frame.columns)
        both = (F.col("first") + F.col("second") + F.col("n")).cast("decimal(38,0)")
        found.append(digest.select(F.lit(_ALL).alias("_p"), F.lit(name).alias("input"), both.alias("version")))
    return reduce(lambda a, b: a.union(b), found)


def held_inputs(spark: SparkSession, path: str) -> DataFrame | None:
    """What the mart was last made from, by day and input."""
    folder = f"{path.rstrip('/')}/{FOLDER}"
    if not storage.has_data(spark, folder):
        return None
    newest = F.max_by("version", "run").alias("version")
    return spark.read.schema(_SCHEMA).parquet(folder).groupBy("_p", "input").agg(newest, F.max("run").alias("run"))


def refresh(
    spark: SparkSession,
    path: str,
    by: Sequence[str],
    build,
    facts: Mapping[str, tuple[str, DataFrame]],
    others: Mapping[str, DataFrame],
) -> dict | None:
    """Bring a mart at ``path`` up to date.  ``build(facts, others)`` gets the facts of the
    days to be made, all days the first time and when another input has changed, and
    returns rows with the columns ``by``.  Returns the ``parts`` that may be new, None for
    all, and how many were ``emptied``; None if nothing has changed."""
    plan_unions_safely(spark)
    staged = _written(current_inputs(facts, others, by), "mart-inputs")
    held = held_inputs(spark, path)
    if held is not None:
        held = _written(held, "mart-inputs")
        differ = staged.join(held, ["_p", "input", "version"], "left_anti").select("_p")
        # A version that is NULL stands for a day without files: it is known to be gone.
        gone = held.where("version is not null").join(staged, ["_p", "input"], "left_anti").select("_p", "input")
        days = _kept_list(differ.union(gone.select("_p")), "mart-days")
        if days.isEmpty():
            return None
    if held is None or not days.where(F.col("_p") == _ALL).isEmpty():
        rows = build({n: frame for n, (_, frame) in facts.items()}, others)
        write_partitions(rows, path, by, mode="overwrite")
        seen, done = staged, {"parts": None, "emptied": 0}
    else:
        rows = build({n: in_partitions(frame, by, days) for n, (_, frame) in facts.items()}, others)
        before = held_partitions(stored_rows(spark, path), by, days)
        replace_partitions(rows, path, by)
        emptied = delete_unwritten(stored_rows(spark, path), by, before)
        done = {"parts": in_partitions(stored_rows(spark, path), by, days).select(*by), "emptied": emptied}
        none = F.lit(None).cast("decimal(38,0)").alias("version")
        seen = staged.join(days.select("_p"), "_p", "left_semi").unionByName(gone.select("_p", "input", none))
    last = None if held is None else held.agg(F.max("run")).head()[0]
    run = F.lit(0 if last is None else last + 1).cast("bigint").alias("run")
    seen.select("_p", "input", "version", run).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{FOLDER}")
    return done


def _written(df: DataFrame, label: str) -> DataFrame:
    """Written once: the inputs as they were before anything was read from them."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
