"""Checks of a growing table that read only what has changed since the last run.

Results are kept by folder in ``_checks`` beside the table, with a digest of the names of the
files they were taken from.  Files are never changed in place, so a folder with the same
files has the same result; the others are read again, and the sum over all folders is the
table's.  A folder that is gone counts no more.  Should a run end early, or another set of
checks be asked for, nothing is kept for it and the folders are read.

The rows are those of ``operators.checks``: check, target, status, failures.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from martflow import storage
from martflow.operators.relational import union_frames
from martflow.sinks.locations import in_files, listed_files, rows_that_may_match
from martflow.sinks.writers import FILE, stored_rows

FOLDER = "_checks"
_SCHEMA = "folder string, files bigint, digest decimal(38,0), what string, failures map<string,bigint>, version bigint"


def _folder(file: str):
    return F.regexp_replace(file, "/[^/]+$", "")


def _state(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The newest result of each folder."""
    kept = f"{path.rstrip('/')}/{FOLDER}"
    if not storage.has_data(spark, kept):
        return spark.createDataFrame([], _SCHEMA).drop("what")
    rows = spark.read.schema(_SCHEMA).parquet(kept).where(F.col("what") == what)
    newest = F.max_by(F.struct("files", "digest", "failures"), "version").alias("s")
    return rows.groupBy("folder").agg(newest, F.max("version").alias("version")).select("folder", "s.*", "version")


def _changed(spark: SparkSession, path: str, what: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders as listed, the state that still holds, and the files of all other folders."""
    files = listed_files(spark, path).withColumn("folder", _folder("file"))
    folders = files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.xxhash64("file").cast("decimal(38,0)")).alias("digest")
    )
    valid = _state(spark, path, what).join(folders, ["folder", "files", "digest"], "left_semi")
    return folders, valid, files.join(valid.select("folder"), "folder", "left_anti")


def _rows_of(target: DataFrame, files: DataFrame, max_files: int) -> DataFrame:
    rows = in_files(target, files, max_files)
    if rows is not None:
        return rows
    return target.join(files.select(F.col("file").alias("_f")), F.col(FILE) == F.col("_f"), "left_semi")


def _keep(found: DataFrame, path: str, what: str, version: int) -> None:
    rows = found.select(
        "folder", "files", F.col("digest").cast("decimal(38,0)").alias("digest"), F.lit(what).alias("what"), "failures",
        F.lit(version).cast("bigint").alias("version"),
    )
    rows.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{FOLDER}")


def _next_version(state: DataFrame) -> int:
    last = state.agg(F.max("version")).head()[0]
    return 0 if last is None else last + 1


def _verdict(name: str, target: str, failures: int) -> tuple[str, str, str, int]:
    return name, target, "error" if failures else "pass", failures


def check_stored(
    spark: SparkSession, path: str, unique: Sequence[str] = (), not_null: Sequence[str] = (), max_files: int = 10_000
) -> DataFrame:
    """``unique`` and ``not_null`` of a partitioned folder; only partitions whose files have
    changed since the last call are read, and of them only these columns.

    ``unique`` is for keys that decide the partition they lie in, such as a key whose
    date is the partition: equal values are counted inside a partition.  For other keys see
    ``check_unique_anywhere``."""
    names = [*(f"unique:{c}" for c in unique), *(f"not_null:{c}" for c in not_null)]
    what = ",".join(sorted(names))
    folders, valid, files = _changed(spark, path, what)
    rows = _rows_of(stored_rows(spark, path), files, max_files)
    counts = []
    for c in unique:
        values = rows.where(F.col(c).isNotNull()).groupBy(_folder(FILE).alias("folder"), F.col(c)).agg(F.count(F.lit(1)).alias("n"))
        counts.append(values.groupBy("folder").agg(F.count_if(F.col("n") > 1).alias("n")).select("folder", F.lit(f"unique:{c}").alias("name"), "n"))
    if not_null:
        nulls = [F.struct(F.lit(f"not_null:{c}").alias("name"), F.count_if(F.col(c).isNull()).alias("n")) for c in not_null]
        per_folder = rows.groupBy(_folder(FILE).alias("folder")).agg(F.array(*nulls).alias("_all"))
        counts.append(per_folder.select("folder", F.inline("_all")))
    failures = union_frames(counts).groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("failures"))
    # Folders whose files hold no row, or only NULL keys, have no counts.
    none = F.create_map().cast("map<string,bigint>")
    found = files.select("folder").distinct().join(folders, "folder").join(failures, "folder", "left")
    _keep(found.withColumn("failures", F.coalesce("failures", none)), path, what, _next_version(valid))
    total = _state(spark, path, what).join(folders, ["folder", "files", "digest"], "left_semi")
    sums = total.agg(*(F.coalesce(F.sum(F.coalesce(F.col("failures")[n], F.lit(0))), F.lit(0)).alias(n) for n in names)).head()
    return spark.createDataFrame([_verdict(*n.split(":", 1), sums[n]) for n in names], "check string, target string, status string, failures long")


def check_unique_anywhere(spark: SparkSession, path: str, keys: Sequence[str], max_files: int = 10_000) -> DataFrame:
    """``unique`` of a key that can lie in any partition: number of values that occur more
    than once; a key with a NULL is not counted.

    What was checked and found unique stays so, and a new repeat has at least one row in a
    partition that has changed.  So the keys of those partitions are compared with the files
    that can hold them by ``index_keys`` (files without a filter are all read).  A failure is
    not kept: its partitions count as changed until a check passes."""
    target = stored_rows(spark, path)
    what = f"anywhere:{','.join(keys)}"
    folders, valid, files = _changed(spark, path, what)
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    fresh = _rows_of(target, files, max_files).where(known).select(*keys)
    may_match = rows_that_may_match(target, path, fresh, keys, max_files).where(known).select(*keys)
    asked = fresh.distinct()
    repeated = may_match.join(asked, list(keys), "left_semi").groupBy(*keys).count().where("count > 1")
    failures = repeated.count()
    if not failures:
        found = files.select("folder").distinct().join(folders, "folder")
        none = F.create_map().cast("map<string,bigint>")
        _keep(found.withColumn("failures", none), path, what, _next_version(valid))
    return spark.createDataFrame([_verdict("unique", ",".join(keys), failures)], "check string, target string, status string, failures long")
