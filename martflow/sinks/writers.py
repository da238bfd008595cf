"""Partitioned folder writes.

A dynamic partition overwrite writes aside first and replaces folders when the
job commits, so a lost executor leaves the table as it was.  The commit renames
folders one by one; to survive a driver lost in that moment, pass ``batch_id``:
the new partitions are then kept in the shared folder until the commit is through,
and a repeated call with the same id finishes from there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import FractionalType, StructField, StructType

from martflow import storage
from martflow.operators.changes import latest_changes
from martflow.operators.merge import SchemaMismatch
from martflow.operators.relational import in_types_of, union_by_name
from martflow.session import scratch_dir, shared_dir

MODES = ("overwrite_partitions", "overwrite", "append", "merge_partitions")
# The stored schema, beside the table.  Readers skip names with an underscore.
SCHEMA_FILE = "_martflow_schema.json"
FILE, PLACE, ROWS_OF = "_metadata.file_path", "_metadata.row_index", "_held_file"


def cluster_for_write(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring the rows of a partition together, sorted, before a write.

    Rebalancing, unlike a plain repartition by the partition columns, splits a
    partition that holds much of the data over several tasks (and files), and
    packs small partitions together.
    """
    return df.hint("rebalance", *by).sortWithinPartitions(*by)


def _name(by: Sequence[str]) -> Column:
    """One text that names a partition, NULLs included."""
    value = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by]
    return F.concat_ws("/", *value)


def _parts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The distinct partitions of a frame.  Fractions as text, as two can be equal and lie
    in two folders (0.0, -0.0)."""
    fractions = [c for c in by if isinstance(df.schema[c].dataType, FractionalType)]
    return df.select(*(F.col(c).cast("string").alias(c) if c in fractions else c for c in by)).distinct()


def partitions_of(df: DataFrame, by: Sequence[str], label: str = "partitions") -> DataFrame:
    """The distinct partitions of a frame, by name, written out."""
    return _kept_list(df.select(_name(by).alias("_p")), label)


def _kept_list(names: DataFrame, label: str) -> DataFrame:
    """Distinct rows of a list of names, written to the shared folder.

    The column ``_on`` is what tells Spark that a join with the list leaves out rows,
    so that it prunes partitions by it."""
    spark = names.sparkSession
    path = scratch_dir(spark, label)
    others = [F.min(c).alias(c) for c in names.columns if c != "_p"]
    listed = names.groupBy("_p").agg(F.min(F.lit(1)).alias("_on"), *others)
    listed.write.parquet(path)
    return spark.read.schema(listed.schema).parquet(path)


def in_partitions(df: DataFrame, by: Sequence[str], names: DataFrame) -> DataFrame:
    """Rows of the partitions in a list made by ``partitions_of``.  The join is on
    partition columns, and a list small enough for a broadcast prunes folders."""
    wanted = names.where("_on = 1").select(F.col("_p").alias("_wanted"), "_on")
    return df.join(wanted, _name(by) == F.col("_wanted"), "left_semi")


def declared_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema kept beside a table, if one of this module's writes has left it."""
    text = storage.read_text(spark, f"{path}/{SCHEMA_FILE}")
    return StructType.fromJson(json.loads(text)) if text else None


def declare_schema(spark: SparkSession, path: str, schema: StructType, replace: bool = False) -> None:
    """Keep a table's schema beside it, so that no later write has to collect it from
    the footers of all files.  Columns add up unless ``replace``.

    Whoever writes to the folder by other means with new columns declares them here."""
    known = None if replace else declared_schema(spark, path)
    have = {f.name for f in known} if known else set()
    fields = [*(known or []), *(StructField(f.name, f.dataType) for f in schema if f.name not in have)]
    if known is None or len(fields) > len(known):
        storage.write_text(spark, f"{path}/{SCHEMA_FILE}", StructType(fields).json())


def stored_rows(
    spark: SparkSession,
    path: str,
    declared: StructType | str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A stored folder with every column any of its files has.

    Files written before and after a schema change differ, and rewriting a partition
    with the columns of just one file would lose the rest.  The schema is the one
    given, or the one kept beside the table; for a folder without one it is collected
    from all footers.
    """
    reader = spark.read.format(fmt)
    declared = declared if declared is not None else declared_schema(spark, path)
    if declared is not None:
        return reader.schema(declared).load(path)
    return (reader.option("mergeSchema", "true") if fmt == "parquet" else reader).load(path)


def stored_like(
    batch: DataFrame,
    path: str,
    by: Sequence[str],
    declared: StructType | str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A stored folder whose partition columns have the batch's types.  Folder names
    carry none, and a text such as ``01`` would come back as a number."""
    spark = batch.sparkSession
    found = stored_rows(spark, path, declared, fmt).schema
    types = {f.name: f.dataType for f in batch.schema if f.name in by}
    typed = [StructField(f.name, types.get(f.name, f.dataType)) for f in found]
    return stored_rows(spark, path, StructType(typed), fmt)


def is_empty_table(spark: SparkSession, path: str) -> bool:
    """True for a folder that is missing, or that no schema and no file is left in: its
    next write is a first one.  A table that lost its last row keeps its schema."""
    return declared_schema(spark, path) is None and not storage.has_data(spark, path)


def _write(
    df: DataFrame, path: str, by: Sequence[str], mode: str, dynamic: bool, fmt: str
) -> None:
    writer = df.write.format(fmt).mode(mode).partitionBy(*by)
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").save(path)
    if fmt == "parquet":
        # A static overwrite has deleted the file; others add their columns.
        declare_schema(df.sparkSession, path, df.schema, replace=mode == "overwrite" and not dynamic)


def commit_stage(spark: SparkSession, path: str, batch_id: str) -> str:
    """The folder that keeps a batch of a table until it is in place."""
    table = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/martflow/commit/{batch_id}-{table}"


def replace_partitions(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    batch_id: str | None = None,
    fmt: str = "parquet",
    cluster: bool = True,
) -> dict:
    """Replace the partitions present in ``df``; others stay.

    ``cluster=False`` writes without an exchange, for rows that already lie together.

    ``df`` may be read from ``path`` itself.  Returns the number of ``rows``, observed
    during the write.  ``batch_id`` keeps the rows aside until they are in place; they are
    taken up again only by the same batch of the same table, with the same columns.
    """
    spark = df.sparkSession
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    rows = cluster_for_write(df, by) if cluster else df
    if batch_id is None:
        _write(rows.observe(seen, *metrics), path, by, "overwrite", True, fmt)
        return seen.get
    stage = commit_stage(spark, path, batch_id)
    kept = declared_schema(spark, stage)
    if not storage.is_complete(spark, stage) or kept is None or kept.simpleString() != df.schema.simpleString():
        storage.delete(spark, stage)
        declare_schema(spark, stage, df.schema)
        rows.write.mode("append").parquet(stage)
    staged = spark.read.schema(df.schema).parquet(stage)
    _write(staged.observe(seen, *metrics), path, by, "overwrite", True, fmt)
    result = seen.get
    storage.delete(spark, stage)
    return result


def write_partitions(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    mode: str = "merge_partitions",
    keys: Sequence[str] | None = None,
    ts: str | None = None,
    tie_break: Sequence[str | Column] = (),
    batch_id: str | None = None,
    fmt: str = "parquet",
    cluster: bool = True,
    declared: StructType | str | None = None,
    distinct: bool = False,
) -> dict | None:
    """Write a batch into a folder partitioned by ``by``.

    - ``merge_partitions`` (default): the partitions of the batch become *existing
      union new*.  A late row therefore adds to its hour.  With ``keys`` one row of a
      key stays in each partition: the newest by ``ts``, or without ``ts`` the batch's.
      Rows with a NULL key are compared with none and stay.  A key that moves between
      partitions needs ``upsert_path``.  Without keys all rows stay, equal ones too,
      unless ``distinct``: needed if a batch can come twice.
      ``declared`` is the stored schema, if known.
    - ``overwrite_partitions``: the partitions of the batch are replaced by it.  A
      single late row then replaces its whole hour.
    - ``overwrite``: everything is replaced.
    - ``append``: nothing is replaced.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode in ("overwrite", "append"):
        rows = cluster_for_write(df, by) if cluster else df
        _write(rows, path, by, mode, False, fmt)
        return None
    if mode == "overwrite_partitions" or is_empty_table(df.sparkSession, path):
        rows = df
        if mode == "merge_partitions":
            rows = _one_version(None, df, by, keys, ts, tie_break, distinct)
        return replace_partitions(rows, path, by, batch_id, fmt=fmt, cluster=cluster)
    # The batch is used twice, to find its partitions and to write them.
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        old = stored_like(df, path, by, declared, fmt)
        lost = sorted(set(old.columns) - set(df.columns))
        if lost:
            raise SchemaMismatch(f"the batch lacks stored columns: {lost}")
        old = old.select(*(c for c in df.columns if c in old.columns))
        touched = in_partitions(old, by, partitions_of(df, by))
        merged = _one_version(touched, in_types_of(df, old), by, keys, ts, tie_break, distinct)
        return replace_partitions(merged, path, by, batch_id, fmt=fmt, cluster=cluster)
    finally:
        df.unpersist()


def _one_version(
    old: DataFrame | None,
    new: DataFrame,
    by: Sequence[str],
    keys: Sequence[str] | None,
    ts: str | None,
    tie_break: Sequence[str | Column],
    distinct: bool,
) -> DataFrame:
    """Stored rows and a batch, one version of each key and partition."""

    def together(first: DataFrame | None, second: DataFrame) -> DataFrame:
        return second if first is None else union_by_name(first, second, allow_missing=True)

    if not keys:
        both = together(old, new)
        return both.distinct() if distinct else both
    # Rows without a key or time cannot be compared; they stay, made distinct.
    unknown = F.lit(False)
    for c in [*keys, *([ts] if ts else [])]:
        unknown = unknown | F.col(c).isNull()
    place = [c for c in by if c not in keys]
    # A NULL partition is a partition like others.
    slot = {f"_slot_{i}": F.coalesce(F.col(c).cast("string"), F.lit("\0")) for i, c in enumerate(place)}
    inside = [*keys, *slot]
    if ts:
        both = together(old, new)
        known = both.where(~unknown).withColumns(slot)
        breakers = list(tie_break) or [c for c in both.columns if c not in {*keys, ts}]
        newest = latest_changes(known, inside, ts, ties="one", tie_break=breakers).drop(*slot)
        return union_by_name(newest, both.where(unknown).distinct())
    # The batch wins; of its own rows of one key always the same one.
    rest = [c for c in new.columns if c not in {*keys, *place}]
    known = new.where(~unknown).withColumns(slot).withColumn("_all", F.struct(*(rest or keys)))
    one = latest_changes(known, inside, "_all", ties="one", tie_break=["_all"]).drop("_all")
    if old is not None:
        theirs = one.select(*(F.col(c).alias(f"_new_{i}") for i, c in enumerate(inside)))
        same = F.lit(True)
        for i, c in enumerate(inside):
            same = same & (F.col(c) == F.col(f"_new_{i}"))
        kept = old.where(~unknown).withColumns(slot).join(theirs, same, "left_anti").drop(*slot)
        one = together(kept, one.drop(*slot))
    loose = together(None if old is None else old.where(unknown), new.where(unknown)).distinct()
    return union_by_name(one.drop(*slot), loose, allow_missing=True)


def drop_partitions(
    spark: SparkSession, path: str, by: Sequence[str], predicate: Column | str
) -> int:
    """Delete the partition folders that satisfy a predicate on partition columns.
    Returns how many."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return delete_partitions(stored_rows(spark, path).where(condition))


def delete_partitions(parts: DataFrame) -> int:
    """Delete the folders of the partitions that a stored frame's rows lie in.

    Folders are those the rows' files are in, so no value is turned into a name and
    back.  They come to the driver page by page."""
    return _delete_folders(parts.sparkSession, parts.select(F.col(FILE).alias("f")))


def _delete_folders(spark: SparkSession, files: DataFrame) -> int:
    folders = files.select(F.regexp_replace("f", "/[^/]+$", "").alias("d")).distinct()
    count = 0
    for row in folders.toLocalIterator():
        storage.delete(spark, unquote(row["d"]))  # file paths come percent-encoded
        count += 1
    return count


def with_file(target: DataFrame, *columns: str) -> DataFrame:
    """Some columns of stored rows, and the file each lies in."""
    return target.select(*columns, F.col(FILE).alias(ROWS_OF))


def files_of(target: DataFrame, by: Sequence[str]) -> DataFrame:
    """The files of a stored frame and the partition of each: the first row of every file."""
    return with_file(target.where(F.col(PLACE) == 0), *by)


def touched_partitions(
    matched: DataFrame, batch: DataFrame, target: DataFrame, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The partitions of rows of a stored ``target`` and of a batch, from one written list:
    all of them, and those of the rows with one file of each."""
    theirs, own = (_parts(df, by).select(_name(by).alias("_p"), F.lit(new).alias("_new")) for df, new in ((matched, 0), (batch, 1)))
    listed = _kept_list(union_by_name(theirs, own), "touched")
    return listed.select("_p", "_on"), held_partitions(target, by, listed.where("_new = 0"))


def held_partitions(target: DataFrame, by: Sequence[str], names: DataFrame, label: str = "held") -> DataFrame:
    """The partitions of a stored frame that are in a list, with one file of each, written out."""
    return _kept_list(files_of(in_partitions(target, by, names), by).select(_name(by).alias("_p"), ROWS_OF), label)


def delete_unwritten(target: DataFrame, by: Sequence[str], held: DataFrame) -> int:
    """Delete those partitions of ``held`` that a write since then has not replaced.

    A dynamic overwrite leaves alone a partition that it has no row for.  One that was
    replaced has new files only, so a file known from before means that it was not."""
    now = files_of(in_partitions(target, by, held), by).select(F.col(ROWS_OF).alias("f"))
    before = held.select(F.col(ROWS_OF).alias("_was"))
    return _delete_folders(target.sparkSession, now.join(before, F.col("f") == F.col("_was"), "left_semi"))


def compact(
    spark: SparkSession, path: str, by: Sequence[str], predicate: Column | str | None = None
) -> dict:
    """Rewrite partitions (all, or those of a predicate on partition columns) into files
    of the advisory size ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.  Rows stay
    the same."""
    rows = stored_rows(spark, path)
    return replace_partitions(rows if predicate is None else rows.where(predicate), path, by)
