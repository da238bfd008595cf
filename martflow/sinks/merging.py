"""Applying a merge to stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from martflow.operators.changes import CONTROL_COLUMNS, DELETE
from martflow.operators.merge import in_key_range, key_facts, merge, refuse_repeats
from martflow.sinks.locations import index_keys, rows_that_may_match
from martflow.sinks.tombstones import expire_deletes, held_deletes, keep_deletes
from martflow.sinks.writers import (
    declare_schema,
    delete_unwritten,
    in_partitions,
    is_empty_table,
    replace_partitions,
    stored_like,
    touched_partitions,
    write_partitions,
)


def upsert_path(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    batch_id: str | None = None,
    op: str = "Op",
    control: Sequence[str] = CONTROL_COLUMNS,
    schema: str = "strict",
    declared: StructType | str | None = None,
    on_duplicate: str = "error",
    keep: bool = True,
    remember: bool = True,
    lateness: timedelta | None = None,
    index: bool = False,
    **options,
) -> dict:
    """Merge a batch into a partitioned Parquet folder, rewriting touched partitions.

    The first batch creates the folder.  The cost follows the touched partitions, not
    the table, and the way is the same for any number of them.  Merging the same batch
    again changes nothing.  ``declared`` is the stored schema; by default the one kept
    beside the table.  ``keep=False`` if the caller holds the batch already.
    ``options`` go to ``merge``.  Returns the number of ``rows`` written, and of
    partitions ``emptied`` if the table was not.

    With ``newer_than`` deletes stay deleted: their keys and times are kept beside the
    table (see ``sinks.tombstones``), and a later batch's row that is no newer is ignored.
    ``lateness`` says how much older than the newest row of a batch a row can be; deletes
    from before that are forgotten.  ``remember=False`` keeps and asks nothing.

    ``index`` keeps a Bloom filter of each file's keys beside the table (see
    ``sinks.locations``) and opens only files that can hold a key of the batch: for keys
    that are spread over the table, where a key range leaves nothing out.

    One aggregate of the batch gives its key range and finds repeated keys; then come
    the touched partitions, the write, and a look for emptied partitions.
    """
    if keep:
        source = source.persist(StorageLevel.MEMORY_AND_DISK)
    matched = None
    rules = {"op": op, "control": control, **options}
    try:
        ts = options.get("newer_than")
        recalled = remember and ts is not None and options.get("deletes", "apply") == "apply"
        facts = key_facts(source, keys, op, ts if recalled else None, repeats=on_duplicate == "error")
        if on_duplicate == "error":
            refuse_repeats(facts)
            on_duplicate = "trust"
        rules["on_duplicate"] = on_duplicate
        if recalled:
            rules["deleted"] = held_deletes(spark, path, source, keys, ts, facts["since"])
            if facts["deletes"]:
                keep_deletes(source, path, keys, ts, op, rules["deleted"])
            if lateness is not None and facts["until"] is not None:
                expire_deletes(spark, path, facts["until"], lateness)
        if is_empty_table(spark, path):
            empty = spark.createDataFrame([], source.drop(op, *control).schema)
            declare_schema(spark, path, empty.schema)
            written = replace_partitions(merge(empty, source, keys, **rules), path, by, batch_id)
            if index:
                index_keys(stored_like(source, path, by, declared), path, keys)
            return written
        target = stored_like(source, path, by, declared)
        may_match = rows_that_may_match(target, path, source, keys) if index else target
        candidates = in_key_range(may_match, facts, keys[0])
        places = candidates.select(*dict.fromkeys([*keys, *by, *([ts] if ts else [])]))
        matched = places.join(source.select(*keys), list(keys), "left_semi")
        if ts is not None:
            # Bounded by the batch, and asked twice: for its places and for its times.
            rules["matched"] = matched.persist(StorageLevel.MEMORY_AND_DISK)
        touched, held = touched_partitions(matched, source, target, by)
        result = merge(in_partitions(target, by, touched), source, keys, schema=schema, **rules)
        written = replace_partitions(result, path, by, batch_id)
        emptied = delete_unwritten(stored_like(source, path, by, target.schema), by, held)
        if index:
            index_keys(stored_like(source, path, by), path, keys)
        return {**written, "emptied": emptied}
    finally:
        if matched is not None:
            matched.unpersist()
        if keep:
            source.unpersist()


def reload(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace a partitioned folder completely, as a repair after schema drift."""
    write_partitions(df, path, by, mode="overwrite")


def native_merge(
    source: DataFrame,
    table: str,
    keys: Sequence[str],
    deletes: str = "apply",
    op: str = "Op",
    control: Sequence[str] = CONTROL_COLUMNS,
    newer_than: str | None = None,
) -> None:
    """MERGE INTO a table whose format supports it; Parquet tables do not.

    No such format is installed here: only the refusal by Parquet is tested."""
    s, t = "s", table.split(".")[-1]
    on = reduce(lambda a, b: a & b, (F.col(f"{s}.{k}") == F.col(f"{t}.{k}") for k in keys))
    newer = F.col(f"{s}.{newer_than}") >= F.col(f"{t}.{newer_than}") if newer_than else F.lit(True)
    rows = {c: F.col(f"{s}.{c}") for c in source.columns if c not in {op, *control}}
    gone = F.lit(False)
    if op in source.columns:
        gone = F.coalesce(F.col(f"{s}.{op}") == DELETE, F.lit(False))
    into = source.alias(s).mergeInto(table, on)
    if deletes == "apply" and op in source.columns:
        into = into.whenMatched(gone & newer).delete()
    into.whenMatched(~gone & newer).update(rows).whenNotMatched(~gone).insert(rows).merge()
