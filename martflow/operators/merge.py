"""Merging a batch of changes into a table, as a lazy DataFrame operator.

The sinks apply it to folders (``upsert_path``) or hand the work to a table
format that supports row-level operations (``native_merge``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from martflow.operators.changes import (
    CONTROL_COLUMNS,
    DELETE,
    INSERT,
    duplicate_keys,
    latest_changes,
    split_changes,
)
from martflow.operators.relational import in_types_of, union_by_name


# Key types whose values survive the way to the driver and back unchanged.
_RANGED = (ByteType, ShortType, IntegerType, LongType, StringType)


class DuplicateKeys(ValueError):
    """The batch holds several rows for one key."""


class SchemaMismatch(ValueError):
    """The batch and the table have different columns."""


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key occurs twice.  Runs one aggregation of the batch's keys."""
    known = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    found = duplicate_keys(known, keys).head(1)
    if found:
        raise DuplicateKeys(f"merge source has several rows for {found[0].asDict()}")


def _aligned(target: DataFrame, upserts: DataFrame, schema: str) -> DataFrame:
    if schema == "strict" and set(target.columns) != set(upserts.columns):
        extra = sorted(set(upserts.columns) ^ set(target.columns))
        raise SchemaMismatch(f"columns differ between source and target: {extra}")
    return in_types_of(upserts, target)


def _not_stale(
    target: DataFrame, source: DataFrame, keys: Sequence[str], ts: str, matched: DataFrame | None = None
) -> DataFrame:
    """Source rows at least as new as the target's rows of the same key.

    Only keys and times of the target are read, and only those the source also
    has go on, so what is aggregated is bounded by the source.  ``matched`` has those
    rows, if the caller has looked for them already.
    """
    if matched is None:
        matched = target.join(source.select(*keys), list(keys), "left_semi")
    theirs = matched.select(*keys, F.col(ts).alias("_held")).groupBy(*keys).agg(F.max("_held").alias("_held"))
    newer = F.col("_held").isNull() | (F.col(ts) >= F.col("_held"))
    return source.join(theirs, list(keys), "left").where(newer).select(*source.columns)


def _not_deleted(source: DataFrame, deleted: DataFrame, keys: Sequence[str], ts: str, op: str) -> DataFrame:
    """Source rows newer than the last delete of their key; deletes stay in any case."""
    last = deleted.groupBy(*keys).agg(F.max(ts).alias("_gone"))
    alive = F.col("_gone").isNull() | (F.col(ts) > F.col("_gone"))
    if op in source.columns:
        alive = alive | F.coalesce(F.col(op) == DELETE, F.lit(False))
    return source.join(last, list(keys), "left").where(alive).select(*source.columns)


def _kept(
    target: DataFrame, source: DataFrame, keys: Sequence[str], ts: str | None
) -> DataFrame:
    """Target rows that no source row replaces or deletes.  One pass over the target;
    the source gives its keys and, when time decides, its times."""
    theirs = source.select(
        *(F.col(k).alias(f"_s_{i}") for i, k in enumerate(keys)),
        *([F.col(ts).alias("_s_ts")] if ts else []),
    )
    on = reduce(
        lambda a, b: a & b, (F.col(k) == F.col(f"_s_{i}") for i, k in enumerate(keys))
    )
    if ts:
        on = on & (F.col(ts).isNull() | (F.col("_s_ts") >= F.col(ts)))
    return target.join(theirs, on, "left_anti")


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    deletes: str = "apply",
    op: str = "Op",
    control: Sequence[str] = CONTROL_COLUMNS,
    on_duplicate: str = "error",
    newer_than: str | None = None,
    tie_break: Sequence[str | Column] = (),
    schema: str = "strict",
    deleted: DataFrame | None = None,
    matched: DataFrame | None = None,
) -> DataFrame:
    """The target after the changes of ``source``: matched keys replaced, new keys
    inserted, and keys whose change is a delete removed.

    - ``deletes="ignore"`` leaves rows alone whose change is a delete.
    - ``on_duplicate="error"`` fails if a key occurs twice in the source;
      ``"latest"`` takes the newest by ``newer_than``; ``"trust"`` skips the check
      when the caller has just selected one row per key.
    - ``newer_than`` names a version column: a source row older than the target's
      is ignored, so reading an overlap twice is harmless.  If the target repeats a
      key, copies older than the source row go in any case.
    - ``deleted`` has the keys and times (``newer_than``) of earlier deletes: a source row
      that is no newer than the delete of its key is ignored.
    - ``matched`` has the keys and times of all target rows whose key the source has, for
      callers that know them: the target is then read once.
    - ``schema="evolve"`` adds the source's new columns to the table and fills
      columns the source has lost with NULL.

    A NULL key matches nothing: such target rows stay, such source rows are added.
    """
    if on_duplicate == "latest":
        if newer_than is None:
            raise ValueError("on_duplicate='latest' needs newer_than")
        source = latest_changes(source, keys, newer_than, ties="one", tie_break=tie_break)
    elif on_duplicate == "error":
        require_unique(source, keys)
    if deletes == "ignore" and op in source.columns:
        source = source.where(F.coalesce(F.col(op), F.lit(INSERT)) != DELETE)
    if deleted is not None:
        if newer_than is None:
            raise ValueError("deleted needs newer_than")
        source = _not_deleted(source, deleted, keys, newer_than, op)
    kept = _kept(target, source, keys, newer_than)
    fresh = source if newer_than is None else _not_stale(target, source, keys, newer_than, matched)
    if op in fresh.columns:
        upserts, _ = split_changes(fresh, op, [op, *control])
    else:
        upserts = fresh.drop(*control)
    upserts = _aligned(target, upserts, schema)
    return union_by_name(kept, upserts, allow_missing=schema == "evolve")


def key_facts(
    source: DataFrame, keys: Sequence[str], op: str | None = None, ts: str | None = None, repeats: bool = True
) -> dict:
    """Smallest and largest first key of a batch, and a repeated key if there is one; with
    ``op`` whether it has deletes, with ``ts`` its first and last time.  One job.
    ``repeats=False`` does not look for repeated keys, and groups nothing."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    gone = F.coalesce(F.col(op) == DELETE, F.lit(False)) if op in source.columns else F.lit(False)
    time = F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")
    if repeats:
        per_key = source.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.max(gone).alias("_gone"), F.min(time).alias("_since"), F.max(time).alias("_until")
        )
        repeated = F.min(F.when(known & (F.col("_n") > 1), F.to_json(F.struct(*keys))))
    else:
        per_key = source.select(*keys, gone.alias("_gone"), time.alias("_since"), time.alias("_until"))
        repeated = F.lit(None).cast("string")
    row = per_key.agg(
        F.min(keys[0]).alias("low"),
        F.max(keys[0]).alias("high"),
        repeated.alias("repeated"),
        F.coalesce(F.max("_gone"), F.lit(False)).alias("deletes"),
        F.min("_since").alias("since"),
        F.max("_until").alias("until"),
    ).head()
    return {**row.asDict(), "type": source.schema[keys[0]].dataType}


def refuse_repeats(facts: dict) -> None:
    if facts["repeated"] is not None:
        raise DuplicateKeys(f"merge source has several rows for {facts['repeated']}")


def in_key_range(target: DataFrame, facts: dict, key: str) -> DataFrame:
    """Target rows whose key lies between the batch's smallest and largest (see
    ``key_facts``).

    The bounds are plain values, so the scan skips row groups by their statistics:
    where keys grow with time, a batch of recent changes reads the recent part of a
    table only.
    """
    if not isinstance(facts["type"], _RANGED):
        return target
    if facts["low"] is None:
        return target.where(F.lit(False))
    return target.where(F.col(key).between(facts["low"], facts["high"]))


def touched_partitions(
    target: DataFrame, source: DataFrame, keys: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Partitions a merge changes: those that hold a matched row now, and those the
    source's rows belong to.  An update may move a row from one to another.

    Reads key and partition columns of the target only.
    """
    holding = target.select(*keys, *(b for b in by if b not in keys))
    holding = holding.join(source.select(*keys), list(keys), "left_semi").select(*by)
    return union_by_name(holding, source.select(*by)).distinct()


def without_partitions(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows left after the source dropped the partitions that satisfy a predicate."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.where(~F.coalesce(condition, F.lit(False)))
