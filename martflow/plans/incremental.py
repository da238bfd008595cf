"""Incremental strategies of a model: append by high-water mark, merge by key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from martflow.operators.changes import changed_since
from martflow.operators.merge import SchemaMismatch, merge
from martflow.operators.relational import in_types_of

# Copies of a row that are made at a time.
_BLOCK = 4096


def incremental_append(
    target: DataFrame,
    source: DataFrame,
    ts: str,
    inclusive: bool = False,
    high: datetime | None = None,
) -> DataFrame:
    """Source rows newer than the target's newest row.

    Strictly newer: rows of the same instant count as seen, later rows of earlier times
    and rows without a time are left out; ``missing_rows`` is for sources that can have
    them.  ``inclusive=True`` lets the same instant in again, for a target that removes
    repeats.  An empty target has no newest row and admits everything.  ``high`` gives
    the newest time when a bookmark holds it: the target is not read then, and the filter
    reaches the source's scan.
    """
    if high is not None:
        return source.where(changed_since(ts, high, inclusive))
    mark = target.select(F.max(ts)).scalar()
    newer = F.col(ts) >= mark if inclusive else F.col(ts) > mark
    return source.where(newer | mark.isNull())


def missing_rows(
    target: DataFrame,
    source: DataFrame,
    ts: str | None = None,
    high: datetime | None = None,
    overlap: timedelta | None = None,
) -> DataFrame:
    """Source rows that the target does not have yet, whatever their time.

    A row that the source has three times and the target once is missing twice.  Columns
    that only the source has are not compared.  With ``high`` and ``overlap`` only rows
    from ``high - overlap`` on, and those without a time, are compared on both sides,
    and an earlier row is taken for stored.  Rows are counted map-side by their columns on
    both sides; a source that has more columns than the target numbers its equal rows in
    one task instead.
    """
    shared = [c for c in source.columns if c in target.columns]
    if ts is not None and high is not None and overlap is not None:
        recent = F.col(ts).isNull() | changed_since(ts, high - overlap)
        target, source = target.where(recent), source.where(recent)
    target = in_types_of(target.select(*shared), source)
    held = target.groupBy(*shared).agg(F.count(F.lit(1)).alias("_held"))
    extra = [c for c in source.columns if c not in shared]
    same = reduce(
        lambda a, b: a & b, (F.col(f"_t.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in shared)
    )
    if not extra:
        return _expanded(_counted(source), held, same, source.columns)
    # Equal rows are numbered, and as many as are held count as stored.
    number = Window.partitionBy(*shared).orderBy(*(F.col(c) for c in (extra or shared[:1])))
    numbered = source.withColumn("_number", F.row_number().over(number))
    joined = numbered.alias("_s").join(held.alias("_t"), same, "left")
    new = joined.where(F.col("_number") > F.coalesce("_held", F.lit(0)))
    return new.select(*(F.col(f"_s.{c}").alias(c) for c in source.columns))


def _counted(rows: DataFrame) -> DataFrame:
    """Distinct rows, their number ``_n``, and ``_upto``, the number of rows equal to them
    up to and with them: 0.0 and -0.0 are equal and yet two rows here."""
    own = rows.columns
    split = [f.name for f in rows.schema if any(t in f.dataType.simpleString() for t in ("float", "double"))]
    if not split:
        return rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.col("_n"))
    # Grouping makes one of both zeros, so the text tells them apart and a row's own is kept.
    written = [F.col(c).cast("string").alias(f"_text{i}") for i, c in enumerate(split)]
    kept = [F.first(c).alias(f"_own{i}") for i, c in enumerate(split)]
    counted = rows.groupBy(*own, *written).agg(F.count(F.lit(1)).alias("_n"), *kept)
    before = Window.partitionBy(*own).orderBy(*(f"_text{i}" for i in range(len(split))))
    counted = counted.withColumn("_upto", F.sum("_n").over(before))
    back = {c: F.col(f"_own{i}").alias(c) for i, c in enumerate(split)}
    return counted.select(*(back.get(c, F.col(c)) for c in own), "_n", "_upto")


def _expanded(counted: DataFrame, held: DataFrame, same: Column, columns: list[str]) -> DataFrame:
    """The rows of ``counted`` beyond those held, each as often as it is missing."""
    left = F.least(F.col("_n"), F.col("_upto") - F.coalesce("_held", F.lit(0)))
    missing = (
        counted.alias("_s")
        .join(held.alias("_t"), same, "left")
        .select(*(F.col(f"_s.{c}").alias(c) for c in columns), left.alias("_left"))
        .where(F.col("_left") > 0)
    )
    blocks = missing.select(
        "*", F.explode(F.expr(f"sequence(0L, (_left - 1) div {_BLOCK})")).alias("_block")
    )
    size = F.least(F.lit(_BLOCK).cast("long"), F.col("_left") - F.col("_block") * _BLOCK)
    rows = blocks.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_copy"))
    return rows.select(*columns)


def incremental_merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], **options
) -> DataFrame:
    """The target after the source's rows replaced or joined those of the same key.

    Only the target's columns are taken, so a first run that selected some columns
    and a later one that selects all agree.
    """
    control = [c for c in (options.get("op", "Op"),) if c in source.columns]
    columns = [c for c in target.columns if c in source.columns]
    return merge(target, source.select(*columns, *control), keys, **options)


def check_schema(existing: DataFrame, new: DataFrame, policy: str = "fail") -> DataFrame:
    """Apply a schema-change policy before writing ``new`` into ``existing``.

    ``fail`` raises on any difference of names or types, ``ignore`` keeps the
    existing columns, ``append`` also lets new columns in.
    """
    have = {f.name: f.dataType for f in existing.schema}
    want = {f.name: f.dataType for f in new.schema}
    if have == want:
        return new.select(*existing.columns)
    if policy == "fail":
        changed = sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))
        raise SchemaMismatch(f"schema changed: {changed}")
    if policy not in ("ignore", "append"):
        raise ValueError(f"unknown policy {policy}")
    kept = [
        (F.col(n).cast(t) if n in want else F.lit(None).cast(t)).alias(n) for n, t in have.items()
    ]
    extra = [n for n in want if n not in have] if policy == "append" else []
    return new.select(*kept, *extra)
