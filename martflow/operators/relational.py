"""Small relational steps shared by the marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from martflow.session import plan_unions_safely

# Account columns that never leave the staging layer.
SENSITIVE = ("password", "is_superuser", "is_staff")


def project_public(
    df: DataFrame, deny: Sequence[str] = SENSITIVE, mask: Sequence[str] = ()
) -> DataFrame:
    """Drop the columns in ``deny``; replace those in ``mask`` by a SHA-256 hash."""
    public = df.drop(*deny)
    return public.withColumns({c: F.sha2(F.col(c).cast("string"), 256) for c in mask})


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Select ``old -> new`` in the order given; columns not named are dropped."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not fit becomes NULL instead of an error."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def union_by_name(a: DataFrame, b: DataFrame, allow_missing: bool = False) -> DataFrame:
    """UNION ALL of two frames by column name."""
    plan_unions_safely(a.sparkSession)
    return a.unionByName(b, allowMissingColumns=allow_missing)


def in_types_of(df: DataFrame, target: DataFrame) -> DataFrame:
    """Cast the columns that both frames have to the target's types.  Without it a
    union would widen them, and files of one table would disagree."""
    types = {f.name: f.dataType for f in target.schema}
    differ = {
        f.name: F.col(f.name).cast(types[f.name])
        for f in df.schema
        if types.get(f.name, f.dataType) != f.dataType
    }
    return df.withColumns(differ) if differ else df


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column missing from one frame is NULL there.
    A union by position would silently swap columns whose order drifted."""
    return reduce(lambda a, b: union_by_name(a, b, allow_missing=True), frames)


def semi_join_max(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows whose ``(keys, ts)`` is in the grouped maximum.

    The maximum is combined map-side from the key and time columns alone.  The
    join is on keys *and* time: a key with many versions spreads over its times,
    and what is left, rows tied on both, is split by adaptive skew handling.
    When the grouped maximum turns out small, it is broadcast and the wide rows
    never move.
    """
    top = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(top, [*keys, ts], "left_semi").select(*df.columns)


def join_on_shifted_day(
    left: DataFrame,
    ts: str,
    days: DataFrame,
    day: str,
    shift: int = 1,
    flag: str = "is_flagged",
    hit: str = "yes",
    miss: str = "no",
) -> DataFrame:
    """Flag rows dated ``shift`` days after one of ``days``.

    A hash join on the shifted date.  The dates are made distinct first, so a
    repeated one does not multiply rows; being dates, they are few, and Spark
    broadcasts them when its size check agrees.
    """
    shifted = (
        days.select(F.date_add(F.col(day).cast("date"), shift).alias("_day"))
        .where(F.col("_day").isNotNull())
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    joined = left.withColumn("_day", F.col(ts).cast("date")).join(shifted, "_day", "left")
    label = F.when(F.col("_hit").isNull(), F.lit(miss)).otherwise(F.lit(hit))
    return joined.select(*left.columns, label.alias(flag))


def join_single_value(df: DataFrame, value: DataFrame) -> DataFrame:
    """Append a one-row aggregate to every row: a scalar subquery.

    ``value`` must be a global aggregate, so it has exactly one row.
    """
    scalars = [value.select(c).scalar().alias(c) for c in value.columns]
    return df.select("*", *scalars)
