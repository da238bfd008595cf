"""A join that keeps frequent keys from filling one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from martflow.operators.relational import union_by_name

HOW = ("inner", "left", "left_semi", "left_anti")
_MOST_SALTS = 4_096


def _key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def frequent_keys(df: DataFrame, keys: Sequence[str], share: float = 0.002, tracked: int = 20_000) -> dict[int, float]:
    """Hashes of the keys that hold ``share`` of the rows or more, with their share.

    One pass with a sketch of ``tracked`` counters for each task, combined map-side; no
    key is shuffled.  At most ``1 / share`` hashes come to the driver.  A key that the sketch
    is wrong about is joined in the other way, with the same rows."""
    most = int(1 / share) + 1
    found = df.select(_key(keys).alias("_h")).agg(
        F.expr(f"approx_top_k(_h, {most}, {max(tracked, 4 * most)})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    ).head()
    least = max(share * found["n"], 1)
    return {t["item"]: t["count"] / found["n"] for t in found["top"] or [] if t["count"] >= least}


def skewed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    share: float | None = None,
    broadcast_rows: int = 100_000,
    frequent: dict[int, float] | None = None,
) -> DataFrame:
    """Join two frames of which the left has frequent keys.

    Rows of rare keys are joined as they lie: two tables bucketed by the keys need no
    exchange for it.  Rows of frequent keys are joined apart: if the right side has no more
    than ``broadcast_rows`` rows of them, counted first, they are broadcast and the left
    rows do not move; else each left row gets one of four salts for each task that its key's
    share is worth, and the right rows are repeated for each salt.

    ``share``: the part of all rows that makes a key frequent; by default half of what a
    task would get.  ``frequent``: the result of ``frequent_keys``, if it is known.
    A NULL key matches nothing, and NULLs are split like any frequent key.  The rows are
    those of a plain join on ``keys``; a left row meets its right rows in one place, so all
    types of ``HOW`` come out right, and others are refused, as are keys of two types.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    for k in keys:
        if left.schema[k].dataType != right.schema[k].dataType:
            raise TypeError(f"{k} has two types: {left.schema[k].dataType}, {right.schema[k].dataType}")
    keys = list(keys)
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if frequent is None:
        frequent = frequent_keys(left, keys, share or min(0.5, max(0.5 / tasks, 0.0005)))
    if not frequent:
        return left.join(right, keys, how)
    is_hot = _key(keys).isin(list(frequent))
    rare = left.where(~is_hot).join(right.where(~is_hot), keys, how)
    hot, theirs = left.where(is_hot), right.where(is_hot)
    if how in ("left_semi", "left_anti"):
        theirs = theirs.select(*keys).distinct()
    if theirs.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return union_by_name(rare, hot.join(F.broadcast(theirs), keys, how))
    # Salts worth a quarter of a task each, so that it matters little where they meet.
    salts = [(h, min(int(4 * part * tasks) + 1, _MOST_SALTS)) for h, part in frequent.items()]
    many = F.broadcast(spark.createDataFrame(salts, "_h long, _salts int"))  # 1 / share rows at most
    hashed = [f.name for f in left.schema if not isinstance(f.dataType, (MapType, VariantType))]
    hot = hot.withColumn("_h", _key(keys)).join(many, "_h")
    hot = hot.withColumn("_salt", F.pmod(F.xxhash64(F.lit(7), *hashed), F.col("_salts")).cast("int"))
    theirs = theirs.withColumn("_h", _key(keys)).join(many, "_h")
    theirs = theirs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    joined = hot.drop("_h", "_salts").join(theirs.drop("_h", "_salts"), [*keys, "_salt"], how)
    return union_by_name(rare, joined.drop("_salt"))
