"""Table checks.  Each returns one row: check, target, status, failures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from martflow.operators.changes import duplicate_keys
from martflow.operators.relational import union_frames

COLUMNS = ("check", "target", "status", "failures")


def _row(name: str, target: str, status: Column, failures: Column) -> list[Column]:
    return [
        F.lit(name).alias("check"),
        F.lit(target).alias("target"),
        status.alias("status"),
        failures.cast("long").alias("failures"),
    ]


def _pass_if_none(failures: Column) -> Column:
    return F.when(failures == 0, F.lit("pass")).otherwise(F.lit("error"))


def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Number of values that occur more than once; NULLs are not counted."""
    found = duplicate_keys(df.where(F.col(col).isNotNull()), [col]).agg(
        F.count(F.lit(1)).alias("n")
    )
    return found.select(*_row("unique", col, _pass_if_none(F.col("n")), F.col("n")))


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    """Number of NULLs."""
    found = df.agg(F.count_if(F.col(col).isNull()).alias("n"))
    return found.select(*_row("not_null", col, _pass_if_none(F.col("n")), F.col("n")))


def check_not_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``check_not_null`` of several columns in one pass: one row for each."""
    counts = [
        F.struct(F.lit(c).alias("target"), F.count_if(F.col(c).isNull()).alias("n")) for c in columns
    ]
    found = df.agg(F.array(*counts).alias("_found")).select(F.inline("_found"))
    return found.select(
        F.lit("not_null").alias("check"),
        "target",
        _pass_if_none(F.col("n")).alias("status"),
        F.col("n").cast("long").alias("failures"),
    )


def check_freshness(
    df: DataFrame,
    ts: str,
    now: datetime,
    warn: timedelta = timedelta(hours=1),
    error: timedelta = timedelta(hours=24),
) -> DataFrame:
    """Age of the newest row against two limits; ``failures`` is the age in seconds.
    An empty table has no newest row and is an error."""
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", F.max(F.col(ts).cast("timestamp_ntz")), at)
    found = df.agg(age.alias("age"))
    status = (
        F.when(F.col("age").isNull() | (F.col("age") > error.total_seconds()), F.lit("error"))
        .when(F.col("age") > warn.total_seconds(), F.lit("warn"))
        .otherwise(F.lit("pass"))
    )
    return found.select(*_row("freshness", ts, status, F.col("age")))


def check_columns(df: DataFrame, declared: Sequence[str]) -> DataFrame:
    """Declared columns that the table lacks.  Reads no data."""
    missing = [c for c in declared if c not in df.columns]
    one = df.sparkSession.range(1)
    status = F.lit("error" if missing else "pass")
    return one.select(*_row("columns", ",".join(missing), status, F.lit(len(missing))))


def run_checks(checks: Sequence[DataFrame]) -> DataFrame:
    """All results as one table."""
    return union_frames(checks)


def assert_checks(checks: Sequence[DataFrame]) -> None:
    """Raise if any check has status ``error``.  The table has one row per check."""
    failed = run_checks(checks).where("status = 'error'").collect()
    if failed:
        detail = "; ".join(f"{r['check']}({r['target']}): {r['failures']}" for r in failed)
        raise AssertionError(f"table checks failed: {detail}")
