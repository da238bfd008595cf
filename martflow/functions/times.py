"""Timestamps, partition columns and time zones.

Everything works on ``timestamp_ntz`` so that results do not depend on the
session time zone, and every parse is a *try*: bad text gives NULL.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

GRAINS = ("year", "month", "day", "hour")
_PART = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_timestamp(text: Column | str) -> Column:
    """ISO text (or a timestamp) to ``timestamp_ntz``; NULL when it does not parse."""
    return _col(text).try_cast("timestamp_ntz")


def day_of(ts: Column | str) -> Column:
    """Truncate to the day, as ``timestamp_ntz``.  ``date_trunc`` would go through the
    session's time zone and change the type."""
    return _col(ts).cast("date").cast("timestamp_ntz")


def with_partitions(df: DataFrame, ts: str, grain: str = "hour") -> DataFrame:
    """Add ``year, month, day, hour`` (up to ``grain``) from the event time."""
    wanted = GRAINS[: GRAINS.index(grain) + 1]
    stamp = as_timestamp(ts)
    return df.withColumns({name: _PART[name](stamp) for name in wanted})


def local_time(ts: Column | str, tz: str = "Asia/Seoul") -> Column:
    """Wall-clock time in ``tz`` of a UTC instant held as ``timestamp_ntz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts).cast("timestamp_ntz"))


def with_local_partitions(
    df: DataFrame, ts: str, tz: str = "Asia/Seoul", grain: str = "hour"
) -> DataFrame:
    """Partition columns of the local wall clock, as an hourly landing uses."""
    wanted = GRAINS[: GRAINS.index(grain) + 1]
    stamp = local_time(ts, tz)
    return df.withColumns({name: _PART[name](stamp) for name in wanted})


def with_applied_at(df: DataFrame, at: datetime, name: str = "last_applied_date") -> DataFrame:
    """Stamp every row with the run's time.  The time is an argument so that a
    repeated run gives the same rows."""
    return df.withColumn(name, F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"))
