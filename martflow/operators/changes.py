"""Change-data operators: latest change per key, thresholds, counts, splits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from martflow.operators.relational import semi_join_max

# Operation codes and control columns.
INSERT, UPDATE, DELETE = "I", "U", "D"
CONTROL_COLUMNS = ("Op", "dms_update_time")
# Envelope operation codes of a change stream.
ENVELOPE_OPS = {"c": INSERT, "r": INSERT, "u": UPDATE, "d": DELETE}


def since_threshold(
    bookmark: datetime | None, overlap: timedelta = timedelta(0)
) -> datetime | None:
    """Where to start reading: the bookmark less an overlap for late rows; None, from the
    beginning, when nothing was read yet."""
    return None if bookmark is None else bookmark - overlap


def changed_since(ts: Column | str, threshold: datetime, inclusive: bool = True) -> Column:
    """Predicate ``ts >= threshold`` (or ``>``)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    t = F.lit(threshold.isoformat(sep=" ")).cast("timestamp_ntz")
    return c >= t if inclusive else c > t


def _known(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def latest_changes(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    since: datetime | None = None,
    ties: str = "keep",
    tie_break: Sequence[str | Column] = (),
    inclusive: bool = True,
    method: str = "join",
) -> DataFrame:
    """The newest row or rows of every key.

    Rows with a NULL key or time never qualify.  ``since`` is applied before the
    selection, which gives the same rows as applying it to the maximum only (a
    key with any row past the threshold has its maximum past it too), and lets
    the scan use the filter.

    ``ties="keep"`` returns all rows that share the newest time.  By default
    through a semi-join, which survives a key, or a tie, that holds much of the
    data (see ``semi_join_max``).  ``method="rank"`` ranks in one scan and one
    exchange instead, and is for tables whose ties are known to be few.

    ``ties="one"`` returns exactly one row per key.  Each task keeps one
    candidate per key before the exchange, so a hot key costs one row per task.
    ``tie_break`` orders rows of equal time: a name means "largest first".
    Without it, all other columns are used, so a re-run picks the same row.
    """
    rows = df.where(_known([*keys, ts]))
    if since is not None:
        rows = rows.where(changed_since(ts, since, inclusive))
    newest = F.col(ts).desc()
    if ties == "keep" and method == "join":
        return semi_join_max(rows, keys, ts)
    if ties == "keep" and method == "rank":
        window = Window.partitionBy(*keys).orderBy(newest)
        return rows.withColumn("_rank", F.rank().over(window)).where("_rank = 1").drop("_rank")
    if ties != "one":
        raise ValueError(f"ties must be 'keep' or 'one', method 'join' or 'rank': {ties}, {method}")
    breakers = list(tie_break) or [c for c in df.columns if c not in {*keys, ts}]
    order = [F.col(c).desc() if isinstance(c, str) else c for c in breakers]
    window = Window.partitionBy(*keys).orderBy(newest, *order)
    return rows.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")


def change_counts(df: DataFrame, op: str = "Op") -> DataFrame:
    """One row: inserted, updated, deleted and total.  One pass."""
    return df.agg(
        F.count_if(F.col(op) == INSERT).alias("inserted"),
        F.count_if(F.col(op) == UPDATE).alias("updated"),
        F.count_if(F.col(op) == DELETE).alias("deleted"),
        F.count(F.lit(1)).alias("total"),
    )


def split_changes(
    df: DataFrame, op: str = "Op", drop: Sequence[str] = CONTROL_COLUMNS
) -> tuple[DataFrame, DataFrame]:
    """``(upserts, deletes)`` without the control columns.

    A row with no operation comes from an initial load and counts as an insert.
    Select the latest change per key *before* splitting: a delete hidden by an
    earlier filter would bring its row back.
    """
    code = F.coalesce(F.col(op), F.lit(INSERT))
    return df.where(code != DELETE).drop(*drop), df.where(code == DELETE).drop(*drop)


def duplicate_keys(df: DataFrame, keys: Sequence[str], count: str = "n_rows") -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def ts_range(df: DataFrame, ts: str) -> DataFrame:
    """One row: smallest and largest version time."""
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def unwrap_envelope(
    df: DataFrame, value: str, row_schema: str, op: str = "Op", keep: Sequence[str] = ()
) -> DataFrame:
    """Rows of a change envelope (``before``, ``after``, ``op``, ``ts_ms``).

    The row is the after-image, or for a delete the before-image.
    """
    schema = f"before struct<{row_schema}>, after struct<{row_schema}>, op string, ts_ms bigint"
    parsed = df.select(*keep, F.from_json(value, schema).alias("_e"))
    codes = F.create_map(*(F.lit(x) for pair in ENVELOPE_OPS.items() for x in pair))
    image = F.coalesce("_e.after", "_e.before")
    return (
        parsed.withColumn("_row", image)
        .where(F.col("_row").isNotNull())
        .select(
            *keep,
            "_row.*",
            F.try_element_at(codes, F.col("_e.op")).alias(op),
            F.expr(
                "timestampadd(MILLISECOND, _e.ts_ms, timestamp_ntz'1970-01-01 00:00:00')"
            ).alias("changed_at"),
        )
    )
