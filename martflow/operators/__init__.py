from martflow.operators.changes import (
    change_counts,
    changed_since,
    duplicate_keys,
    latest_changes,
    since_threshold,
    split_changes,
    ts_range,
    unwrap_envelope,
)
from martflow.operators.checks import (
    assert_checks,
    check_columns,
    check_freshness,
    check_not_null,
    check_not_nulls,
    check_unique,
    run_checks,
)
from martflow.operators.merge import merge, touched_partitions, without_partitions
from martflow.operators.relational import (
    cast_columns,
    join_on_shifted_day,
    join_single_value,
    project_public,
    rename_columns,
    semi_join_max,
    union_frames,
)
from martflow.operators.skew import frequent_keys, skewed_join

__all__ = [
    "assert_checks",
    "cast_columns",
    "change_counts",
    "changed_since",
    "check_columns",
    "check_freshness",
    "check_not_null",
    "check_not_nulls",
    "check_unique",
    "duplicate_keys",
    "frequent_keys",
    "join_on_shifted_day",
    "join_single_value",
    "latest_changes",
    "merge",
    "project_public",
    "rename_columns",
    "run_checks",
    "semi_join_max",
    "since_threshold",
    "skewed_join",
    "split_changes",
    "touched_partitions",
    "ts_range",
    "union_frames",
    "unwrap_envelope",
    "without_partitions",
]
