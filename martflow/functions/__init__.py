from martflow.functions.logs import LOG_LINE_SCHEMA, parse_access_log, query_params
from martflow.functions.times import (
    as_timestamp,
    day_of,
    local_time,
    with_applied_at,
    with_local_partitions,
    with_partitions,
)
from martflow.functions.values import (
    clean_price,
    fraction,
    full_name,
    json_field,
    json_value,
    non_zero,
    percent,
    route_name,
    text_date_part,
)

__all__ = [
    "LOG_LINE_SCHEMA",
    "as_timestamp",
    "clean_price",
    "day_of",
    "fraction",
    "full_name",
    "json_field",
    "json_value",
    "local_time",
    "non_zero",
    "parse_access_log",
    "percent",
    "query_params",
    "route_name",
    "text_date_part",
    "with_applied_at",
    "with_local_partitions",
    "with_partitions",
]
