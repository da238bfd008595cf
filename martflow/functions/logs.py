"""Access-log lines to typed columns.

``service`` is the path up to its query string, so a request without ``?`` has
an empty service.  A field that does not match is an empty text, or NULL when it
is a number: Spark's ANSI mode would raise on ``cast('' as int)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from martflow.functions.times import with_partitions

LOG_LINE_SCHEMA = "`@timestamp` double, log string"

# The patterns that define each field of a line.
LOG_PATTERNS = {
    "timestamp": r"\|([^\|]+)\|",
    "ip_address": r"\|\s(\d+\.\d+\.\d+\.\d+)\s-\s-\s",
    "http_method": r"\"(GET|POST|PUT|DELETE)\s",
    "service": r"\"[A-Z]+\s/([^\s]+)\?",
    "endpoint": r"\"[A-Z]+\s(/[^\s]+)\s",
    "protocol": r"\"[A-Z]+\s/[^\s]+\s(HTTP/\d\.\d)\"",
    "status_code": r"\s(\d{3})\s",
    "response_size": r"\s(\d+)$",
}
# Numeric fields, and the ids carried in a request's query string.
NUMERIC_FIELDS = ("status_code", "response_size")
QUERY_IDS = ("product_id", "customer_id", "order_id")
# Column order of the parsed table.
LOG_COLUMNS = (
    "timestamp",
    "ip_address",
    "http_method",
    "endpoint",
    "service",
    "protocol",
    "status_code",
    "response_size",
    "product_id",
    "customer_id",
    "order_id",
)


def _number(text: Column, type_: str = "bigint") -> Column:
    """Text to a number.  Empty text, the usual case, is made NULL first: a failing
    cast costs an exception per row."""
    return F.nullif(text, F.lit("")).try_cast(type_)


def query_params(
    url: Column | str, names: Sequence[str] = QUERY_IDS, type_: str = "bigint", anchored: bool = True
) -> dict[str, Column]:
    """Numeric query-string parameters of a URL, one column per name.

    ``anchored`` requires ``?`` or ``&`` in front, so ``xproduct_id=7`` is not a
    ``product_id``; switch it off for the loose match.
    """
    u = F.col(url) if isinstance(url, str) else url
    lead = "[?&]" if anchored else ""
    return {
        name: _number(F.regexp_extract(u, rf"{lead}{name}=(\d+)", 1), type_) for name in names
    }


def parse_access_log(
    lines: DataFrame,
    col: str = "log",
    keep: Sequence[str] = (),
    anchored: bool = True,
    partitions: bool = True,
) -> DataFrame:
    """Parse one line per row.  ``keep`` passes further input columns through.

    The timestamp stays text, as logged; ``year, month, day, hour`` come from it
    and are NULL for a malformed line.  Unused fields cost nothing: Catalyst
    prunes their extraction.
    """
    fields = {
        name: F.regexp_extract(F.col(col), pattern, 1) for name, pattern in LOG_PATTERNS.items()
    }
    for name in NUMERIC_FIELDS:
        fields[name] = _number(fields[name])
    parsed = lines.select(*keep, *(c.alias(name) for name, c in fields.items()))
    parsed = parsed.withColumns(query_params("endpoint", anchored=anchored))
    parsed = parsed.select(*keep, *LOG_COLUMNS)
    return with_partitions(parsed, "timestamp", "hour") if partitions else parsed

