from martflow.sources.bookmarks import Bookmarks
from martflow.sources.catalog import (
    describe_table,
    discover_table,
    register_external,
    scan_catalog,
    table,
)
from martflow.sources.files import (
    day_folders,
    describe_files,
    hours_between,
    local_clock,
    mark_processed,
    newest_day,
    newest_hour,
    oldest_hour,
    prune_hours,
    read_unprocessed,
    scan_csv,
    scan_days,
    scan_full,
    scan_hours,
    seed,
    unprocessed_files,
)
from martflow.sources.ledger import mark_files, next_files

__all__ = [
    "Bookmarks",
    "day_folders",
    "describe_files",
    "describe_table",
    "discover_table",
    "hours_between",
    "local_clock",
    "mark_files",
    "mark_processed",
    "newest_day",
    "newest_hour",
    "next_files",
    "oldest_hour",
    "prune_hours",
    "read_unprocessed",
    "register_external",
    "scan_catalog",
    "scan_csv",
    "scan_days",
    "scan_full",
    "scan_hours",
    "seed",
    "table",
    "unprocessed_files",
]
