from martflow.sinks.checked import check_stored, check_unique_anywhere
from martflow.sinks.locations import index_keys, rows_that_may_match
from martflow.sinks.merging import native_merge, reload, upsert_path
from martflow.sinks.reports import read_sorted, write_sorted
from martflow.sinks.tables import (
    create_table,
    drop_old_versions,
    drop_table,
    ensure_database,
    insert_into,
    layout,
    list_databases,
    list_tables,
    publish,
    temp_view,
    write_bucketed,
)
from martflow.sinks.writers import (
    cluster_for_write,
    compact,
    drop_partitions,
    replace_partitions,
    write_partitions,
)

__all__ = [
    "check_stored",
    "check_unique_anywhere",
    "cluster_for_write",
    "compact",
    "create_table",
    "drop_old_versions",
    "drop_partitions",
    "drop_table",
    "ensure_database",
    "index_keys",
    "insert_into",
    "layout",
    "list_databases",
    "list_tables",
    "native_merge",
    "publish",
    "read_sorted",
    "reload",
    "replace_partitions",
    "rows_that_may_match",
    "temp_view",
    "upsert_path",
    "write_bucketed",
    "write_partitions",
    "write_sorted",
]
