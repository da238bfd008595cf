from martflow.streaming.once import add_once, lines_once
from martflow.streaming.sinks import (
    compact_routed,
    hourly_rows,
    route_to_tables,
    routed_table,
    sink_hourly,
)
from martflow.streaming.sources import (
    kafka_available,
    scan_new_files,
    stream_changes,
    stream_text,
    stream_topic,
    topic_rows,
)
from martflow.streaming.upsert import malformed_lines, merge_batches, stream_access_log, stream_upsert, timed_lines

__all__ = [
    "add_once",
    "compact_routed",
    "hourly_rows",
    "kafka_available",
    "lines_once",
    "malformed_lines",
    "merge_batches",
    "route_to_tables",
    "routed_table",
    "scan_new_files",
    "sink_hourly",
    "stream_access_log",
    "stream_changes",
    "stream_text",
    "stream_topic",
    "stream_upsert",
    "timed_lines",
    "topic_rows",
]
