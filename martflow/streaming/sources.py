"""Streaming sources: new files, log directories, topics, change streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from martflow.functions.values import json_value
from martflow.operators.changes import unwrap_envelope

# Columns of a topic row; the value comes parsed, as ``data``.
TOPIC_COLUMNS = {
    "kafka_partition": "partition",
    "kafka_offset": "offset",
    "kafka_timestamp_type": "timestampType",
    "kafka_timestamp": "timestamp",
    "kafka_key": "key",
    "kafka_headers": "headers",
}


def scan_new_files(
    spark: SparkSession,
    root: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    schema: StructType | str,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Process the files under ``root`` (recursively) that no earlier run has seen.

    The checkpoint remembers files; it advances when ``handle(batch, batch_id)``
    returns.  The call ends when nothing is left.  ``max_files`` bounds one batch,
    so a large backlog is worked off in steps.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        reader.load(root)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_text(
    spark: SparkSession, directory: str, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Lines of the files of a log directory, with arrival time, as they appear."""
    reader = spark.readStream
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(directory).select(
        F.col("value").alias("log"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def kafka_available(spark: SparkSession) -> bool:
    """True if the Kafka connector is on the class path."""
    try:
        spark._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.kafka010.KafkaSourceProvider",
            False,
            spark._jvm.java.lang.Thread.currentThread().getContextClassLoader(),
        )
    except Exception:
        return False
    return True


def topic_rows(rows: DataFrame) -> DataFrame:
    """Topic rows with the value parsed as semi-structured data.

    Works on any frame with the connector's columns (``topic`` is kept if there).
    Malformed values give NULL.
    """
    names = [F.col(c).alias(n) for n, c in TOPIC_COLUMNS.items() if c in rows.columns]
    topic = ["topic"] if "topic" in rows.columns else []
    return rows.select(*topic, *names, json_value(F.col("value").cast("string")).alias("data"))


def stream_topic(
    spark: SparkSession, servers: str, topics: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """Subscribe to topics (a comma list, or a pattern when it holds ``*``)."""
    if not kafka_available(spark):
        raise RuntimeError("the Kafka connector is not on the class path")
    how = "subscribePattern" if "*" in topics else "subscribe"
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option(how, topics).option("includeHeaders", "true")
    return reader.options(**(options or {})).load()


def stream_changes(stream: DataFrame, row_schema: str, value: str = "value") -> DataFrame:
    """Rows of a change stream: the after-image (before-image of a delete), the
    operation and the change time.  Snapshot rows of the stream count as inserts."""
    text = stream.withColumn(value, F.col(value).cast("string"))
    return unwrap_envelope(text, value, row_schema)
