"""Session set-up and the one shared folder every intermediate result goes to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"

# Defaults for a session this package starts itself.  A session that already
# exists keeps its own settings: nothing below is applied to it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    UNION_PARTITIONING: "false",
    # Streams keep their state on disk, not in the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # A lost executor must not fail the job.
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "10",
}


def build_session(app: str = "martflow", master: str | None = None, **conf) -> SparkSession:
    """Start (or get) a session.  Extra settings use ``__`` for dots:
    ``build_session(spark__sql__shuffle__partitions=8)``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def plan_unions_safely(spark: SparkSession) -> None:
    """Keep Spark from deriving a partitioning for unions.

    Spark 4.1 may plan a union of equally partitioned inputs as a zip of their
    tasks and then fail at run time, when adaptive execution has given them
    different numbers of tasks ("Can't zip RDDs with unequal numbers of
    partitions").  A merge is such a union.  Without the derived partitioning the
    rows are the same, and a later exchange may be needed.
    """
    if spark.conf.get(UNION_PARTITIONING, None) != "false":
        spark.conf.set(UNION_PARTITIONING, "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` wins, then a directory already set on the context.
    Only a local session (tests) may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="martflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder name under the shared folder."""
    return f"{shared_dir(spark)}/martflow/{label}-{uuid.uuid4().hex[:12]}"
