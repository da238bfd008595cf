"""Staging, file access and copy classes shared by the operators of this folder."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.session import scratch_dir

# What must not enter a header line or a URL.
CONTROL = r"[\x00-\x1f\x7f]"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    and a lost executor costs nothing that was already written."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it, inside a task."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place, for files that tasks write themselves."""
    return scratch_dir(spark, label)


def fresh_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of a task can have.  Only the names that a
    finished attempt reports are ever read, so attempts that were lost do no harm."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def pick(columns, wanted: str) -> str:
    """A column name that is not taken yet."""
    name = wanted
    while name in columns:
        name = "_" + name
    return name


def copies(df: DataFrame, key, order: str, largest: bool = False, label: str = "copies") -> DataFrame:
    """The values of ``key`` that more than one row has: ``(_key, _first, _rows)``.

    ``_first`` is the smallest (or largest) ``order`` of the rows.  Counted map-side,
    so a key with a third of all rows is one row for each task before the shuffle.
    The result is written out, so that a join with it sees its true size and splits
    hot keys."""
    best = F.max(order) if largest else F.min(order)
    return staged(
        df.groupBy(key.alias("_key"))
        .agg(best.alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") > 1) & F.col("_key").isNotNull()),
        label,
    )


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def tasks(spark: SparkSession) -> int:
    """How many tasks to deal small rows with large work to.  A number that is given is
    kept; without one, adaptive execution sees small rows and makes one task of them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of ``pool[start:start + length]`` for all runs."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    shift = start - (np.cumsum(length) - length)
    return pool[np.repeat(shift, length) + np.arange(total)]


def bare_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")
