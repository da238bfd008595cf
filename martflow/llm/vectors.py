"""Vectors as bytes, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWEST = -(1 << 63)


def clean(df: DataFrame, grid: int | None = None) -> DataFrame:
    """``(_id, _vec)`` of every row of ``vec_id, embedding``: the components as
    little-endian doubles, or null if the vector is null, empty or has null or
    non-finite components.  ``grid``: components become ``floor(grid * x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("_e"):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    if grid is not None:
                        x = np.floor(grid * x)
                    x = (x + 0.0).tobytes() if np.isfinite(x).all() else None  # no negative zeros
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, type=pa.binary())], names=["_id", "_vec"])

    return df.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LOWEST)).alias("_id"), F.col("embedding").cast("array<double>").alias("_e")
    ).mapInArrow(run, "_id long, _vec binary")


def matrix(blobs: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    if not blobs:
        return np.zeros((0, 1))
    width = max(len(b) for b in blobs) // 8
    out = np.zeros((len(blobs), width))
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // 8] = np.frombuffer(b, dtype="<f8")
    return out


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
