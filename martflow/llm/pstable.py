"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on random Gaussian directions; each projection, shifted
and divided by ``QUANTUM``, is rounded down, and ``PROJECTIONS`` of them together are a
bucket of one of ``TABLES`` tables.  Vectors of a bucket are compared exactly, in blocks
of at most ``2 * BLOCK``, so a bucket of any size is many tasks.  A pair counts only in
the first table that brings it together, so no list of pairs is needed to count links.

A pair of cosine 0.95 is found with probability 0.988, one of 0.98 with 0.999995.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; equal vectors are one class and link with each other; vectors of different
lengths are compared as if the shorter were filled with zeros; a null ``vec_id`` counts
as smaller than any other; rows that repeat a ``vec_id`` count each; an empty table
gives no row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import staged, tasks
from martflow.llm.graph import components, fewer
from martflow.llm.ngram import forest
from martflow.llm.vectors import LOWEST, clean, matrix
from martflow.llm.words import mix
from martflow.session import plan_unions_safely

TABLES, PROJECTIONS, QUANTUM = 48, 18, 2.0
BLOCK = 1024


def directions(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions and shifts; the first components of a direction do not depend
    on the width."""
    n = TABLES * PROJECTIONS
    draw = [np.random.Generator(np.random.PCG64([17, i])).standard_normal(n) for i in range(width)]
    shift = np.random.Generator(np.random.PCG64(18)).uniform(0, QUANTUM, n)
    return np.array(draw), shift


def table_hashes(unit: np.ndarray) -> np.ndarray:
    """The bucket of each vector (rows of length one) in each table."""
    axes, shift = _cached(unit.shape[1])
    cells = np.floor((unit @ axes + shift) / QUANTUM).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, PROJECTIONS)
    out = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), (len(unit), TABLES)).copy()
    for k in range(PROJECTIONS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return out.view(np.int64)


_AXES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _cached(width: int):
    if width not in _AXES:
        _AXES[width] = directions(width)
    return _AXES[width]


def unit_rows(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    x = np.divide(x, scale, out=np.zeros_like(x), where=scale > 0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = table_hashes(unit_rows(matrix(part.column("_vec").to_pylist())))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.tolist(), type=pa.list_(pa.int64()))], names=[*part.schema.names, "_tables"])


def _nonzero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [b if b is not None and np.frombuffer(b).any() else None for b in batch.column("_vec").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(blobs, type=pa.binary())], names=["_id", "_vec"])


def near(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links`` (other vectors linked),
    ``component_id`` (smallest ``vec_id`` reachable by links), ``kept`` (whether that is
    its own) and ``class_id`` (smallest ``vec_id`` of the same vector)."""
    plan_unions_safely(vectors.sparkSession)
    rows = staged(clean(vectors).mapInArrow(_nonzero, "_id long, _vec binary"), "vectors")
    classes = staged(
        rows.where(F.col("_vec").isNotNull())
        .groupBy("_vec")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_node", F.monotonically_increasing_id()),
        "classes",
    )
    hashed = staged(
        classes.mapInArrow(_hash, "_vec binary, _first long, _rows long, _node long, _tables array<long>"), "hashed"
    )
    slots = hashed.select("_node", F.posexplode("_tables").alias("_table", "_bucket"))
    buckets = staged(
        slots.groupBy("_bucket")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_bucket", "_blocks"),
        "buckets",
    )
    shared = staged(slots.join(buckets, "_bucket"), "slots")  # vectors alone in a bucket stay out
    sent = (
        shared.join(hashed.select("_node", "_vec", "_rows", "_tables"), "_node")
        .withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "_bucket", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "_table", "_node", "_vec", "_rows", "_tables"
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; the last of a batch may go on in the next."""
        out: list[tuple] = []
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            a, n, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(b)], names=["_a", "_n", "_b"])

        def groups(table: pa.Table, last: bool) -> pa.Table:
            keys = [table.column(c).to_numpy() for c in ("_bucket", "_low", "_high")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *cuts.tolist(), *([table.num_rows] if last else [])]
            unit = unit_rows(matrix(table.column("_vec").to_pylist()))
            tables = np.array(table.column("_tables").to_pylist(), dtype=np.int64)
            which, node, weight, block = (table.column(c).to_numpy() for c in ("_table", "_node", "_rows", "_block"))
            for s, e in zip(edges, edges[1:], strict=False):
                if e - s > 1:
                    out.append(_links(unit[s:e], tables[s:e], int(which[s]), node[s:e], weight[s:e], block[s:e], keys[1][s] != keys[2][s], threshold))
            return table.slice(edges[-1])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held.append(batch.slice(at, 4096))
                held = groups(pa.Table.from_batches(held), False).to_batches()
                yield told()
        if held:
            groups(pa.Table.from_batches(held), True)
            yield told()

    keys = ("_bucket", "_low", "_high")
    found = staged(
        sent.repartition(tasks(vectors.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(compare, "_a long, _n long, _b long"), "found"
    )
    counts = found.groupBy(F.col("_a").alias("_node")).agg(F.sum("_n").alias("_n"))
    roots = components(fewer(found.where("_a != _b")), "links")
    names = staged(
        roots.join(classes.select("_node", "_first"), "_node").groupBy("_root").agg(F.min("_first").alias("_component")), "names"
    )
    linked = staged(counts.join(roots, "_node").join(names, "_root").select(F.col("_node").alias("_linked"), "_n", "_component"), "linked")
    per_class = staged(
        classes.join(linked, F.col("_node") == F.col("_linked"), "left").select(
            F.col("_vec").alias("_class"), "_first", (F.coalesce("_n", F.lit(0)) + F.col("_rows") - 1).alias("_n"), F.coalesce("_component", F.col("_first")).alias("_component")
        ),
        "per_class",
    )
    null_or = lambda c: F.when(c != LOWEST, c)
    component = F.coalesce("_component", F.col("_id"))
    return rows.join(per_class, F.col("_vec") == F.col("_class"), "left").select(
        null_or(F.col("_id")).alias("vec_id"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        null_or(component).alias("component_id"),
        (F.col("_id") == component).alias("kept"),
        null_or(F.coalesce("_first", F.col("_id"))).alias("class_id"),
    )


def _links(unit, tables, table: int, node, weight, block, across: bool, threshold: float):
    """Link counts and a spanning forest of one group."""
    cosine = unit @ unit.T
    hit = np.triu(cosine >= threshold, 1)
    if across:
        hit &= block[:, None] != block[None, :]
    a, b = np.nonzero(hit)
    new = np.ones(len(a), dtype=bool)
    for t in range(table):  # an earlier table has had the pair
        new &= tables[a, t] != tables[b, t]
    a, b = a[new], b[new]
    count = np.zeros(len(node), dtype=np.int64)
    np.add.at(count, a, weight[b])
    np.add.at(count, b, weight[a])
    root = forest(len(node), np.stack((a, b), axis=1))
    some = count > 0
    return node[some], count[some], node[root[some]]
