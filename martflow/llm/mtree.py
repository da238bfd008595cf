"""Exact top-k search by inner product with M-trees.

The largest inner product is the nearest neighbour after one more component is added:
``sqrt(M - |v|^2)`` for a candidate, with ``M`` the largest squared norm, and 0 for a
query.  There, candidates are put into metric trees: routing objects, under them roots of
at most ``CHUNK`` entries, and under those leaf pages of at most ``PAGE``.  Every page
stores its routing object, its covering radius and each entry's distance to the routing
object.

A block of queries searches a forest of roots best-first: each query takes its pages in
order of the smallest distance they can hold and ends at the first that cannot beat its
k-th best.  In a page, an entry is left out if the difference of its stored distance and
the query's own already exceeds that.  All bounds allow for rounding; scores are whole
numbers.

Cases: vectors that are null, empty or hold null or non-finite components take no part;
shorter vectors count as filled with zeros; a null ``vec_id`` takes no part; of rows that
repeat a ``vec_id`` one counts (the smallest as bytes); fewer candidates than ``k`` are
all returned; an empty table gives no row.  Scaled components and scores must stay
below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martflow.llm.common import staged
from martflow.llm.vectors import LOWEST, clean, matrix, padded

ROUTERS = 16
CHUNK = 2048
PAGE = 128
FOREST = 8  # roots of a forest
QUERIES = 1024  # of a block
_SLACK = 1e-7


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Candidates with the component that makes all norms equal."""
    return np.concatenate((x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]), axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def pages(points: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Split points into pages of neighbours: entry numbers and the routing object's.
    A part that is too large is halved by distance to two of its points that lie far
    apart, so equal points do not stop it."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) > PAGE:
            x = points[own]
            a = int(np.argmax(((x - x[0]) ** 2).sum(axis=1)))
            b = int(np.argmax(((x - x[a]) ** 2).sum(axis=1)))
            side = ((x - x[a]) ** 2).sum(axis=1) - ((x - x[b]) ** 2).sum(axis=1)
            order = np.argsort(side, kind="stable")
            todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        else:
            centre = points[own].mean(axis=0)
            done.append((own, int(own[np.argmin(((points[own] - centre) ** 2).sum(axis=1))])))
    return done


class Best:
    """The ``k`` best candidates of each query so far: highest score, then smallest id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """``scores``: one row for each of ``rows``, one column for each of ``ids``."""
        better = allowed & (scores >= self.score[rows, -1][:, None])
        q, c = np.nonzero(better)
        if not len(q):
            return
        hit, at = np.unique(q, return_inverse=True)
        own = np.repeat(np.arange(len(hit)), self.k)
        row = np.concatenate((own, at))
        score = np.concatenate((self.score[rows[hit]].ravel(), scores[q, c]))
        ident = np.concatenate((self.id[rows[hit]].ravel(), ids[c]))
        order = np.lexsort((ident, -score, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], np.arange(len(hit)))[row[order]]
        kept = order[place < self.k]
        self.score[rows[hit]] = score[kept].reshape(len(hit), self.k)
        self.id[rows[hit]] = ident[kept].reshape(len(hit), self.k)


def search(query_ids: np.ndarray, queries: np.ndarray, leaves: list[dict], top: float, k: int) -> tuple[Best, int]:
    """Best-first search of all queries in the pages; also the number of distances
    computed to entries."""
    best, computed = Best(len(queries), k), 0
    if not leaves:
        return best, computed
    points = np.pad(queries, ((0, 0), (0, 1)))
    square = (queries * queries).sum(axis=1) + top
    to_router = distances(points, np.stack([p["router"] for p in leaves]))
    radius = np.array([p["radius"] for p in leaves])
    root_distance = np.array([p["root_distance"] for p in leaves])
    # The page's own bound, and the one by way of its root, that needs no distance to it.
    roots, root_of = np.unique(np.array([p["root"] for p in leaves]), return_inverse=True)
    first = [int(np.argmax(root_of == i)) for i in range(len(roots))]
    to_root = distances(points, np.stack([leaves[i]["root_router"] for i in first]))[:, root_of]
    least = np.maximum(to_router - radius, np.abs(to_root - root_distance) - radius)
    order = np.argsort(least, axis=1, kind="stable")
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        page_of = order[active, step]
        # Smaller distance than the k-th best: higher score than its.
        limit = np.sqrt(np.maximum(square[active] - 2 * best.score[active, -1], 0))
        limit = limit * (1 + _SLACK) + _SLACK
        on = least[active, page_of] <= limit
        active, page_of, limit = active[on], page_of[on], limit[on]
        if not len(active):
            break
        by_page = np.argsort(page_of, kind="stable")
        for part in np.split(by_page, np.flatnonzero(np.diff(page_of[by_page])) + 1):
            page, rows = leaves[page_of[part[0]]], active[part]
            need = np.abs(to_router[rows, page_of[part[0]]][:, None] - page["distances"][None, :]) <= limit[part][:, None]
            columns = np.flatnonzero(need.any(axis=0))
            if not len(columns):
                continue
            computed += len(rows) * len(columns)
            scores = queries[rows] @ page["entries"][columns].T
            ids = page["ids"][columns]
            best.offer(rows, scores, ids, need[:, columns] & (ids[None, :] != query_ids[rows][:, None]))
    return best, computed


_PAGE_TYPE = "_forest int, _root int, _root_router binary, _root_distance double, _router binary, _radius double, _ids binary, _entries binary, _distances binary"


def build(candidates: DataFrame, top: float) -> DataFrame:
    """The pages of all trees, written out: one row for each leaf page."""
    spark = candidates.sparkSession
    routers = matrix(
        [bytes(r["_vec"]) for r in candidates.orderBy(F.xxhash64("_id"), "_id").limit(ROUTERS).collect()]  # at most ROUTERS rows
    )
    shared = spark.sparkContext.broadcast(lifted(routers, top))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = lifted(matrix(batch.column("_vec").to_pylist()), top)
                cell = distances(*_same_width(x, shared.value)).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "_cell"])

    placed = staged(candidates.mapInArrow(assign, "_id long, _vec binary, _cell int"), "placed")
    sizes = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ROUTERS rows
    chunks = {cell: -(-n // CHUNK) for cell, n in sorted(sizes.items())}
    base, choice = 0, F.lit(0)
    for cell, n in chunks.items():  # a large cell is dealt to several roots
        choice = F.when(F.col("_cell") == cell, F.lit(base) + F.pmod(F.xxhash64("_id"), F.lit(n))).otherwise(choice)
        base += n

    def make(rows: pa.Table) -> pa.Table:
        root = rows.column("_root")[0].as_py()
        ids, x = rows.column("_id").to_numpy(), matrix(rows.column("_vec").to_pylist())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        points = lifted(x, top)
        centre = points[np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
        out = []
        for own, router in pages(points):
            d = np.sqrt(((points[own] - points[router]) ** 2).sum(axis=1))
            out.append(
                {
                    "_forest": root // FOREST,
                    "_root": root,
                    "_root_router": centre.tobytes(),
                    "_root_distance": float(np.sqrt(((centre - points[router]) ** 2).sum())),
                    "_router": points[router].tobytes(),
                    "_radius": float(d.max()),
                    "_ids": ids[own].tobytes(),
                    "_entries": x[own].tobytes(),
                    "_distances": d.tobytes(),
                }
            )
        return pa.Table.from_pylist(out, schema=_PAGES)

    return staged(placed.withColumn("_root", choice.cast("int")).groupBy("_root").applyInArrow(make, _PAGE_TYPE), "pages")


_PAGES = pa.schema(
    [("_forest", pa.int32()), ("_root", pa.int32()), ("_root_router", pa.binary()), ("_root_distance", pa.float64()), ("_router", pa.binary()), ("_radius", pa.float64()), ("_ids", pa.binary()), ("_entries", pa.binary()), ("_distances", pa.binary())]
)


def _same_width(*lifted_rows: np.ndarray) -> list[np.ndarray]:
    """Fill with zeros before the last, added component."""
    width = max(x.shape[1] for x in lifted_rows) - 1
    return [np.concatenate((padded(x[:, :-1], width), x[:, -1:]), axis=1) for x in lifted_rows]


def _leaves(rows: list[dict], width: int) -> list[dict]:
    out = []
    for r in rows:
        ids = np.frombuffer(r["_ids"], dtype=np.int64)
        entries = np.frombuffer(r["_entries"]).reshape(len(ids), -1)
        point = lambda b: _same_width(np.frombuffer(b)[None, :], np.zeros((1, width + 1)))[0][0]
        out.append(
            {
                "root": r["_root"],
                "root_router": point(r["_root_router"]),
                "root_distance": r["_root_distance"],
                "router": point(r["_router"]),
                "radius": r["_radius"],
                "ids": ids,
                "entries": padded(entries, width),
                "distances": np.frombuffer(r["_distances"]),
            }
        )
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20, grid: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row for which ``is_query`` (a column
    of ``_id``) holds, the ``k`` other rows with the highest inner product of components
    ``floor(grid * x)``, ties to the smaller ``vec_id``."""
    rows = staged(
        clean(vectors, grid)
        .where(F.col("_vec").isNotNull() & (F.col("_id") != LOWEST))
        .groupBy("_id")
        .agg(F.min("_vec").alias("_vec")),
        "vectors",
    )

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("_vec").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max())])], names=["_norm"])

    top = rows.mapInArrow(norm, "_norm double").agg(F.max("_norm")).first()[0] or 0.0
    trees = build(rows, top)
    queries = staged(rows.where(is_query), "queries")
    forests = (trees.agg(F.max("_forest")).first()[0] or 0) + 1
    blocks = max(1, -(-queries.count() // QUERIES))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).withColumn("_forest", deal(forests))
    right = trees.withColumn("_block", deal(blocks))

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        ids, x = asked.column("_id").to_numpy(), matrix(asked.column("_vec").to_pylist())
        pages = stored.to_pylist()
        width = max([x.shape[1], *(len(p["_router"]) // 8 - 1 for p in pages)])
        best, _ = search(ids, padded(x, width), _leaves(pages, width), top, k)
        q, c = np.nonzero(best.score > -np.inf)
        return pa.table({"query_id": ids[q], "vec_id": best.id[q, c], "score": best.score[q, c].astype(np.int64)})

    found = left.groupBy("_block", "_forest").cogroup(right.groupBy("_block", "_forest")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
