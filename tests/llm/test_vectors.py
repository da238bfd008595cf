"""The operators on vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martflow.llm import graph, mtree, pstable
from tests.conftest import rows_of
from tests.llm import plain

SCHEMA = "vec_id long, embedding array<double>, label int, _vec int"
ODD = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [-0.0, 1.0], [0.0, 1.0], [0.0, 1.0, 0.0]]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def _clouds(seed, width=6):
    pick = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(12):
        centre = pick.standard_normal(width)
        for _ in range(pick.integers(1, 12)):
            rows.append((i, (centre + 0.15 * pick.standard_normal(width)).tolist()))
            i += 3
    return rows + [(i + 3, rows[0][1]), (i + 6, rows[0][1]), (i + 9, (2 * np.array(rows[0][1])).tolist())]


@pytest.mark.parametrize("block", [3, 1024])
def test_links_like_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(pstable, "BLOCK", block)
    found = total = 0
    for seed in range(2):
        rows = [*_clouds(seed), *((5000 + k, v) for k, v in enumerate(ODD))]
        want = plain.near_vectors([(i, v if v is None or len(v) != 2 else [*v, 0, 0, 0, 0]) for i, v in rows if v is None or len(v) != 3])
        got = {r["vec_id"]: r for r in pstable.near(_frame(spark, rows)).collect()}
        assert len(got) == len(rows)
        for i, (links, _) in want.items():
            assert got[i]["n_links"] <= links + (i in (5006, 5007))
            found, total = found + got[i]["n_links"], total + links
            assert got[i]["kept"] == (got[i]["component_id"] == i)
        assert all(got[5000 + k]["n_links"] == 0 for k in range(6))
        # Negative zero is zero, and a shorter vector is filled with zeros.
        assert {got[5000 + k]["component_id"] for k in (6, 7, 8)} == {5006} and got[5006]["n_links"] == 2
    assert found >= 0.95 * total


def test_near_on_null_ids_and_no_rows(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.01]), (4, [1.0, 0.01])]
    got = pstable.near(_frame(spark, rows))
    assert rows_of(got, "vec_id", "n_links", "component_id") == sorted([(None, 2, None), (4, 2, None), (4, 2, None)], key=repr)
    assert pstable.near(_frame(spark, [])).isEmpty()


def test_recall_on_the_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = plain.near_vectors(rows)
    got = {r["vec_id"]: r["n_links"] for r in pstable.near(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()}
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())


@pytest.mark.parametrize("seed", range(2))
def test_search_like_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(mtree, "CHUNK", 20)
    monkeypatch.setattr(mtree, "PAGE", 4)
    monkeypatch.setattr(mtree, "FOREST", 3)
    monkeypatch.setattr(mtree, "QUERIES", 5)
    monkeypatch.setattr(mtree, "ROUTERS", 3)
    rows = [*_clouds(seed), *((9000 + 10 * k, v) for k, v in enumerate(ODD)), (None, [1.0, 1.0]), (3, _clouds(seed)[1][1])]
    got = mtree.top_k(_frame(spark, rows), F.col("_id") % 10 == 0, k=7).collect()
    points = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            points[i] = np.floor(64 * np.pad(np.array(v), (0, 6 - len(v)))).astype(int)
    for q in (i for i in points if i % 10 == 0):
        want = sorted((-int(points[q] @ points[i]), i) for i in points if i != q)[:7]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert own == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert mtree.top_k(_frame(spark, []), F.lit(True)).isEmpty()
    few = mtree.top_k(_frame(spark, [(0, [1.0]), (1, [2.0])]), F.lit(True), k=7)
    assert rows_of(few, "query_id", "vec_id", "score") == [(0, 1, 64 * 128), (1, 0, 64 * 128)]


def test_bounds_spare_computations():
    pick = np.random.default_rng(1)
    centres = 40 * pick.standard_normal((30, 4))
    x = np.floor(64 * np.concatenate([c + 0.05 * pick.standard_normal((60, 4)) for c in centres]))
    top = float((x * x).sum(axis=1).max())
    points = mtree.lifted(x, top)
    leaves = []
    for own, router in mtree.pages(points):
        d = np.sqrt(((points[own] - points[router]) ** 2).sum(axis=1))
        root = points[0]
        leaves.append(
            {"root": 0, "root_router": root, "root_distance": float(np.linalg.norm(root - points[router])), "router": points[router], "radius": d.max(), "ids": own, "entries": x[own], "distances": d}
        )
    best, computed = mtree.search(np.full(5, -1), x[:5], leaves, top, 3)
    assert computed < 0.5 * 5 * len(x)
    for q in range(5):
        scores = x @ x[q]
        assert best.id[q].tolist() == np.lexsort((np.arange(len(x)), -scores))[:3].tolist()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)], "_a long, _b long")
    roots = dict(rows_of(graph.components(edges)))
    assert {roots[i] for i in (*range(41), 100)} == {0} and roots[201] == 200
    star = spark.createDataFrame([(i, j) for i in range(10, 30) for j in (1, 2, 3)], "_a long, _b long")
    assert graph.fewer(star).count() == 22 and set(dict(rows_of(graph.components(graph.fewer(star)))).values()) == {1}
    assert graph.components(edges.where("false")).isEmpty()
