"""Whitening against the eigenvectors of the covariance, and on odd rows."""

import numpy as np
import pytest

from martflow.llm import whitening
from martflow.llm.queries import QUERIES
from tests.conftest import rows_of

SCHEMA = "vec_id long, embedding array<double>, component string, x int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA)


def _grid(vectors):
    width = max(map(len, vectors))
    return np.array([[int(np.floor(1024 * c)) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors], dtype=object)


def _check(got, ids, vectors, components=8):
    x = _grid(vectors)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, k + 1)) and len(got) == n * k
    deviations = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    matrix = np.array([[by[c + 1][i][0]["whitened"] for c in range(k)] for i in ids])
    for c in range(k):
        for i, d in zip(ids, deviations, strict=True):
            row = by[c + 1][i][0]
            assert row["n"] == n and (row["deviation"] == d or ids.count(i) > 1)
            assert row["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert row["identity_error"] < 1e-8
        if len(set(ids)) == n:
            apart = min(abs(values[c] - v) for j, v in enumerate(values) if j != c) / values[0] if len(values) > 1 else 1
            if apart > 1e-3:
                want = centred @ axes[:, c] / np.sqrt(values[c])
                assert np.abs(np.abs(matrix[:, c]) - np.abs(want)).max() < 1e-7
                assert abs(np.dot(matrix[:, c], want)) == pytest.approx(n, rel=1e-9)
    if len(set(ids)) == n:
        assert np.abs(matrix.T @ matrix / n - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("width", [1, 2, 5, 12])
def test_like_eigenvectors(spark, monkeypatch, width):
    monkeypatch.setattr(whitening, "_BLOCK", 7)
    monkeypatch.setattr(whitening, "_JOINED", 2)
    pick = np.random.default_rng(width)
    vectors = (pick.standard_normal((60, width)) @ np.diag(0.2 + np.arange(width)) @ pick.standard_normal((width, width))).tolist()
    df = _frame(spark, list(enumerate(vectors))).repartition(5)
    _check(whitening.whiten(df).collect(), list(range(60)), vectors)


def test_odd_rows(spark):
    odd = [(100, None), (101, [None, 1.0, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0])]
    good = [(0, [1.0, 2.0, 3.0]), (None, [0.5, -1.0, 0.25]), (2, []), (3, [1.0]), (0, [1.0, 2.0, 3.0]), (4, [-0.0, 2.0, -7.5])]
    _check(whitening.whiten(_frame(spark, odd + good)).collect(), [i for i, _ in good], [v for _, v in good])


def test_fewer_components(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    assert {r["component"] for r in whitening.whiten(_frame(spark, flat)).collect()} == {1}
    assert whitening.whiten(_frame(spark, [(1, [1.0, 2.0])] * 4)).isEmpty()
    assert whitening.whiten(_frame(spark, [])).isEmpty() and whitening.whiten(_frame(spark, [(1, None), (2, [])])).isEmpty()


def test_too_large_entries_are_refused(spark):
    with pytest.raises(Exception, match="2\\^52"):
        whitening.whiten(_frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0])])).collect()


def test_the_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    got = QUERIES["op13_bidiagonal_whitening"](spark, sf).collect()
    _check(got, [r[0] for r in rows], [r[1] for r in rows])


def _solved(r):
    diagonal, upper, right = whitening.bidiagonal(r)
    values = whitening.dqds(diagonal, upper)
    k = int((values > 1e-12 * max(values[0], 1e-300)).sum())
    z = right @ whitening.directions(diagonal, upper, values[:k])
    gram = z.T @ (r.T @ (r @ z))
    return values, np.abs(gram / np.sqrt(np.outer(values[:k], values[:k])) - np.eye(k)).max(initial=0)


@pytest.mark.parametrize("seed", range(20))
def test_solver_on_small_whole_numbers(seed):
    """Ranks below full, equal values and parts that do not touch each other."""
    pick = np.random.default_rng(seed)
    for _ in range(20):
        n = pick.integers(1, 12)
        r = np.triu(pick.integers(-2, 3, (n, n)).astype(float))
        values, error = _solved(r)
        assert error < 1e-9
        assert values == pytest.approx(np.linalg.svd(r, compute_uv=False) ** 2, rel=1e-9, abs=1e-12)


def test_solver_on_close_values():
    pick = np.random.default_rng(3)
    q = np.linalg.qr(pick.standard_normal((30, 30)))[0]
    for gap in (0.0, 1e-12, 1e-8, 1e-5):
        values = np.concatenate([2 * (1 + gap * np.arange(10)), np.full(10, 1.0), np.full(10, 1e-6)])
        assert _solved(np.linalg.qr(np.diag(values) @ q, mode="r"))[1] < 1e-9


def test_small_values_keep_their_relative_accuracy():
    """Of a bidiagonal matrix with entries of very different size."""
    diagonal = 10.0 ** -np.arange(0, 24, 2)
    upper = np.zeros(11)
    values = whitening.dqds(diagonal, upper + 1e-30)
    assert values == pytest.approx(diagonal**2, rel=1e-13)


def test_columns(spark):
    got = whitening.whiten(_frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.5])]))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == [
        "vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double",
    ]
    assert rows_of(got, "n", "component") == [(2, 1), (2, 1)]
