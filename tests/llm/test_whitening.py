"""Whitening against the definition, and the singular value solver against another one."""

import numpy as np
import pytest
from pyspark.sql import types as T

from spanloom.llm import whitening
from spanloom.llm.bidiagonal import right_singular
from spanloom.llm.queries import op13_whitening

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def check(rows, table):
    """Rows of the query against numpy's own eigenvectors."""
    ids, c = [i for i, _ in table], np.array([v for _, v in table], float)
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(32, x.shape[1])
    got = sorted(rows, key=lambda r: (r.vec_id, r.component))
    order = np.argsort(ids, kind="stable")
    assert [(r.vec_id, r.component) for r in got] == [(ids[i], c) for i in order for c in range(1, k + 1)]
    white = np.array([r.whitened for r in got], float).reshape(-1, k)
    np.testing.assert_allclose(np.abs(white), np.abs((y @ v[:, :k]) / np.sqrt(e[:k]))[order], atol=1e-8)
    np.testing.assert_allclose([r.explained for r in got[:k]], e[:k] / e.sum(), rtol=1e-9)
    assert [r.deviation for r in got[::k]] == ((n * x - s) ** 2).sum(axis=1)[order].tolist()
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    # the mask of signs is one per component
    ratio = white / ((y @ v[:, :k]) / np.sqrt(e[:k]))[order]
    np.testing.assert_allclose(ratio, np.sign(ratio[:1]).repeat(len(ratio), 0), rtol=1e-4)


def test_query(spark, small):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(op13_whitening(spark, small).collect(), table)


def run(df):
    rows = whitening.scaled(df)
    return whitening.report(rows, whitening.model(rows))


def test_edges(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, [1.0, 2.0]), (105, [1e30] * 5)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(good + bad, VECTOR).repartition(7).withColumns({"x": F.lit("a"), "d": F.lit(1), "c": F.lit(None)})
    check(run(df).collect(), good)
    assert run(df.where("false")).count() == 0 and run(df.where("vec_id >= 100 and vec_id < 104")).count() == 0


@pytest.mark.parametrize("rows", [[[1.0, 2.0]], [[1.0, 2.0]] * 4])
def test_no_variance(spark, rows):
    got = run(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], VECTOR)).collect()
    assert len(got) == 2 * len(rows) and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in got)


def test_repeats_and_missing_components(spark):
    rows = [(7, [float(i), 2.0 * i, 1.0]) for i in range(6)] * 2
    got = run(spark.createDataFrame(rows, VECTOR)).collect()
    assert len(got) == 36 and {r.component for r in got if r.whitened is None} == {2, 3}
    assert abs(next(r.explained for r in got if r.component == 1) - 1) < 1e-12


def test_huge_entries_are_exact(spark):
    rows = [(i, [float(i * (1 << 33)), float(i)]) for i in range(50)]
    got = {r.vec_id: r for r in run(spark.createDataFrame(rows, VECTOR)).where("component = 1").collect()}
    x = [[64 * i * (1 << 33), 64 * i] for i in range(50)]
    s = [sum(v[j] for v in x) for j in (0, 1)]
    for i in range(50):
        want = sum((50 * x[i][j] - s[j]) ** 2 for j in (0, 1))
        assert got[i].deviation == (want if want < 1 << 63 else None)


@pytest.mark.parametrize("name", ["plain", "rank", "equal", "graded", "near", "zeros"])
def test_singular_values(name):
    rng = np.random.default_rng(1)
    q, p = (np.linalg.qr(rng.normal(size=(30, 30)))[0] for _ in range(2))
    r = {"plain": rng.normal(size=(30, 30)), "rank": rng.normal(size=(30, 4)) @ rng.normal(size=(4, 30)), "equal": (q * np.repeat(np.arange(1, 16), 2)) @ p,
         "graded": (q * 10.0 ** -np.arange(30)) @ p, "near": (q * (1 + 1e-10 * rng.normal(size=30))) @ p, "zeros": np.zeros((30, 30))}[name]
    squares, v = right_singular(np.linalg.qr(r, mode="r"))
    top = max(squares[0], 1e-300)
    np.testing.assert_allclose(squares / top, np.linalg.svd(r, compute_uv=False) ** 2 / top, atol=1e-13)
    np.testing.assert_allclose(v.T @ v, np.eye(30), atol=1e-10)
    np.testing.assert_allclose(r.T @ (r @ v) / top, v * squares / top, atol=1e-12)
