"""The similarity search against brute force: recall, crowded groups, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from spanloom.operators import similarity
from spanloom.operators.similarity import similar

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(points, queries, threshold):
    def unit(v):
        v = np.array(v, float)
        return v / np.sqrt(v @ v)

    out = []
    for i, v in queries:
        links = sorted((-round(float(unit(v) @ unit(w)), 9), j) for j, w in points if j != i and float(unit(v) @ unit(w)) >= threshold)
        out.append((i, len(links), [(j, -c) for c, j in links[:10]]))
    return sorted(out)


def answer(df):
    return sorted((r.query_id, r.links, [(b.key, round(b.cosine, 9)) for b in r.best]) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.0, 0.35, 0.8, 0.99])
def test_no_link_is_lost(spark, threshold):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    points = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.4, 2.0])).astype(np.float32).tolist()) for i in range(900)]
    queries = [p for p in points if p[0] % 10 == 0]
    df = spark.createDataFrame(points, ROWS).repartition(5)
    # the index sees only a small sample and has few cells; small blocks and chunks take several rounds
    got = similar(df, df.where("vec_id % 10 = 0"), threshold, cells=9, sample_rows=120, block_rows=40, chunk_rows=100)
    want = brute(points, queries, threshold)
    got = answer(got)
    assert [(q, n) for q, n, _ in got] == [(q, n) for q, n, _ in want]
    assert [c for *_, best in got for _, c in best] == pytest.approx([c for *_, best in want for _, c in best], abs=1e-8)
    assert sum(n for _, n, _ in want) > 0


def test_a_third_of_the_rows_are_near_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    points = [(i, (base + rng.normal(size=8) * 1e-3 if i % 3 else rng.normal(size=8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(6)
    got = {q: (n, best) for q, n, best in answer(similar(df, df.where("vec_id % 100 = 1"), 0.999, k=3))}
    crowd = [q for q in got if q % 3]
    assert len(got) == 30 and all(got[q][0] >= 1999 and len(got[q][1]) == 3 for q in crowd)


def test_equal_vectors_go_by_id(spark):
    points = [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(i, [3.0, -2.0, 1.0]) for i in range(50, 60)]
    df = spark.createDataFrame(points, ROWS).repartition(4)
    got = answer(similar(df, df.where("vec_id in (7, 55)"), 0.9, k=4))
    assert [(q, n, [j for j, _ in best]) for q, n, best in got] == [(7, 49, [0, 1, 2, 3]), (55, 9, [50, 51, 52, 53])]


def test_odd_vectors_and_repeats(spark):
    points = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 5.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
              (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1e-9]), (10, [3e38, 0.0]), (11, [1e-38, 0.0])]
    df = spark.createDataFrame(points, ROWS).repartition(3).withColumns({"key": F.lit("x"), "v": F.lit(1), "links": F.lit(2)})
    got = answer_all(similar(df, df, 0.9))
    assert len(got) == len(points)
    assert [(n, ids) for q, n, ids in got if q == 1] == [(4, [None, 2, 10, 11])]
    assert sorted((n, ids) for q, n, ids in got if q == 2) == [(0, []), (4, [None, 1, 10, 11])]
    assert all(n == 0 and ids == [] for q, n, ids in got if q in (3, 4, 5, 6, 7, 8, 9))
    assert similar(df, df.where("false"), 0.9).count() == 0
    assert answer_all(similar(df.where("false"), df.where("vec_id = 1"), 0.9)) == [(1, 0, [])]
    assert answer_all(similar(df, df.where("vec_id = 3"), 0.9)) == [(3, 0, [])]


def answer_all(df):
    return sorted(((r.query_id, r.links, sorted((b.key for b in r.best), key=lambda k: (k is not None, k))) for r in df.collect()), key=str)


def test_angles_skip_most_cells():
    """Rows of another group are not compared at all."""
    rng = np.random.default_rng(5)
    centres = np.eye(6)
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(300, 6)) * 0.01
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    cells = similarity.Cells(centres)
    cell, away = cells.place(x)
    assert (cell == np.repeat(np.arange(6), 50)).all()
    reach = np.arccos(np.clip(x[:1] @ centres.T, -1, 1))[0]
    angle = np.arccos(0.9)
    assert sum(reach[c] - angle <= away[cell == c].max() for c in range(6)) == 1
