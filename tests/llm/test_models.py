"""Learned operators: held-out accuracy, edges."""

import numpy as np

from spanloom.llm import langid, quality, toxicity
from spanloom.llm.queries import op3_language, op6_quality


def test_language_held_out(spark, docs, small):
    rows = {r.doc_id: r for r in op3_language(spark, small).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert set(rows) == set(truth) and held
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edges(spark, make, odd, docs):
    fitted = langid.model(docs.limit(60))
    got = {r.doc_id: r for r in langid.languages(make(odd, shares=1), fitted).collect()}
    letters = [any(map(str.isalpha, t or "")) for t in odd]
    assert [got[i].lang_pred != "und" for i in range(len(odd))] == letters
    none = langid.model(make(["a b"]))
    assert langid.languages(make(["a b"]), none).first().lang_pred == "und"
    assert langid.languages(make(["a"]).where("false"), none).count() == 0


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(1)
    emit, start, moves = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p = langid.marginals(emit, np.array([0, 4, 4, 7]), start, moves)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in np.ndindex(*[3] * (b - a)):
            w = np.exp(start[path[0]] + sum(emit[a + i, y] for i, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += w
        np.testing.assert_allclose(p[a:b], want / want.sum(1, keepdims=True), rtol=1e-6)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_toxicity_learns_an_expression(spark, make, odd):
    texts = [f"plain words here number {i % 7} and some more of them" + (" zorkface" if i % 3 == 0 else "") for i in range(120)]
    df = make(texts + odd, score="clash")
    fitted = toxicity.model(df, labels(spark, [(i, int(i % 3 == 0), 1) for i in range(120)] + [(None, 1, 1), (5, None, 1)]))
    got = {r.doc_id: r for r in toxicity.scores(df, fitted).collect()}
    assert len(got) == len(texts) + len(odd)
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(120))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(spark, make):
    fitted = toxicity.model(make(["a b c"]), labels(spark, []))
    assert toxicity.scores(make(["a b c", None]), fitted).select("score").distinct().collect() == [(0.5,)]
    empty = make(["a"]).where("false")
    assert toxicity.scores(empty, toxicity.model(empty, labels(spark, []))).count() == 0


def test_quality_held_out(spark, small):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [r for r in op6_quality(spark, small).collect() if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.85


def test_quality_edges(spark, make, odd):
    stats = quality.described(make(odd, stats=1))
    assert stats.count() == len(odd)
    kernel = quality.model(quality.labelled_rows(stats, labels(spark, [])))
    assert {r.score for r in quality.scores(stats, kernel).collect()} == {0.5}
    few = quality.model(quality.labelled_rows(stats, labels(spark, [(i, 0, i % 2) for i in range(len(odd))])))
    assert all(0 <= r.score <= 1 for r in quality.scores(stats, few).collect())


def test_isotonic_pools():
    ones, total = np.zeros(quality.BINS), np.zeros(quality.BINS)
    total[[1, 2, 3]], ones[[1, 2, 3]] = 2, [1, 0, 2]
    out = quality.isotonic(ones, total)
    assert list(out[:5]) == [0.25, 0.25, 0.25, 1, 1] and (np.diff(out) >= 0).all()
