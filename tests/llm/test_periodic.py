"""Periodic runs against their definition."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spanloom.llm import periodic
from spanloom.llm.queries import op11_periodic_runs
from spanloom.llm.wavelet import WaveletMatrix


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = periodic.brute_force(words)
    dropped = {i for x in found for i in range(x.start + x.period, x.start + x.length)}
    best = max(found, key=lambda x: (x.length / x.period, -x.start, -x.period), default=None)
    return (len(found), *((best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4),
            periodic.digest(found), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_query_is_brute_force(spark, docs, small):
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, small).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    some = [r for r in rows if len(r.text or "") < 4000]
    assert len(some) > len(rows) // 2
    assert [got[r.doc_id] for r in some] == [expected(r.doc_id, r.text) for r in some]
    assert any(got[r.doc_id][0] for r in some)


piece = st.builds(lambda a, b, k: (a * k) + b, st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), max_size=4), st.integers(0, 7))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.builds(lambda p, k: p * k, st.lists(piece, max_size=4).map(lambda x: sum(x, [])), st.integers(1, 5)), max_size=4))
def test_runs_are_brute_force(texts):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids = np.array(sum(texts, []), np.int64)
    assert periodic.runs(ids, offsets) == [periodic.brute_force(t) for t in texts]


@pytest.mark.parametrize("base", [[0], [0, 1], [0] * 40 + [1] + [0] * 11 + [2], list(range(333))])
def test_long_repeats(base):
    text = np.array([9] + base * (6000 // len(base)) + [8], np.int64)
    found = periodic.runs(text, np.array([0, len(text)]))[0]
    assert periodic.Run(1, len(text) - 2, len(base)) in found
    assert len({(x.start, x.period) for x in found}) == len(found)


def test_windows_adjoin():
    ends = [periodic.window(2 ** k) for k in range(1, 30)]
    assert ends[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(ends, ends[1:]))


def test_edges(spark, make, odd):
    texts = [*odd, "a " * 6, "b b b b b", "x y " * 4, "           ", "w " * 100_000]
    table = make(texts, runs=1, n_words="z", collapsed=None)
    out = {r.doc_id: r for r in periodic.periodic_runs(table.unionByName(table)).collect()}
    assert len(out) == len(texts)
    assert periodic.periodic_runs(table.unionByName(table)).count() == 2 * len(texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert out[i].n_words == len(words)
        if len(words) < 100:
            assert [periodic.Run(*r) for r in out[i].runs] == periodic.brute_force(words)
    assert [tuple(r) for r in out[len(texts) - 1].runs] == [(0, 100_000, 1)] and out[len(texts) - 1].collapsed == "w"
    assert periodic.report(periodic.periodic_runs(table.where("false"))).count() == 0
    from pyspark.sql import functions as F
    none = make(["k " * 9]).withColumn("doc_id", F.lit(None).cast("long"))
    assert periodic.report(periodic.periodic_runs(none, alter="doc_id")).first().n_runs == 1


def test_strongest_breaks_ties():
    runs = [periodic.Run(0, 8, 2), periodic.Run(3, 9, 2), periodic.Run(5, 18, 4), periodic.Run(9, 9, 2)]
    assert periodic.strongest(runs) == periodic.Run(3, 9, 2)
    assert periodic.strongest([]) is None


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)
    tree = WaveletMatrix(values)
    l = rng.integers(0, 999, 300)
    r = np.minimum(l + rng.integers(1, 200, 300), 1000)
    bound = rng.integers(0, 2100, 300)
    assert tree.below(l, r, bound).tolist() == [(values[a:b] < c).sum() for a, b, c in zip(l, r, bound)]
    k = (r - l) // 2
    assert tree.kth(l, r, k).tolist() == [np.sort(values[a:b])[c] for a, b, c in zip(l, r, k)]
