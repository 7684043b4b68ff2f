"""Large buckets: pairs are compared where their texts meet, and links stay fewer than rows."""

import random

import numpy as np
import pyarrow as pa

from spanloom.llm import neardup
from spanloom.llm.batches import prepare
from spanloom.llm.components import components


def texts(n, size, subs, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = [f"w{k}" for k in range(size)]
        for p in rng.sample(range(size), subs):
            t[p] = f"x{rng.randint(0, 10 ** 9)}"
        out.append(" ".join(t))
    return out


def test_many_at_once_are_as_similar_as_one_by_one():
    column = pa.array([*texts(12, 60, 2), "one", "a b a b a b a b a b a b", "one two"])
    frequencies = neardup.Frequencies(np.random.default_rng(1).integers(1, 40, neardup.CELLS).astype(float), 60)
    s, level, begin, _ = neardup.weighted(column, frequencies)
    one = [(s[a:b], neardup.WEIGHTS[level[a:b]]) for a, b in zip(begin[:-1], begin[1:])]
    sets = neardup.Sets(column, frequencies)
    for r in range(len(one)):
        assert np.allclose(sets.similarities(r, np.arange(len(one))), [neardup.similarity(one[r], o) for o in one])


def test_links_of_a_large_bucket_are_fewer_than_its_rows(spark, make):
    prepare(spark)
    some = texts(40, 90, 1)
    narrow = make(some).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    frequencies = neardup.document_frequencies(narrow)
    rows = neardup.settled(neardup.signatures(narrow, frequencies).select("id", "bands", "bytes"))
    none = spark.createDataFrame([], "id long, root long")
    links = neardup.crowded(rows, neardup.buckets(rows), none, narrow, frequencies, 0.8)
    assert 39 <= links.count() <= 24 * 40  # 780 pairs in each of many buckets; a bucket gives at most 39 links
    assert {r.root for r in components(links).collect()} == {0}


def test_texts_are_picked_by_marks_before_they_are_shuffled(make, monkeypatch):
    monkeypatch.setattr(neardup, "MARKS", 128)  # others share a mark with one of the ids, and must go all the same
    narrow = make([f"text {i}" for i in range(300)]).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    ids = narrow.where("id % 20 = 0").select("id")
    assert sorted((r.id, r.text) for r in neardup.only(narrow, ids).collect()) == [(i, f"text {i}") for i in range(0, 300, 20)]
    assert neardup.only(narrow, ids.where("false")).count() == 0


def test_rows_of_large_buckets_meet_their_samples_once(spark, make):
    prepare(spark)
    narrow = make(texts(40, 90, 1)).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    rows = neardup.settled(neardup.signatures(narrow, neardup.document_frequencies(narrow)).select("id", "bands", "bytes"))
    placed = neardup.buckets(rows)
    pairs = neardup.bucket_pairs(placed, neardup.finer_keys(rows, placed))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "bytes" not in plan  # the samples are joined before, not for each of the four readers
    assert pairs.count()


def join_rows(df):
    """Rows that each join on ids made, in the plan that ran."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(plan.plan())
        left += [plan.children().apply(k) for k in range(plan.children().size())]
        if kind.endswith("JoinExec") and "[id#" in plan.leftKeys().toString().replace("List(", "["):
            found.append(plan.metrics().get("numOutputRows").get().value())
    return found


def test_joins_on_ids_make_one_row_per_document(spark, make, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 10)  # each row of a bucket goes to several places
    prepare(spark)
    narrow = make(texts(40, 90, 1)).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    frequencies = neardup.document_frequencies(narrow)
    rows = neardup.settled(neardup.signatures(narrow, frequencies).select("id", "bands", "bytes"))
    placed = neardup.buckets(rows)
    assert placed.where(f"n > {neardup.FEW}").count() > 5 * 40  # a document is in many large buckets
    made, keep = [], neardup.settled

    def kept(df):
        made.extend(join_rows(df))
        return keep(df)

    monkeypatch.setattr(neardup, "settled", kept)
    neardup.finer_keys(rows, placed)
    links = neardup.crowded(rows, placed, spark.createDataFrame([], "id long, root long"), narrow, frequencies, 0.8)
    assert {r.root for r in components(links).collect()} == {0}
    assert len(made) >= 4 and max(made) <= 40


def test_texts_of_repeated_rows_come_once(make):
    narrow = make(["one text", "another"]).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    some = neardup.only(narrow.unionByName(narrow).unionByName(narrow), narrow.where("id = 0").select("id"))
    assert [(r.id, r.text) for r in some.collect()] == [(0, "one text")]
