"""Chat formatting: exact round trips, loss mask, edges."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from oracle import compare, duck
from spanloom.llm import chat
from spanloom.llm.queries import SQL, op12_chat

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
BITS = [*chat.DEFAULT.controls, "<", "[", "\\", "\\\\", "s>", "INST]", "|im_end|>", "", "\n", "é👍", "<|im_", "ok"]


def read_back(df):
    return {r.conv_id: [(m.role, list(m.parts)) for m in r.messages] for r in chat.parsed(chat.formatted(df)).collect()}


def test_query_matches_sql(spark, small):
    assert compare(op12_chat(spark, small), duck(small), SQL["op12_chat"]) == ""
    row = op12_chat(spark, small).where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars) == (2, len(chat.PROBE))
    assert row.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n".encode()).hexdigest()


def test_round_trip_of_any_text(spark):
    texts = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.sampled_from(BITS), max_size=8).map("".join))
    def collect(t):
        texts.append(t)

    collect()
    roles = ["user", "assistant", "assistant", "", "a<|im_sep|>b", "[INST]"]
    rows = [(i // 6, i, roles[i % 6], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = read_back(df)
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        assert [(role, p) for role, parts in got[conv] for p in parts] == [(r[2], r[3]) for r in mine]
    # outside the marks that the template set, no control string is left
    body = "".join(r.formatted for r in chat.formatted(df.where("role = 'user'")).collect())
    n = len([r for r in rows if r[2] == "user"])
    assert body.count("<|im_end|>") == len({r[0] for r in rows if r[2] == "user"}) and body.count("<|im_part|>") + body.count("<|im_end|>") == n
    assert not any(c in body for c in chat.DEFAULT.guarded)


def test_merge_mask_and_order(spark):
    rows = [(1, 2, "assistant", "c<s>"), (1, 0, "user", "a"), (1, 1, "user", None), (1, 3, "assistant", "d"), (1, 3, "assistant", "d"), (1, None, None, "first"), (None, 0, "assistant", "lost"), (2, 0, "user", "")]
    convs = chat.formatted(spark.createDataFrame(rows, ROWS))
    assert read_back(spark.createDataFrame(rows, ROWS))[1] == [("", ["first"]), ("user", ["a", ""]), ("assistant", ["c<s>", "d", "d"])]
    text = {r.conv_id: r.formatted for r in convs.collect()}
    spans = sorted((r.conv_id, r.start, r.end) for r in chat.loss_spans(convs).where("conv_id is not null").collect())
    assert [text[c][a:b] for c, a, b in spans] == ["c<\\s>", "d", "d"]
    got = {r.conv_id: r for r in chat.report(convs).collect()}
    assert got[1].n_turns == 6 and got[1].n_messages == 3 and got[1].loss_chars == 6 and got[1].formatted_chars == len(text[1])
    assert got[None].n_turns == 1 and got[2].loss_chars == 0


def test_edges(spark):
    df = spark.createDataFrame([(5, i, "user" if i % 3 else "assistant", "w" * (i % 7)) for i in range(30_000)], ROWS)
    row = chat.report(chat.formatted(df)).first()
    assert row.n_turns == 30_000 and row.n_messages == 20_000
    assert chat.report(chat.formatted(df.where("false"))).count() == 0
    from pyspark.sql import functions as F
    extra = df.limit(3).withColumns({"formatted": F.lit(1), "segments": F.lit(2), "roles": F.lit(3), "before": F.lit(None)})
    assert chat.report(chat.formatted(extra)).first().n_turns == 3
    with pytest.raises(ValueError):
        chat.Template(start="<<im>")


def test_no_python_in_the_plan(spark, small):
    plan = op12_chat(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
