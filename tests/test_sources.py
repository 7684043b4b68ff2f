"""Payload normalisers on small literal payloads."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions.jsontext import iso_timestamp
from spanloom.sources import imports, native, otlp, tables, validation as V, workflow as W



def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def payloads(spark, *docs):
    return spark.createDataFrame([(json.dumps(d) if not isinstance(d, str) else d,) for d in docs], "payload string")


def test_native_trace_with_spans(spark):
    doc = {"trace_id": "t1", "service_name": "svc", "started_at": "2026-02-13T10:00:00Z", "completed_at": "2026-02-13T10:00:01.5+00:00",
           "duration_ms": 0, "status": "completed", "attributes": {"a.b": 1}, "spans": [
               {"span_id": "s1", "name": "root", "span_type": "agent", "events": [{"name": "x"}]}, {"span_id": "s2", "service_name": "other"}]}
    parsed = native.parse_traces(payloads(spark, doc, {"service_name": "no id"}, "not json"))
    trace = native.trace_rows(parsed).collect()
    assert len(trace) == 1 and trace[0]["duration_ms"] == 1500.0 and trace[0]["span_count"] == 2
    assert json.loads(trace[0]["attributes"]) == {"a.b": 1}
    spans = {r["span_id"]: r for r in native.nested_span_rows(parsed).collect()}
    assert spans["s1"]["service_name"] == spans["s2"]["service_name"] == "svc"
    assert spans["s2"]["span_type"] == "unknown" and spans["s2"]["parent_span_id"] == ""
    own = {r["span_id"]: r["service_name"] for r in native.nested_span_rows(parsed, inherit="missing").collect()}
    assert own == {"s1": "svc", "s2": "other"}
    assert parsed.where("reject_reason IS NOT NULL").count() == 2


def test_project_from_metadata(spark):
    parsed = native.parse_traces(payloads(spark, {"trace_id": "a", "metadata": {"project_id": "px"}}, {"trace_id": "b"}))
    assert {r["trace_id"]: r["project_id"] for r in native.trace_rows(parsed).collect()} == {"a": "px", "b": "default"}


def otlp_doc(attrs, kind=1, code=0, **span):
    return {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": [
        {"traceId": "t", "spanId": "s", "name": "n", "kind": kind, "startTimeUnixNano": "1706000000000000999", "endTimeUnixNano": "1706000001000000000",
         "attributes": attrs, "status": {"code": code}, **span}]}]}]}


def kv(key, **value):
    return {"key": key, "value": value}


@pytest.mark.parametrize("attrs, kind, expected", [
    ([kv("tool.name", stringValue="x"), kv("llm.model", stringValue="m")], 1, "llm"),
    ([kv("gen_ai.system", stringValue="x")], 2, "llm"), ([kv("db.statement", stringValue="x"), kv("tool.name", stringValue="y")], 1, "retrieval"),
    ([kv("embedding.model", stringValue="x")], 1, "embedding"), ([], 2, "tool"), ([], 3, "custom"), ([kv("llmx", stringValue="x")], 1, "custom")])
def test_otlp_span_type(spark, attrs, kind, expected):
    assert otlp.span_rows(payloads(spark, otlp_doc(attrs, kind)), now()).first()["span_type"] == expected


def test_otlp_values_and_keys(spark):
    attrs = [kv("", stringValue="skip"), kv("i", intValue="7"), kv("j", intValue=8), kv("d", doubleValue=0.5), kv("b", boolValue=False),
             kv("l", arrayValue={"values": [{"stringValue": "a"}, {"intValue": "1"}, {"boolValue": True}]}), kv("none"),
             kv("dup", stringValue="first"), kv("dup", stringValue='las"t'), kv("raw", bytesValue="QQ==")]
    row = otlp.span_rows(payloads(spark, otlp_doc(attrs, code=2)), now()).first()
    assert json.loads(row["attributes"]) == {"i": 7, "j": 8, "d": 0.5, "b": False, "l": ["a", 1, True], "dup": 'las"t', "raw": "QQ=="}
    assert row["status"] == "error" and row["service_name"] == "shop" and row["duration_ms"] == 1000.0
    assert row["started_at"].microsecond == 0


def test_otlp_events_and_missing_parts(spark):
    event = {"timeUnixNano": "1706000000500000000", "name": "exception", "attributes": [kv("exception.message", stringValue="boom")]}
    row = otlp.span_rows(payloads(spark, otlp_doc([], events=[event])), now()).first()
    assert json.loads(row["events"])[0]["attributes"] == {"exception.message": "boom"}
    bare = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s"}]}]}]}
    row = otlp.span_rows(payloads(spark, bare, {}), now()).first()
    assert (row["service_name"], row["status"], row["attributes"], row["events"]) == ("unknown", "pending", "{}", "[]")
    assert row["started_at"].year == 1970


def test_synthesized_trace_prefers_root_and_any_error(spark):
    rows = [("s2", "t", "s1", "a", "2024-01-01 00:00:00", "2024-01-01 00:00:09", "error"), ("s1", "t", "", "b", "2024-01-01 00:00:01", "2024-01-01 00:00:05", "success")]
    df = spark.createDataFrame(rows, "span_id string, trace_id string, parent_span_id string, service_name string, s string, e string, status string").select(
        "*", F.lit("p").alias("project_id"), F.col("s").cast("timestamp").alias("started_at"), F.col("e").cast("timestamp").alias("ended_at"), F.lit("otlp").alias("source"))
    row = otlp.synthesize_traces(df).first()
    assert (row["root_span_id"], row["service_name"], row["status"], row["duration_ms"], row["span_count"]) == ("s1", "b", "error", 9000.0, 2)


def test_imported_observations(spark):
    obs = [{"id": "o1", "traceId": "t", "type": "GENERATION", "name": "gen", "startTime": "2026-02-13T10:30:00.000Z", "endTime": "2026-02-13T10:30:02Z",
            "model": "m", "usage": {"promptTokens": 1, "completionTokens": 0}, "input": "hi", "output": {"a": [1]}, "metadata": {}},
           {"id": "o2", "traceId": "t", "type": "EVENT"}, {"id": "o3", "traceId": "t", "level": "ERROR", "startTime": "bad"}]
    spans = imports.observation_rows(payloads(spark, *obs), now())
    got = {r["span_id"]: r for r in spans.collect()}
    assert set(got) == {"o1", "o3"}
    assert json.loads(got["o1"]["attributes"]) == {"name": "gen", "gen_ai.request.model": "m", "gen_ai.usage.prompt_tokens": 1,
                                                  "gen_ai.usage.completion_tokens": 0, "input": "hi", "output": {"a": [1]}}
    assert got["o1"]["duration_ms"] == 2000.0 and got["o3"]["status"] == "error" and got["o3"]["span_type"] == "custom"
    traces = imports.imported_traces(payloads(spark, {"id": "t", "name": "n", "userId": "", "tags": ["x"]}, {"name": "skip"}), spans, now()).collect()
    assert len(traces) == 1 and json.loads(traces[0]["attributes"]) == {"langfuse.trace.name": "n", "langfuse.tags": ["x"]}
    assert traces[0]["status"] == "error" and traces[0]["span_count"] == 2


@pytest.mark.parametrize("text, expected", [
    ("2026-02-13T10:30:00.000Z", "2026-02-13 10:30:00"), ("2026-02-13T10:30:00+02:00", "2026-02-13 08:30:00"), ("2026-02-13T10:30:00", "2026-02-13 10:30:00"),
    ("2026-02-13", "2026-02-13 00:00:00"), ("13/02/2026", None), ("", None), (None, None), ("2026-13-99T00:00:00Z", None)])
def test_iso_timestamps(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(iso_timestamp(F.col("t")).cast("string")).first()[0]
    assert got == expected


def test_workflow_events_need_a_start(spark):
    cols = ("kind string, execution_id string, project_id string, at timestamp, workflow_id string, workflow_name string, span_name string, span_type string, "
            "provider string, model string, prompt_tokens int, completion_tokens int, latency_ms double, outcome string, error_message string")
    base = [None] * 11
    at = __import__("datetime").datetime(2024, 1, 1)
    rows = [("start", "e1", "p", at, "w", "Flow", *[None] * 9), ("ai_call", "e1", "p", at, *[None] * 4, "openai", "gpt-4", 5, 2, None, None, None),
            ("end", "e1", "p", at, *base[:9], "failed", "boom"), ("span", "e2", "p", at, *base)]
    got = W.event_spans(spark.createDataFrame(rows, cols)).collect()
    assert {r["trace_id"] for r in got} == {"n8n-e1"} and len(got) == 3
    call = next(r for r in got if r["span_type"] == "llm")
    assert call["name"] == "openai.gpt-4" and json.loads(call["attributes"])["llm.total_tokens"] == 7
    end = next(r for r in got if r["status"] == "error")
    assert end["parent_span_id"] == "" and json.loads(end["attributes"])["error.message"] == "boom"
    assert end["span_id"] == next(r for r in got if r["status"] == "running")["span_id"]


def test_validation_reasons(spark):
    df = spark.createDataFrame([("ok", "a@b.co"), ("bad id!", "a@b.co"), ("ok", "nope"), (None, None)], "id string, email string")
    checked = V.check(df, {"id": V.matches(F.col("id"), V.PROJECT_ID), "email": V.matches(F.col("email"), V.EMAIL)})
    good, bad = V.split(checked)
    assert good.count() == 1 and sorted(r["reject_reason"] for r in bad.collect()) == ["email", "id", "id"]
    assert spark.range(1).select(V.has_length(F.lit("abc"), 1, 3), V.matches(F.lit("sk_" + "a" * 32), V.api_key())).first() == (True, True)


def test_fact_table_round_trip_prunes_months(spark, small, tmp_path):
    from spanloom.plans.bind import spans

    path = str(tmp_path / "facts")
    rows = spans(spark, small)
    tables.write_facts(rows, path, ["service_name", "started_at", "span_id"])
    back = tables.read_facts(spark, path, "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    assert back.count() == rows.where("started_at BETWEEN '2024-01-10' AND '2024-01-20'").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan
    assert tables.drop_expired(spark, path, "202402").count() == 0


# ---- sink and pulls --------------------------------------------------------------------
def test_sink_run_twice_and_pruned_read(spark, tmp_path):
    from spanloom.sources import tables

    rows = spark.range(400).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("project_id"), F.col("id").alias("span_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 36_000).alias("started_at"))
    sink = tables.FactSink(f"{tmp_path}/facts")
    for b in (0, 1, 1, 0):
        sink(rows.where(F.col("span_id") % 2 == b), b)
    assert spark.read.parquet(f"{tmp_path}/facts").count() == 400
    some = tables.read_facts(spark, f"{tmp_path}/facts", "2024-02-10", "2024-04-02").where("project_id = 'p1'")
    assert some.count() == rows.where("project_id = 'p1' and started_at between timestamp'2024-02-10' and timestamp'2024-04-02'").count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "project_id" in filters and "month" in filters


def test_rows_at_the_mark_come_once(spark, tmp_path):
    import datetime as dt

    from spanloom.sources import tables

    at = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    job = tables.Pull(spark, str(tmp_path), every=2)
    schema = "event_id long, source_id string, ts timestamp"
    landing = []
    got = []
    for n, new in enumerate([[(1, "a", at[1]), (2, "a", at[1]), (3, "b", at[0])], [(4, "a", at[1]), (5, "a", at[0])], [], [(6, "a", at[2]), (7, "a", at[1]), (8, "b", at[0])], [(9, "a", at[2])]]):
        landing += new
        df = spark.createDataFrame(landing, schema)
        job(df, n)
        job(df, n)
        got.append(sorted(r.event_id for r in job.pulled().where(f"batch_id = {n}").collect()))
    # 4 comes later at the mark; 5 is older than it; 7 was passed by the pull that saw 6
    assert got == [[1, 2, 3], [4], [], [6, 7, 8], [9]]


def test_json_strings_are_those_of_the_json_writer(spark):
    from spanloom.functions.jsontext import json_string, json_value

    odd = ["", "plain", 'say "hi"', "back\\slash", "a\nb\tc\x00\x1f", "/ </script>", "é 字 \U0001f44d  \x7f", "{}}", None]
    df = spark.createDataFrame([(x,) for x in odd], "s string")
    text = F.col("s")
    assert all(r.a == r.b for r in df.select(json_string(text).alias("a"), json_value(text).alias("b")).collect())
    # no JSON writer for numbers, flags and most texts of an OTLP value
    from spanloom.sources import otlp
    value = spark.createDataFrame([], f"v {otlp.VALUE}").select(otlp.scalar_literal(F.col("v")).alias("x"))
    assert value._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") <= 6
