"""Registered queries: payload normalisation. Payload texts are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.attrs import json_or
from ..functions.jsontext import duration_or, iso_timestamp
from ..schema import is_success, status_norm
from ..sources import imports, native, otlp, tables, validation as V, workflow as W
from ..sources.readers import table
from . import bind as B
from .bind import EV, SPANS, TRACES, as_of, cat, pick, spans, sql_pick, traces, ts_sql, with_
from .registry import Registry

reg = Registry()
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def iso(ts):
    return F.date_format(ts, ISO)


END = "ts + to_microseconds(CAST(round(value * 1000) AS BIGINT))"


def with_end(ev):
    return ev.withColumn("ended", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long")))


def native_payloads(spark, d):
    """One trace payload per event with one or two spans; some lack ids or durations."""
    ev = with_end(B.events(spark, d))
    eid, k = F.col("event_id"), F.col("k")
    one = F.struct(cat("s", eid).alias("span_id"), F.lit("root").alias("name"), F.lit("agent").alias("span_type"),
                   iso(F.col("ts")).alias("started_at"), iso(F.col("ended")).alias("ended_at"),
                   F.when(k % 2 == 0, F.col("value")).alias("duration_ms"), F.col("event_type").alias("status"),
                   F.struct(k.alias("llm.total_tokens")).alias("attributes"))
    two = F.struct(F.when(k % 5 != 0, cat("c", eid)).alias("span_id"), F.lit(None).cast("string").alias("name"),
                   F.lit(None).cast("string").alias("span_type"), iso(F.col("ts")).alias("started_at"),
                   F.lit(None).cast("string").alias("ended_at"), F.lit(None).cast("double").alias("duration_ms"),
                   F.lit(None).cast("string").alias("status"), F.struct(k.alias("llm.total_tokens")).alias("attributes"))
    payload = F.to_json(F.struct(
        F.when(eid % 50 != 7, cat("t", eid)).alias("trace_id"), F.when(k % 3 != 0, cat("svc", k % 3)).alias("service_name"),
        iso(F.col("ts")).alias("started_at"), iso(F.col("ended")).alias("completed_at"),
        F.when(k % 2 == 0, F.lit(0.0)).alias("duration_ms"), F.when(k % 4 != 0, F.col("event_type")).alias("status"),
        cat("s", eid).alias("root_span_id"),
        F.when(k % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("spans")))
    return ev.select("event_id", payload.alias("payload"))


@reg.add("a1_native_traces", with_(EV) + f"""
SELECT 't' || event_id AS trace_id, CASE WHEN k % 3 <> 0 THEN 'svc' || (k % 3) ELSE 'unknown' END AS service_name, {ts_sql('ts')} AS started_at,
  {ts_sql(END)} AS completed_at, round(value, 3) AS duration_ms, CASE WHEN k % 4 <> 0 THEN event_type ELSE 'unknown' END AS status,
  's' || event_id AS root_span_id, CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS span_count FROM ev WHERE event_id % 50 <> 7""")
def _(spark, d):
    return native.trace_rows(native.parse_traces(native_payloads(spark, d))).drop("project_id", "attributes", "source")


@reg.add("a1_native_spans", with_(EV) + f"""
, s AS (SELECT event_id, k, ts, value, event_type, 1 AS n FROM ev WHERE event_id % 50 <> 7 UNION ALL
  SELECT event_id, k, ts, value, event_type, 2 FROM ev WHERE event_id % 50 <> 7 AND k % 2 = 0)
SELECT CASE WHEN n = 1 THEN 's' || event_id WHEN k % 5 <> 0 THEN 'c' || event_id ELSE '' END AS span_id, 't' || event_id AS trace_id,
  CASE WHEN n = 1 THEN 'root' ELSE '' END AS name, CASE WHEN n = 1 THEN 'agent' ELSE 'unknown' END AS span_type,
  CASE WHEN k % 3 <> 0 THEN 'svc' || (k % 3) ELSE 'unknown' END AS service_name, {ts_sql('ts')} AS started_at,
  {ts_sql(f'CASE WHEN n = 1 THEN {END} END')} AS ended_at, CASE WHEN n = 1 THEN value ELSE 0 END AS duration_ms,
  CASE WHEN n = 1 THEN event_type ELSE 'unknown' END AS status, '{{"llm.total_tokens":' || k || '}}' AS attributes FROM s""")
def _(spark, d):
    return native.nested_span_rows(native.parse_traces(native_payloads(spark, d))).drop(
        "project_id", "parent_span_id", "events", "replay_snapshot", "source")


def batches(spark, d):
    ev = B.events(spark, d)
    eid, k = F.col("event_id"), F.col("k")
    item = lambda p: F.struct(
        F.when((k % 7 != 0) | F.lit(p == "a"), cat(p, eid)).alias("span_id"),
        F.when((k % 11 != 0) | F.lit(p == "b"), cat("t", eid)).alias("trace_id"), F.col("event_type").alias("name"),
        iso(F.col("ts")).alias("started_at"))
    return ev.select("event_id", F.to_json(F.struct(F.array(item("a"), item("b")).alias("spans"))).alias("payload"))


@reg.add("a2_single_spans", with_(EV) + f"""
SELECT 'a' || event_id AS span_id, 't' || event_id AS trace_id, event_type AS name, 'unknown' AS span_type, {ts_sql('ts')} AS started_at
FROM ev WHERE k % 11 <> 0
UNION ALL SELECT 'b' || event_id, 't' || event_id, event_type, 'unknown', {ts_sql('ts')} FROM ev WHERE k % 7 <> 0""")
def _(spark, d):
    single = batches(spark, d).withColumn("payload", F.explode(F.from_json("payload", "struct<spans:array<string>>")["spans"]))
    return native.single_span_rows(single).select("span_id", "trace_id", "name", "span_type", "started_at")


@reg.add("a3_batch_tally", with_(EV) + """
SELECT event_id, CAST(k % 11 <> 0 AS BIGINT) + CAST(k % 7 <> 0 AS BIGINT) AS ingested, CAST(2 AS BIGINT) AS total FROM ev""")
def _(spark, d):
    return native.batch_tally(native.split_batches(batches(spark, d)), "event_id")


@reg.add("a3_batch_rejects", with_(EV) + """
SELECT event_id, 'missing trace_id' AS reject_reason FROM ev WHERE k % 11 = 0
UNION ALL SELECT event_id, 'missing span_id' FROM ev WHERE k % 7 = 0""")
def _(spark, d):
    return native.split_batches(batches(spark, d)).where("reject_reason IS NOT NULL").select("event_id", "reject_reason")


@reg.add("a3_batch_spans", with_(EV) + """
SELECT 'a' || event_id AS span_id, 't' || event_id AS trace_id, event_type AS name FROM ev WHERE k % 11 <> 0
UNION ALL SELECT 'b' || event_id, 't' || event_id, event_type FROM ev WHERE k % 7 <> 0""")
def _(spark, d):
    return native.batch_span_rows(native.split_batches(batches(spark, d))).select("span_id", "trace_id", "name")


# First attribute key of an OTLP span, by k % 6.
OTLP_KEYS = ["gen_ai.system", "db.statement", "embedding.model", "tool.name", "http.route", ""]
OTLP_TYPES = ["llm", "retrieval", "embedding", "tool", None, None]


def otlp_payloads(spark, d):
    """One OTLP payload per event with a single span of typed attributes and one event."""
    ev = with_end(B._with_trace_id(B.events(spark, d)))
    k, eid = F.col("k"), F.col("event_id")
    nanos = lambda ts: cat(F.unix_micros(ts), "123")
    val = lambda **v: F.struct(*[c.alias(n) for n, c in v.items()])
    kv = lambda key, v: F.to_json(F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), v.alias("value")))
    attrs = F.concat(F.lit("["), F.array_join(F.array(
        kv(pick(OTLP_KEYS, k % 6), val(stringValue=F.lit('say "hi"'))), kv("n", val(intValue=cat(k))), kv("n", val(intValue=k + 1)),
        kv("x", val(doubleValue=F.col("value"))), kv("flag", val(boolValue=k % 2 == 0)),
        kv("list", val(arrayValue=val(values=F.array(val(stringValue=F.lit("a")), val(stringValue=cat(k))))))), ","), F.lit("]"))
    resource = F.when(k % 4 != 0, F.concat(F.lit("["), kv("service.name", val(stringValue=cat("svc", k % 4))), F.lit("]"))).otherwise("[]")
    event = F.concat(F.lit('[{"timeUnixNano":"'), nanos("ended"), F.lit('","name":"done","attributes":[{"key":"ok","value":{"boolValue":true}}]}]'))
    span = F.concat(F.lit('{"traceId":"'), F.col("trace_id"), F.lit('","spanId":"'), cat(eid), F.lit('","name":"'), F.col("event_type"),
                    F.lit('","kind":'), cat(k % 4), F.lit(',"startTimeUnixNano":"'), nanos("ts"), F.lit('","endTimeUnixNano":"'), nanos("ended"),
                    F.lit('","status":{"code":'), cat(k % 4), F.lit('},"attributes":'), attrs, F.lit(',"events":'), event, F.lit("}"))
    return ev.select("event_id", F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":'), resource,
                                         F.lit('},"scopeSpans":[{"spans":['), span, F.lit("]}]}]}")).alias("payload"))


def otlp_spans(spark, d):
    return otlp.span_rows(otlp_payloads(spark, d), as_of())


KIND_TYPE = f"coalesce({sql_pick(OTLP_TYPES, 'k % 6')}, CASE WHEN k % 4 = 2 THEN 'tool' ELSE 'custom' END)"


@reg.add("a4_otlp_spans", with_(EV) + f"""
SELECT CAST(event_id AS VARCHAR) AS span_id, trace_id, event_type AS name, {KIND_TYPE} AS span_type,
  CASE WHEN k % 4 <> 0 THEN 'svc' || (k % 4) ELSE 'unknown' END AS service_name, {ts_sql('ts')} AS started_at, {ts_sql(END)} AS ended_at,
  round(value, 3) AS duration_ms, coalesce((['pending', 'success', 'error'])[k % 4 + 1], 'pending') AS status FROM ev""")
def _(spark, d):
    return otlp_spans(spark, d).select("span_id", "trace_id", "name", "span_type", "service_name", "started_at", "ended_at", "duration_ms", "status")


@reg.add("a5_otlp_values", with_(EV) + """
SELECT CAST(event_id AS VARCHAR) AS span_id, k + 1 AS n, value AS x, k % 2 = 0 AS flag, '["a","' || k || '"]' AS list FROM ev""")
def _(spark, d):
    a = F.from_json("attributes", "struct<n:bigint,x:double,flag:boolean,list:string>")
    return otlp_spans(spark, d).select("span_id", a.alias("a")).select("span_id", "a.*")


@reg.add("a6_otlp_attribute_keys", with_(EV) + f"""
SELECT CAST(event_id AS VARCHAR) AS span_id, CASE WHEN k % 6 = 5 THEN '' ELSE {sql_pick(OTLP_KEYS, 'k % 6')} || '|' END || 'n|x|flag|list' AS keys FROM ev""")
def _(spark, d):
    return otlp_spans(spark, d).select("span_id", F.json_object_keys("attributes").alias("keys"))


@reg.add("a7_span_types", with_(EV) + f"SELECT {KIND_TYPE} AS span_type, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, d):
    return otlp_spans(spark, d).groupBy("span_type").agg(F.count("*").alias("n"))


@reg.add("a8_otlp_status", with_(EV) + """
SELECT k % 4 AS code, coalesce((['pending', 'success', 'error'])[k % 4 + 1], 'pending') AS status, count(*) AS n FROM ev GROUP BY ALL""")
def _(spark, d):
    from ..schema import OTLP_STATUS, lookup

    rows = B.events(spark, d).withColumn("code", F.col("k") % 4)
    return rows.groupBy("code", lookup(OTLP_STATUS, F.col("code"), "pending").alias("status")).agg(F.count("*").alias("n"))


@reg.add("a9_nanos", with_(EV) + f"""
SELECT event_id, {ts_sql("CASE WHEN k % 10 = 0 THEN TIMESTAMP '2024-01-31' ELSE ts END")} AS at FROM ev""")
def _(spark, d):
    text = F.when(F.col("k") % 10 == 0, "not a number").otherwise(cat(F.unix_micros("ts"), "999"))
    return B.events(spark, d).select("event_id", otlp.nanos_timestamp(text, as_of()).alias("at"))


@reg.add("a10_otlp_events", with_(EV) + f"""
SELECT CAST(event_id AS VARCHAR) AS span_id, 'done' AS name, strftime({END}, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp, 'true' AS ok FROM ev""")
def _(spark, d):
    e = F.from_json("events", "array<struct<name:string,timestamp:string,attributes:map<string,string>>>")[0]
    return otlp_spans(spark, d).select("span_id", e["name"].alias("name"), e["timestamp"].alias("timestamp"), e["attributes"]["ok"].alias("ok"))


@reg.add("a11_synthesized_traces", with_(SPANS, TRACES) + f"""
SELECT trace_id, project_id, service_name, {ts_sql('started_at')} AS started_at, {ts_sql('completed_at')} AS completed_at,
  round(duration_ms, 6) AS duration_ms, status, root_span_id, span_count FROM traces""")
def _(spark, d):
    return otlp.synthesize_traces(spans(spark, d, parents=True)).drop("attributes", "source")


# Status words of the binding, by k % 8, and import levels, by k % 5.
WORDS = ["success", "COMPLETED", "error", "ERROR", "unknown", "running", "pending", "weird"]
LEVELS = ["DEBUG", "DEFAULT", "WARNING", "ERROR", "OTHER"]


@reg.add("a12_status_words", with_(EV) + f"""
SELECT event_id, (['success', 'success', 'error', 'error', 'unknown', 'running', 'pending', 'unknown'])[k % 8 + 1] AS status,
  k % 8 < 2 AS ok FROM ev""")
def _(spark, d):
    word = pick(WORDS, F.col("k") % 8)
    return B.events(spark, d).select("event_id", status_norm(word).alias("status"), is_success(word).alias("ok"))


@reg.add("a13_attribute_rows", with_(SPANS) + """
SELECT span_id, u.key, u.value, u.number FROM spans, LATERAL (VALUES ('agent.name', agent_name, NULL), ('llm.model', model, NULL), ('llm.vendor', vendor, NULL),
  ('llm.prompt_tokens', CAST(prompt_tokens AS VARCHAR), NULL), ('llm.completion_tokens', CAST(completion_tokens AS VARCHAR), NULL),
  ('llm.total_tokens', CAST(total_tokens AS VARCHAR), NULL), ('llm.cost_usd', NULL, cost_usd), ('llm.latency_ms', NULL, latency_ms),
  ('tool.call_count', CAST(tool_calls AS VARCHAR), NULL), ('framework', framework, NULL), ('n8n.workflow.id', workflow_id, NULL),
  ('n8n.workflow.name', workflow_name, NULL), ('n8n.node.name', node_name, NULL), ('n8n.node.type', node_type, NULL),
  ('error.message', error_message, NULL), ('error.status_code', CAST(error_code AS VARCHAR), NULL)) u(key, value, number)
WHERE u.value IS NOT NULL OR u.number IS NOT NULL""")
def _(spark, d):
    real = F.col("key").isin("llm.cost_usd", "llm.latency_ms")
    return tables.attribute_rows(spans(spark, d)).select(
        "span_id", "key", F.when(~real, F.col("value")).alias("value"), F.when(real, F.col("value").cast("double")).alias("number"))


OBS_TYPES = ["GENERATION", "SPAN", "CHAIN", "AGENT", "RETRIEVER", "EMBEDDING", "TOOL", "EVALUATOR", "GUARDRAIL", "EVENT"]
OBS_SPAN = ["llm", "custom", "custom", "custom", "retrieval", "embedding", "tool", "custom", "custom", None]


def observations(spark, d):
    ev = with_end(B._with_trace_id(B.events(spark, d)))
    k, eid = F.col("k"), F.col("event_id")
    usage = F.struct((7 * k).alias("promptTokens"), (3 * k).alias("completionTokens"), (10 * k).alias("totalTokens"))
    payload = F.to_json(F.struct(
        cat(eid).alias("id"), F.col("trace_id").alias("traceId"), pick(OBS_TYPES, k % 10).alias("type"), F.col("event_type").alias("name"),
        iso(F.col("ts")).alias("startTime"), F.when(k % 3 != 0, iso(F.col("ended"))).alias("endTime"), pick(LEVELS, k % 5).alias("level"),
        F.when(k % 10 == 0, pick(B.MODELS, k % 4)).alias("model"), F.when(k % 10 == 0, usage).alias("usage"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit('say "x"').alias("content")))).alias("input"),
        F.when(k % 4 == 1, cat(k - 1, "0")).alias("parentObservationId")))
    return ev.select("event_id", payload.alias("payload"))


def observation_spans(spark, d):
    return imports.observation_rows(observations(spark, d), as_of())


OBS = f"""
obs AS (SELECT *, {sql_pick(OBS_SPAN, 'k % 10')} AS span_type, CASE WHEN k % 3 <> 0 THEN {END} ELSE ts END AS ended_at,
  CASE WHEN k % 5 = 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN k % 4 = 1 THEN (k - 1) || '0' ELSE '' END AS parent FROM ev WHERE k % 10 <> 9)"""


@reg.add("a15_observations", with_(EV, OBS) + f"""
SELECT CAST(event_id AS VARCHAR) AS span_id, trace_id, parent AS parent_span_id, event_type AS name, span_type, status,
  {ts_sql('ts')} AS started_at, {ts_sql('ended_at')} AS ended_at,
  '{{"name":"' || event_type || '"' || CASE WHEN k % 10 = 0 THEN ',"gen_ai.request.model":"' || {sql_pick(B.MODELS, 'k % 4')} || '","gen_ai.usage.prompt_tokens":' || 7 * k
    || ',"gen_ai.usage.completion_tokens":' || 3 * k || ',"gen_ai.usage.total_tokens":' || 10 * k ELSE '' END
  || CASE WHEN k % 2 = 0 THEN ',"input":[{{"content":"say \\"x\\"","role":"user"}}]' ELSE '' END || '}}' AS attributes FROM obs""")
def _(spark, d):
    return observation_spans(spark, d).select("span_id", "trace_id", "parent_span_id", "name", "span_type", "status", "started_at", "ended_at", "attributes")


@reg.add("a14_imported_traces", with_(EV, TRACES, OBS) + f"""
, per AS (SELECT trace_id, min(ts) AS first, max(ended_at) AS last, bool_or(status = 'error') AS failed, count(*) AS n,
    arg_min(CAST(event_id AS VARCHAR), ROW(parent <> '', ts, CAST(event_id AS VARCHAR))) AS root FROM obs GROUP BY trace_id),
t AS (SELECT trace_id, service_name, user_id, k, CASE WHEN k % 2 = 0 THEN started_at ELSE coalesce(first, TIMESTAMP '2024-01-31') END AS started_at,
    last, failed, n, root FROM traces LEFT JOIN per USING (trace_id) WHERE k % 13 <> 0)
SELECT trace_id, service_name, {ts_sql('started_at')} AS started_at, {ts_sql('coalesce(last, started_at)')} AS completed_at,
  CASE WHEN coalesce(failed, false) THEN 'error' ELSE 'success' END AS status, coalesce(root, '') AS root_span_id, coalesce(n, 0) AS span_count,
  '{{"langfuse.trace.name":"' || service_name || '","langfuse.user_id":"' || user_id || '"' || CASE WHEN k % 3 = 0 THEN ',"langfuse.tags":["a","b"]' ELSE '' END || '}}' AS attributes FROM t""")
def _(spark, d):
    tr = B.traces(spark, d)
    user = F.regexp_extract("trace_id", r"^t(\d+)-", 1)
    k = (F.get_json_object("attributes", "$.total_tokens").cast("int") / 10).cast("int")
    heads = tr.select(F.to_json(F.struct(
        F.when(k % 13 != 0, F.col("trace_id")).alias("id"), F.col("service_name").alias("name"),
        F.when(k % 2 == 0, iso(F.col("started_at"))).alias("timestamp"), user.alias("userId"),
        F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"))).alias("payload"))
    return imports.imported_traces(heads, observation_spans(spark, d), as_of()).drop("project_id", "duration_ms", "source")


@reg.add("a16_iso_timestamps", with_(EV) + f"""
SELECT event_id, {ts_sql("CASE k % 5 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN ts - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts) END")} AS at FROM ev""")
def _(spark, d):
    k, ts = F.col("k"), F.col("ts")
    text = (F.when(k % 5 == 0, iso(ts)).when(k % 5 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
            .when(k % 5 == 3, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm")))
    return B.events(spark, d).select("event_id", iso_timestamp(text).alias("at"))


@reg.add("a17_duration_fill", with_(SPANS) + """
SELECT span_id, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 0 WHEN k % 3 = 0 THEN round(duration_ms, 3) ELSE 1.5 END AS duration_ms FROM spans""")
def _(spark, d):
    k = F.get_json_object("attributes", "$['llm.total_tokens']").cast("int") / 10
    rows = spans(spark, d).withColumn("k", k.cast("int"))
    given = F.when(F.col("k") % 3 != 0, 1.5).otherwise(0.0)
    return rows.select("span_id", duration_or(given, F.col("started_at"), F.when(F.col("k") % 2 == 0, F.col("ended_at"))).alias("duration_ms"))


KINDS = ["start", "span", "ai_call", "end"]


def workflow_events(spark, d):
    k, eid, uid = F.col("k"), F.col("event_id"), F.col("user_id")
    return B.events(spark, d).select(
        pick(KINDS, k % 4).alias("kind"), cat("x", uid, "-", F.date_format("ts", "MMdd")).alias("execution_id"), cat("p", uid % 5).alias("project_id"),
        F.col("ts").alias("at"), cat("wf", uid % 7).alias("workflow_id"), cat("Workflow ", uid % 7).alias("workflow_name"),
        F.when(k % 4 == 1, cat("step", eid)).alias("span_name"), F.lit("custom").alias("span_type"),
        F.lit("openai").alias("provider"), pick(B.MODELS, uid % 4).alias("model"), (7 * k).alias("prompt_tokens"), (3 * k).alias("completion_tokens"),
        F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("outcome"),
        F.lit(None).cast("string").alias("error_message"))


@reg.add("a18_workflow_events", with_(EV) + f"""
, e AS (SELECT *, 'x' || user_id || '-' || strftime(ts, '%m%d') AS ex, {sql_pick(KINDS, 'k % 4')} AS kind FROM ev)
SELECT 'n8n-' || ex AS trace_id, {ts_sql('ts')} AS updated_at, CASE kind WHEN 'ai_call' THEN 'openai.' || {sql_pick(B.MODELS, 'user_id % 4')}
    WHEN 'span' THEN 'step' || event_id ELSE 'Workflow ' || (user_id % 7) END AS name,
  CASE kind WHEN 'ai_call' THEN 'llm' WHEN 'span' THEN 'custom' ELSE 'agent' END AS span_type, kind IN ('start', 'end') AS is_root,
  CASE WHEN kind = 'start' THEN 'running' WHEN kind = 'end' AND event_type = 'error' THEN 'error' ELSE 'completed' END AS status,
  CASE WHEN kind = 'ai_call' THEN 10 * k END AS total_tokens
FROM e WHERE ex IN (SELECT ex FROM e WHERE kind = 'start')""")
def _(spark, d):
    out = W.event_spans(workflow_events(spark, d))
    return out.select("trace_id", "updated_at", "name", "span_type", (F.col("parent_span_id") == "").alias("is_root"), "status",
                      F.get_json_object("attributes", "$['llm.total_tokens']").cast("long").alias("total_tokens"))


def webhooks(spark, d):
    k, eid = F.col("k"), F.col("event_id")
    node = F.when(k % 2 == 0, F.struct(cat("node", k).alias("name"), pick(list(W.NODE_TYPES), k % 10).alias("type")))
    payload = F.to_json(F.struct(
        F.struct(F.when(k % 9 != 0, cat("wf", k)).alias("id"), cat("Flow ", k).alias("name")).alias("workflow"),
        F.struct(F.when(k % 11 == 0, cat("bad id ", eid)).otherwise(cat("x", eid)).alias("id")).alias("execution"), node.alias("node"),
        F.when(k % 4 == 0, F.array(F.lit("one"), F.lit("two"))).alias("data")))
    return B.events(spark, d).select("event_id", payload.alias("payload"), F.col("ts").alias("received_at"),
                                     F.when(k % 3 == 0, cat("p", k)).otherwise("default").alias("query_project"),
                                     F.when(k % 5 == 0, "bad project!").when(k % 2 == 0, "header").alias("header_project"))


HOOK_PROJECT = "CASE WHEN k % 3 = 0 THEN 'p' || k WHEN k % 5 = 0 THEN 'bad project!' WHEN k % 2 = 0 THEN 'header' ELSE 'default' END"


@reg.add("a19_webhook_spans", with_(EV) + f"""
, h AS (SELECT *, {HOOK_PROJECT} AS project_id FROM ev WHERE k % 9 <> 0 AND k % 11 <> 0)
SELECT 'n8n-x' || event_id AS trace_id, project_id, 'Flow ' || k AS name, 'agent' AS span_type, 0 AS has_output FROM h WHERE project_id <> 'bad project!'
UNION ALL SELECT 'n8n-x' || event_id, project_id, 'node' || k, {sql_pick(list(W.NODE_TYPES.values()), 'k % 10')}, CAST(k % 4 = 0 AS INTEGER)
FROM h WHERE project_id <> 'bad project!' AND k % 2 = 0""")
def _(spark, d):
    out = W.webhook_spans(W.parse_webhooks(webhooks(spark, d)))
    return out.select("trace_id", "project_id", "name", "span_type", F.contains("events", F.lit("node.output")).cast("int").alias("has_output"))


@reg.add("a19_webhook_rejects", with_(EV) + f"""
SELECT event_id, CASE WHEN {HOOK_PROJECT} = 'bad project!' THEN 'bad project id' WHEN k % 9 = 0 THEN 'missing ids' ELSE 'bad ids' END AS reject_reason
FROM ev WHERE {HOOK_PROJECT} = 'bad project!' OR k % 9 = 0 OR k % 11 = 0""")
def _(spark, d):
    return W.parse_webhooks(webhooks(spark, d)).where("reject_reason IS NOT NULL").select("event_id", "reject_reason")


@reg.add("a20_node_types", with_(EV) + f"""
SELECT {sql_pick(list(W.NODE_TYPES) + ['other'], 'k % 11')} AS node_type, {sql_pick(list(W.NODE_TYPES.values()) + ['custom'], 'k % 11')} AS span_type, count(*) AS n
FROM ev GROUP BY ALL""")
def _(spark, d):
    rows = B.events(spark, d).withColumn("node_type", pick([*W.NODE_TYPES, "other"], F.col("k") % 11))
    return rows.groupBy("node_type", W.node_span_type(F.col("node_type")).alias("span_type")).agg(F.count("*").alias("n"))


@reg.add("a21_new_projects", with_(EV) + f"""
SELECT project_id, {ts_sql('min(ts)')} AS created_at FROM (SELECT 'p' || (user_id % 9) AS project_id, ts FROM ev)
WHERE project_id NOT IN (SELECT 'p' || r_regionkey FROM region) GROUP BY project_id""")
def _(spark, d):
    from ..operators.access import missing_projects

    facts = B.events(spark, d).select(cat("p", F.col("user_id") % 9).alias("project_id"), F.col("ts").alias("started_at"))
    return missing_projects(facts, B.projects(spark, d).select("project_id"))


def candidates(spark, d):
    key = F.col("c_custkey")
    h = F.md5(cat(key))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, d, "customer").select(
        "c_custkey", F.when(key % 11 == 0, F.concat(uuid, F.lit("x"))).otherwise(uuid).alias("id"),
        F.when(key % 7 == 0, cat("bad id ", key)).otherwise(cat("p_", key)).alias("project_id"),
        F.when(key % 5 == 0, cat("user", key, "@nowhere")).otherwise(cat("user", key, "@example.com")).alias("email"),
        F.when(key % 13 == 0, "13/01/2024").otherwise("2024-01-13T10:00:00Z").alias("at"),
        F.concat(F.lit("sk_"), F.substring(F.concat(h, h), F.lit(1), (20 + key % 30).cast("int"))).alias("key"))


@reg.add("a22_validity", """
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'bad id' WHEN c_custkey % 7 = 0 THEN 'bad project' WHEN c_custkey % 5 = 0 THEN 'bad email'
  WHEN c_custkey % 13 = 0 THEN 'bad timestamp' WHEN c_custkey % 30 < 12 THEN 'bad key' END AS reject_reason FROM customer""")
def _(spark, d):
    checked = V.check(candidates(spark, d), {
        "bad id": V.matches(F.col("id"), V.UUID), "bad project": V.matches(F.col("project_id"), V.PROJECT_ID),
        "bad email": V.matches(F.col("email"), V.EMAIL), "bad timestamp": V.is_timestamp(F.col("at")),
        "bad key": V.matches(F.col("key"), V.api_key())})
    return checked.select("c_custkey", "reject_reason")


@reg.add("a23_tolerant_json", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    parsed = json_or(text, "struct<k:bigint>", F.struct(F.lit(None).cast("bigint").alias("k")))
    return B.events(spark, d).select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


MARKS = "marks AS (SELECT 'p' || r_regionkey AS source_id, TIMESTAMP '2024-01-05' + to_days(r_regionkey * 5) AS mark FROM region WHERE r_regionkey < 4)"


def marks_of(spark, d):
    return table(spark, d, "region").where("r_regionkey < 4").select(
        cat("p", F.col("r_regionkey")).alias("source_id"),
        (F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(F.col("r_regionkey") * 5)).alias("high_water"))


def landing(spark, d):
    return B.events(spark, d).select("event_id", cat("p", F.col("user_id") % 5).alias("source_id"), "ts")


@reg.add("a27_pull_since", with_(EV, MARKS) + f"""
SELECT event_id, 'p' || (user_id % 5) AS source_id, {ts_sql('ts')} AS ts FROM ev LEFT JOIN marks ON source_id = 'p' || (user_id % 5)
WHERE mark IS NULL OR ev.ts > mark""")
def _(spark, d):
    return tables.pull_since(landing(spark, d), marks_of(spark, d))


@reg.add("a27_next_marks", with_(EV) + f"SELECT 'p' || (user_id % 5) AS source_id, {ts_sql('max(ts)')} AS high_water FROM ev GROUP BY 1")
def _(spark, d):
    return tables.next_marks(tables.pull_since(landing(spark, d), marks_of(spark, d)), marks_of(spark, d))
