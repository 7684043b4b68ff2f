"""Registered queries: workflow, project, agent and replay analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as J, analytics as A, rollup as R
from ..operators.aggregates import usage_breakdown
from ..operators.lookup import newest
from ..sources.readers import table
from . import bind as B
from .bind import AS_OF_SQL, EV, SPANS, TRACES, as_of, spans, traces, ts_sql, with_
from .registry import Registry
from .rollups import E5

reg = Registry()
DAY = f"started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR"

F1 = f"""
f1 AS (SELECT project_id, workflow_id, workflow_name, max(started_at) AS last_execution, count(*) AS execution_count,
  count(*) FILTER (status = 'success') * 100.0::DOUBLE / count(*) AS success_rate, avg(duration_ms) AS avg_duration_ms,
  CAST(sum(ai_calls) AS BIGINT) AS total_ai_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(cost_usd) AS total_cost_usd
  FROM traces WHERE workflow_id IS NOT NULL AND {DAY} GROUP BY ALL)"""
F4 = f"""
f4 AS (SELECT project_id, workflow_id, name AS node_name, model, vendor, count(*) AS call_count,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  avg(latency_ms) AS avg_latency_ms FROM spans WHERE span_type = 'llm' AND workflow_id IS NOT NULL AND {DAY} GROUP BY ALL)"""
F3 = """
f3 AS (SELECT project_id, workflow_id, execution_id, started_at, completed_at, status, duration_ms, total_tokens, cost_usd,
  row_number() OVER (PARTITION BY project_id, workflow_id ORDER BY started_at DESC, execution_id) AS recent_rank
  FROM traces WHERE workflow_id IS NOT NULL)"""


@reg.add("f1_workflow_list", with_(EV, TRACES, F1) + f"""
SELECT * REPLACE ({ts_sql('last_execution')} AS last_execution, round(success_rate, 6) AS success_rate,
  round(avg_duration_ms, 6) AS avg_duration_ms, round(total_cost_usd, 6) AS total_cost_usd) FROM f1""")
def _(spark, d):
    return A.workflow_list(traces(spark, d), as_of())


@reg.add("f2_workflow_detail", with_(SPANS, TRACES, F1, F3, F4) + f"""
SELECT f1.* REPLACE ({ts_sql('last_execution')} AS last_execution, round(success_rate, 6) AS success_rate,
  round(avg_duration_ms, 6) AS avg_duration_ms, round(total_cost_usd, 6) AS total_cost_usd),
  execution_id AS last_execution_id, status AS last_status, coalesce(n.c, 0) AS ai_node_count, CAST(coalesce(n.s, 0) AS BIGINT) AS ai_node_calls
FROM f1 LEFT JOIN (SELECT * FROM f3 WHERE recent_rank = 1) l USING (project_id, workflow_id)
LEFT JOIN (SELECT project_id, workflow_id, count(*) AS c, sum(call_count) AS s FROM f4 GROUP BY ALL) n USING (project_id, workflow_id)""")
def _(spark, d):
    return A.workflow_detail(traces(spark, d), spans(spark, d), as_of())


@reg.add("f2_workflow_runs", with_(EV, TRACES, F1, F3) + f"""
SELECT project_id, workflow_id, recent_rank, execution_id, {ts_sql('started_at')} AS started_at, f3.status, round(duration_ms, 3) AS duration_ms, total_tokens,
  round(cost_usd, 6) AS cost_usd, round(avg_duration_ms, 6) AS avg_duration_ms FROM f1 JOIN f3 USING (project_id, workflow_id) WHERE recent_rank <= 50""".replace("total_tokens,", "f3.total_tokens,"))
def _(spark, d):
    page = A.workflow_page(traces(spark, d), spans(spark, d), as_of())
    return page.select("project_id", "workflow_id", "avg_duration_ms", F.explode("runs").alias("r")).select(
        "project_id", "workflow_id", "avg_duration_ms", "r.recent_rank", "r.execution_id", "r.started_at", "r.status", "r.duration_ms", "r.total_tokens", "r.cost_usd")


@reg.add("f2_workflow_nodes", with_(SPANS, TRACES, F1, F4) + """
SELECT project_id, workflow_id, execution_count, node_name, model, vendor, call_count, prompt_tokens, completion_tokens, round(avg_latency_ms, 1) AS avg_latency_ms
FROM f1 JOIN f4 USING (project_id, workflow_id)""")
def _(spark, d):
    page = A.workflow_page(traces(spark, d), spans(spark, d), as_of())
    return page.select("project_id", "workflow_id", "execution_count", F.explode("nodes").alias("n")).select("project_id", "workflow_id", "execution_count", "n.*")


@reg.add("f3_all_executions", with_(EV, TRACES, F3) + f"""
SELECT * REPLACE ({ts_sql('started_at')} AS started_at, {ts_sql('completed_at')} AS completed_at, round(duration_ms, 3) AS duration_ms) FROM f3""")
def _(spark, d):
    return A.recent_executions(traces(spark, d))


@reg.add("f3_recent_executions", with_(EV, TRACES, F3) + f"""
SELECT * REPLACE ({ts_sql('started_at')} AS started_at, {ts_sql('completed_at')} AS completed_at,
  round(duration_ms, 3) AS duration_ms) FROM f3 WHERE recent_rank <= 50""")
def _(spark, d):
    return A.recent_executions(traces(spark, d), 50)


@reg.add("f4_ai_nodes", with_(SPANS, F4) + "SELECT * REPLACE (round(avg_latency_ms, 6) AS avg_latency_ms) FROM f4")
def _(spark, d):
    return A.ai_nodes(spans(spark, d), as_of())


@reg.add("f5_project_list", with_(EV, TRACES, B.PROJECTS, B.MEMBERS) + f"""
SELECT p.project_id, p.name, count(t.trace_id) FILTER (t.started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS trace_count_24h,
  count(DISTINCT coalesce(t.workflow_id, '')) AS workflow_count FROM projects p LEFT JOIN traces t USING (project_id)
WHERE p.project_id IN (SELECT project_id FROM members JOIN project_teams USING (team_id))
GROUP BY ALL""")
def _(spark, d):
    granted = J.accessible_projects(B.members(spark, d), B.project_teams(spark, d))
    mine = B.projects(spark, d).join(granted.select("project_id").distinct(), "project_id", "left_semi")
    return J.project_stats(mine, traces(spark, d), as_of(), parity=True)


@reg.add("f6_receiver_status", with_(EV, TRACES, B.PROJECTS) + f"""
SELECT project_id, CASE WHEN coalesce(n, 0) > 0 THEN 'active' ELSE 'inactive' END AS status,
  {ts_sql('last_event')} AS last_event, coalesce(n, 0) AS event_count
FROM projects LEFT JOIN (SELECT project_id, max(started_at) AS last_event, count(*) AS n FROM traces
  WHERE started_at >= {AS_OF_SQL} - INTERVAL 12 HOUR GROUP BY project_id) USING (project_id)""")
def _(spark, d):
    return A.receiver_status(B.projects(spark, d), traces(spark, d), as_of(), hours=12)


@reg.add("f7_agent_performance", with_(SPANS) + f"""
SELECT agent_name, framework, count(*) AS total_executions, round(avg(duration_ms), 6) AS avg_duration_ms,
  round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM spans WHERE started_at >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY ALL""")
def _(spark, d):
    return A.agent_performance(spans(spark, d), as_of() - F.expr("INTERVAL 7 DAY"))


@reg.add("f8_graph_nodes", with_(EV, B.TASK_SPANS) + """
SELECT trace_id, agent_name AS agent_id, agent_name AS label, count(*) AS invocations
FROM task_spans WHERE agent_name IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return A.graph_nodes(B.task_spans(spark, d)).drop("project_id")


@reg.add("f8_graph_edges", with_(EV, B.TASK_SPANS) + """
SELECT trace_id, sender AS source, recipient AS target, count(*) AS weight
FROM task_spans WHERE sender IS NOT NULL AND recipient IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return A.graph_edges(B.task_spans(spark, d)).drop("project_id")


@reg.add("f9_violation_summary", with_(EV, B.VIOLATIONS) + """
SELECT guard_name, phase, action, count(*) AS violations FROM violations GROUP BY GROUPING SETS ((guard_name, phase, action), ())""")
def _(spark, d):
    return A.violation_summary(B.violations(spark, d))


@reg.add("f10_cost_analytics", with_(SPANS, E5) + f"""
SELECT project_id, model, vendor,
  CASE WHEN GROUPING(model) = 0 THEN 1 WHEN GROUPING(vendor) = 0 THEN 2 ELSE 3 END AS level,
  CAST(sum(call_count) AS BIGINT) AS total_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(sum(total_cost_usd), 6) AS total_cost_usd, round(sum(total_cost_usd) / sum(call_count), 6) AS cost_per_call,
  round(sum(total_tokens) / sum(call_count), 6) AS tokens_per_call
FROM e5 WHERE date >= DATE '2024-01-31' - 30 GROUP BY GROUPING SETS ((project_id), (project_id, model), (project_id, vendor))""")
def _(spark, d):
    return usage_breakdown(R.since(R.llm_usage_daily(spans(spark, d)), as_of(), 30), ["project_id"])


@reg.add("f12_replay_candidates", with_(SPANS, TRACES) + f"""
SELECT t.trace_id, t.service_name, {ts_sql('t.started_at')} AS started_at, round(t.duration_ms, 6) AS duration_ms, t.total_tokens,
  t.cost_usd AS total_cost_usd, bool_or(s.snapshot_model IS NOT NULL) AS has_replay_snapshot, t.span_count,
  count(*) FILTER (s.span_type = 'llm') AS llm_span_count
FROM traces t JOIN spans s USING (trace_id)
GROUP BY t.trace_id, t.service_name, t.started_at, t.duration_ms, t.total_tokens, t.cost_usd, t.span_count""")
def _(spark, d):
    return A.replay_candidates(traces(spark, d), spans(spark, d)).drop("project_id")


@reg.add("f13_snapshot_summary", with_(SPANS) + """
SELECT trace_id, count(*) AS snapshot_count, string_agg(DISTINCT snapshot_model, '|' ORDER BY snapshot_model) AS models
FROM spans WHERE snapshot_model IS NOT NULL GROUP BY trace_id""")
def _(spark, d):
    return A.snapshot_summary(spans(spark, d)).drop("project_id")


@reg.add("b11_replay_history", with_(B.REPLAYS) + f"""
SELECT execution_id, trace_id, batch_id, {ts_sql('triggered_at')} AS triggered_at, status,
  CASE WHEN done THEN qty * 1.5 END AS duration_ms, round(CASE WHEN done THEN discounted - price END, 6) AS cost_delta FROM replays""")
def _(spark, d):
    return A.replay_history(B.replays(spark, d))


@reg.add("f14_batch_summary", with_(B.REPLAYS) + """
SELECT batch_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total,
  round(sum(discounted) FILTER (ok) - sum(price) FILTER (ok), 6) AS cost_delta_usd,
  CAST(sum(lines) FILTER (ok) - sum(qty) FILTER (ok) AS DOUBLE) AS token_delta,
  round(sum(qty * 0.5) FILTER (ok) / count(*) FILTER (ok), 6) AS avg_duration_delta_ms,
  CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (status = 'completed') = 0 THEN 'failed'
    ELSE 'partial' END AS status
FROM (SELECT *, status = 'completed' AS ok FROM replays) GROUP BY batch_id""")
def _(spark, d):
    return A.batch_summary(B.replays(spark, d))


@reg.add("f15_replay_differences", """
WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q, max(l_shipdate) AS s, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
pairs AS (SELECT 't' || o_orderkey AS trace_id, 'order' AS span_name, o_orderstatus AS a, f AS b, CAST(o_custkey AS VARCHAR) AS c,
  CAST(CAST(q AS BIGINT) AS VARCHAR) AS e FROM orders FULL JOIN o ON o_orderkey = l_orderkey)
SELECT trace_id, span_name, 'output' AS field, a AS original_value, b AS modified_value FROM pairs WHERE a IS DISTINCT FROM b
UNION ALL SELECT trace_id, span_name, 'tokens', c, e FROM pairs WHERE c IS DISTINCT FROM e""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("tokens"), F.max("l_returnflag").alias("output"))
    modified = lines.select(B.cat("t", F.col("l_orderkey")).alias("trace_id"), F.lit("order").alias("span_name"), "output", "tokens")
    original = table(spark, d, "orders").select(
        B.cat("t", F.col("o_orderkey")).alias("trace_id"), F.lit("order").alias("span_name"),
        F.col("o_orderstatus").alias("output"), F.col("o_custkey").alias("tokens"))
    return A.replay_differences(original, modified, ["output", "tokens"])


@reg.add("f16_monthly_replays", with_(EV, TRACES) + f"""
SELECT project_id, count(*) AS replays, count(*) >= 100 AS limit_reached FROM (
  SELECT 'p' || (user_id % 7) AS project_id, ts FROM ev WHERE event_type = 'click') r
WHERE ts >= TIMESTAMP '2024-01-01' AND project_id IN (SELECT project_id FROM traces) GROUP BY project_id""")
def _(spark, d):
    runs = B.events(spark, d).where("event_type = 'click'").select(
        B.cat("p", F.col("user_id") % 7).alias("project_id"), F.col("ts").alias("triggered_at"))
    return A.monthly_replays(runs, traces(spark, d), as_of())


@reg.add("f17_batch_check", with_(EV, TRACES) + """
SELECT batch_id, count(*) AS requested, count(t.trace_id) AS found, count(*) = count(t.trace_id) AS accepted FROM (
  SELECT DISTINCT 'b' || c_custkey AS batch_id, 't' || (c_custkey % 200) || '-2024-01-' || printf('%02d', 1 + (c_custkey + i) % 9) AS trace_id
  FROM customer, (VALUES (0), (3), (9)) v(i)) LEFT JOIN traces t USING (trace_id) GROUP BY batch_id""")
def _(spark, d):
    u = F.col("user_id")
    wanted = F.transform(F.array(F.lit(0), F.lit(3), F.lit(9)), lambda i: F.concat(
        F.lit("t"), (u % 200).cast("string"), F.lit("-2024-01-"), F.lpad((1 + (u + i) % 9).cast("string"), 2, "0")))
    batches = B.users(spark, d).select(B.cat("b", u).alias("batch_id"), wanted.alias("trace_ids"))
    return A.check_batches(batches, traces(spark, d))
