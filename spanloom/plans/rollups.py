"""Registered queries: aggregation blocks and daily rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.attrs import with_attrs
from ..operators import aggregates as A, rollup as R
from .bind import AS_OF_SQL, EV, SPANS, TRACES, as_of, spans, traces, ts_sql, with_
from .registry import Registry

reg = Registry()

E1 = """
e1 AS (SELECT project_id, workflow_id, workflow_name, CAST(started_at AS DATE) AS date,
    count(*) AS execution_count, count(*) FILTER (status = 'error') AS error_count,
    count(*) FILTER (status IN ('success', 'completed')) AS success_count,
    avg(duration_ms) AS avg_duration_ms, quantile_cont(duration_ms, 0.5) AS p50_duration_ms,
    quantile_cont(duration_ms, 0.95) AS p95_duration_ms, quantile_cont(duration_ms, 0.99) AS p99_duration_ms,
    min(duration_ms) AS min_duration_ms, max(duration_ms) AS max_duration_ms
  FROM traces WHERE workflow_id IS NOT NULL GROUP BY ALL)"""
E2 = """
e2 AS (SELECT project_id, workflow_id, name AS node_name, model, vendor, CAST(started_at AS DATE) AS date,
    count(*) AS call_count, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    avg(latency_ms) AS avg_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
    sum(cost_usd) AS total_cost_usd, count(*) FILTER (status = 'error') AS error_count
  FROM spans WHERE span_type = 'llm' AND workflow_id IS NOT NULL GROUP BY ALL)"""
E3 = """
e3 AS (SELECT project_id, workflow_id, node_name, node_type, span_type, CAST(started_at AS DATE) AS date,
    count(*) AS execution_count, avg(duration_ms) AS avg_duration_ms,
    quantile_cont(duration_ms, 0.95) AS p95_duration_ms, count(*) FILTER (status = 'error') AS error_count,
    count(*) FILTER (status IN ('success', 'completed')) AS success_count
  FROM spans WHERE span_type <> 'llm' AND workflow_id IS NOT NULL GROUP BY ALL)"""
E4 = """
e4 AS (SELECT project_id, service_name, span_type, CAST(started_at AS DATE) AS date, count(*) AS span_count,
    avg(duration_ms) AS avg_duration_ms, quantile_cont(duration_ms, 0.95) AS p95_duration_ms,
    count(*) FILTER (status = 'error') AS error_count
  FROM spans GROUP BY ALL)"""
E5 = """
e5 AS (SELECT project_id, vendor, model, CAST(started_at AS DATE) AS date, count(*) AS call_count,
    CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens, avg(latency_ms) AS avg_latency_ms,
    sum(cost_usd) AS total_cost_usd, count(*) FILTER (status IN ('success', 'completed')) AS success_count
  FROM spans WHERE span_type = 'llm' GROUP BY ALL)"""
DAYS = "date >= DATE '2024-01-31' - {n}"


def rounded(cte: str, cols: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in cols.split())}) FROM {cte}"


def usage(spark, d):
    return with_attrs(spans(spark, d), R.USAGE)


# ---- D: building blocks --------------------------------------------------------
@reg.add("d1_error_ratio", with_(SPANS) + """
SELECT project_id, span_type, count(*) AS total, count(*) FILTER (status = 'error') AS errors,
  round(count(*) FILTER (status = 'error') / count(*), 6) AS error_ratio
FROM spans GROUP BY ALL""")
def _(spark, d):
    return A.error_ratio(spans(spark, d), ["project_id", "span_type"])


@reg.add("d2_duration_spread", with_(SPANS) + """
SELECT service_name, span_type, round(avg(duration_ms), 6) AS mean, round(stddev_pop(duration_ms), 6) AS stddev,
  min(duration_ms) AS min, max(duration_ms) AS max, round(sum(duration_ms), 6) AS sum
FROM spans GROUP BY ALL""")
def _(spark, d):
    return A.spread(spans(spark, d), ["service_name", "span_type"], "duration_ms")


@reg.add("d3_duration_quantiles", with_(SPANS) + """
SELECT project_id, span_type, count(duration_ms) AS n, round(quantile_cont(duration_ms, 0.5), 6) AS p50,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99
FROM spans GROUP BY ALL""")
def _(spark, d):
    return A.quantiles(spans(spark, d), ["project_id", "span_type"], "duration_ms")


@reg.add("d4_distinct_counts", with_(SPANS) + """
SELECT project_id, count(DISTINCT trace_id) AS traces, count(DISTINCT agent_name) AS agents,
  count(DISTINCT name) AS names FROM spans GROUP BY ALL""")
def _(spark, d):
    rows = with_attrs(spans(spark, d), {"agent_name": ("agent.name", "str")})
    return A.distinct_counts(rows, ["project_id"], {"traces": "trace_id", "agents": "agent_name", "names": "name"})


@reg.add("d5_any_workflow_name", with_(EV, TRACES) + """
SELECT project_id, workflow_id, min(workflow_name) AS workflow_name
FROM traces WHERE workflow_id IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    rows = with_attrs(traces(spark, d).where(R.has_key("attributes", "n8n.workflow.id")), R.WORKFLOW)
    return A.any_value(rows, ["project_id", "workflow_id"], "workflow_name", "workflow_name")


@reg.add("d6_distinct_agents", with_(SPANS) + """
SELECT DISTINCT project_id, agent_name, service_name FROM spans WHERE agent_name <> ''""")
def _(spark, d):
    rows = with_attrs(spans(spark, d), {"agent_name": ("agent.name", "str")})
    return rows.where("agent_name <> ''").select("project_id", "agent_name", "service_name").distinct()


@reg.add("d7_having_calls", with_(SPANS) + """
SELECT project_id, name, count(*) AS n FROM spans GROUP BY ALL HAVING count(*) >= 100""")
def _(spark, d):
    return A.having(spans(spark, d), ["project_id", "name"], 100)


@reg.add("d8_most_common_errors", with_(SPANS) + f"""
SELECT error_message, count(*) AS n, {ts_sql('min(started_at)')} AS first_seen
FROM spans WHERE status = 'error' GROUP BY error_message
ORDER BY n DESC, first_seen, error_message LIMIT 5""")
def _(spark, d):
    rows = with_attrs(spans(spark, d).where("status = 'error'"), {"error_message": ("error.message", "str")})
    return A.most_common(rows, "error_message", "started_at", 5)


@reg.add("d10_usage_breakdown", with_(SPANS, E5) + """
SELECT project_id, model, vendor,
  CASE WHEN GROUPING(model) = 0 THEN 1 WHEN GROUPING(vendor) = 0 THEN 2 ELSE 3 END AS level,
  CAST(sum(call_count) AS BIGINT) AS total_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(sum(total_cost_usd), 6) AS total_cost_usd, round(sum(total_cost_usd) / sum(call_count), 6) AS cost_per_call,
  round(sum(total_tokens) / sum(call_count), 6) AS tokens_per_call
FROM e5 GROUP BY GROUPING SETS ((project_id), (project_id, model), (project_id, vendor))""")
def _(spark, d):
    return A.usage_breakdown(R.llm_usage_daily(spans(spark, d)), ["project_id"])


@reg.add("d11_cost_map", with_(SPANS, E5) + """
SELECT project_id, '{' || string_agg('"' || model || '":' || CAST(c AS VARCHAR), ',' ORDER BY model) || '}' AS cost_by_model
FROM (SELECT project_id, model, CAST(round(CAST(sum(total_cost_usd) AS DECIMAL(28,6)), 2) AS DOUBLE) AS c FROM e5 GROUP BY ALL) GROUP BY project_id""")
def _(spark, d):
    return A.cost_map(R.llm_usage_daily(spans(spark, d)), ["project_id"])


# ---- E: rollups -------------------------------------------------------------------
@reg.add("e1_workflow_daily", with_(EV, TRACES, E1) + rounded(
    "e1", "avg_duration_ms p50_duration_ms p95_duration_ms p99_duration_ms"))
def _(spark, d):
    return R.workflow_daily(traces(spark, d))


@reg.add("e2_ai_node_daily", with_(SPANS, E2) + rounded("e2", "avg_latency_ms p95_latency_ms total_cost_usd"))
def _(spark, d):
    return R.ai_node_daily(spans(spark, d))


@reg.add("e3_node_daily", with_(SPANS, E3) + rounded("e3", "avg_duration_ms p95_duration_ms"))
def _(spark, d):
    return R.node_daily(spans(spark, d))


@reg.add("e4_span_daily", with_(SPANS, E4) + rounded("e4", "avg_duration_ms p95_duration_ms"))
def _(spark, d):
    return R.span_daily(spans(spark, d))


@reg.add("e5_llm_usage_daily", with_(SPANS, E5) + rounded("e5", "avg_latency_ms total_cost_usd"))
def _(spark, d):
    return R.llm_usage_daily(spans(spark, d))


@reg.add("e6_workflow_performance", with_(EV, TRACES, E1) + f"""
SELECT project_id, workflow_name, date, execution_count, error_count,
  round(error_count / execution_count * 100, 2) AS error_rate_pct, round(avg_duration_ms, 2) AS avg_duration_ms,
  round(p95_duration_ms, 2) AS p95_duration_ms FROM e1 WHERE {DAYS.format(n=7)}""")
def _(spark, d):
    return R.workflow_performance(R.workflow_daily(traces(spark, d)), as_of())


@reg.add("e7_model_usage_by_workflow", with_(SPANS, E2) + f"""
SELECT project_id, workflow_id, model, vendor, CAST(sum(call_count) AS BIGINT) AS total_calls,
  CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_cost_usd), 4) AS total_cost_usd,
  round(avg(avg_latency_ms), 6) AS avg_latency_ms
FROM e2 WHERE {DAYS.format(n=30)} GROUP BY project_id, workflow_id, model, vendor""")
def _(spark, d):
    return R.model_usage_by_workflow(R.ai_node_daily(spans(spark, d), quantiles=False), as_of())


@reg.add("e8_most_expensive_workflows", with_(SPANS, TRACES, E1, E2) + f"""
SELECT * FROM (
  SELECT project_id, workflow_name, CAST(sum(call_count) AS BIGINT) AS ai_calls,
    CAST(sum(total_tokens) AS BIGINT) AS tokens_used, round(sum(total_cost_usd), 6) AS total_cost_usd,
    row_number() OVER (PARTITION BY project_id ORDER BY round(sum(total_cost_usd), 6) DESC, workflow_name) AS rank
  FROM e2 JOIN (SELECT project_id, workflow_id, min(workflow_name) AS workflow_name FROM e1 GROUP BY ALL) w
    USING (project_id, workflow_id)
  WHERE {DAYS.format(n=30)} GROUP BY project_id, workflow_name) WHERE rank <= 10""")
def _(spark, d):
    return R.most_expensive_workflows(R.ai_node_daily(spans(spark, d), quantiles=False), R.workflow_daily(traces(spark, d), quantiles=False), as_of())


@reg.add("e9_error_rate_trend", with_(EV, TRACES, E1) + f"""
SELECT project_id, workflow_name, date, execution_count, error_count,
  round(error_count / execution_count * 100, 2) AS error_rate_pct FROM e1 WHERE {DAYS.format(n=30)}""")
def _(spark, d):
    return R.error_rate_trend(R.workflow_daily(traces(spark, d), quantiles=False), as_of())


@reg.add("e10_slowest_nodes", with_(SPANS, E3) + f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id
      ORDER BY avg_duration_ms DESC, node_name, node_type, span_type) AS rank
  FROM (SELECT project_id, node_name, node_type, span_type, CAST(sum(execution_count) AS BIGINT) AS total_executions,
      round(avg(avg_duration_ms), 6) AS avg_duration_ms, round(avg(p95_duration_ms), 6) AS p95_duration_ms
    FROM e3 WHERE {DAYS.format(n=7)} GROUP BY ALL)) WHERE rank <= 20""")
def _(spark, d):
    return R.slowest_nodes(R.node_daily(spans(spark, d)), as_of())


@reg.add("e11_vendor_comparison", with_(SPANS, E5) + f"""
SELECT project_id, vendor, count(DISTINCT model) AS model_count, CAST(sum(call_count) AS BIGINT) AS total_calls,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(round(CAST(sum(total_cost_usd) AS DECIMAL(28,6)), 2) AS DOUBLE) AS total_cost_usd,
  round(avg(avg_latency_ms), 6) AS avg_latency_ms
FROM e5 WHERE {DAYS.format(n=30)} GROUP BY project_id, vendor""")
def _(spark, d):
    return R.vendor_comparison(R.llm_usage_daily(spans(spark, d)), as_of())


@reg.add("e12_merged_rollup_state", with_(SPANS) + """
SELECT project_id, service_name, span_type, CAST(started_at AS DATE) AS date, count(*) AS span_count,
  count(*) FILTER (status = 'error') AS error_count, round(avg(duration_ms), 6) AS avg_duration_ms,
  min(duration_ms) AS duration_min, max(duration_ms) AS duration_max,
  list_sort(list(duration_ms))[greatest(1, CAST(ceil(0.95 * count(duration_ms)) AS BIGINT))] AS p95_duration_ms
FROM spans GROUP BY ALL""")
def _(spark, d):
    rows = spans(spark, d)
    stored = R.span_state(rows.where("span_id % 2 = 0"))
    batch = R.span_state(rows.where("span_id % 2 = 1"))
    return R.read_span_state(R.merge_span_state(stored, batch))


# ---- R: windows over rollups -----------------------------------------------------------
@reg.add("r1_day_over_day", with_(SPANS, E5) + """
SELECT project_id, vendor, model, date, round(total_cost_usd, 6) AS total_cost_usd,
  round(lag(total_cost_usd) OVER w, 6) AS previous, round(total_cost_usd - lag(total_cost_usd) OVER w, 6) AS change
FROM e5 WINDOW w AS (PARTITION BY project_id, vendor, model ORDER BY date)""")
def _(spark, d):
    return R.day_over_day(R.llm_usage_daily(spans(spark, d)), ["project_id", "vendor", "model"], "total_cost_usd")


@reg.add("r2_moving_average", with_(SPANS, E4) + """
SELECT project_id, service_name, span_type, date, round(avg_duration_ms, 6) AS avg_duration_ms,
  round(avg(avg_duration_ms) OVER w, 6) AS moving_avg, count(*) OVER w AS days_seen
FROM e4 WINDOW w AS (PARTITION BY project_id, service_name, span_type ORDER BY date
  RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    daily = R.span_daily(spans(spark, d))
    return R.moving_average(daily, ["project_id", "service_name", "span_type"], "avg_duration_ms")
