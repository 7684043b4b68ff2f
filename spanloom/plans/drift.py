"""Registered queries: drift detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as G, versions as V
from ..operators.access import match_rules
from ..operators.lookup import newest
from . import bind as B
from .bind import AS_OF_SQL, EV, SPANS, TRACES, as_of, spans, traces, ts_sql, with_
from .lookups import MATCH, RULES_CTE, current_alerts, rules
from .registry import Registry

reg = Registry()
SENSITIVITY = 0.15  # the given data is uniform, so the checks run with a low threshold

AGENTS = "agents AS (SELECT * FROM spans WHERE span_type = 'agent')"


def base_sql(name: str, end: str) -> str:
    return f"""
{name} AS (SELECT project_id, agent_name, service_name, {end} AS window_end, count(*) AS sample_size,
    avg(duration_ms) AS duration_mean, stddev_pop(duration_ms) AS duration_stddev, quantile_cont(duration_ms, 0.5) AS duration_p50,
    quantile_cont(duration_ms, 0.95) AS duration_p95, quantile_cont(duration_ms, 0.99) AS duration_p99,
    min(duration_ms) AS duration_min, max(duration_ms) AS duration_max, avg(total_tokens) AS token_usage_mean,
    stddev_pop(total_tokens) AS token_usage_stddev, quantile_cont(total_tokens, 0.5) AS token_usage_p50,
    quantile_cont(total_tokens, 0.95) AS token_usage_p95, avg(tool_calls) AS tool_calls_mean,
    stddev_pop(tool_calls) AS tool_calls_stddev, 0.0::DOUBLE AS response_length_mean, 0.0::DOUBLE AS response_length_stddev,
    count(*) FILTER (status = 'success') / count(*) AS success_rate, count(*) FILTER (status = 'error') AS error_count,
    avg(cost_usd) AS cost_mean, sum(cost_usd) AS cost_total
  FROM agents WHERE started_at >= {end} - INTERVAL 7 DAY AND started_at <= {end} GROUP BY ALL)"""


BASE = base_sql("base", AS_OF_SQL)
ROUND_BASE = ", ".join(f"round({c}, 6) AS {c}" for c in (
    "duration_mean duration_stddev duration_p50 duration_p95 duration_p99 token_usage_mean token_usage_stddev "
    "token_usage_p50 token_usage_p95 tool_calls_mean tool_calls_stddev success_rate cost_mean cost_total").split())
CUR = f"""
cur AS (SELECT project_id, agent_name, service_name, count(*) AS sample_size, avg(duration_ms) AS duration,
    avg(total_tokens) AS token_usage, avg(tool_calls) AS tool_calls, 0.0::DOUBLE AS response_length,
    count(*) FILTER (status = 'success') / count(*) AS success_rate, avg(cost_usd) AS cost
  FROM agents WHERE started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR AND started_at <= {AS_OF_SQL} GROUP BY ALL)"""
ANOM = f"""
m AS (
  SELECT c.project_id, c.agent_name, c.service_name, c.sample_size, u.* FROM cur c JOIN base b USING (project_id, agent_name, service_name),
  LATERAL (VALUES ('duration', 'ms', c.duration, b.duration_mean, b.duration_stddev),
    ('token_usage', 'tokens', c.token_usage, b.token_usage_mean, b.token_usage_stddev),
    ('tool_calls', 'calls', c.tool_calls, b.tool_calls_mean, b.tool_calls_stddev),
    ('cost', 'USD', c.cost, b.cost_mean, b.cost_mean * 0.3),
    ('success_rate', '%', c.success_rate, b.success_rate, NULL)) u(metric_name, unit, current_value, baseline_mean, baseline_stddev)),
z AS (SELECT *, CASE WHEN baseline_stddev > 0 THEN (current_value - baseline_mean) / baseline_stddev END AS z_score,
  current_value - baseline_mean AS diff FROM m),
anom AS (SELECT project_id, agent_name, service_name, metric_name, unit, current_value, baseline_mean, baseline_stddev, z_score,
    CASE WHEN metric_name = 'success_rate' THEN CASE WHEN abs(diff) > 0.3 THEN 'critical' WHEN abs(diff) > 0.2 THEN 'high' ELSE 'medium' END
      WHEN abs(z_score) >= 4 THEN 'critical' WHEN abs(z_score) >= 3 THEN 'high' WHEN abs(z_score) >= 2 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN baseline_mean = 0 THEN 0 ELSE diff / baseline_mean * 100 END AS change_percent,
    CASE WHEN diff > 0 THEN 'increased' ELSE 'decreased' END AS direction, sample_size
  FROM z WHERE CASE WHEN metric_name = 'success_rate' THEN abs(diff) > 0.1 ELSE abs(z_score) >= {SENSITIVITY} END)"""
CAUSES = f"""
models AS (SELECT project_id, agent_name, service_name, string_agg(DISTINCT model, ', ' ORDER BY model) AS ms, count(DISTINCT model) AS n
  FROM spans WHERE span_type IN ('agent', 'llm') AND started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY ALL),
causes AS (
  SELECT project_id, agent_name, service_name, 'model_change' AS cause, 'Model changed: ' || ms AS description, 0.9::DOUBLE AS confidence
  FROM models WHERE n > 1 AND (project_id, agent_name, service_name) IN (SELECT (project_id, agent_name, service_name) FROM anom)
  UNION ALL SELECT project_id, agent_name, service_name, 'input_complexity_increase',
    printf('Input complexity increased by %.1f%%', change_percent), 0.8 FROM anom WHERE metric_name = 'token_usage' AND z_score > 0
  UNION ALL SELECT project_id, agent_name, service_name, 'error_rate_increase',
    printf('Error rate increased (success rate dropped %.1f%%)', abs(change_percent)), 0.95
  FROM anom WHERE metric_name = 'success_rate' AND direction = 'decreased')"""
ALERT = f"""
newalerts AS (SELECT project_id, agent_name, service_name, severity_rank, metrics, anomaly_count,
    (['low', 'medium', 'high', 'critical'])[severity_rank] AS severity, severity_rank / 4.0::DOUBLE AS score, coalesce(causes, '') AS causes
  FROM (SELECT project_id, agent_name, service_name, max(list_position(['low', 'medium', 'high', 'critical'], severity)) AS severity_rank,
      string_agg(metric_name, '|' ORDER BY metric_name) AS metrics, count(*) AS anomaly_count FROM anom GROUP BY ALL)
  LEFT JOIN (SELECT project_id, agent_name, service_name, string_agg(cause, '|' ORDER BY cause) AS causes FROM causes GROUP BY ALL)
    USING (project_id, agent_name, service_name)),
fresh AS (SELECT * FROM newalerts n WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.project_id = n.project_id
  AND a.agent_name = n.agent_name AND a.status = 'active' AND a.detected_at >= {AS_OF_SQL} - INTERVAL 6 HOUR))"""
ALERT_COLS = ["project_id", "agent_name", "service_name", "severity_rank", "severity", "score", "metrics",
              "anomaly_count", "causes"]


def anomalies(spark, d):
    s = spans(spark, d)
    return G.detect_anomalies(G.current_metrics(s, as_of()), G.agent_baselines(s, [as_of()], quantiles=False), SENSITIVITY)


def scored_agents(spark, d):
    s = spans(spark, d)
    return G.score_agents(G.current_metrics(s, as_of()), G.agent_baselines(s, [as_of()], quantiles=False), SENSITIVITY)


def new_alerts(spark, d):
    return G.build_alerts(G.with_causes(scored_agents(spark, d), G.recent_models(spans(spark, d), as_of())), as_of())


BASE_KEYS = ["project_id", "agent_name", "service_name"]


@reg.add("g1_agent_baselines", with_(SPANS, AGENTS, BASE) + f"""
SELECT * REPLACE ({ROUND_BASE}, {ts_sql('window_end')} AS window_end) FROM base""")
def _(spark, d):
    return G.agent_baselines(spans(spark, d), [as_of()]).drop("window_start", "baseline_id")


@reg.add("g2_baseline_agents", with_(SPANS, AGENTS, BASE) + """
SELECT project_id, count(*) AS baselines, CAST(sum(sample_size) AS BIGINT) AS samples FROM base GROUP BY project_id""")
def _(spark, d):
    return G.agent_baselines(spans(spark, d), [as_of()], quantiles=False).groupBy("project_id").agg(
        F.count("*").alias("baselines"), F.sum("sample_size").alias("samples"))


ENDS = [f"{AS_OF_SQL} - INTERVAL {n} DAY" for n in (0, 8, 16)]
ALL_BASE = ",".join(base_sql(f"b{i}", f"({e})") for i, e in enumerate(ENDS))
SNAPS = f"{ALL_BASE}, snaps AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)"


def snapshots(spark, d):
    return G.agent_baselines(spans(spark, d), [as_of() - F.expr(f"INTERVAL {n} DAY") for n in (0, 8, 16)], quantiles=False)


@reg.add("g3_latest_baselines", with_(SPANS, AGENTS, SNAPS) + f"""
SELECT project_id, agent_name, service_name, {ts_sql('window_end')} AS window_end, sample_size, round(duration_mean, 6) AS duration_mean
FROM snaps WHERE window_end <= {AS_OF_SQL} - INTERVAL 2 DAY
QUALIFY row_number() OVER (PARTITION BY project_id, agent_name, service_name ORDER BY snaps.window_end DESC) = 1""")
def _(spark, d):
    return G.latest_baselines(snapshots(spark, d), as_of() - F.expr("INTERVAL 2 DAY")).select(
        *BASE_KEYS, "window_end", "sample_size", "duration_mean")


@reg.add("b6_list_baselines", with_(SPANS, AGENTS, SNAPS) + f"""
SELECT project_id, agent_name, service_name, {ts_sql('window_end')} AS window_end, sample_size FROM snaps
WHERE project_id = 'p3' ORDER BY snaps.window_end DESC, agent_name, service_name LIMIT 5""")
def _(spark, d):
    rows = snapshots(spark, d).where("project_id = 'p3'").select(*BASE_KEYS, "window_end", "sample_size")
    return newest(rows, [F.desc("window_end"), F.col("agent_name"), F.col("service_name")], 5)


@reg.add("c9_baseline_as_of", with_(SPANS, AGENTS, SNAPS) + f"""
SELECT s.span_id, {ts_sql('b.window_end')} AS window_end, round(b.duration_mean, 6) AS duration_mean
FROM agents s ASOF JOIN snaps b ON s.project_id = b.project_id AND s.agent_name = b.agent_name
  AND s.service_name = b.service_name AND s.started_at >= b.window_end""")
def _(spark, d):
    points = G.agent_rows(spans(spark, d)).select(*BASE_KEYS, "span_id", "started_at")
    base = snapshots(spark, d).select(*BASE_KEYS, "window_end", "duration_mean")
    return G.baseline_as_of(points, base, BASE_KEYS, "started_at").select("span_id", "window_end", "duration_mean")


@reg.add("g4_current_metrics", with_(SPANS, AGENTS, CUR) + """
SELECT * REPLACE (round(duration, 6) AS duration, round(token_usage, 6) AS token_usage, round(tool_calls, 6) AS tool_calls,
  round(success_rate, 6) AS success_rate, round(cost, 6) AS cost) FROM cur""")
def _(spark, d):
    return G.current_metrics(spans(spark, d), as_of())


ROUND_ANOM = ", ".join(f"round({c}, 6) AS {c}" for c in "current_value baseline_mean baseline_stddev z_score change_percent".split())


@reg.add("g5_metric_anomalies", with_(SPANS, AGENTS, BASE, CUR, ANOM) + f"""
SELECT * REPLACE ({ROUND_ANOM}) FROM anom WHERE metric_name IN ('duration', 'token_usage', 'tool_calls')""")
def _(spark, d):
    return anomalies(spark, d).where("metric_name IN ('duration', 'token_usage', 'tool_calls')").drop("baseline_id")


@reg.add("g6_all_anomalies", with_(SPANS, AGENTS, BASE, CUR, ANOM) + f"SELECT * REPLACE ({ROUND_ANOM}) FROM anom")
def _(spark, d):
    return anomalies(spark, d).drop("baseline_id")


@reg.add("g7_success_rate_anomalies", with_(SPANS, AGENTS, BASE, CUR, ANOM) + f"""
SELECT * REPLACE ({ROUND_ANOM}) FROM anom WHERE metric_name = 'success_rate'""")
def _(spark, d):
    return anomalies(spark, d).where("metric_name = 'success_rate'").drop("baseline_id")


@reg.add("g8_root_causes", with_(SPANS, AGENTS, BASE, CUR, ANOM, CAUSES) + "SELECT * FROM causes")
def _(spark, d):
    return G.root_causes(scored_agents(spark, d), G.recent_models(spans(spark, d), as_of()))


@reg.add("g9_drift_alerts", with_(SPANS, AGENTS, BASE, CUR, ANOM, CAUSES, B.ALERTS.lstrip(), ALERT) + """
SELECT * FROM newalerts""")
def _(spark, d):
    return new_alerts(spark, d).select(*ALERT_COLS)


@reg.add("g10_suppressed_alerts", with_(SPANS, AGENTS, BASE, CUR, ANOM, CAUSES, B.ALERTS, ALERT) + "SELECT * FROM fresh")
def _(spark, d):
    return G.suppress_recent(new_alerts(spark, d), current_alerts(spark, d), as_of(), hours=6).select(*ALERT_COLS)


@reg.add("g11_active_projects", with_(EV, TRACES) + f"""
SELECT DISTINCT project_id FROM traces WHERE started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR""")
def _(spark, d):
    return G.active_projects(traces(spark, d), as_of())


@reg.add("g12_notifications", with_(EV, B.ALERTS, RULES_CTE) + f"""
SELECT r.rule_id, a.alert_id, unnest(r.channels) AS channel FROM alerts a JOIN rules r ON {MATCH}""")
def _(spark, d):
    return G.notifications(match_rules(rules(spark), current_alerts(spark, d))).select("rule_id", "alert_id", "channel")


@reg.add("g13_drift_check", with_(SPANS, AGENTS, BASE, CUR, ANOM, CAUSES, B.ALERTS, ALERT.replace("6 HOUR", "1 HOUR")) + """
SELECT project_id, agents_checked, coalesce(anomalies_found, 0) AS anomalies_found, coalesce(alerts_created, 0) AS alerts_created
FROM (SELECT project_id, count(*) AS agents_checked FROM cur JOIN base USING (project_id, agent_name, service_name) GROUP BY 1)
LEFT JOIN (SELECT project_id, count(*) AS anomalies_found FROM anom GROUP BY 1) USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS alerts_created FROM fresh GROUP BY 1) USING (project_id)""")
def _(spark, d):
    return G.check_drift(spans(spark, d), current_alerts(spark, d), as_of(), sensitivity=SENSITIVITY)


@reg.add("g15_iqr_outliers", with_(SPANS) + """
, q AS (SELECT project_id, span_type, quantile_cont(duration_ms, 0.25) AS q1, quantile_cont(duration_ms, 0.75) AS q3 FROM spans GROUP BY ALL)
SELECT span_id, project_id, span_type, duration_ms, round(q1, 6) AS q1, round(q3, 6) AS q3 FROM spans JOIN q USING (project_id, span_type)
WHERE duration_ms < q1 - 1.5 * (q3 - q1) OR duration_ms > q3 + 1.5 * (q3 - q1)""")
def _(spark, d):
    return G.iqr_outliers(spans(spark, d), ["project_id", "span_type"], "duration_ms").select(
        "span_id", "project_id", "span_type", "duration_ms", "q1", "q3")


ACTIONS = f"""
actions AS (SELECT project_id, alert_id, (['acknowledge', 'dismiss', 'mute'])[seq % 3 + 1] AS action, seq % 48 + 1 AS hours FROM alerts)"""


@reg.add("g16_alert_updates", with_(EV, B.ALERTS, ACTIONS) + f"""
SELECT alert_id, project_id, severity, CASE action WHEN 'acknowledge' THEN 'acknowledged' WHEN 'dismiss' THEN 'dismissed' ELSE 'muted' END AS status,
  {ts_sql(f"CASE WHEN action = 'mute' THEN {AS_OF_SQL} + to_hours(hours) END")} AS mute_until
FROM alerts JOIN actions USING (project_id, alert_id)""")
def _(spark, d):
    rows = current_alerts(spark, d)
    seq = F.col("seq")
    actions = rows.select("project_id", "alert_id", B.pick(["acknowledge", "dismiss", "mute"], seq % 3).alias("action"),
                          (seq % 48 + 1).cast("int").alias("hours"), as_of().alias("acted_at"))
    changed = G.update_alerts(rows, actions)
    return V.apply_changes(rows.select("project_id", "alert_id", "severity", "status", "mute_until", "updated_at", "seq"),
                           changed.select("project_id", "alert_id", "severity", "status", "mute_until", "updated_at", "seq"),
                           ["project_id", "alert_id"], ["updated_at", "seq"]).select(
        "alert_id", "project_id", "severity", "status", "mute_until")
