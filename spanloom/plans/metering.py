"""Registered queries: quotas, overage billing, alerts, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost as H, errors as E, metering as M, rollup as R
from ..sources.readers import table
from . import bind as B
from .bind import AS_OF_SQL, EV, SPANS, TRACES, as_of, spans, sql_pick, traces, ts_sql, with_
from .cost import REC, stats
from .errors import J1, J8, ALTS
from .lookups import current_alerts
from .registry import Registry
from .rollups import E5

reg = Registry()
LIMITS = {"free": 1, "lunch-money": 2, "pro": 3, "enterprise": None}  # scaled to the data
LIMIT_SQL = "CASE tier WHEN 'free' THEN 1 WHEN 'lunch-money' THEN 2 WHEN 'pro' THEN 3 END"


def half(ts):
    """1 in the second half of a month, when every user has the next tier."""
    return (F.dayofmonth(ts) > 15).cast("int")


def accepted_sql(rows, keys, order, most, most0):
    """Rows with arrival, allowed and usage: one limit in each half of the month, usage grows on accepted rows."""
    return f"""
  SELECT *, quota IS NULL OR before + j <= quota AS allowed, CASE WHEN quota IS NULL THEN before + j ELSE greatest(before, least(before + j, quota)) END AS usage FROM (
    SELECT *, CASE WHEN half = 0 THEN 0 WHEN quota0 IS NULL THEN n0 ELSE least(n0, quota0) END AS before, CASE WHEN half = 0 THEN arrival ELSE arrival - n0 END AS j FROM (
      SELECT *, {most} AS quota, {most0} AS quota0, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS arrival,
        count(*) FILTER (WHERE half = 0) OVER (PARTITION BY {keys}) AS n0 FROM {rows}))"""


def arrivals(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("trace_no"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("arrived_at"), B.pick(B.TIERS, (F.col("o_custkey") + half("o_orderdate")) % 4).alias("tier"))


ARRIVALS = f"""
arrivals AS (SELECT o_orderkey AS trace_no, o_custkey AS user_id, o_orderdate AS arrived_at,
  strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END AS half, {sql_pick(B.TIERS, 'o_custkey % 4')} AS tier0,
  {sql_pick(B.TIERS, '(o_custkey + half) % 4')} AS tier FROM orders),
quota AS ({accepted_sql('arrivals', 'user_id, period', 'arrived_at, trace_no', LIMIT_SQL, LIMIT_SQL.replace('CASE tier', 'CASE tier0'))})"""


@reg.add("m1_monthly_usage", with_(ARRIVALS) + "SELECT user_id, period, count(*) AS usage FROM arrivals GROUP BY ALL")
def _(spark, d):
    return M.monthly_usage(arrivals(spark, d), "user_id", "arrived_at")


@reg.add("m2_quota_decisions", with_(ARRIVALS) + """
SELECT trace_no, user_id, period, tier, arrival, CAST(quota AS BIGINT) AS quota, allowed FROM quota""")
def _(spark, d):
    out = M.quota_decisions(arrivals(spark, d), "user_id", "arrived_at", "trace_no", "tier", LIMITS)
    return out.select("trace_no", "user_id", "period", "tier", "arrival", "quota", "allowed")


@reg.add("m3_remaining_quota", with_(ARRIVALS) + """
SELECT trace_no, CASE WHEN quota IS NOT NULL THEN CAST(greatest(0, quota - usage) AS BIGINT) END AS remaining FROM quota""")
def _(spark, d):
    return M.quota_decisions(arrivals(spark, d), "user_id", "arrived_at", "trace_no", "tier", LIMITS).select("trace_no", "remaining")


HARD, SOFT = {"hallucination": 5, "drift": 1, "debug": 3, "eval_generation": 2}, {
    "hallucination": 6, "drift": 1, "nlp": 2, "security": 6, "debug": 3, "eval_generation": 2}


def feature_calls(spark, d):
    uid = F.col("user_id")
    return B.events(spark, d).select(F.col("event_id").alias("call_id"), "user_id", B.pick(M.FEATURES, F.col("k") % 6).alias("feature"),
                                     F.col("ts").alias("used_at"), B.pick(B.TIERS, (uid + half("ts")) % 4).alias("tier"))


def case_of(mapping):
    return "CASE feature " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


MOST = "CASE tier WHEN 'enterprise' THEN NULL WHEN 'free' THEN 0 WHEN 'lunch-money' THEN cap ELSE lim * 5 END"
CALLS = f"""
calls AS (SELECT event_id AS call_id, user_id, {sql_pick(M.FEATURES, 'k % 6')} AS feature, ts AS used_at, strftime(ts, '%Y-%m') AS period,
  CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END AS half, {sql_pick(B.TIERS, 'user_id % 4')} AS tier0, {sql_pick(B.TIERS, '(user_id + half) % 4')} AS tier,
  coalesce({case_of(HARD)}, 0) AS cap, {case_of(SOFT)} AS lim FROM ev),
ranked AS ({accepted_sql('calls', 'user_id, feature, period', 'used_at, call_id', MOST, MOST.replace('CASE tier', 'CASE tier0'))})"""


@reg.add("m4_feature_decisions", with_(EV, CALLS) + """
SELECT call_id, user_id, feature, tier, arrival AS call_no, CASE WHEN NOT allowed THEN 'refused' WHEN tier = 'pro' AND usage > lim THEN 'overage' ELSE 'allowed' END AS decision
FROM ranked""")
def _(spark, d):
    return M.feature_decisions(feature_calls(spark, d), "call_id", HARD, SOFT).select(
        "call_id", "user_id", "feature", "tier", "call_no", "decision")


@reg.add("m5_feature_usage", with_(EV, CALLS) + f"""
SELECT c.user_id, c.feature, coalesce(u.n, 0) AS used, {case_of(M.SOFT_LIMITS).replace('CASE feature', 'CASE c.feature')} AS quota
FROM (SELECT c_custkey AS user_id, unnest({M.FEATURES}) AS feature FROM customer) c
LEFT JOIN (SELECT user_id, feature, count(*) AS n FROM calls GROUP BY ALL) u ON u.user_id = c.user_id AND u.feature = c.feature""")
def _(spark, d):
    return M.feature_usage(B.users(spark, d), feature_calls(spark, d))


@reg.add("m6_burst_decisions", with_(EV) + f"""
SELECT event_id, project_id, {ts_sql("window_start")} AS window_start, hit_no, hit_no <= 1 AS allowed FROM (
  SELECT event_id, 'p' || (user_id % 5) AS project_id, date_trunc('hour', ts) AS window_start,
    row_number() OVER (PARTITION BY user_id % 5, date_trunc('hour', ts) ORDER BY ts, event_id) AS hit_no FROM ev)""")
def _(spark, d):
    hits = B.events(spark, d).select("event_id", B.cat("p", F.col("user_id") % 5).alias("project_id"), "ts")
    return M.burst_decisions(hits, "project_id", "ts", "event_id", limit=1, unit="hour").drop("ts")


def meter_usage(spark, d):
    """Usage meters of a supplier account from its order lines."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        (F.sum("l_quantity") * 100).cast("long").alias("traces"), F.count_distinct("l_partkey").alias("users"),
        F.sum(F.col("l_linenumber").cast("long") * 7).alias("ai_hallucination_checks"), F.count("*").alias("ai_drift_baselines"),
        (F.sum("l_quantity").cast("long") % 5003).alias("ai_nlp_searches"), F.max(F.col("l_quantity").cast("long") * 3).alias("retention_days"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.lit(1)).otherwise(0)).alias("ai_debug_sessions"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.lit(2)).otherwise(0)).alias("ai_eval_generations"))


METER_ROWS = ", ".join(f"('{m}', {col}, {inc}, {unit}, {int(price * 100)})" for m, (col, inc, unit, price) in M.METERS.items())
OVERAGE = f"""
usage AS (SELECT l_suppkey, CAST(sum(l_quantity) * 100 AS BIGINT) AS traces, count(DISTINCT l_partkey) AS users,
    CAST(sum(l_linenumber * 7) AS BIGINT) AS ai_hallucination_checks, count(*) AS ai_drift_baselines,
    CAST(sum(l_quantity) AS BIGINT) % 5003 AS ai_nlp_searches, CAST(max(l_quantity) * 3 AS BIGINT) AS retention_days,
    count(*) FILTER (l_returnflag = 'A') AS ai_debug_sessions, 2 * count(*) FILTER (l_returnflag = 'R') AS ai_eval_generations
  FROM lineitem GROUP BY l_suppkey),
parts AS (SELECT l_suppkey, m.*, greatest(0, m.used - m.included) AS overage, greatest(0, m.used - m.included) * m.cents AS num
  FROM usage, LATERAL (VALUES {METER_ROWS}) m(meter, used, included, unit, cents)),
ov AS (SELECT l_suppkey, meter, used, included, overage, (num // unit + CASE WHEN 2 * (num % unit) > unit
    OR (2 * (num % unit) = unit AND (num // unit) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS cost FROM parts)"""


@reg.add("m7_overage_costs", with_(OVERAGE) + "SELECT l_suppkey, meter, used, included, overage, round(cost, 6) AS cost FROM ov")
def _(spark, d):
    return M.overage_lines(meter_usage(spark, d), ["l_suppkey"]).drop("meter_no")


@reg.add("m7_overage_totals", with_(OVERAGE) + "SELECT l_suppkey, round(sum(cost), 6) AS total FROM ov GROUP BY l_suppkey")
def _(spark, d):
    return M.overage_totals(M.overage_lines(meter_usage(spark, d), ["l_suppkey"]), ["l_suppkey"])


WIDE = ", ".join(f"round(max({c}) FILTER (meter = '{m}'), 6) AS {m}_{c}" for m in M.METERS for c in ("included", "used", "overage", "cost"))


@reg.add("m8_overage_record", with_(OVERAGE) + f"SELECT l_suppkey, {WIDE}, round(sum(cost), 6) AS total FROM ov GROUP BY l_suppkey")
def _(spark, d):
    return M.overage_record(M.overage_lines(meter_usage(spark, d), ["l_suppkey"]), ["l_suppkey"])


def accounts(spark, d):
    """Customers as accounts with a ten-day period."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 15).cast("int"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("account_id"), start.alias("period_start"), F.date_add(start, 10).alias("period_end"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit(120)).alias("retention_days"))


ACCOUNTS = """
accounts AS (SELECT c_custkey AS account_id, DATE '2024-01-01' + CAST(c_custkey % 15 AS INTEGER) AS period_start,
  DATE '2024-01-01' + CAST(c_custkey % 15 AS INTEGER) + 10 AS period_end, CASE WHEN c_custkey % 2 = 0 THEN 120 END AS retention_days FROM customer)"""
FEATURE_COLS = [("hallucination", "ai_hallucination_checks"), ("drift", "ai_drift_baselines"), ("nlp", "ai_nlp_searches"),
                ("debug", "ai_debug_sessions"), ("eval_generation", "ai_eval_generations")]


@reg.add("m9_period_usage", with_(EV, TRACES, CALLS, ACCOUNTS) + f"""
, t AS (SELECT account_id, count(*) AS n FROM accounts JOIN traces ON user_id = account_id AND CAST(started_at AS DATE) >= period_start
    AND CAST(started_at AS DATE) < period_end GROUP BY account_id),
f AS (SELECT account_id, {', '.join(f"count(*) FILTER (feature = '{a}') AS {b}" for a, b in FEATURE_COLS)} FROM accounts JOIN calls ON user_id = account_id
    AND CAST(used_at AS DATE) >= period_start AND CAST(used_at AS DATE) < period_end GROUP BY account_id),
p AS (SELECT o_custkey AS account_id, count(*) AS users FROM orders GROUP BY o_custkey)
SELECT account_id, coalesce(t.n, 0) AS traces, {', '.join(f'coalesce({b}, 0) AS {b}' for _, b in FEATURE_COLS)},
  greatest(coalesce(users, 0), 1) AS users, coalesce(retention_days, 90) AS retention_days
FROM accounts LEFT JOIN t USING (account_id) LEFT JOIN f USING (account_id) LEFT JOIN p USING (account_id)""")
def _(spark, d):
    tr = traces(spark, d).withColumn("user_id", F.regexp_extract("trace_id", r"^t(\d+)-", 1).cast("long"))
    people = table(spark, d, "orders").select(F.col("o_custkey").alias("account_id"))
    return M.period_usage(accounts(spark, d), M.daily_counts(tr, "user_id", "started_at"),
                          M.daily_counts(feature_calls(spark, d), "user_id", "used_at", "feature"), people
                          ).drop("period_start", "period_end")


@reg.add("m10_period_counters", with_(EV, TRACES, ACCOUNTS) + """
, u AS (SELECT user_id, CAST(started_at AS DATE) AS day FROM traces UNION ALL SELECT user_id, CAST(ts AS DATE) FROM ev)
SELECT account_id, count(u.user_id) AS usage FROM accounts LEFT JOIN u ON user_id = account_id AND day >= period_start AND day < period_end
GROUP BY account_id""")
def _(spark, d):
    tr = traces(spark, d).withColumn("user_id", F.regexp_extract("trace_id", r"^t(\d+)-", 1).cast("long"))
    return M.period_counters(accounts(spark, d), M.daily_counts(tr, "user_id", "started_at"),
                             M.daily_counts(B.events(spark, d), "user_id", "ts")).select("account_id", "usage")


@reg.add("m11_team_sizes", with_(B.MEMBERS) + "SELECT team_id, count(*) AS members FROM members GROUP BY team_id")
def _(spark, d):
    return M.team_sizes(B.members(spark, d))


# The metric rules of the binding
# (rule, project, agent, metric, window minutes, condition, threshold, severity, cooldown, channels).
METRIC_RULES = [
    ("a1", "p0", None, "error_rate", 1440, "gt", 0.1, "high", 60, ["email"]),
    ("a2", "p0", "agent5", "latency_p95", 10080, "gte", 50.0, "medium", 600, ["slack"]),
    ("a3", "p1", None, "latency_mean", 43200, "lt", 40.0, "low", 60, ["email"]),
    ("a4", "p1", "agent1", "cost_per_trace", 20160, "gt", 0.001, "critical", 1440, ["pagerduty", "email"]),
    ("a5", "p2", None, "success_rate", 4320, "lte", 0.95, "medium", 30, ["slack"]),
    ("a6", "p3", None, "token_usage", 10080, "gt", 1000.0, "high", 60, ["pagerduty"]),
    ("a7", "p4", "nobody", "error_rate", 10080, "gt", 0.0, "high", 60, ["email"]),
    ("a8", "p4", None, "latency_p95", 20160, "between", 1.0, "low", 60, ["email"]),
]
RULE_COLS = ("rule_id string, project_id string, agent_name string, metric_type string, window_minutes int, condition string, "
             "threshold double, severity string, cooldown_minutes int, channels array<string>, enabled boolean")


def metric_rules(spark):
    return spark.createDataFrame([(*r, True) for r in METRIC_RULES], RULE_COLS)


def lit(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


RULE_CTE = ("rules(rule_id, project_id, agent_name, metric_type, window_minutes, condition, threshold, severity, cooldown_minutes, channels) AS (VALUES "
            + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in METRIC_RULES) + ")")
M12 = f"""
m12 AS (SELECT r.rule_id, any_value(r.metric_type) AS metric_type, CASE any_value(r.metric_type)
    WHEN 'error_rate' THEN count(*) FILTER (s.status = 'error' OR s.error_code >= 400) / nullif(count(s.span_id), 0)
    WHEN 'success_rate' THEN count(*) FILTER (s.status <> 'error' AND coalesce(s.error_code, 0) < 400) / nullif(count(s.span_id), 0)
    WHEN 'latency_p95' THEN quantile_cont(s.duration_ms, 0.95) FILTER (s.span_type = 'llm')
    WHEN 'latency_mean' THEN avg(s.duration_ms) FILTER (s.span_type = 'llm')
    WHEN 'cost_per_trace' THEN sum(s.cost_usd) / nullif(count(DISTINCT s.trace_id), 0)
    WHEN 'token_usage' THEN CAST(sum(s.total_tokens) FILTER (s.span_type = 'llm') AS DOUBLE) END AS value
  FROM rules r LEFT JOIN spans s ON s.project_id = r.project_id AND (r.agent_name IS NULL OR r.agent_name = s.agent_name)
    AND s.started_at >= {AS_OF_SQL} - to_minutes(r.window_minutes) GROUP BY r.rule_id),
fired AS (SELECT r.*, m12.value FROM rules r JOIN m12 USING (rule_id) WHERE CASE r.condition WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold
  WHEN 'gte' THEN value >= threshold WHEN 'lte' THEN value <= threshold ELSE false END),
history AS (SELECT 'a' || (k % 8 + 1) AS rule_id, max(ts) AS last FROM ev WHERE event_type = 'error' AND k % 3 = 0 GROUP BY 1),
ready AS (SELECT f.* FROM fired f LEFT JOIN history h USING (rule_id) WHERE h.last IS NULL OR h.last <= {AS_OF_SQL} - to_minutes(f.cooldown_minutes))"""


def history(spark, d):
    return B.events(spark, d).where("event_type = 'error' AND k % 3 = 0").select(
        B.cat("a", F.col("k") % 8 + 1).alias("rule_id"), F.col("ts").alias("fired_at"))


def fired(spark, d):
    return M.fired_rules(M.rule_metrics(metric_rules(spark), spans(spark, d), as_of()))


@reg.add("m12_rule_metrics", with_(SPANS, RULE_CTE, M12) + "SELECT rule_id, metric_type, round(value, 6) AS value FROM m12")
def _(spark, d):
    return M.rule_metrics(metric_rules(spark), spans(spark, d), as_of()).select("rule_id", "metric_type", "value")


@reg.add("m13_fired_rules", with_(SPANS, RULE_CTE, M12) + "SELECT rule_id, round(value, 6) AS value, condition, threshold::DOUBLE AS threshold FROM fired")
def _(spark, d):
    return fired(spark, d).select("rule_id", "value", "condition", "threshold")


@reg.add("m14_after_cooldown", with_(SPANS, RULE_CTE, M12) + "SELECT rule_id, round(value, 6) AS value FROM ready")
def _(spark, d):
    return M.outside_cooldown(fired(spark, d), history(spark, d), as_of()).select("rule_id", "value")


@reg.add("m15_dispatch_rows", with_(SPANS, RULE_CTE, M12) + f"""
SELECT rule_id, project_id, unnest(channels) AS channel, metric_type, round(value, 6) AS value, condition, threshold::DOUBLE AS threshold, severity,
  CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END AS pager_severity,
  'rule-' || rule_id AS dedup_key, {ts_sql(AS_OF_SQL)} AS fired_at FROM ready""")
def _(spark, d):
    return M.dispatch_rows(M.outside_cooldown(fired(spark, d), history(spark, d), as_of()), as_of())


def health_inputs(spark, d):
    s = stats(spark, d)
    recs = H.recommend_models(s, min_calls=10, min_savings=0.05)
    saving = recs.groupBy("project_id").agg(F.sum("monthly_savings").alias("monthly_savings"))
    savings = s.groupBy("project_id").agg(F.sum("total_cost_usd").alias("total_cost_usd")).join(saving, "project_id", "left")
    findings = B.violations(spark, d).groupBy("project_id").agg((F.count("*") / 50).cast("long").alias("findings"))
    drift = current_alerts(spark, d).where("status = 'active'").groupBy("project_id").agg(F.count("*").alias("alerts"))
    return savings, findings, drift


SINCE = f"{AS_OF_SQL} - INTERVAL 30 DAY"
HEALTH = f"""
{B.ALERTS.strip()}, {B.VIOLATIONS.strip()},
cost AS (SELECT project_id, sum(total_cost_usd) AS c FROM h2 GROUP BY 1),
saving AS (SELECT project_id, sum(monthly_savings) AS s FROM h6 WHERE call_count >= 10 AND monthly_savings >= 0.05 AND latency_change_pct <= 20 GROUP BY 1),
viol AS (SELECT project_id, count(*) // 50 AS n FROM violations GROUP BY 1),
act AS (SELECT project_id, count(*) AS n FROM alerts WHERE status = 'active' GROUP BY 1),
tot AS (SELECT project_id, count(*) AS n, count(*) FILTER (status = 'error') AS e FROM traces WHERE started_at >= {SINCE} GROUP BY 1),
rates AS (SELECT project_id, t.n AS trace_count, e / t.n AS error_rate, coalesce(s / (c * 30 / 30.0::DOUBLE) * 100, 0) AS waste_pct,
  least(coalesce(viol.n, 0) / t.n, 1.0::DOUBLE) AS security_rate, least(coalesce(act.n, 0) / t.n, 1.0::DOUBLE) AS drift_rate
  FROM tot t LEFT JOIN cost USING (project_id) LEFT JOIN saving USING (project_id) LEFT JOIN viol USING (project_id) LEFT JOIN act USING (project_id))"""


def score(err):
    return (f"greatest(0.0, least(100.0, round(100.0::DOUBLE - {err} * 30 - waste_pct * 15 - security_rate * 15 - drift_rate * 15, 1)))::DOUBLE")


@reg.add("m16_health_trend", REC.rstrip() + "," + TRACES + "," + HEALTH + f"""
SELECT project_id, date, trace_count, error_count, {score('error_count / trace_count')} AS health_score FROM (
  SELECT project_id, CAST(started_at AS DATE) AS date, count(*) AS trace_count, count(*) FILTER (status = 'error') AS error_count
  FROM traces WHERE started_at >= {SINCE} GROUP BY 1, 2) JOIN (SELECT project_id, waste_pct, security_rate, drift_rate FROM rates) USING (project_id)""")
def _(spark, d):
    savings, findings, drift = health_inputs(spark, d)
    return M.project_health(traces(spark, d), savings, findings, drift, as_of() - F.expr("INTERVAL 30 DAY"), 30, daily=True).select(
        "project_id", "date", "trace_count", "error_count", "health_score")


@reg.add("m17_insights_summary", REC.rstrip() + "," + TRACES + "," + HEALTH + "," + J1 + "," + ALTS + "," + J8 + f"""
SELECT project_id, trace_count, round(error_rate, 6) AS error_rate, {score('error_rate')} AS health_score, round(waste_pct, 6) AS waste_pct,
  round(c, 6) AS total_cost_usd, round(coalesce(s, 0), 6) AS potential_savings, category AS top_issue, error_count AS top_issue_count, recommendation,
  coalesce(viol.n, 0) AS findings, coalesce(act.n, 0) AS active_alerts, coalesce(ag.n, 0) AS agents_affected
FROM rates LEFT JOIN cost USING (project_id) LEFT JOIN saving USING (project_id) LEFT JOIN viol USING (project_id) LEFT JOIN act USING (project_id)
LEFT JOIN (SELECT project_id, count(DISTINCT agent_name) AS n FROM alerts WHERE status = 'active' GROUP BY 1) ag USING (project_id)
LEFT JOIN (SELECT * FROM j8 WHERE rank = 1) USING (project_id)""")
def _(spark, d):
    savings, findings, drift = health_inputs(spark, d)
    health = M.project_health(traces(spark, d), savings, findings, drift, as_of() - F.expr("INTERVAL 30 DAY"), 30)
    agents = current_alerts(spark, d).where("status = 'active'").groupBy("project_id").agg(
        F.count_distinct("agent_name").alias("agents_affected"))
    issues = E.top_issues(E.classify(spans(spark, d)), k=1).select(
        "project_id", F.col("category").alias("top_issue"), F.col("error_count").alias("top_issue_count"), "recommendation")
    return health.join(issues, "project_id", "left").join(agents, "project_id", "left").select(
        "project_id", "trace_count", "error_rate", "health_score", "waste_pct", "total_cost_usd",
        F.coalesce("monthly_savings", F.lit(0.0)).alias("potential_savings"), "top_issue", "top_issue_count", "recommendation",
        F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("alerts", F.lit(0)).alias("active_alerts"),
        F.coalesce("agents_affected", F.lit(0)).alias("agents_affected"))
