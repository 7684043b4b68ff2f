"""Registered queries: lists, detail views, joins, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import latest_per_key
from ..operators import access as J, analytics, errors, lookup as L, versions as V
from ..sources.readers import table
from . import bind as B
from .bind import AS_OF_SQL, EV, SPANS, TRACES, as_of, spans, traces, ts_sql, with_
from .registry import Registry

reg = Registry()
HOURS_7D = f"{AS_OF_SQL} - INTERVAL 7 DAY"


def week_ago():
    return as_of() - F.expr("INTERVAL 7 DAY")


def current_alerts(spark, d):
    return V.current(B.alert_versions(spark, d), ["project_id", "alert_id"], ["updated_at", "seq"])


TRACE_COLS = f"""trace_id, project_id, service_name, {ts_sql('started_at')} AS started_at, status, span_count"""


# ---- B: lists and lookups ----------------------------------------------------------
@reg.add("b1_list_traces", with_(EV, TRACES) + f"""
SELECT {TRACE_COLS} FROM traces WHERE project_id = 'p1' AND status = 'error' AND started_at >= {AS_OF_SQL} - INTERVAL 20 DAY
ORDER BY traces.started_at DESC, trace_id""")
def _(spark, d):
    return L.list_traces(traces(spark, d), project="p1", status="error",
                         start=as_of() - F.expr("INTERVAL 20 DAY")).select(
        "trace_id", "project_id", "service_name", "started_at", "status", "span_count")


@reg.add("b2_traces_of_agent", with_(SPANS, TRACES) + f"""
SELECT {TRACE_COLS} FROM traces WHERE agent_name = 'agent3'
  OR trace_id IN (SELECT DISTINCT trace_id FROM spans WHERE agent_name = 'agent3')""")
def _(spark, d):
    return L.traces_of_agent(traces(spark, d), spans(spark, d), "agent3").select(
        "trace_id", "project_id", "service_name", "started_at", "status", "span_count")


@reg.add("b3_spans_in_order", with_(SPANS) + """
SELECT trace_id, span_id, name, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) AS position
FROM spans""")
def _(spark, d):
    return L.spans_in_order(spans(spark, d)).select("trace_id", "span_id", "name", "position")


@reg.add("b4_trace_pages", with_(SPANS, TRACES) + """
SELECT trace_id, page, string_agg(span_id || ':' || name, '|' ORDER BY position) AS spans, any_value(t.project_id) AS project_id,
  any_value(t.service_name) AS service_name, any_value(t.status) AS status, any_value(t.span_count) AS span_count
FROM (SELECT *, (position - 1) // 5 + 1 AS page FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) AS position FROM spans)) s
JOIN traces t USING (trace_id) GROUP BY trace_id, page""")
def _(spark, d):
    pages = L.trace_pages(traces(spark, d), spans(spark, d), page_size=5)
    return pages.withColumn("spans", F.transform("spans", lambda s: F.concat_ws(":", s["span_id"], s["name"])))


@reg.add("b5_search", with_(SPANS) + f"""
SELECT DISTINCT term, trace_id, service_name, {ts_sql('started_at')} AS started_at, status
FROM spans JOIN (VALUES ('purchase'), ('timeout'), ('Workflow 3')) q(term)
  ON contains(name, term) OR contains(coalesce(error_message, ''), term) OR contains(coalesce(workflow_name, ''), term)""")
def _(spark, d):
    return L.search(spans(spark, d), ["purchase", "timeout", "Workflow 3"])


@reg.add("b7_active_drift_alerts", with_(EV, B.ALERTS) + f"""
SELECT alert_id, project_id, agent_name, severity, status, {ts_sql('detected_at')} AS detected_at
FROM alerts WHERE status = 'active' OR (status = 'muted' AND mute_until > TIMESTAMP '2024-01-31 00:00:00')""")
def _(spark, d):
    rows = L.active_alerts(current_alerts(spark, d), as_of())
    order = [F.desc("severity_rank"), F.desc("detected_at"), F.col("alert_id")]
    return L.newest(rows, order, None).select("alert_id", "project_id", "agent_name", "severity", "status", "detected_at")


@reg.add("b8_guardrail_violations", with_(EV, B.VIOLATIONS) + f"""
SELECT violation_id, project_id, guard_name, phase, action, {ts_sql('detected_at')} AS detected_at
FROM violations WHERE project_id = 'p2' AND action = 'block' AND phase = 'input'
  AND detected_at >= {AS_OF_SQL} - INTERVAL 480 HOUR ORDER BY violations.detected_at DESC, violation_id""")
def _(spark, d):
    rows = L.filter_all(B.violations(spark, d), project_id="p2", action="block", phase="input")
    rows = rows.where(F.col("detected_at") >= as_of() - F.expr("INTERVAL 480 HOUR"))
    return L.newest(rows, [F.desc("detected_at"), F.col("violation_id")], None)


@reg.add("b9_agent_runs", with_(EV, TRACES) + f"""
SELECT trace_id, coalesce(nullif(run_id, ''), trace_id) AS execution_id, framework, service_name, lower(status) AS status,
  {ts_sql('started_at')} AS started_at, round(duration_ms, 6) AS duration_ms, num_agents, num_tasks,
  coalesce(num_messages, 0) AS num_messages
FROM traces WHERE framework IS NOT NULL AND started_at >= {HOURS_7D}""")
def _(spark, d):
    return L.agent_runs(traces(spark, d), week_ago(), limit=None)


@reg.add("b10_paginated_violations", with_(EV, B.VIOLATIONS) + f"""
SELECT violation_id, guard_name, {ts_sql('detected_at')} AS detected_at, (SELECT count(*) FROM violations) AS total
FROM violations ORDER BY violations.detected_at DESC, violation_id LIMIT 25 OFFSET 50""")
def _(spark, d):
    rows = B.violations(spark, d).select("violation_id", "guard_name", "detected_at")
    return L.paginate(rows, [F.desc("detected_at"), F.col("violation_id")], page=3, page_size=25)


@reg.add("b12_latest_prompts", with_(EV, B.PROMPTS) + """
SELECT project_id, name, version, template, model, array_to_string(tags, '|') AS tags FROM (
  SELECT * FROM prompts QUALIFY row_number() OVER (PARTITION BY project_id, name ORDER BY version DESC) = 1)
WHERE list_contains(tags, 't1') AND contains(name, 'prompt')""")
def _(spark, d):
    return V.latest_prompts(B.prompts(spark, d), tag="t1", name_like="prompt").drop("promoted_stages")


@reg.add("b13_prompt_at_stage", with_(EV, B.PROMPTS) + """
SELECT project_id, name, version, template FROM prompts WHERE list_contains(promoted_stages, 'production')
QUALIFY row_number() OVER (PARTITION BY project_id, name ORDER BY version DESC) = 1""")
def _(spark, d):
    return V.prompt_at_stage(B.prompts(spark, d), "production").select("project_id", "name", "version", "template")


@reg.add("b14_prompt_history", with_(EV, B.PROMPTS) + """
SELECT project_id, name, version, template, lag(version) OVER w AS previous_version,
  lag(version) OVER w IS NOT NULL AND template IS DISTINCT FROM lag(template) OVER w AS template_changed
FROM prompts WINDOW w AS (PARTITION BY project_id, name ORDER BY version)""")
def _(spark, d):
    return V.prompt_history(B.prompts(spark, d)).select(
        "project_id", "name", "version", "template", "previous_version", "template_changed")


@reg.add("b15_cached_analysis", with_(EV) + f"""
SELECT trace_id, project_id, analysis_type, {ts_sql('ts')} AS created_at, event_id AS result_id FROM (
  SELECT *, 'p' || (user_id % 5) AS project_id, {B.sql_pick(['security', 'debug', 'errors'], 'k % 3')} AS analysis_type FROM ev)
QUALIFY row_number() OVER (PARTITION BY project_id, analysis_type, trace_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, d):
    rows = B._with_trace_id(B.events(spark, d)).select(
        "trace_id", B.cat("p", F.col("user_id") % 5).alias("project_id"),
        B.pick(["security", "debug", "errors"], F.col("k") % 3).alias("analysis_type"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("result_id"))
    return L.cached_analysis(rows)


@reg.add("b16_timeline", with_(SPANS, TRACES) + """
SELECT s.trace_id, s.span_id AS node_id, s.name AS node_name, s.span_type AS node_type,
  round((epoch_us(s.started_at) - epoch_us(t.started_at)) / 1000.0::DOUBLE, 1) AS start_offset_ms,
  round(s.duration_ms, 1) AS duration_ms, s.status,
  s.span_type IN ('llm', 'embedding') OR coalesce(regexp_matches(lower(s.node_type), 'openai|anthropic|langchain|vector|embedding'), false) AS is_ai_node
FROM spans s JOIN traces t USING (trace_id)""")
def _(spark, d):
    return L.timeline(traces(spark, d), spans(spark, d))


@reg.add("b17_run_detail", with_(EV, B.TASK_SPANS) + """
, a AS (SELECT trace_id, agent_name, min(ROW(started_at, span_id)) AS f FROM task_spans WHERE agent_name IS NOT NULL GROUP BY ALL),
u AS (SELECT trace_id, string_agg(agent_name, '|' ORDER BY f) AS agents_used FROM a GROUP BY trace_id),
c AS (SELECT trace_id, count(*) FILTER (agent_name IS NOT NULL) AS agent_spans,
    count(*) FILTER (task_id IS NOT NULL OR description IS NOT NULL) AS task_spans,
    count(*) FILTER (content IS NOT NULL OR span_type = 'custom') AS message_spans FROM task_spans GROUP BY trace_id)
SELECT trace_id, agent_spans, task_spans, message_spans, coalesce(agents_used, '') AS agents_used
FROM c LEFT JOIN u USING (trace_id) WHERE agent_spans + task_spans + message_spans > 0""")
def _(spark, d):
    return L.run_detail(B.task_spans(spark, d))


@reg.add("b18_tasks", with_(EV, B.TASK_SPANS) + f"""
SELECT span_id, coalesce(task_id, span_id) AS task_id,
  CASE WHEN description IS NOT NULL THEN description ELSE string_split(name, '.')[-1] END AS task_name,
  '' AS description, '' AS expected_output,
  coalesce(agent_name, CASE WHEN string_split(name, '.')[-2] = 'agent' THEN string_split(name, '.')[-1] ELSE '' END) AS assigned_agent,
  {ts_sql('started_at')} AS started_at, duration_ms, lower(status) AS status
FROM task_spans WHERE task_id IS NOT NULL OR description IS NOT NULL""")
def _(spark, d):
    return L.list_tasks(B.task_spans(spark, d))


@reg.add("b19_accessible_projects", with_(B.MEMBERS) + """
SELECT DISTINCT user_id, project_id FROM members JOIN project_teams USING (team_id)
WHERE role IN ('member', 'admin', 'owner')""")
def _(spark, d):
    return J.accessible_projects(B.members(spark, d), B.project_teams(spark, d), "member")


@reg.add("b19_visible_traces", with_(EV, TRACES, B.MEMBERS, B.PROJECTS) + """
SELECT trace_id, project_id, status FROM traces WHERE project_id IN (
  SELECT project_id FROM members JOIN project_teams USING (team_id) WHERE user_id = 7
  UNION SELECT project_id FROM projects WHERE project_id NOT IN (SELECT project_id FROM project_teams))""")
def _(spark, d):
    granted = J.accessible_projects(B.members(spark, d), B.project_teams(spark, d))
    unassigned = J.unassigned_projects(B.projects(spark, d), B.project_teams(spark, d))
    return J.visible_facts(traces(spark, d).select("trace_id", "project_id", "status"), granted, unassigned, 7)


COMMENTS = """
comments AS (SELECT 't' || conv_id AS trace_id, turn AS comment_id, turn - 1 AS parent_comment_id, conv_id AS user_id,
  text AS content FROM conversations)"""


@reg.add("b20_comment_threads", with_(COMMENTS) + """
SELECT c.trace_id, c.comment_id, c.user_id, u.c_name AS full_name, md5(c.content) AS content_md5, md5(p.content) AS parent_md5
FROM comments c JOIN customer u ON u.c_custkey = c.user_id
LEFT JOIN comments p ON p.trace_id = c.trace_id AND p.comment_id = c.parent_comment_id""")
def _(spark, d):
    comments = table(spark, d, "conversations").select(
        B.cat("t", F.col("conv_id")).alias("trace_id"), F.col("turn").alias("comment_id"),
        (F.col("turn") - 1).alias("parent_comment_id"), F.col("conv_id").alias("user_id"), F.col("text").alias("content"))
    out = J.comment_threads(comments, B.users(spark, d).select("user_id", "full_name"))
    return out.select("trace_id", "comment_id", "user_id", "full_name", F.md5("content").alias("content_md5"),
                      F.md5("parent_content").alias("parent_md5"))


@reg.add("b21_project_slugs", """
SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM part""")
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", L.project_slug(B.cat("  ", F.col("p_name"), " / ", F.col("p_brand"), "!")).alias("slug"))


@reg.add("b22_tier_gate", with_(B.SUBSCRIPTIONS) + """
SELECT subscription_id, user_id, tier FROM subscriptions WHERE tier IN ('pro', 'enterprise')""")
def _(spark, d):
    return J.tier_at_least(B.subscriptions(spark, d), "pro").select("subscription_id", "user_id", "tier")


# ---- C: join shapes ---------------------------------------------------------------------
@reg.add("c1_project_stats", with_(EV, TRACES, B.PROJECTS) + f"""
SELECT p.project_id, p.name, count(t.trace_id) FILTER (t.started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS trace_count_24h,
  count(DISTINCT t.workflow_id) AS workflow_count FROM projects p LEFT JOIN traces t USING (project_id) GROUP BY ALL""")
def _(spark, d):
    return J.project_stats(B.projects(spark, d), traces(spark, d), as_of())


@reg.add("c2_llm_span_counts", with_(SPANS, TRACES) + """
SELECT trace_id, coalesce(n, 0) AS llm_span_count FROM traces LEFT JOIN (
  SELECT trace_id, count(*) AS n FROM spans WHERE span_type = 'llm' GROUP BY trace_id) USING (trace_id)""")
def _(spark, d):
    return J.with_llm_span_count(traces(spark, d), spans(spark, d)).select("trace_id", "llm_span_count")


@reg.add("c4_traces_with_errors", with_(SPANS, TRACES) + """
SELECT trace_id, span_count FROM traces WHERE trace_id IN (SELECT trace_id FROM spans WHERE status = 'error')""")
def _(spark, d):
    return J.traces_with_error_span(traces(spark, d), spans(spark, d)).select("trace_id", "span_count")


@reg.add("c5_latest_version_tuples", with_(EV, B.PROMPTS) + """
SELECT project_id, name, version, template FROM prompts WHERE (project_id, name, version) IN (
  SELECT (project_id, name, max(version)) FROM prompts GROUP BY project_id, name)""")
def _(spark, d):
    rows = B.prompts(spark, d)
    newest = rows.groupBy("project_id", "name").agg(F.max("version").alias("version"))
    return rows.join(newest, ["project_id", "name", "version"], "left_semi").select("project_id", "name", "version", "template")


@reg.add("c6_missing_projects", with_(EV, TRACES, B.MEMBERS) + f"""
SELECT project_id, {ts_sql('min(started_at)')} AS created_at FROM traces
WHERE project_id NOT IN (SELECT project_id FROM project_teams) GROUP BY project_id""")
def _(spark, d):
    return J.missing_projects(traces(spark, d), B.project_teams(spark, d))


@reg.add("c7_spans_under_traces", with_(SPANS, TRACES) + """
SELECT t.trace_id, t.status, count(*) FILTER (span_type = 'agent') AS agent_spans, count(*) FILTER (span_type = 'llm') AS llm_spans,
  count(*) FILTER (span_type = 'tool') AS tool_spans, count(*) FILTER (span_type = 'retrieval') AS retrieval_spans
FROM traces t JOIN spans s USING (trace_id) GROUP BY ALL""")
def _(spark, d):
    return J.span_totals_by_trace(traces(spark, d).select("project_id", "trace_id", "status"), spans(spark, d)).drop("project_id")


# The rule set of the binding.
RULES = [
    ("r1", "p0", None, 2, None, ["email"]), ("r2", "p0", "agent5", 1, "duration", ["slack"]),
    ("r3", "p1", "agent1", 3, None, ["email", "slack"]), ("r4", "p1", None, 4, "token_usage", ["pagerduty"]),
    ("r5", "p2", None, 1, None, ["email"]), ("r6", "p3", "agent3", 2, None, ["slack", "pagerduty"]),
    ("r7", "p4", None, 3, "success_rate", ["email"]), ("r8", "p4", "agent9", 1, None, ["slack"]),
]


def rules(spark):
    return spark.createDataFrame(
        [(r, p, a, s, m, c, True) for r, p, a, s, m, c in RULES],
        "rule_id string, project_id string, agent_name string, severity_rank int, metric_name string, "
        "channels array<string>, enabled boolean")


def _sql_text(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


RULES_CTE = "rules(rule_id, project_id, agent_name, severity_rank, metric_name, channels) AS (VALUES " + ", ".join(
    f"({_sql_text(r)}, {_sql_text(p)}, {_sql_text(a)}, {s}, {_sql_text(m)}, {c})" for r, p, a, s, m, c in RULES) + ")"
MATCH = """a.project_id = r.project_id AND (r.agent_name IS NULL OR r.agent_name = a.agent_name)
  AND r.severity_rank <= a.severity_rank"""


@reg.add("c8_rule_match", with_(EV, B.ALERT_VERSIONS, RULES_CTE) + f"""
SELECT r.rule_id, a.alert_id, a.seq FROM alert_versions a JOIN rules r ON {MATCH}
  AND (r.metric_name IS NULL OR r.metric_name = a.metric_name)""")
def _(spark, d):
    return J.match_rules(rules(spark), B.alert_versions(spark, d), honour_metric=True).select("rule_id", "alert_id", "seq")


KEYS = f"""
api_keys AS (SELECT c_custkey AS api_key_id, c_custkey AS user_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {AS_OF_SQL} + to_hours(CAST((c_custkey % 7) - 3 AS BIGINT)) END AS expires_at FROM customer)"""


@reg.add("c12_key_owners", with_(KEYS, B.SUBSCRIPTIONS) + f"""
SELECT k.api_key_id, user_id, c_name AS full_name, s.tier, s.subscription_id FROM api_keys k
JOIN customer c ON c.c_custkey = k.user_id
JOIN (SELECT * FROM subscriptions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id DESC) = 1) s
  USING (user_id) WHERE k.expires_at IS NULL OR k.expires_at > {AS_OF_SQL}""")
def _(spark, d):
    u = B.users(spark, d)
    keys = u.select(F.col("user_id").alias("api_key_id"), "user_id", F.when(
        F.col("user_id") % 3 != 0, as_of() + F.make_dt_interval(F.lit(0), (F.col("user_id") % 7 - 3).cast("int"))).alias("expires_at"))
    out = J.key_owners(keys, u.select("user_id", "full_name"), B.subscriptions(spark, d), as_of())
    return out.select("api_key_id", "user_id", "full_name", "tier", "subscription_id")


@reg.add("c13_member_list", with_(B.MEMBERS) + """
SELECT team_id, user_id, role, c_name AS full_name FROM members JOIN customer ON c_custkey = user_id""")
def _(spark, d):
    return J.member_list(B.members(spark, d), B.users(spark, d).select("user_id", "full_name"))


PERSONAL = "personal AS (SELECT c_custkey AS owner_id, 'personal-' || c_custkey AS team_id FROM customer WHERE c_custkey % 3 <> 0)"


@reg.add("c14_backfill_team", with_(B.SUBSCRIPTIONS, PERSONAL) + """
SELECT subscription_id, user_id, coalesce(CASE WHEN subscription_id % 5 = 0 THEN 'team' || (user_id % 4) END, p.team_id) AS team_id
FROM subscriptions LEFT JOIN personal p ON p.owner_id = user_id""")
def _(spark, d):
    subs = B.subscriptions(spark, d).select("subscription_id", "user_id", F.when(
        F.col("subscription_id") % 5 == 0, B.cat("team", F.col("user_id") % 4)).alias("team_id"))
    teams = B.users(spark, d).where("user_id % 3 <> 0").select(
        F.col("user_id").alias("owner_id"), B.cat("personal-", F.col("user_id")).alias("team_id"))
    return J.backfill_team(subs, teams)


# ---- N: versions, retention, evolution -----------------------------------------------------
@reg.add("n1_latest_version", with_(EV, B.ALERTS) + f"""
SELECT alert_id, project_id, severity, status, {ts_sql('updated_at')} AS updated_at, seq FROM alerts""")
def _(spark, d):
    return current_alerts(spark, d).select("alert_id", "project_id", "severity", "status", "updated_at", "seq")


@reg.add("n2_retention", with_(SPANS) + f"""
SELECT span_id, project_id, {ts_sql('started_at')} AS started_at FROM spans
WHERE started_at >= {AS_OF_SQL} - to_days(CASE project_id WHEN 'p0' THEN 3 WHEN 'p1' THEN 20 ELSE 10 END)""")
def _(spark, d):
    rows = spans(spark, d).withColumn("_keep", F.when(F.col("project_id") == "p0", 3).when(F.col("project_id") == "p1", 20))
    return V.retain(rows, "started_at", as_of(), 10, "_keep").select("span_id", "project_id", "started_at")


@reg.add("n3_soft_delete", with_(EV, B.ALERT_VERSIONS) + f"""
, changes AS (SELECT alert_id, project_id, status, updated_at + INTERVAL 1 SECOND AS updated_at, seq, status = 'dismissed' AS deleted FROM alert_versions
  WHERE status IN ('dismissed', 'muted')),
merged AS (SELECT alert_id, project_id, status, updated_at, seq, false AS deleted FROM alert_versions UNION ALL SELECT * FROM changes)
SELECT alert_id, project_id, status, {ts_sql('updated_at')} AS updated_at, seq FROM (
  SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY project_id, alert_id ORDER BY updated_at DESC, seq DESC) = 1)
WHERE NOT deleted""")
def _(spark, d):
    base = B.alert_versions(spark, d).select("alert_id", "project_id", "status", "updated_at", "seq", F.lit(False).alias("deleted"))
    changes = base.where("status IN ('dismissed', 'muted')").withColumns({
        "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 SECOND"), "deleted": F.col("status") == "dismissed"})
    return V.apply_changes(base, changes, ["project_id", "alert_id"], ["updated_at", "seq"], "deleted").drop("deleted")


def prompt_requests(spark, d):
    """One request per customer; every second leaves tags and model out."""
    u = F.col("user_id")
    return B.users(spark, d).select(
        B.cat("p", u % 5).alias("project_id"), B.cat("prompt", u % 100).alias("name"), B.cat("new ", u).alias("template"),
        F.when(u % 2 == 0, F.array(F.lit("fresh"))).alias("tags"), F.when(u % 3 == 0, "gpt-4o").alias("model"))


REQUESTS = """
requests AS (SELECT 'p' || (c_custkey % 5) AS project_id, 'prompt' || (c_custkey % 100) AS name, 'new ' || c_custkey AS template,
  CASE WHEN c_custkey % 2 = 0 THEN ['fresh'] END AS tags, CASE WHEN c_custkey % 3 = 0 THEN 'gpt-4o' END AS model FROM customer)"""
LATEST_PROMPT = "(SELECT * FROM prompts QUALIFY row_number() OVER (PARTITION BY project_id, name ORDER BY version DESC) = 1)"


@reg.add("n4_next_prompt_version", with_(EV, B.PROMPTS, REQUESTS) + f"""
SELECT project_id, name, r.template, p.version + 1 AS version, array_to_string(coalesce(r.tags, p.tags), '|') AS tags,
  coalesce(r.model, p.model) AS model FROM requests r JOIN {LATEST_PROMPT} p USING (project_id, name)""")
def _(spark, d):
    return V.next_prompt_versions(B.prompts(spark, d), prompt_requests(spark, d))


@reg.add("n4_create_prompt", with_(EV, B.PROMPTS, REQUESTS) + """
SELECT project_id, name, template, CAST(1 AS BIGINT) AS version FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM prompts p WHERE p.project_id = r.project_id AND p.name = r.name)""")
def _(spark, d):
    return V.new_prompts(B.prompts(spark, d), prompt_requests(spark, d)).select("project_id", "name", "template", "version")


@reg.add("n5_promote_stage", with_(EV, B.PROMPTS) + """
, target AS (SELECT project_id, name, max(version) AS version FROM prompts WHERE template LIKE 'click%' GROUP BY ALL)
SELECT p.project_id, p.name, p.version, array_to_string(CASE WHEN t.version IS NULL THEN p.promoted_stages
  WHEN t.version = p.version THEN CASE WHEN list_contains(p.promoted_stages, 'production') THEN p.promoted_stages
    ELSE list_append(p.promoted_stages, 'production') END
  ELSE list_filter(p.promoted_stages, lambda x: x <> 'production') END, '|') AS promoted_stages
FROM prompts p LEFT JOIN target t USING (project_id, name)""")
def _(spark, d):
    rows = B.prompts(spark, d)
    target = rows.where(F.col("template").startswith("click")).groupBy("project_id", "name").agg(
        F.max("version").alias("version")).withColumn("stage", F.lit("production"))
    return V.promote(rows, target).select("project_id", "name", "version", "promoted_stages")


@reg.add("n6_schema_evolution", with_(SPANS) + """
SELECT span_id, project_id, CASE WHEN CAST(span_id AS BIGINT) % 2 = 0 THEN 'native' ELSE 'otlp' END AS source FROM spans""")
def _(spark, d):
    rows = spans(spark, d).select("span_id", "project_id")
    return V.evolve(rows.where("span_id % 2 = 0"), rows.where("span_id % 2 = 1").withColumn("source", F.lit("otlp")),
                    {"source": "native"})


@reg.add("n7_missing_personal_teams", with_(PERSONAL) + """
SELECT c_custkey AS user_id, 'personal-' || c_custkey AS slug FROM customer
WHERE c_custkey NOT IN (SELECT owner_id FROM personal)""")
def _(spark, d):
    u = B.users(spark, d).select("user_id")
    teams = u.where("user_id % 3 <> 0").select(F.col("user_id").alias("owner_id"),
                                             B.cat("personal-", F.col("user_id")).alias("slug"))
    return J.missing_personal_teams(u, teams)


# ---- projects that share trace ids ---------------------------------------------------------
def _tenants(spark, d):
    return B.shared_ids(traces(spark, d)), B.shared_ids(spans(spark, d))


def _tenant_query(name, sql, of, *ctes):
    @reg.add(f"{name}_two_tenants", with_(B.SHARED_SPANS, B.SHARED_TRACES, *ctes) + sql)
    def _(spark, d):
        return of(*_tenants(spark, d))


_tenant_query("b2_traces_of_agent", """
SELECT project_id, trace_id, span_count FROM traces WHERE agent_name = 'agent3'
  OR (project_id, trace_id) IN (SELECT (project_id, trace_id) FROM spans WHERE agent_name = 'agent3')""",
              lambda t, s: L.traces_of_agent(t, s, "agent3").select("project_id", "trace_id", "span_count"))
_tenant_query("b3_spans_in_order", """
SELECT project_id, trace_id, span_id, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY started_at, span_id) AS position FROM spans""",
              lambda t, s: L.spans_in_order(s).select("project_id", "trace_id", "span_id", "position"))
_tenant_query("b4_trace_pages", """
SELECT project_id, trace_id, page, string_agg(span_id, '|' ORDER BY position) AS spans, any_value(t.span_count) AS span_count
FROM (SELECT *, (position - 1) // 5 + 1 AS page FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY started_at, span_id) AS position FROM spans)) s
JOIN traces t USING (project_id, trace_id) GROUP BY project_id, trace_id, page""",
              lambda t, s: L.trace_pages(t, s, page_size=5).select("project_id", "trace_id", "page", "span_count", F.transform("spans", lambda x: x["span_id"]).alias("spans")))
_tenant_query("c2_llm_span_counts", """
SELECT project_id, trace_id, coalesce(n, 0) AS llm_span_count FROM traces LEFT JOIN (
  SELECT project_id, trace_id, count(*) AS n FROM spans WHERE span_type = 'llm' GROUP BY ALL) USING (project_id, trace_id)""",
              lambda t, s: J.with_llm_span_count(t, s).select("project_id", "trace_id", "llm_span_count"))
_tenant_query("c4_traces_with_errors", """
SELECT project_id, trace_id, span_count FROM traces WHERE (project_id, trace_id) IN (SELECT (project_id, trace_id) FROM spans WHERE status = 'error')""",
              lambda t, s: J.traces_with_error_span(t, s).select("project_id", "trace_id", "span_count"))
_tenant_query("c7_spans_under_traces", """
SELECT project_id, trace_id, count(*) FILTER (span_type = 'agent') AS agent_spans, count(*) FILTER (span_type = 'llm') AS llm_spans
FROM traces JOIN spans USING (project_id, trace_id) GROUP BY ALL""",
              lambda t, s: J.span_totals_by_trace(t.select("project_id", "trace_id"), s).select("project_id", "trace_id", "agent_spans", "llm_spans"))
_tenant_query("f11_trace_errors", """
SELECT project_id, trace_id, count(*) FILTER (status = 'error') AS error_count FROM spans GROUP BY ALL""",
              lambda t, s: analytics.trace_errors(s, errors.classify(s)).select("project_id", "trace_id", "error_count"))
_tenant_query("f12_replay_candidates", """
SELECT t.project_id, t.trace_id, bool_or(s.snapshot_model IS NOT NULL) AS has_replay_snapshot, t.span_count, count(*) FILTER (s.span_type = 'llm') AS llm_span_count
FROM traces t JOIN spans s USING (project_id, trace_id) GROUP BY t.project_id, t.trace_id, t.span_count""",
              lambda t, s: analytics.replay_candidates(t, s).select("project_id", "trace_id", "has_replay_snapshot", "span_count", "llm_span_count"))
_tenant_query("f13_snapshot_summary", """
SELECT project_id, trace_id, count(*) AS snapshot_count, string_agg(DISTINCT snapshot_model, '|' ORDER BY snapshot_model) AS models
FROM spans WHERE snapshot_model IS NOT NULL GROUP BY ALL""", lambda t, s: analytics.snapshot_summary(s))
