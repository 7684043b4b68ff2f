"""The given tables read as spans, traces and friends.

Every binding exists twice with the same expressions: as a DataFrame and as a
CTE for the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.readers import table

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# Fixed values of the binding: one entry per k % 8.
ERROR_CASES = [
    ("Rate limit exceeded", 429),
    ("Invalid API key", 401),
    ("maximum context length exceeded", 400),
    ("model not found", 404),
    ("connection timeout", 504),
    ("malformed request", 400),
    ("server error", 500),
    ("something odd", None),
]
MODELS = ["gpt-4", "gpt-4o", "gpt-4o-mini", "claude-opus-4"]
FRAMEWORKS = ["crewai", "autogen", "langgraph"]
SPAN_TYPES = ["agent", "llm", "tool", "retrieval"]


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(values: list, index: str) -> str:
    parts = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{parts}])[CAST({index} AS BIGINT) + 1]"


def cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def typed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return typed(table(spark, d, "events"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a file stream."""
    from ..streaming.jobs import file_stream

    schema = spark.read.parquet(f"{d.rstrip('/')}/events.parquet").schema
    return typed(file_stream(spark, d, schema, pattern="events.parquet"))


def _with_trace_id(ev: DataFrame) -> DataFrame:
    return ev.withColumn("trace_id", cat("t", F.col("user_id"), "-", F.date_format("ts", "yyyy-MM-dd")))


def span_attributes() -> Column:
    uid, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    model = pick(MODELS, uid % 4)
    is_error, in_workflow = F.col("event_type") == "error", eid % 2 == 1
    return F.to_json(F.struct(
        cat("agent", uid % 10).alias("agent.name"),
        model.alias("llm.model"),
        F.when(model.startswith("gpt"), "openai").otherwise("anthropic").alias("llm.vendor"),
        (k * 7).alias("llm.prompt_tokens"),
        (k * 3).alias("llm.completion_tokens"),
        (k * 10).alias("llm.total_tokens"),
        (k / F.lit(10000.0)).alias("llm.cost_usd"),
        F.col("value").alias("llm.latency_ms"),
        (k % 6).alias("tool.call_count"),
        pick(FRAMEWORKS, uid % 3).alias("framework"),
        F.when(in_workflow, cat("wf", uid % 7)).alias("n8n.workflow.id"),
        F.when(in_workflow, cat("Workflow ", uid % 7)).alias("n8n.workflow.name"),
        F.when(in_workflow, cat("node", k % 4)).alias("n8n.node.name"),
        F.when(in_workflow, pick(["httpRequest", "openAi", "set", "vectorStore"], k % 4)).alias("n8n.node.type"),
        F.when(is_error, pick([m for m, _ in ERROR_CASES], k % 8)).alias("error.message"),
        F.when(is_error, pick([c for _, c in ERROR_CASES], k % 8)).alias("error.status_code"),
    ))


def spans(spark: SparkSession, d: str, *, parents: bool = False) -> DataFrame:
    """Spans from ``events``; ``parents=True`` also fills ``parent_span_id``."""
    ev = _with_trace_id(events(spark, d))
    if parents:
        first = ev.groupBy("trace_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("_first"))
        ev = ev.join(first, "trace_id").withColumn(
            "parent_span_id",
            F.when(F.col("event_id") == F.col("_first"), "").otherwise(F.col("_first").cast("string")))
    else:
        ev = ev.withColumn("parent_span_id", F.lit(None).cast("string"))
    return spans_from(ev)


def spans_from(ev: DataFrame) -> DataFrame:
    """Span columns of events that carry trace_id and parent_span_id."""
    span_type = pick(SPAN_TYPES, F.col("event_id") % 4)
    return ev.select(
        F.col("event_id").cast("string").alias("span_id"),
        "trace_id",
        cat("p", F.col("user_id") % 5).alias("project_id"),
        "parent_span_id",
        F.concat_ws(".", span_type, "event_type").alias("name"),
        span_type.alias("span_type"),
        cat("svc", F.col("user_id") % 3).alias("service_name"),
        F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long")).alias("ended_at"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        span_attributes().alias("attributes"),
        F.lit("[]").alias("events"),
        F.when(F.col("k") % 3 == 0, F.to_json(F.struct(F.struct(
            pick(MODELS, F.col("user_id") % 4).alias("model")).alias("llm_request")))
            ).otherwise("{}").alias("replay_snapshot"),
        F.lit("native").alias("source"),
    )


EV = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         't' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id
  FROM events)"""

SPANS = f"""{EV},
spans AS (
  SELECT CAST(event_id AS VARCHAR) AS span_id, trace_id, event_id, user_id, k,
    'p' || (user_id % 5) AS project_id,
    CASE WHEN event_id = first_value(event_id) OVER (PARTITION BY trace_id ORDER BY ts, event_id) THEN ''
      ELSE CAST(first_value(event_id) OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS VARCHAR) END AS parent_span_id,
    {sql_pick(SPAN_TYPES, 'event_id % 4')} || '.' || event_type AS name,
    {sql_pick(SPAN_TYPES, 'event_id % 4')} AS span_type,
    'svc' || (user_id % 3) AS service_name,
    ts AS started_at, ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) AS ended_at,
    value AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    'agent' || (user_id % 10) AS agent_name,
    {sql_pick(MODELS, 'user_id % 4')} AS model,
    CASE WHEN user_id % 4 = 3 THEN 'anthropic' ELSE 'openai' END AS vendor,
    7 * k AS prompt_tokens, 3 * k AS completion_tokens, 10 * k AS total_tokens,
    k / 10000.0::DOUBLE AS cost_usd, value AS latency_ms, k % 6 AS tool_calls,
    {sql_pick(FRAMEWORKS, 'user_id % 3')} AS framework,
    CASE WHEN event_id % 2 = 1 THEN 'wf' || (user_id % 7) END AS workflow_id,
    CASE WHEN event_id % 2 = 1 THEN 'Workflow ' || (user_id % 7) END AS workflow_name,
    CASE WHEN event_id % 2 = 1 THEN 'node' || (k % 4) END AS node_name,
    CASE WHEN event_id % 2 = 1 THEN {sql_pick(['httpRequest', 'openAi', 'set', 'vectorStore'], 'k % 4')} END AS node_type,
    CASE WHEN event_type = 'error' THEN {sql_pick([m for m, _ in ERROR_CASES], 'k % 8')} END AS error_message,
    CASE WHEN event_type = 'error' THEN {sql_pick([c for _, c in ERROR_CASES], 'k % 8')} END AS error_code,
    CASE WHEN k % 3 = 0 THEN {sql_pick(MODELS, 'user_id % 4')} END AS snapshot_model
  FROM ev)"""


def span_stream(spark: SparkSession, d: str) -> DataFrame:
    return spans_from(_with_trace_id(event_stream(spark, d)).withColumn("parent_span_id", F.lit("")))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """One trace per user and day, with the workflow keys of its first span."""
    ev = _with_trace_id(events(spark, d))
    end = F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long")
    t = ev.groupBy("trace_id").agg(
        F.min(F.struct("ts", "event_id", "user_id", "k")).alias("f"),
        F.max(end).alias("end_us"),
        F.bool_or(F.col("event_type") == "error").alias("failed"),
        F.count("*").alias("span_count"),
    )
    uid, k, eid = F.col("f.user_id"), F.col("f.k"), F.col("f.event_id")
    in_workflow = eid % 2 == 1
    attributes = F.to_json(F.struct(
        F.when(in_workflow, cat("wf", uid % 7)).alias("n8n.workflow.id"),
        F.when(in_workflow, cat("Workflow ", uid % 7)).alias("n8n.workflow.name"),
        F.when(in_workflow, cat("ex", eid)).alias("n8n.execution.id"),
        (k % 6).alias("n8n.total_ai_calls"),
        (k * 10).alias("llm.total_tokens"),
        (k / F.lit(10000.0)).alias("llm.cost_usd"),
        (k * 10).alias("total_tokens"),
        (k / F.lit(10000.0)).alias("total_cost_usd"),
        F.when(k % 5 != 0, pick(FRAMEWORKS, uid % 3)).alias("framework"),
        F.when(k % 2 == 0, cat("run", eid)).otherwise("").alias("execution_id"),
        (k % 4).alias("num_agents"),
        (k % 7).alias("num_tasks"),
        F.when(k % 3 != 0, k).alias("num_messages"),
        cat("agent", uid % 10).alias("agent.name"),
    ))
    return t.select(
        "trace_id",
        cat("p", uid % 5).alias("project_id"),
        cat("svc", uid % 3).alias("service_name"),
        F.col("f.ts").alias("started_at"),
        F.timestamp_micros("end_us").alias("completed_at"),
        ((F.col("end_us") - F.unix_micros("f.ts")) / F.lit(1000.0)).alias("duration_ms"),
        F.when(F.col("failed"), "error").otherwise("success").alias("status"),
        eid.cast("string").alias("root_span_id"),
        "span_count",
        attributes.alias("attributes"),
        F.lit("native").alias("source"),
    )


TRACES = f"""
traces AS (
  SELECT trace_id, 'p' || (u % 5) AS project_id, 'svc' || (u % 3) AS service_name, started_at, completed_at,
    (epoch_us(completed_at) - epoch_us(started_at)) / 1000.0::DOUBLE AS duration_ms,
    CASE WHEN failed THEN 'error' ELSE 'success' END AS status,
    CAST(first_id AS VARCHAR) AS root_span_id, span_count, first_id, u AS user_id, fk AS k,
    CASE WHEN first_id % 2 = 1 THEN 'wf' || (u % 7) END AS workflow_id,
    CASE WHEN first_id % 2 = 1 THEN 'Workflow ' || (u % 7) END AS workflow_name,
    CASE WHEN first_id % 2 = 1 THEN 'ex' || first_id END AS execution_id,
    fk % 6 AS ai_calls, 10 * fk AS total_tokens, fk / 10000.0::DOUBLE AS cost_usd,
    CASE WHEN fk % 5 <> 0 THEN {sql_pick(FRAMEWORKS, 'u % 3')} END AS framework,
    CASE WHEN fk % 2 = 0 THEN 'run' || first_id ELSE '' END AS run_id,
    fk % 4 AS num_agents, fk % 7 AS num_tasks, CASE WHEN fk % 3 <> 0 THEN fk END AS num_messages,
    'agent' || (u % 10) AS agent_name
  FROM (SELECT trace_id, min(ts) AS started_at,
          max(ts + to_microseconds(CAST(round(value * 1000) AS BIGINT))) AS completed_at,
          bool_or(event_type = 'error') AS failed, count(*) AS span_count,
          arg_min(event_id, ROW(ts, event_id)) AS first_id, min(user_id) AS u,
          arg_min(k, ROW(ts, event_id)) AS fk
        FROM ev GROUP BY trace_id))"""


def shared_ids(df: DataFrame) -> DataFrame:
    """Trace ids that two users, and so two projects, have in common."""
    user = F.regexp_extract("trace_id", r"^t(\d+)-", 1).cast("long")
    return df.withColumn("trace_id", cat("t", F.floor(user / 2), F.regexp_extract("trace_id", r"(-.*)$", 1)))


SHARED_SPANS = SPANS.replace("'t' || user_id ||", "'t' || (user_id // 2) ||")
SHARED_TRACES = TRACES.replace("FROM ev GROUP BY trace_id)", "FROM ev GROUP BY trace_id, user_id)")


def ts_sql(expr: str) -> str:
    """Timestamp as the text form ``tidy`` produces."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes)


# ---- smaller bindings ---------------------------------------------------------------
ALERT_STATUS = ["active", "acknowledged", "dismissed", "muted"]
SEVERITIES = ["low", "medium", "high", "critical"]
TIERS = ["free", "lunch-money", "pro", "enterprise"]
ROLES = ["viewer", "member", "admin", "owner"]


def alert_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of 50 alerts; the newest (ts, event_id) is current."""
    uid, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    return events(spark, d).select(
        cat("al", uid % 50).alias("alert_id"), cat("p", uid % 5).alias("project_id"),
        cat("agent", uid % 10).alias("agent_name"), F.col("ts").alias("detected_at"),
        pick(SEVERITIES, eid % 4).alias("severity"), ((eid % 4) + 1).alias("severity_rank"),
        pick(ALERT_STATUS, k % 4).alias("status"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), k)).alias("mute_until"),
        pick(["duration", "token_usage", "success_rate"], k % 3).alias("metric_name"),
        F.col("ts").alias("updated_at"), eid.alias("seq"))


ALERT_VERSIONS = f"""
alert_versions AS (
  SELECT 'al' || (user_id % 50) AS alert_id, 'p' || (user_id % 5) AS project_id, 'agent' || (user_id % 10) AS agent_name,
    ts AS detected_at, {sql_pick(SEVERITIES, 'event_id % 4')} AS severity, event_id % 4 + 1 AS severity_rank,
    {sql_pick(ALERT_STATUS, 'k % 4')} AS status, ts + to_hours(k) AS mute_until,
    {sql_pick(['duration', 'token_usage', 'success_rate'], 'k % 3')} AS metric_name,
    ts AS updated_at, event_id AS seq FROM ev)"""
ALERTS = f"""{ALERT_VERSIONS},
alerts AS (SELECT * FROM alert_versions QUALIFY row_number() OVER (PARTITION BY project_id, alert_id
  ORDER BY updated_at DESC, seq DESC) = 1)"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt versions: 50 names, the event id is the version."""
    uid, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    return events(spark, d).select(
        cat("p", uid % 5).alias("project_id"), cat("prompt", uid % 50).alias("name"), eid.alias("version"),
        F.concat_ws("-", "event_type", (k % 5).cast("string")).alias("template"),
        F.array("event_type", cat("t", k % 3)).alias("tags"),
        pick(MODELS, uid % 4).alias("model"),
        F.when(k % 10 == 0, F.array(F.lit("production"))).when(k % 10 == 1, F.array(F.lit("staging"), F.lit("canary")))
        .otherwise(F.array().cast("array<string>")).alias("promoted_stages"))


PROMPTS = f"""
prompts AS (
  SELECT 'p' || (user_id % 5) AS project_id, 'prompt' || (user_id % 50) AS name, event_id AS version,
    event_type || '-' || (k % 5) AS template, [event_type, 't' || (k % 3)] AS tags,
    {sql_pick(MODELS, 'user_id % 4')} AS model,
    CASE WHEN k % 10 = 0 THEN ['production'] WHEN k % 10 = 1 THEN ['staging', 'canary'] ELSE [] END AS promoted_stages
  FROM ev)"""


def violations(spark: SparkSession, d: str) -> DataFrame:
    uid, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    return events(spark, d).where("event_type = 'error'").select(
        cat("v", eid).alias("violation_id"), cat("p", uid % 5).alias("project_id"),
        cat("guard", k % 3).alias("guard_name"), pick(["input", "output"], eid % 2).alias("phase"),
        pick(["block", "redact", "log", "warn"], k % 4).alias("action"), F.col("ts").alias("detected_at"))


VIOLATIONS = f"""
violations AS (
  SELECT 'v' || event_id AS violation_id, 'p' || (user_id % 5) AS project_id, 'guard' || (k % 3) AS guard_name,
    {sql_pick(['input', 'output'], 'event_id % 2')} AS phase,
    {sql_pick(['block', 'redact', 'log', 'warn'], 'k % 4')} AS action, ts AS detected_at
  FROM ev WHERE event_type = 'error')"""


def task_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of agent runs with task, message and agent keys."""
    uid, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    described = cat("Handle ", F.col("event_type"), " number ", k, " for customer ", uid,
                    F.when(k % 2 == 0, " and write a full report for the whole team").otherwise(""))
    attributes = F.to_json(F.struct(
        F.when((eid % 3 == 0) & (k % 4 != 1), cat("task", eid)).alias("task.id"),
        F.when((eid % 3 == 0) & (k % 4 != 0), described).alias("task.description"),
        F.when(k % 3 == 0, cat("agent", k % 10)).alias("agent.name"),
        F.when(eid % 3 == 1, cat("message ", k)).alias("message.content"),
        F.when(eid % 3 == 1, cat("agent", k % 5)).alias("sender.name"),
        F.when((eid % 3 == 1) & (k % 7 != 0), cat("agent", (k + 1) % 5)).alias("recipient.name"),
    ))
    return _with_trace_id(events(spark, d)).select(
        eid.cast("string").alias("span_id"), "trace_id", cat("p", uid % 5).alias("project_id"),
        F.when(k % 5 == 0, cat("crewai.agent.writer", k % 3)).otherwise(cat("crewai.task.", F.col("event_type"))).alias("name"),
        F.when(eid % 5 == 0, "custom").otherwise("agent").alias("span_type"),
        F.col("ts").alias("started_at"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("success").alias("status"),
        attributes.alias("attributes"))


TASK_SPANS = """
task_spans AS (
  SELECT CAST(event_id AS VARCHAR) AS span_id, trace_id, 'p' || (user_id % 5) AS project_id,
    CASE WHEN k % 5 = 0 THEN 'crewai.agent.writer' || (k % 3) ELSE 'crewai.task.' || event_type END AS name,
    CASE WHEN event_id % 5 = 0 THEN 'custom' ELSE 'agent' END AS span_type, ts AS started_at, value AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'success' END AS status,
    CASE WHEN event_id % 3 = 0 AND k % 4 <> 1 THEN 'task' || event_id END AS task_id,
    CASE WHEN event_id % 3 = 0 AND k % 4 <> 0 THEN 'Handle ' || event_type || ' number ' || k || ' for customer ' || user_id
      || CASE WHEN k % 2 = 0 THEN ' and write a full report for the whole team' ELSE '' END END AS description,
    CASE WHEN k % 3 = 0 THEN 'agent' || (k % 10) END AS agent_name,
    CASE WHEN event_id % 3 = 1 THEN 'message ' || k END AS content,
    CASE WHEN event_id % 3 = 1 THEN 'agent' || (k % 5) END AS sender,
    CASE WHEN event_id % 3 = 1 AND k % 7 <> 0 THEN 'agent' || ((k + 1) % 5) END AS recipient
  FROM ev)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"),
                                              F.col("c_nationkey").alias("nation"), "c_mktsegment", "c_acctbal")


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("team_id"),
        pick(ROLES, F.col("c_custkey") % 4).alias("role"))


def project_teams(spark: SparkSession, d: str) -> DataFrame:
    """Each nation is a team that owns the project of its region; region 4 has no team."""
    return table(spark, d, "nation").where("n_regionkey < 4").select(
        F.col("n_nationkey").cast("long").alias("team_id"), cat("p", F.col("n_regionkey")).alias("project_id"))


MEMBERS = f"""
members AS (SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS team_id,
  {sql_pick(ROLES, 'c_custkey % 4')} AS role FROM customer),
project_teams AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, 'p' || n_regionkey AS project_id FROM nation WHERE n_regionkey < 4)"""


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(cat("p", F.col("r_regionkey")).alias("project_id"),
                                            F.col("r_name").alias("name"))


PROJECTS = "projects AS (SELECT 'p' || r_regionkey AS project_id, r_name AS name FROM region)"


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """One subscription per order of the user, the newest order counts; tier by user."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("subscription_id"), F.col("o_custkey").alias("user_id"),
        pick(TIERS, F.col("o_custkey") % 4).alias("tier"), F.col("o_orderstatus").alias("sub_status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


SUBSCRIPTIONS = f"""
subscriptions AS (SELECT o_orderkey AS subscription_id, o_custkey AS user_id, {sql_pick(TIERS, 'o_custkey % 4')} AS tier,
  o_orderstatus AS sub_status, o_orderdate AS created_at FROM orders)"""


def replays(spark: SparkSession, d: str) -> DataFrame:
    """One replay per order: original price against the discounted price of its lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("price"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("discounted"),
        F.sum("l_quantity").cast("long").alias("qty"), F.max("l_linenumber").cast("long").alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    side = lambda cost, tokens, ms: F.struct(
        ms.alias("total_duration_ms"), tokens.alias("total_tokens"), cost.alias("total_cost_usd"))
    done = F.col("o_orderstatus") != "P"
    return o.select(
        F.col("o_orderkey").alias("execution_id"), cat("t", F.col("o_custkey")).alias("trace_id"),
        cat("b", F.col("o_custkey") % 100).alias("batch_id"),
        F.col("o_orderdate").cast("timestamp").alias("triggered_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed")
        .otherwise("running").alias("status"),
        F.when(done, F.to_json(F.struct((F.col("qty") * 1.5).alias("total_duration_ms")))).alias("result"),
        F.when(done, F.to_json(F.struct(
            side(F.col("price"), F.col("qty"), F.col("qty") * 1.0).alias("original"),
            side(F.col("discounted"), F.col("lines"), F.col("qty") * 1.5).alias("modified")))).alias("comparison"))


REPLAYS = """
replays AS (
  SELECT o_orderkey AS execution_id, 't' || o_custkey AS trace_id, 'b' || (o_custkey % 100) AS batch_id,
    o_orderdate AS triggered_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
    o_orderstatus <> 'P' AS done, price, discounted, qty, lines
  FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS price, sum(l_extendedprice * (1 - l_discount)) AS discounted,
      CAST(sum(l_quantity) AS BIGINT) AS qty, max(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey)"""
