"""Workflow, project, agent and replay analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attrs import blank_to, has_key, with_attrs
from ..functions.ordering import MINUTE_US, position, time_bucket, top_per_key
from ..schema import TRACE, is_error, is_success
from .rollup import USAGE, WORKFLOW

RUN = {
    **WORKFLOW,
    "ai_calls": ("n8n.total_ai_calls", "int"),
    "total_tokens": ("llm.total_tokens", "int"),
    "cost_usd": ("llm.cost_usd", "float"),
}


def last_hours(df: DataFrame, as_of: Column, hours: int, column: str = "started_at") -> DataFrame:
    return df.where(F.col(column) >= as_of - F.expr(f"INTERVAL {hours} HOUR"))


def workflow_list(traces: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Workflows with their metrics of the last day."""
    rows = with_attrs(last_hours(traces, as_of, hours).where(has_key("attributes", "n8n.workflow.id")), RUN)
    return rows.groupBy("project_id", "workflow_id", "workflow_name").agg(
        F.max("started_at").alias("last_execution"),
        F.count("*").alias("execution_count"),
        F.try_divide(F.count_if(is_success(F.col("status"))) * 100.0, F.count("*")).alias("success_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum("ai_calls").alias("total_ai_calls"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("total_cost_usd"),
    )


def recent_executions(traces: DataFrame, per_workflow: int | None = None) -> DataFrame:
    """Executions of every workflow, newest first, as ``recent_rank`` says; with ``per_workflow`` the newest so many."""
    rows = with_attrs(traces.where(has_key("attributes", "n8n.workflow.id")), {
        **RUN, "execution_id": ("n8n.execution.id", "str")})
    rows = rows.select("project_id", "workflow_id", "execution_id", "started_at", "completed_at", "status",
                       F.round("duration_ms", 3).alias("duration_ms"), "total_tokens", "cost_usd")
    keys, order = ["project_id", "workflow_id"], [F.desc("started_at"), F.col("execution_id")]
    if per_workflow is not None:
        return top_per_key(rows, keys, order, per_workflow, "recent_rank")
    # newest first and whole: minutes count down, so a busy workflow is spread over them
    return position(rows, keys, -time_bucket(F.col("started_at"), MINUTE_US), order, "recent_rank")


def ai_nodes(spans: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Model usage per workflow node over the last day."""
    rows = last_hours(spans.where("span_type = 'llm'"), as_of, hours).where(
        has_key("attributes", "n8n.workflow.id"))
    rows = with_attrs(rows, {"workflow_id": WORKFLOW["workflow_id"], **USAGE})
    return rows.groupBy(
        "project_id", "workflow_id", F.col("name").alias("node_name"),
        blank_to(F.col("model"), "unknown").alias("model"), blank_to(F.col("vendor"), "unknown").alias("vendor"),
    ).agg(
        F.count("*").alias("call_count"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.avg("latency_ms").alias("avg_latency_ms"))


def workflow_page(traces: DataFrame, spans: DataFrame, as_of: Column, runs: int = 50) -> DataFrame:
    """One row per workflow active in the last day: its summary, its newest ``runs`` runs and its model-calling nodes.

    Runs are a report of fixed length; nodes are already one entry per node, model and vendor.
    """
    keys = ["project_id", "workflow_id"]
    newest = recent_executions(traces, runs).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("recent_rank", "execution_id", "started_at", "completed_at", "status", "duration_ms", "total_tokens", "cost_usd"))).alias("runs"))
    nodes = ai_nodes(spans, as_of).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "node_name", "model", "vendor", "call_count", "prompt_tokens", "completion_tokens", F.round("avg_latency_ms", 1).alias("avg_latency_ms")))).alias("nodes"))
    return workflow_list(traces, as_of).join(newest, keys, "left").join(nodes, keys, "left")


def workflow_detail(traces: DataFrame, spans: DataFrame, as_of: Column) -> DataFrame:
    """Summary per workflow with the last run and the number of model-calling nodes."""
    summary = workflow_list(traces, as_of)
    last = recent_executions(traces, 1).select(
        "project_id", "workflow_id", F.col("execution_id").alias("last_execution_id"),
        F.col("status").alias("last_status"))
    nodes = ai_nodes(spans, as_of).groupBy("project_id", "workflow_id").agg(
        F.count("*").alias("ai_node_count"), F.sum("call_count").alias("ai_node_calls"))
    return summary.join(last, ["project_id", "workflow_id"], "left").join(
        nodes, ["project_id", "workflow_id"], "left").withColumns({
            "ai_node_count": F.coalesce("ai_node_count", F.lit(0)),
            "ai_node_calls": F.coalesce("ai_node_calls", F.lit(0))})


def receiver_status(projects: DataFrame, traces: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Whether a project received anything lately."""
    recent = last_hours(traces, as_of, hours).groupBy("project_id").agg(
        F.max("started_at").alias("last_event"), F.count("*").alias("_n"))
    out = projects.join(recent, "project_id", "left").withColumn("event_count", F.coalesce("_n", F.lit(0)))
    return out.select("project_id", F.when(F.col("event_count") > 0, "active").otherwise("inactive").alias("status"),
                      "last_event", "event_count")


def agent_performance(spans: DataFrame, since: Column) -> DataFrame:
    rows = with_attrs(spans.where(F.col("started_at") >= since), {
        "agent_name": ("agent.name", "str"), "framework": ("framework", "str"),
        "total_tokens": ("llm.total_tokens", "int")}).where("agent_name <> ''")
    return rows.groupBy("agent_name", "framework").agg(
        F.count("*").alias("total_executions"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.try_divide(F.count_if(is_success(F.col("status"))), F.count("*")).alias("success_rate"),
        F.sum("total_tokens").alias("total_tokens"),
    )


# ---- agent communication graph ------------------------------------------------
def graph_nodes(spans: DataFrame) -> DataFrame:
    """Agents of each trace with how often they were invoked."""
    rows = with_attrs(spans, {"_id": ("agent.id", "str"), "_name": ("agent.name", "str")})
    rows = rows.withColumn("agent_id", blank_to(F.col("_id"), F.col("_name"))).where("agent_id <> ''")
    label = F.min_by(blank_to(F.col("_name"), F.col("agent_id")), F.struct("started_at", "span_id"))
    return rows.groupBy(*TRACE, "agent_id").agg(label.alias("label"), F.count("*").alias("invocations"))


def graph_edges(spans: DataFrame) -> DataFrame:
    """Messages between agents with their weight."""
    rows = with_attrs(spans, {
        "_s": ("sender.name", "str"), "_s2": ("sender", "str"),
        "_r": ("recipient.name", "str"), "_r2": ("recipient", "str")})
    rows = rows.withColumns({"source": blank_to(F.col("_s"), F.col("_s2")), "target": blank_to(F.col("_r"), F.col("_r2"))})
    return rows.where("source <> '' AND target <> ''").groupBy(*TRACE, "source", "target").agg(
        F.count("*").alias("weight"))


# ---- guardrails ------------------------------------------------------------------
def violation_summary(violations: DataFrame) -> DataFrame:
    """Violations per (guard, phase, action) and the grand total from one scan."""
    return violations.groupingSets(
        [[F.col("guard_name"), F.col("phase"), F.col("action")], []], "guard_name", "phase", "action"
    ).agg(F.count("*").alias("violations"))


# ---- replay analysis ------------------------------------------------------------
def replay_candidates(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Traces with token and cost totals, model span count and a real snapshot flag."""
    per_trace = spans.groupBy(*TRACE).agg(
        F.count_if(F.col("span_type") == "llm").alias("llm_span_count"),
        F.bool_or(F.coalesce(F.col("replay_snapshot"), F.lit("")).isin("", "{}") == F.lit(False)).alias("has_snapshot"))
    rows = with_attrs(traces, {"total_tokens": ("total_tokens", "int"), "total_cost_usd": ("total_cost_usd", "float")})
    return rows.join(per_trace, TRACE, "left").select(
        *TRACE, "service_name", "started_at", "duration_ms", "total_tokens", "total_cost_usd",
        F.coalesce("has_snapshot", F.lit(False)).alias("has_replay_snapshot"), "span_count",
        F.coalesce("llm_span_count", F.lit(0)).alias("llm_span_count"))


def snapshot_summary(spans: DataFrame) -> DataFrame:
    """Snapshots and distinct snapshot models per trace."""
    model = F.get_json_object("replay_snapshot", "$.llm_request.model")
    rows = spans.where(~F.coalesce(F.col("replay_snapshot"), F.lit("")).isin("", "{}")).withColumn("_m", model)
    per_model = rows.groupBy(*TRACE, "_m").agg(F.count("*").alias("_n"))
    return per_model.groupBy(*TRACE).agg(
        F.sum("_n").alias("snapshot_count"),
        F.array_sort(F.collect_set("_m")).alias("models"))


COMPARISON = ("struct<original:struct<total_duration_ms:double,total_tokens:bigint,total_cost_usd:double>,"
              "modified:struct<total_duration_ms:double,total_tokens:bigint,total_cost_usd:double>>")
RESULT = "struct<total_duration_ms:double>"


def replay_history(executions: DataFrame) -> DataFrame:
    """Duration and cost change of each replay; NULL unless both documents are there."""
    c, r = F.from_json("comparison", COMPARISON), F.from_json("result", RESULT)
    both = F.coalesce("result", F.lit("")).isin("", "{}") | F.coalesce("comparison", F.lit("")).isin("", "{}")
    delta = F.coalesce(c["modified"]["total_cost_usd"], F.lit(0.0)) - F.coalesce(c["original"]["total_cost_usd"], F.lit(0.0))
    return executions.withColumns({
        "duration_ms": F.when(~both, r["total_duration_ms"]), "cost_delta": F.when(~both, delta)}).drop("result", "comparison")


def batch_summary(executions: DataFrame) -> DataFrame:
    """Totals and differences per replay batch, with the batch status."""
    rows = executions.withColumn("c", F.from_json("comparison", COMPARISON)).withColumn(
        "ok", (F.col("status") == "completed") & F.col("c").isNotNull())

    def total(side: str, field: str) -> Column:
        return F.sum(F.when(F.col("ok"), F.coalesce(F.col(f"c.{side}.{field}"), F.lit(0)))).cast("double")

    done = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    n_ok = F.count_if(F.col("ok"))
    return rows.groupBy("batch_id").agg(
        done.alias("completed"), failed.alias("failed"), F.count("*").alias("total"),
        (total("modified", "total_cost_usd") - total("original", "total_cost_usd")).alias("cost_delta_usd"),
        (total("modified", "total_tokens") - total("original", "total_tokens")).alias("token_delta"),
        F.try_divide(total("modified", "total_duration_ms") - total("original", "total_duration_ms"), n_ok)
        .alias("avg_duration_delta_ms"),
        F.when(failed == 0, "completed").when(done == 0, "failed").otherwise("partial").alias("status"))


def replay_differences(original: DataFrame, modified: DataFrame, fields: list[str], cut: int | None = None) -> DataFrame:
    """Field-by-field differences of two span sets joined on (trace, span name)."""
    key = ["trace_id", "span_name"]
    shown = (lambda c: F.col(c)) if cut is None else (lambda c: F.substring(c, 1, cut))
    o = original.select(*key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("o"))
    m = modified.select(*key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("m"))
    pairs = o.join(m, key, "full_outer").withColumn("f", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("original_value"),
                 F.col(f"m.{f}").alias("modified_value")) for f in fields])))
    return pairs.where(~F.col("f.original_value").eqNullSafe(F.col("f.modified_value"))).select(
        *key, "f.field", shown("f.original_value").alias("original_value"),
        shown("f.modified_value").alias("modified_value"))


def monthly_replays(executions: DataFrame, traces: DataFrame, as_of: Column, cap: int = 100) -> DataFrame:
    """Replays per project since the start of the month, against the cap."""
    known = traces.select("project_id").distinct()
    rows = executions.where(F.col("triggered_at") >= F.date_trunc("month", as_of)).join(known, "project_id", "left_semi")
    return rows.groupBy("project_id").agg(F.count("*").alias("replays")).withColumn(
        "limit_reached", F.col("replays") >= cap)


def check_batches(batches: DataFrame, traces: DataFrame) -> DataFrame:
    """Per batch: distinct requested traces, how many exist, and whether all do."""
    ids = batches.select("batch_id", F.explode(F.array_distinct("trace_ids")).alias("trace_id"))
    known = traces.select("trace_id", F.lit(1).alias("_known"))
    return ids.join(known, "trace_id", "left").groupBy("batch_id").agg(
        F.count("*").alias("requested"), F.count("_known").alias("found"),
        (F.count("*") == F.count("_known")).alias("accepted"))


def trace_errors(spans: DataFrame, classified: DataFrame) -> DataFrame:
    """Failed spans per trace and whether any is critical; clean traces count 0."""
    all_traces = spans.select(*TRACE).distinct()
    per = classified.groupBy(*TRACE).agg(
        F.count("*").alias("_n"), F.bool_or(F.col("severity") == "critical").alias("_crit"))
    return all_traces.join(per, TRACE, "left").select(
        *TRACE, F.coalesce("_n", F.lit(0)).alias("error_count"),
        F.coalesce("_crit", F.lit(False)).alias("has_critical"))
