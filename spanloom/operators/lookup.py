"""Lists, searches and detail views over traces and spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attrs import blank_to, has_key, with_attrs
from ..functions.ordering import HOUR_US, first_per_key, position, time_bucket, top_per_key
from ..schema import TRACE, is_error


def filter_all(df: DataFrame, **equal) -> DataFrame:
    """Equality filters for the arguments that are given."""
    conds = [F.col(name) == value for name, value in equal.items() if value is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def between(df: DataFrame, column: str, start: Column | None, end: Column | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= start)
    return df if end is None else df.where(F.col(column) <= end)


def newest(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def list_traces(traces: DataFrame, spans: DataFrame | None = None, *, project: str | None = None,
                service: str | None = None, agent: str | None = None, status: str | None = None,
                start: Column | None = None, end: Column | None = None,
                limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = between(filter_all(traces, project_id=project, service_name=service, status=status),
                   "started_at", start, end)
    if agent is not None:
        rows = traces_of_agent(rows, spans, agent)
    return newest(rows, [F.desc("started_at"), F.col("trace_id")], limit, offset)


def traces_of_agent(traces: DataFrame, spans: DataFrame, agent: str) -> DataFrame:
    """Traces that name the agent themselves or have a span that does."""
    name = {"_agent": ("agent.name", "str")}
    own = with_attrs(traces, name).where(F.col("_agent") == agent).select(*TRACE)
    by_span = with_attrs(spans, name).where(F.col("_agent") == agent).select(*TRACE)
    return traces.join(own.union(by_span).distinct(), TRACE, "left_semi")


def spans_in_order(spans: DataFrame) -> DataFrame:
    """Spans with their 1-based position inside the trace, for all traces at once."""
    return position(spans, TRACE, time_bucket(F.col("started_at"), HOUR_US),
                    [F.col("started_at"), F.col("span_id")], "position")


def trace_pages(traces: DataFrame, spans: DataFrame, page_size: int = 1000) -> DataFrame:
    """Traces with nested spans, cut into pages of ``page_size`` spans.

    A page bounds what one task has to hold, however long a trace is; all pages
    of a trace together hold all of its spans.
    """
    paged = spans_in_order(spans).withColumn(
        "page", F.floor((F.col("position") - 1) / page_size) + 1)
    nested = paged.groupBy(*TRACE, "page").agg(
        F.array_sort(F.collect_list(F.struct("position", "span_id", "name", "span_type", "status"))).alias("spans"))
    head = traces.select(*TRACE, "service_name", "status", "span_count")
    return nested.join(head, TRACE)


def search(spans: DataFrame, terms: list[str], limit: int | None = None, wildcards: bool = False) -> DataFrame:
    """Distinct traces whose spans mention a term in name or attributes; newest first per term."""

    def hit(term: str) -> Column:
        if wildcards:
            return F.col("attributes").like(f"%{term}%") | F.col("name").like(f"%{term}%")
        return F.col("attributes").contains(term) | F.col("name").contains(term)

    found = F.filter(F.array(*[F.when(hit(t), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    rows = (
        spans.select(F.explode(found).alias("term"), "trace_id", "service_name", "started_at", "status")
        .distinct()
    )
    order = [F.desc("started_at"), F.col("trace_id"), F.col("service_name"), F.col("status")]
    return rows if limit is None else top_per_key(rows, ["term"], order, limit)


def paginate(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page plus the total row count as a column (a scalar subquery, no collect)."""
    total = df.select(F.count("*").alias("total"))
    rows = newest(df, order, page_size, (page - 1) * page_size)
    return rows.select("*", total.scalar().alias("total"))


def active_alerts(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Default alert view: active, or muted until a time still ahead."""
    return alerts.where((F.col("status") == "active")
                        | ((F.col("status") == "muted") & (F.col("mute_until") > as_of)))


def agent_runs(traces: DataFrame, since: Column, *, framework: str | None = None,
               status: str | None = None, limit: int | None = None) -> DataFrame:
    """Multi-agent executions, newest first."""
    rows = with_attrs(traces.where(F.col("started_at") >= since), {
        "run_id": ("execution_id", "str"), "framework": ("framework", "str"),
        "num_agents": ("num_agents", "int"), "num_tasks": ("num_tasks", "int"),
        "num_messages": ("num_messages", "int"),
    }).where("framework <> ''")
    rows = filter_all(rows, framework=framework, status=status)
    out = rows.select(
        "trace_id", blank_to(F.col("run_id"), F.col("trace_id")).alias("execution_id"), "framework",
        "service_name", F.lower("status").alias("status"), "started_at", "duration_ms",
        "num_agents", "num_tasks", "num_messages")
    return newest(out, [F.desc("started_at"), F.col("trace_id")], limit)


# Node type words that mark a model call.
AI_NODE_WORDS = ["openai", "anthropic", "langchain", "vector", "embedding"]


def timeline(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with their offset from the start of the trace and a model-call flag."""
    starts = traces.select("trace_id", F.col("started_at").alias("_t0"))
    rows = with_attrs(spans, {"_node_type": ("n8n.node.type", "str")}).join(starts, "trace_id")
    words = "|".join(AI_NODE_WORDS)
    return rows.select(
        "trace_id", F.col("span_id").alias("node_id"), F.col("name").alias("node_name"),
        F.col("span_type").alias("node_type"),
        F.round((F.unix_micros("started_at") - F.unix_micros("_t0")) / 1000, 1).alias("start_offset_ms"),
        F.round("duration_ms", 1).alias("duration_ms"), "status",
        (F.col("span_type").isin("llm", "embedding") | F.lower("_node_type").rlike(words)).alias("is_ai_node"))


def run_roles(spans: DataFrame) -> DataFrame:
    """Spans of a run split into agents, tasks and messages by the keys they carry (one span may be several)."""
    rows = with_attrs(spans, {
        "agent_name": ("agent.name", "str"), "task_id": ("task.id", "str"),
        "description": ("task.description", "str"), "content": ("message.content", "str"),
    })
    keys = F.coalesce(F.json_object_keys("attributes"), F.array().cast("array<string>"))
    roles = F.filter(F.array(
        F.when(F.arrays_overlap(keys, F.array(F.lit("agent.id"), F.lit("agent.name"))), "agent"),
        F.when(F.arrays_overlap(keys, F.array(F.lit("task.id"), F.lit("task.description"))), "task"),
        F.when(F.array_contains(keys, "message.content") | (F.col("span_type") == "custom"), "message"),
    ), lambda r: r.isNotNull())
    return rows.withColumn("role", F.explode(roles))


def run_detail(spans: DataFrame) -> DataFrame:
    """Per trace: span counts by role and the agent names in order of first use."""
    rows = run_roles(spans)
    counts = rows.groupBy("trace_id").agg(
        F.count_if(F.col("role") == "agent").alias("agent_spans"),
        F.count_if(F.col("role") == "task").alias("task_spans"),
        F.count_if(F.col("role") == "message").alias("message_spans"))
    agents = rows.where("role = 'agent' AND agent_name <> ''").groupBy("trace_id", "agent_name").agg(
        F.min(F.struct("started_at", "span_id")).alias("first"))
    used = agents.groupBy("trace_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "agent_name"))), lambda x: x["agent_name"]).alias("agents_used"))
    return counts.join(used, "trace_id", "left").withColumn(
        "agents_used", F.coalesce("agents_used", F.array().cast("array<string>")))


def list_tasks(spans: DataFrame, name_length: int | None = None) -> DataFrame:
    """Task spans with derived name, extra description and assigned agent."""
    rows = with_attrs(spans, {
        "_task": ("task.id", "str"), "_desc": ("task.description", "str"),
        "expected_output": ("task.expected_output", "str"), "_agent": ("agent.name", "str"),
    }).where("_task <> '' OR _desc <> ''")
    parts = F.split("name", "\\.")
    task_name = F.when(F.col("_desc") != "", F.substring("_desc", 1, name_length) if name_length else F.col("_desc")).otherwise(F.element_at(parts, -1))
    by_pattern = F.when((F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(-2)) == "agent"),
                        F.element_at(parts, -1)).otherwise("")
    return rows.select(
        "span_id", F.when(has_key("attributes", "task.id"), F.col("_task")).otherwise(F.col("span_id")).alias("task_id"),
        task_name.alias("task_name"),
        F.when(F.length("_desc") > F.length(task_name), F.col("_desc")).otherwise("").alias("description"),
        "expected_output", blank_to(F.col("_agent"), by_pattern).alias("assigned_agent"),
        "started_at", "duration_ms", F.lower(blank_to(F.col("status"), "pending")).alias("status"))


def project_slug(name: Column, length: int | None = None) -> Column:
    """URL-safe project id from a display name; cut only if a length is asked for."""
    slug = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(slug, 1, length) if length else slug


def cached_analysis(results: DataFrame) -> DataFrame:
    from ..functions.ordering import latest_per_key

    return latest_per_key(results, ["project_id", "analysis_type", "trace_id"], ["created_at", "result_id"])


def first_error_span(spans: DataFrame) -> DataFrame:
    return first_per_key(spans.where(is_error(F.col("status"))), ["trace_id"], ["started_at", "span_id"])
