"""Daily rollups over traces and spans, and the reports that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attrs import has_key, with_attrs
from ..functions.quantiles import agg_with_quantiles
from ..schema import is_error, is_success

WORKFLOW = {
    "workflow_id": ("n8n.workflow.id", "str"),
    "workflow_name": ("n8n.workflow.name", "str"),
}
USAGE = {
    "model": ("llm.model", "str"),
    "vendor": ("llm.vendor", "str"),
    "prompt_tokens": ("llm.prompt_tokens", "int"),
    "completion_tokens": ("llm.completion_tokens", "int"),
    "total_tokens": ("llm.total_tokens", "int"),
    "latency_ms": ("llm.latency_ms", "float"),
    "cost_usd": ("llm.cost_usd", "float"),
}


def day(ts: str = "started_at") -> Column:
    return F.to_date(ts).alias("date")


def cents(amount: Column) -> Column:
    """Money to two digits, decided in decimal so that halves do not depend on summation order."""
    return F.round(amount.cast("decimal(28,6)"), 2)


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


USAGE_MEASURES = {
    "call_count": ("count", None),
    "prompt_tokens": ("sum", "prompt_tokens"),
    "completion_tokens": ("sum", "completion_tokens"),
    "total_tokens": ("sum", "total_tokens"),
    "avg_latency_ms": ("avg", "latency_ms"),
    "total_cost_usd": ("sum", "cost_usd"),
}


def usage_sums() -> list[Column]:
    return [
        F.count("*").alias("call_count"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("cost_usd").alias("total_cost_usd"),
    ]


# ---- the five daily rollups --------------------------------------------------
def workflow_daily(traces: DataFrame, quantiles: bool = True) -> DataFrame:
    """Executions, outcomes and duration spread per workflow and day."""
    rows = with_attrs(traces.where(has_key("attributes", "n8n.workflow.id")), WORKFLOW).withColumn("date", day())
    return agg_with_quantiles(
        rows, ["project_id", "workflow_id", "workflow_name", "date"],
        {
            "execution_count": ("count", None),
            "error_count": ("count_if", is_error(F.col("status"))),
            "success_count": ("count_if", is_success(F.col("status"))),
            "avg_duration_ms": ("avg", "duration_ms"),
            "min_duration_ms": ("min", "duration_ms"),
            "max_duration_ms": ("max", "duration_ms"),
        },
        {"duration_ms": {"p50_duration_ms": 0.5, "p95_duration_ms": 0.95, "p99_duration_ms": 0.99}} if quantiles else {},
    )


def ai_node_daily(spans: DataFrame, quantiles: bool = True) -> DataFrame:
    """Model calls of workflow nodes per day; without quantiles where they aren't read."""
    rows = spans.where((F.col("span_type") == "llm") & has_key("attributes", "n8n.workflow.id"))
    rows = with_attrs(rows, {"workflow_id": WORKFLOW["workflow_id"], **USAGE})
    rows = rows.withColumn("date", day()).withColumnRenamed("name", "node_name")
    return agg_with_quantiles(
        rows, ["project_id", "workflow_id", "node_name", "model", "vendor", "date"],
        {**USAGE_MEASURES, "error_count": ("count_if", is_error(F.col("status")))},
        {"latency_ms": {"p95_latency_ms": 0.95}} if quantiles else {},
    )


def node_daily(spans: DataFrame) -> DataFrame:
    """Executions of all other workflow nodes per day."""
    rows = spans.where((F.col("span_type") != "llm") & has_key("attributes", "n8n.workflow.id"))
    rows = with_attrs(rows, {
        "workflow_id": WORKFLOW["workflow_id"],
        "node_name": ("n8n.node.name", "str"),
        "node_type": ("n8n.node.type", "str"),
    }).withColumn("date", day())
    return agg_with_quantiles(
        rows, ["project_id", "workflow_id", "node_name", "node_type", "span_type", "date"],
        {
            "execution_count": ("count", None),
            "avg_duration_ms": ("avg", "duration_ms"),
            "error_count": ("count_if", is_error(F.col("status"))),
            "success_count": ("count_if", is_success(F.col("status"))),
        },
        {"duration_ms": {"p95_duration_ms": 0.95}},
    )


def span_daily(spans: DataFrame) -> DataFrame:
    """Span counts and durations per service, type and day."""
    return agg_with_quantiles(
        spans.withColumn("date", day()), ["project_id", "service_name", "span_type", "date"],
        {
            "span_count": ("count", None),
            "avg_duration_ms": ("avg", "duration_ms"),
            "error_count": ("count_if", is_error(F.col("status"))),
        },
        {"duration_ms": {"p95_duration_ms": 0.95}},
    )


def llm_usage_daily(spans: DataFrame) -> DataFrame:
    """Calls, tokens, latency and cost per vendor, model and day."""
    rows = with_attrs(spans.where(F.col("span_type") == "llm"), USAGE)
    return (
        rows.withColumn("success", is_success(F.col("status")))
        .groupBy("project_id", "vendor", "model", day())
        .agg(*usage_sums(), F.count_if("success").alias("success_count"))
    )


# ---- reports over the rollups -------------------------------------------------
def since(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col("date") >= F.date_sub(F.to_date(as_of), days))


def workflow_performance(daily: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return since(daily, as_of, days).select(
        "project_id", "workflow_name", "date", "execution_count", "error_count",
        F.round(ratio(F.col("error_count"), F.col("execution_count")) * 100, 2).alias("error_rate_pct"),
        F.round("avg_duration_ms", 2).alias("avg_duration_ms"),
        F.round("p95_duration_ms", 2).alias("p95_duration_ms"),
    ).orderBy("project_id", F.desc("date"), "workflow_name")


def model_usage_by_workflow(ai_daily: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return (
        since(ai_daily, as_of, days)
        .groupBy("project_id", "workflow_id", "model", "vendor")
        .agg(
            F.sum("call_count").alias("total_calls"),
            F.sum("prompt_tokens").alias("total_prompt_tokens"),
            F.sum("completion_tokens").alias("total_completion_tokens"),
            F.sum("total_tokens").alias("total_tokens"),
            F.round(F.sum("total_cost_usd"), 4).alias("total_cost_usd"),
            F.avg("avg_latency_ms").alias("avg_latency_ms"),
        )
        .orderBy("project_id", "workflow_id", F.desc("total_cost_usd"), "model")
    )


def most_expensive_workflows(ai_daily: DataFrame, wf_daily: DataFrame, as_of: Column,
                             days: int = 30, k: int = 10) -> DataFrame:
    """Top k workflows by model cost in each project."""
    names = wf_daily.groupBy("project_id", "workflow_id").agg(F.min("workflow_name").alias("workflow_name"))
    usage = since(ai_daily, as_of, days).groupBy("project_id", "workflow_id").agg(
        F.sum("call_count").alias("calls"), F.sum("total_tokens").alias("tokens"),
        F.sum("total_cost_usd").alias("cost"))
    joined = usage.join(names, ["project_id", "workflow_id"]).groupBy("project_id", "workflow_name").agg(
        F.sum("calls").alias("ai_calls"), F.sum("tokens").alias("tokens_used"),
        F.round(F.sum("cost"), 6).alias("total_cost_usd"))
    w = Window.partitionBy("project_id").orderBy(F.desc("total_cost_usd"), "workflow_name")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def error_rate_trend(wf_daily: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return since(wf_daily, as_of, days).select(
        "project_id", "workflow_name", "date", "execution_count", "error_count",
        F.round(ratio(F.col("error_count"), F.col("execution_count")) * 100, 2).alias("error_rate_pct"),
    ).orderBy("project_id", F.desc("date"), F.desc("error_rate_pct"), "workflow_name")


def slowest_nodes(daily: DataFrame, as_of: Column, days: int = 7, k: int = 20) -> DataFrame:
    """Top k nodes by mean daily duration (means of daily values, as published)."""
    agg = since(daily, as_of, days).groupBy("project_id", "node_name", "node_type", "span_type").agg(
        F.sum("execution_count").alias("total_executions"),
        F.round(F.avg("avg_duration_ms"), 6).alias("avg_duration_ms"),
        F.round(F.avg("p95_duration_ms"), 6).alias("p95_duration_ms"),
    )
    w = Window.partitionBy("project_id").orderBy(F.desc("avg_duration_ms"), "node_name", "node_type", "span_type")
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vendor_comparison(usage_daily: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return since(usage_daily, as_of, days).groupBy("project_id", "vendor").agg(
        F.count_distinct("model").alias("model_count"),
        F.sum("call_count").alias("total_calls"),
        F.sum("total_tokens").alias("total_tokens"),
        cents(F.sum("total_cost_usd")).alias("total_cost_usd"),
        F.avg("avg_latency_ms").alias("avg_latency_ms"),
    )


# ---- mergeable rollup state ------------------------------------------------------
def span_state(spans: DataFrame) -> DataFrame:
    """Daily span rollup as mergeable parts: count, sum, min, max, KLL sketch."""
    return spans.groupBy("project_id", "service_name", "span_type", day()).agg(
        F.count("*").alias("span_count"),
        F.count_if(is_error(F.col("status"))).alias("error_count"),
        F.sum("duration_ms").alias("duration_sum"),
        F.min("duration_ms").alias("duration_min"),
        F.max("duration_ms").alias("duration_max"),
        F.expr("kll_sketch_agg_double(duration_ms)").alias("duration_sketch"),
    )


def merge_span_state(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge new parts into stored parts without reading the spans again."""
    return stored.unionByName(batch).groupBy("project_id", "service_name", "span_type", "date").agg(
        F.sum("span_count").alias("span_count"),
        F.sum("error_count").alias("error_count"),
        F.sum("duration_sum").alias("duration_sum"),
        F.min("duration_min").alias("duration_min"),
        F.max("duration_max").alias("duration_max"),
        F.expr("kll_merge_agg_double(duration_sketch)").alias("duration_sketch"),
    )


def read_span_state(state: DataFrame) -> DataFrame:
    """Readable form: weighted mean and approximate p95 (KLL, about 1 % rank error)."""
    return state.select(
        "project_id", "service_name", "span_type", "date", "span_count", "error_count",
        ratio(F.col("duration_sum"), F.col("span_count")).alias("avg_duration_ms"),
        "duration_min", "duration_max",
        F.expr("kll_sketch_get_quantile_double(duration_sketch, 0.95D)").alias("p95_duration_ms"),
    )


# ---- windows over rollups ----------------------------------------------------------
def day_over_day(daily: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Change of ``measure`` against the previous day present (one row per key and day)."""
    w = Window.partitionBy(*keys).orderBy("date")
    prev = F.lag(measure).over(w)
    return daily.select(*keys, "date", measure, prev.alias("previous"),
                        (F.col(measure) - prev).alias("change"))


def moving_average(daily: DataFrame, keys: list[str], measure: str, days: int = 7) -> DataFrame:
    """Mean of ``measure`` over the last ``days`` calendar days."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    return daily.select(*keys, "date", measure, F.avg(measure).over(w).alias("moving_avg"),
                        F.count("*").over(w).alias("days_seen"))
