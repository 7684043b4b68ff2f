"""Behavioural drift: rolling baselines, anomaly checks, root causes, alerts.

All agents of all projects are handled by one job; the wide fact table is read
once per time window and everything after the first aggregation is one row per
(project, agent, service).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attrs import with_attrs
from ..functions.ordering import latest_per_key
from ..functions.quantiles import agg_with_quantiles, exact_quantiles, same_keys
from ..schema import is_error, is_success, severity_name, severity_rank

AGENT = ["project_id", "agent_name", "service_name"]
MEASURES = {
    "agent_name": ("agent.name", "str"),
    "tokens": ("llm.total_tokens", "int"),
    "tool_calls": ("tool.call_count", "int"),
    "response": ("llm.response", "str"),
    "cost_usd": ("llm.cost_usd", "float"),
    "model": ("llm.model", "str"),
}

# ---- fixed values: what is said of a cause ---------------------------------------------------
CAUSES = {
    "model_change": "Model changed: ",
    "input_complexity_increase": "Input complexity increased by %.1f%%",
    "error_rate_increase": "Error rate increased (success rate dropped %.1f%%)",
}


def agent_rows(spans: DataFrame, types: list[str] | None = None) -> DataFrame:
    rows = with_attrs(spans.where(F.col("span_type").isin(types or ["agent"])), MEASURES)
    return rows.where("agent_name <> ''").withColumn("response_length", F.length("response"))


def in_window(start: Column, end: Column) -> Column:
    return (F.col("started_at") >= start) & (F.col("started_at") <= end)


def agent_baselines(spans: DataFrame, ends: list[Column], days: int = 7, quantiles: bool = True) -> DataFrame:
    """Twenty measures per agent for each window ``[end - days, end]``, in one pass; without the five quantiles where they aren't read."""
    span = F.expr(f"INTERVAL {days} DAY")
    hits = F.filter(F.array(*[F.when(in_window(e - span, e), e) for e in ends]), lambda x: x.isNotNull())
    rows = agent_rows(spans).withColumn("window_end", F.explode(hits))
    out = agg_with_quantiles(
        rows, [*AGENT, "window_end"],
        {
            "sample_size": ("count", None),
            "duration_mean": ("avg", "duration_ms"),
            "duration_stddev": ("stddev", "duration_ms"),
            "duration_min": ("min", "duration_ms"),
            "duration_max": ("max", "duration_ms"),
            "token_usage_mean": ("avg", "tokens"),
            "token_usage_stddev": ("stddev", "tokens"),
            "tool_calls_mean": ("avg", "tool_calls"),
            "tool_calls_stddev": ("stddev", "tool_calls"),
            "response_length_mean": ("avg", "response_length"),
            "response_length_stddev": ("stddev", "response_length"),
            "success_rate": ("rate", is_success(F.col("status"))),
            "error_count": ("count_if", is_error(F.col("status"))),
            "cost_mean": ("avg", "cost_usd"),
            "cost_total": ("sum", "cost_usd"),
        },
        {
            "duration_ms": {"duration_p50": 0.5, "duration_p95": 0.95, "duration_p99": 0.99},
            "tokens": {"token_usage_p50": 0.5, "token_usage_p95": 0.95},
        } if quantiles else {},
    )
    return out.withColumns({
        "window_start": F.col("window_end") - span,
        "baseline_id": F.sha2(F.concat_ws("|", *AGENT, F.unix_micros("window_end").cast("string")), 256),
    })


def latest_baselines(baselines: DataFrame, as_of: Column | None = None) -> DataFrame:
    rows = baselines if as_of is None else baselines.where(F.col("window_end") <= as_of)
    return latest_per_key(rows, AGENT, ["window_end"])


def baseline_as_of(points: DataFrame, baselines: DataFrame, keys: list[str], ts: str, horizon: Column | None = None) -> DataFrame:
    """As-of join: for every point the newest baseline whose window ended at or before it.

    Each baseline holds until the next one of its key, the last one until ``horizon`` or, without one, the newest
    point; that interval is listed per day, so the join is an equi-join on (key, day) with at most the day's
    baselines as candidates, and a busy key is spread over its days. Points after a given horizon get no baseline.
    """
    if horizon is None:
        horizon = F.lit(points.agg(F.max(ts).cast("string")).first()[0]).cast("timestamp")
    following = F.lead("window_end").over(Window.partitionBy(*keys).orderBy("window_end"))
    held = baselines.withColumn("_until", following)
    last_day = F.to_date(F.coalesce(F.col("_until"), horizon))
    slots = held.withColumn("_day", F.explode(F.sequence(
        F.to_date("window_end"), F.greatest(last_day, F.to_date("window_end")))))
    rest = [c for c in baselines.columns if c not in keys]
    slots = slots.select(*keys, "_day", "_until", *rest)
    days = points.withColumn("_day", F.to_date(ts))
    joined = days.join(slots, [*keys, "_day"])
    keep = (F.col("window_end") <= F.col(ts)) & (F.col("_until").isNull() | (F.col(ts) < F.col("_until")))
    return joined.where(keep).drop("_day", "_until")


def current_metrics(spans: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    rows = agent_rows(spans.where(in_window(as_of - F.expr(f"INTERVAL {hours} HOUR"), as_of)))
    return rows.groupBy(*AGENT).agg(
        F.count("*").alias("sample_size"),
        F.avg("duration_ms").alias("duration"),
        F.avg("tokens").alias("token_usage"),
        F.avg("tool_calls").alias("tool_calls"),
        F.avg("response_length").alias("response_length"),
        F.try_divide(F.count_if(is_success(F.col("status"))), F.count("*")).alias("success_rate"),
        F.avg("cost_usd").alias("cost"),
    )


def severity_of_z(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 4, "critical").when(a >= 3, "high").when(a >= 2, "medium").otherwise("low")


def change_percent(current: Column, mean: Column) -> Column:
    return F.coalesce(F.try_divide(current - mean, mean) * 100, F.lit(0.0))


def score_agents(current: DataFrame, baselines: DataFrame, sensitivity: float = 2.0, keys: list[str] = AGENT,
                 keep: list[str] | None = None) -> DataFrame:
    """One row per agent (or other ``keys``, and columns ``keep`` of the current row) with the array of its drifted metrics (at most five)."""
    base = baselines.drop("sample_size").withColumnRenamed("success_rate", "base_success")
    joined = current.join(base, keys)

    def metric(name: str, unit: str, mean: str, stddev: Column | None) -> Column:
        value, center = F.col(name), F.col(mean)
        diff = value - center
        if stddev is None:
            stddev = z = F.lit(None).cast("double")
            drifted = F.abs(diff) > 0.1
            severity = F.when(F.abs(diff) > 0.3, "critical").when(F.abs(diff) > 0.2, "high").otherwise("medium")
        else:
            z = F.when(stddev > 0, diff / stddev)
            drifted = F.abs(z) >= sensitivity
            severity = severity_of_z(z)
        return F.when(drifted, F.struct(
            F.lit(name).alias("metric_name"), F.lit(unit).alias("unit"), value.alias("current_value"),
            center.alias("baseline_mean"), stddev.alias("baseline_stddev"), z.alias("z_score"),
            severity.alias("severity"), change_percent(value, center).alias("change_percent"),
            F.when(diff > 0, "increased").otherwise("decreased").alias("direction")))

    metrics = F.array(
        metric("duration", "ms", "duration_mean", F.col("duration_stddev")),
        metric("token_usage", "tokens", "token_usage_mean", F.col("token_usage_stddev")),
        metric("tool_calls", "calls", "tool_calls_mean", F.col("tool_calls_stddev")),
        metric("cost", "USD", "cost_mean", F.col("cost_mean") * 0.3),
        metric("success_rate", "%", "base_success", None),
    )
    return joined.select(*keys, *(keep or []), "baseline_id", "sample_size",
                         F.filter(metrics, lambda m: m.isNotNull()).alias("anomalies"))


def detect_anomalies(current: DataFrame, baselines: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """One row per agent and drifted metric."""
    scored = score_agents(current, baselines, sensitivity)
    return scored.select(*AGENT, "baseline_id", "sample_size", F.explode("anomalies").alias("m")).select(
        *AGENT, "baseline_id", "m.*", "sample_size")


def recent_models(spans: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Distinct non-empty models per agent over the lookback."""
    rows = agent_rows(spans.where(F.col("started_at") >= as_of - F.expr(f"INTERVAL {hours} HOUR")), ["agent", "llm"])
    return rows.where("model <> ''").groupBy(*AGENT).agg(F.array_sort(F.collect_set("model")).alias("models"))


def with_causes(scored: DataFrame, models: DataFrame) -> DataFrame:
    """Add the array of possible causes to every agent that has anomalies."""

    def cause(kind: str, description: Column, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("cause"), description.alias("description"),
                        F.lit(confidence).alias("confidence"))

    changed = F.when(F.size("models") > 1, cause(
        "model_change", F.concat(F.lit(CAUSES["model_change"]), F.array_join("models", ", ")), 0.9))
    heavier = F.transform(
        F.filter("anomalies", lambda m: (m["metric_name"] == "token_usage") & (m["z_score"] > 0)),
        lambda m: cause("input_complexity_increase",
                        F.format_string(CAUSES["input_complexity_increase"], m["change_percent"]), 0.8))
    failing = F.transform(
        F.filter("anomalies", lambda m: (m["metric_name"] == "success_rate") & (m["direction"] == "decreased")),
        lambda m: cause("error_rate_increase", F.format_string(
            CAUSES["error_rate_increase"], F.abs(m["change_percent"])), 0.95))
    found = F.filter(F.concat(F.array(changed), heavier, failing), lambda c: c.isNotNull())
    return scored.where(F.size("anomalies") > 0).join(models, AGENT, "left").withColumn("causes", found).drop("models")


def root_causes(scored: DataFrame, models: DataFrame) -> DataFrame:
    """Possible causes, one row each."""
    return with_causes(scored, models).select(*AGENT, F.explode("causes").alias("c")).select(*AGENT, "c.*")


def build_alerts(drifted: DataFrame, as_of: Column) -> DataFrame:
    """One alert per agent: highest severity, anomalies and causes."""
    rank = F.array_max(F.transform("anomalies", lambda m: severity_rank(m["severity"])))
    return drifted.withColumn("severity_rank", rank).select(
        *AGENT, "baseline_id", "severity_rank", severity_name(F.col("severity_rank")).alias("severity"),
        (F.col("severity_rank") / F.lit(4.0)).alias("score"),
        F.array_sort(F.transform("anomalies", lambda m: m["metric_name"])).alias("metrics"),
        F.size("anomalies").alias("anomaly_count"),
        F.array_sort(F.transform("causes", lambda c: c["cause"])).alias("causes"),
        "anomalies", F.col("causes").alias("cause_details"),
        F.lit("active").alias("status"), as_of.alias("detected_at"),
        F.sha2(F.concat_ws("|", *AGENT, F.unix_micros(as_of).cast("string")), 256).alias("alert_id"))


def recently_alerted(existing: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    recent = existing.where((F.col("status") == "active")
                            & (F.col("detected_at") >= as_of - F.expr(f"INTERVAL {hours} HOUR")))
    return recent.select("project_id", "agent_name").distinct()


def suppress_recent(alerts: DataFrame, existing: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Leave out agents that already got an active alert within the last hour."""
    return alerts.join(recently_alerted(existing, as_of, hours), ["project_id", "agent_name"], "left_anti")


def active_projects(traces: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return traces.where(F.col("started_at") >= as_of - F.expr(f"INTERVAL {hours} HOUR")).select("project_id").distinct()


def notifications(matched: DataFrame) -> DataFrame:
    """Matched (rule, alert) pairs to one row per channel."""
    return matched.withColumn("channel", F.explode("channels")).drop("channels")


def check_drift(spans: DataFrame, existing: DataFrame, as_of: Column, *, days: int = 7, hours: int = 24,
                sensitivity: float = 2.0) -> DataFrame:
    """Full check for every project: agents checked, anomalies found, alerts created."""
    scored = score_agents(current_metrics(spans, as_of, hours), agent_baselines(spans, [as_of], days, quantiles=False), sensitivity)
    told = recently_alerted(existing, as_of).withColumn("_told", F.lit(True))
    n = F.size("anomalies")
    return scored.join(told, ["project_id", "agent_name"], "left").groupBy("project_id").agg(
        F.count("*").alias("agents_checked"), F.sum(n).alias("anomalies_found"),
        F.count_if((n > 0) & F.col("_told").isNull()).alias("alerts_created"))


def update_alerts(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """New alert versions for actions acknowledge, dismiss or mute (with hours)."""
    status = F.when(F.col("action") == "acknowledge", "acknowledged").when(
        F.col("action") == "dismiss", "dismissed").when(F.col("action") == "mute", "muted")
    rows = alerts.drop("status", "mute_until", "updated_at").join(actions, ["project_id", "alert_id"])
    return rows.withColumns({
        "status": status,
        "mute_until": F.when(F.col("action") == "mute", F.col("acted_at") + F.make_dt_interval(F.lit(0), F.col("hours"))),
        "updated_at": F.col("acted_at"),
    })


def iqr_outliers(df: DataFrame, keys: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences of their group."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    return same_keys(df, q, keys).where((v < F.col("q1") - factor * iqr) | (v > F.col("q3") + factor * iqr))
