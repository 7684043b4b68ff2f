"""Quotas, overage billing, threshold alerts and health scores."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.attrs import with_attrs
from ..functions.ordering import HOUR_US, MINUTE_US, position, running, time_bucket
from ..functions.quantiles import exact_quantiles
from ..schema import is_error, is_success, lookup

# ---- fixed values: monthly trace limits per tier (None = unlimited) -----------------
TRACE_LIMITS = {"free": 50_000, "lunch-money": 100_000, "pro": 1_000_000, "enterprise": None}
# ---- fixed values: monthly AI feature limits ------------------------------------------
HARD_CAPS = {"hallucination": 1_000, "drift": 10, "debug": 50, "eval_generation": 25}
SOFT_LIMITS = {"hallucination": 10_000, "drift": 100, "nlp": 1_000, "security": 10_000, "debug": 200,
               "eval_generation": 250}
SOFT_CAP_FACTOR = 5
FEATURES = list(SOFT_LIMITS)
# ---- fixed values: overage meters (usage column, included, unit, price per unit) ---------
METERS = {
    "traces": ("traces", 1_000_000, 100_000, Decimal("8.00")),
    "users": ("users", 5, 1, Decimal("12.00")),
    "ai_hallucination": ("ai_hallucination_checks", 10_000, 10_000, Decimal("5.00")),
    "ai_drift": ("ai_drift_baselines", 100, 10, Decimal("2.00")),
    "ai_nlp": ("ai_nlp_searches", 1_000, 1_000, Decimal("3.00")),
    "retention": ("retention_days", 90, 30, Decimal("10.00")),
    "ai_debug": ("ai_debug_sessions", 200, 10, Decimal("1.00")),
    "ai_eval": ("ai_eval_generations", 250, 10, Decimal("1.00")),
}
# ---- fixed values: pager severities ----------------------------------------------------------
PAGER_SEVERITY = {"critical": "critical", "high": "error", "medium": "warning", "low": "info"}


def period(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


# ---- monthly quotas ---------------------------------------------------------------------------
def monthly_usage(facts: DataFrame, user: str, ts: str) -> DataFrame:
    return facts.groupBy(user, period(ts).alias("period")).agg(F.count("*").alias("usage"))


def limit_of(tier: Column, limits: dict) -> Column:
    """Limit of a tier; an unknown tier counts as free, NULL means unlimited."""
    known = F.coalesce(tier.isin(*limits), F.lit(False))
    finite = {k: v for k, v in limits.items() if v is not None}
    return lookup(finite, F.when(known, tier).otherwise("free"))


def _fold_runs(batches):
    """Usage and rows before each run, for runs sorted by key and time; one number per key is held."""
    used = seen = 0
    for batch in batches:
        out_used, out_seen = [], []
        for opens, had, n, most in zip(*[batch.column(c).to_pylist() for c in ("_opens", "_had", "n", "most")]):
            if opens:
                used, seen = had or 0, 0
            out_used.append(used)
            out_seen.append(seen)
            seen += n
            used = used + n if most is None else max(used, min(used + n, most))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_key", "_b", "_run", "_first")], pa.array(out_used, pa.int64()), pa.array(out_seen, pa.int64())],
                                         ["_key", "_b", "_run", "_first", "_used", "_seen"])


def admissions(rows: DataFrame, keys: list[str], ts: str, tie: str, limit: Column, used: DataFrame | None = None) -> DataFrame:
    """Add arrival, quota, allowed and usage: a counter per key that grows by one on accepted rows only.

    A key's rows are cut by minute, and a minute into runs of equal limit; over a run of n rows a usage u becomes
    max(u, min(u + n, limit)). Runs are far fewer than rows; they are sorted per key and folded in a stream that holds
    one usage, and inside a run the position decides. ``used`` (keys, usage) is what keys start with, else 0.
    """
    rows = rows.withColumns({"quota": limit.cast("long"), "_key": F.struct(*keys), "_b": time_bucket(F.col(ts), MINUTE_US)})
    w = Window.partitionBy("_key", "_b").orderBy(ts, tie)
    before = F.lag(F.struct("quota")).over(w)
    starts = F.when(before.isNull() | ~before["quota"].eqNullSafe(F.col("quota")), 1).otherwise(0)
    placed = rows.withColumns({"_pos": F.row_number().over(w).cast("long"), "_start": starts})
    placed = placed.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = placed.groupBy("_key", "_b", "_run").agg(F.count("*").alias("n"), F.min("quota").alias("most"), F.min("_pos").alias("_first"))
    if used is None:
        runs = runs.withColumn("_had", F.lit(0).cast("long"))
    else:
        runs = runs.join(used.select(F.struct(*keys).alias("_key"), F.col("usage").alias("_had")), "_key", "left")
    opens = F.row_number().over(Window.partitionBy("_key").orderBy("_b", "_run")) == 1
    kind = f"_key {placed.schema['_key'].dataType.simpleString()}, _b long, _run long, _first long, _used long, _seen long"
    # the window leaves its rows sorted by key, minute and run
    folded = runs.withColumn("_opens", opens).select("_key", "_b", "_run", "_first", "_opens", "_had", "n", "most").mapInArrow(_fold_runs, kind)
    out = placed.join(folded, ["_key", "_b", "_run"])
    arrival = F.col("_seen") + F.col("_pos") - F.col("_first") + 1
    reached = F.col("_used") + F.col("_pos") - F.col("_first") + 1
    return out.withColumns({
        "arrival": arrival, "allowed": F.col("quota").isNull() | (reached <= F.col("quota")),
        "usage": F.when(F.col("quota").isNull(), reached).otherwise(F.greatest(F.col("_used"), F.least(reached, F.col("quota"))))}).drop(
        "_key", "_b", "_run", "_first", "_used", "_seen", "_pos", "_start")


def cost_admissions(rows: DataFrame, keys: list[str], ts: str, tie: str, limit: Column, cost: str, used: DataFrame | None = None) -> DataFrame:
    """Like ``admissions`` with a cost per row: a row whose cost doesn't fit is refused and later, cheaper ones may fit.

    That cannot be computed out of order, so a key's rows pass one task, sorted, in a stream that holds one usage.
    """
    rows = rows.withColumns({"quota": limit.cast("long"), "_key": F.struct(*keys)})
    if used is None:
        rows = rows.withColumn("_had", F.lit(0).cast("long"))
    else:
        rows = rows.join(used.select(F.struct(*keys).alias("_key"), F.col("usage").alias("_had")), "_key", "left")
    rows = rows.withColumn("_opens", F.row_number().over(Window.partitionBy("_key").orderBy(ts, tie)) == 1).drop("_key")
    kept = [c for c in rows.columns if c not in ("_had", "_opens")]

    def fold(batches):
        usage = 0
        for batch in batches:
            allowed, after = [], []
            for opens, had, price, most in zip(*[batch.column(c).to_pylist() for c in ("_opens", "_had", cost, "quota")]):
                if opens:
                    usage = had or 0
                fits = most is None or usage + (price or 0) <= most
                usage += (price or 0) if fits else 0
                allowed.append(fits)
                after.append(usage)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(allowed, pa.bool_()), pa.array(after, pa.int64())], [*kept, "allowed", "usage"])

    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("usage", T.LongType())])
    return rows.mapInArrow(fold, schema)


def quota_decisions(facts: DataFrame, user: str, ts: str, tie: str, tier: str, limits: dict) -> DataFrame:
    """Allowed or refused per arriving row, in time order inside user and month; the tier may change."""
    rows = admissions(facts.withColumn("period", period(ts)), [user, "period"], ts, tie, limit_of(F.col(tier), limits))
    return rows.withColumn("remaining", F.when(F.col("quota").isNotNull(), F.greatest(F.lit(0), F.col("quota") - F.col("usage"))))


def feature_decisions(usage: DataFrame, tie: str, hard: dict | None = None, soft: dict | None = None) -> DataFrame:
    """Decision per AI feature call: allowed, overage or refused; refused calls don't count as usage.

    Free users are refused; lunch-money stops at hard caps; enterprise is unlimited; pro, and any
    other tier, may run over up to five times the limit.
    """
    hard, soft = hard or HARD_CAPS, soft or SOFT_LIMITS
    tier, limit = F.coalesce("tier", F.lit("")), F.coalesce(lookup(soft, F.col("feature")), F.lit(0))
    most = (F.when(tier == "enterprise", None).when(tier == "free", 0)
            .when(tier == "lunch-money", F.coalesce(lookup(hard, F.col("feature")), F.lit(0))).otherwise(limit * SOFT_CAP_FACTOR))
    rows = admissions(usage.withColumn("period", period("used_at")), ["user_id", "feature", "period"], "used_at", tie, most)
    over = ~tier.isin("enterprise", "lunch-money") & (F.col("usage") > limit)
    decision = F.when(~F.col("allowed"), "refused").when(over, "overage").otherwise("allowed")
    return rows.withColumn("decision", decision).withColumnRenamed("arrival", "call_no").drop("quota", "allowed", "usage")


def feature_usage(users: DataFrame, usage: DataFrame, limits: dict | None = None) -> DataFrame:
    """Every feature of every user with usage (0 when unused) and limit."""
    limits = limits or SOFT_LIMITS
    used = usage.groupBy("user_id", "feature").agg(F.count("*").alias("_n"))
    all_pairs = users.select("user_id", F.explode(F.array(*[F.lit(f) for f in FEATURES])).alias("feature"))
    return all_pairs.join(used, ["user_id", "feature"], "left").select(
        "user_id", "feature", F.coalesce("_n", F.lit(0)).alias("used"), lookup(limits, F.col("feature")).alias("quota"))


def burst_decisions(hits: DataFrame, key: str, ts: str, tie: str, limit: int = 100, unit: str = "minute") -> DataFrame:
    """Fixed-window limit: hits beyond ``limit`` per key and minute are rejected."""
    rows = hits.withColumn("window_start", F.date_trunc(unit, ts))
    ranked = position(rows, [key, "window_start"], time_bucket(F.col(ts), 1_000_000), [F.col(ts), F.col(tie)], "hit_no")
    return ranked.withColumn("allowed", F.col("hit_no") <= limit)


# ---- overage billing -----------------------------------------------------------------------------
def overage_lines(usage: DataFrame, key: list[str]) -> DataFrame:
    """Cost per meter in cents, rounded half-even, one row per meter in use."""
    meters = F.array(*[
        F.struct(F.lit(meter).alias("meter"), F.lit(n).alias("meter_no"), F.lit(included).cast("long").alias("included"),
                 F.coalesce(F.col(column), F.lit(included)).cast("long").alias("used"),
                 F.lit(unit).cast("decimal(10,0)").alias("unit"), F.lit(price).cast("decimal(10,2)").alias("price"))
        for n, (meter, (column, included, unit, price)) in enumerate(METERS.items())])
    rows = usage.select(*key, F.explode(meters).alias("m")).select(*key, "m.*")
    over = F.greatest(F.lit(0).cast("long"), F.col("used") - F.col("included"))
    cost = F.bround(over.cast("decimal(18,0)") * F.col("price") / F.col("unit"), 2).cast("decimal(12,2)")
    return rows.withColumns({"overage": over, "cost": cost}).drop("unit", "price")


def overage_totals(lines: DataFrame, key: list[str]) -> DataFrame:
    """Sum of the rounded meter costs."""
    return lines.groupBy(*key).agg(F.sum("cost").alias("total"))


def overage_record(lines: DataFrame, key: list[str]) -> DataFrame:
    """One wide row: included, used, overage and cost of every meter, plus the total."""
    cols = []
    for meter in METERS:
        at = F.col("meter") == meter
        cols += [F.max(F.when(at, F.col(c))).alias(f"{meter}_{c}") for c in ("included", "used", "overage", "cost")]
    return lines.groupBy(*key).agg(*cols, F.sum("cost").alias("total"))


def period_usage(accounts: DataFrame, traces: DataFrame, features: DataFrame, members: DataFrame) -> DataFrame:
    """Usage of each account in its period with the defaults users >= 1, retention 90.

    ``traces`` and ``features`` carry (account_id, day, n[, feature]) daily counts, so the
    range join handles days, not single facts.
    """
    inside = (F.col("day") >= F.col("period_start")) & (F.col("day") < F.col("period_end"))
    base = accounts.select("account_id", "period_start", "period_end")
    t = base.join(traces, "account_id").where(inside).groupBy("account_id").agg(F.sum("n").alias("traces"))
    per_feature = base.join(features, "account_id").where(inside).groupBy("account_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("feature") == f, F.col("n"))), F.lit(0)).alias(out)
        for f, out in (("hallucination", "ai_hallucination_checks"), ("drift", "ai_drift_baselines"),
                       ("nlp", "ai_nlp_searches"), ("debug", "ai_debug_sessions"), ("eval_generation", "ai_eval_generations"))])
    people = members.groupBy("account_id").agg(F.count("*").alias("users"))
    out = accounts.join(t, "account_id", "left").join(per_feature, "account_id", "left").join(people, "account_id", "left")
    zero = ["traces", "ai_hallucination_checks", "ai_drift_baselines", "ai_nlp_searches", "ai_debug_sessions", "ai_eval_generations"]
    return out.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in zero},
        "users": F.greatest(F.coalesce("users", F.lit(0)), F.lit(1)),
        "retention_days": F.coalesce("retention_days", F.lit(90))})


def daily_counts(facts: DataFrame, account: str, ts: str, *extra: str) -> DataFrame:
    return facts.groupBy(F.col(account).alias("account_id"), F.to_date(ts).alias("day"), *extra).agg(F.count("*").alias("n"))


def period_counters(accounts: DataFrame, traces_daily: DataFrame, spans_daily: DataFrame) -> DataFrame:
    """Traces plus spans of each account between period start and end."""
    both = traces_daily.select("account_id", "day", "n").unionByName(spans_daily.select("account_id", "day", "n"))
    inside = (F.col("day") >= F.col("period_start")) & (F.col("day") < F.col("period_end"))
    used = accounts.join(both, "account_id").where(inside).groupBy("account_id").agg(F.sum("n").alias("_n"))
    return accounts.join(used, "account_id", "left").withColumn("usage", F.coalesce("_n", F.lit(0))).drop("_n")


def team_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("team_id").agg(F.count("*").alias("members"))


# ---- threshold alerts ---------------------------------------------------------------------------------
def rule_metrics(rules: DataFrame, spans: DataFrame, as_of: Column) -> DataFrame:
    """Metric value of every enabled rule over its own window and agent, in one pass over the spans."""
    widest = rules.agg(F.max("window_minutes")).scalar()
    recent = spans.where(F.col("started_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), widest))
    rows = with_attrs(recent, {"_agent": ("agent.name", "str"), "_tokens": ("llm.total_tokens", "int"),
                               "_cost": ("llm.cost_usd", "float"), "_code": ("error.status_code", "int")})
    s = rows.select("project_id", "trace_id", "started_at", "span_type", "status", "duration_ms",
                    "_agent", "_tokens", "_cost", "_code").alias("s")
    r = rules.where("enabled").select("project_id", "rule_id", "agent_name", "window_minutes", "metric_type").alias("r")
    cond = (
        (F.col("s.project_id") == F.col("r.project_id"))
        & (F.col("s.started_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.col("r.window_minutes")))
        & (F.col("r.agent_name").isNull() | (F.col("r.agent_name") == F.col("s._agent"))))
    hits = s.join(r, cond).select("r.rule_id", "r.metric_type", "s.*")
    bad = (F.col("_code") >= 400) | is_error(F.col("status"))
    model_call = F.col("span_type") == "llm"
    # traces are counted by (rule, trace) first, so that a busy rule is spread over its traces
    per_trace = hits.groupBy("rule_id", "metric_type", "trace_id").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(model_call).alias("calls"),
        F.sum(F.when(model_call, F.col("duration_ms"))).alias("ms"), F.sum("_cost").alias("cost"),
        F.sum(F.when(model_call, F.col("_tokens"))).alias("tokens"))
    sums = per_trace.groupBy("rule_id", "metric_type").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("calls").alias("calls"), F.sum("ms").alias("ms"),
        F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.count("*").alias("traces"))
    p95 = exact_quantiles(hits.where(model_call & (F.col("metric_type") == "latency_p95")), ["rule_id"],
                          "duration_ms", {"p95": 0.95})
    joined = rules.where("enabled").join(sums.drop("metric_type"), "rule_id", "left").join(p95, "rule_id", "left")
    m = F.col("metric_type")
    value = (
        F.when(m == "error_rate", F.try_divide(F.col("bad"), F.col("n")))
        .when(m == "success_rate", F.try_divide(F.col("n") - F.col("bad"), F.col("n")))
        .when(m == "latency_p95", F.col("p95"))
        .when(m == "latency_mean", F.try_divide(F.col("ms"), F.col("calls")))
        .when(m == "cost_per_trace", F.try_divide(F.col("cost"), F.col("traces")))
        .when(m == "token_usage", F.col("tokens").cast("double")))
    return joined.withColumn("value", value).drop("n", "bad", "calls", "ms", "cost", "tokens", "traces", "p95")


def condition_met(value: Column, condition: Column, threshold: Column) -> Column:
    """Threshold test; NULL values and unknown conditions never fire."""
    test = F.when(condition == "gt", value > threshold).when(condition == "lt", value < threshold).when(
        condition == "gte", value >= threshold).when(condition == "lte", value <= threshold)
    return F.coalesce(test, F.lit(False))


def fired_rules(metrics: DataFrame) -> DataFrame:
    return metrics.where(condition_met(F.col("value"), F.col("condition"), F.col("threshold")))


def outside_cooldown(fired: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Fired rules whose last firing is older than their cooldown."""
    last = history.groupBy("rule_id").agg(F.max("fired_at").alias("_last"))
    rows = fired.join(last, "rule_id", "left")
    ready = F.col("_last").isNull() | (F.col("_last") <= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.col("cooldown_minutes")))
    return rows.where(ready).drop("_last")


def dispatch_rows(fired: DataFrame, as_of: Column) -> DataFrame:
    """One row per channel to notify, with pager severity and de-duplication key."""
    rows = fired.withColumn("channel", F.explode("channels"))
    return rows.select(
        "rule_id", "project_id", "channel", "metric_type", "value", "condition", "threshold", "severity",
        lookup(PAGER_SEVERITY, F.col("severity"), "warning").alias("pager_severity"),
        F.concat_ws("-", F.lit("rule"), "rule_id").alias("dedup_key"), as_of.alias("fired_at"))


# ---- health -----------------------------------------------------------------------------------------------
def health_score(error_rate: Column, waste_pct: Column, security_rate: Column, drift_rate: Column) -> Column:
    """100 minus weighted rates, within 0 and 100. Waste comes in percent, the rest as shares."""
    raw = F.lit(100.0) - error_rate * 30 - waste_pct * 15 - security_rate * 15 - drift_rate * 15
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 1)))


def trace_rates(traces: DataFrame, since: Column, *by: str | Column) -> DataFrame:
    return traces.where(F.col("started_at") >= since).groupBy("project_id", *by).agg(
        F.count("*").alias("trace_count"), F.count_if(is_error(F.col("status"))).alias("error_count"))


def project_health(traces: DataFrame, savings: DataFrame, findings: DataFrame, drift: DataFrame, since: Column,
                   days: int, daily: bool = False) -> DataFrame:
    """Health per project (and day): error rate, saving potential, findings, active alerts.

    ``savings`` (project_id, total_cost_usd, monthly_savings), ``findings`` (project_id, findings) and
    ``drift`` (project_id, alerts) hold one row per project.
    """
    total = trace_rates(traces, since)
    cost = F.col("total_cost_usd") * 30 / days
    count = F.col("trace_count")
    rates = (
        total.join(savings, "project_id", "left").join(findings, "project_id", "left").join(drift, "project_id", "left")
        .withColumns({
            "waste_pct": F.coalesce(F.try_divide(F.col("monthly_savings"), cost) * 100, F.lit(0.0)),
            "security_rate": F.least(F.coalesce(F.col("findings"), F.lit(0)) / count, F.lit(1.0)),
            "drift_rate": F.least(F.coalesce(F.col("alerts"), F.lit(0)) / count, F.lit(1.0))}))
    if daily:
        per_day = trace_rates(traces, since, F.to_date("started_at").alias("date"))
        rates = per_day.join(rates.select("project_id", "waste_pct", "security_rate", "drift_rate"), "project_id")
    rate = F.col("error_count") / F.col("trace_count")
    return rates.withColumn("error_rate", rate).withColumn("health_score", health_score(
        F.col("error_rate"), F.col("waste_pct"), F.col("security_rate"), F.col("drift_rate")))
