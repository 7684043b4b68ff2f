"""Tables kept up to date by micro-batches, late rows included: rollups, traces, quotas, alerts.

Every job here is a ``foreachBatch`` writer over ``carried`` tables. Its watermark is the greatest event
time of the batches before, less a delay. Rows behind it aren't dropped: they are set aside or re-open what was closed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.attrs import has_key, with_attrs
from ..functions.ordering import MINUTE_US
from ..operators import drift, metering, rollup
from ..schema import is_error, is_success, severity_name, severity_rank
from .carried import Carried, Marks, delete, parts


# ---- rollups as mergeable parts ---------------------------------------------------------
@dataclass(frozen=True)
class Daily:
    """A daily rollup that can be added to: counts, sums, means, extremes, quantile sketches.

    ``rows`` makes key columns and measures of facts; ``date`` is the day of ``started_at``. Sketches
    (KLL) hold a group's values as they are up to their size, and a rank within about 1 % beyond.
    """

    keys: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    counts: dict[str, Callable[[], Column]] = field(default_factory=dict)
    sums: dict[str, str] = field(default_factory=dict)
    means: dict[str, str] = field(default_factory=dict)
    least: dict[str, str] = field(default_factory=dict)
    most: dict[str, str] = field(default_factory=dict)
    quantiles: dict[str, tuple[str, float]] = field(default_factory=dict)

    @property
    def by(self) -> list[str]:
        return [*self.keys, "date"]

    @property
    def _sketched(self) -> list[str]:
        return sorted({column for column, _ in self.quantiles.values()})

    def parts(self, facts: DataFrame, late: bool = False) -> DataFrame:
        """Mergeable rows of some facts; combined before the shuffle."""
        rows = self.rows(facts).withColumn("date", rollup.day())
        out = [F.count_if(c()).alias(n) for n, c in self.counts.items()]
        out += [F.sum(c).alias(n) for n, c in self.sums.items()]
        for n, c in self.means.items():
            out += [F.sum(c).alias(f"{n}_sum"), F.count(c).alias(f"{n}_n")]
        out += [F.min(c).alias(n) for n, c in self.least.items()] + [F.max(c).alias(n) for n, c in self.most.items()]
        out += [F.expr(f"kll_sketch_agg_double(cast({c} as double))").alias(f"{c}_sketch") for c in self._sketched]
        return rows.groupBy(*self.by).agg(*out, F.count_if(F.lit(late)).alias("late_rows"))

    def merge(self, stored: DataFrame) -> DataFrame:
        add = [*self.counts, *self.sums, *[f"{n}_{p}" for n in self.means for p in ("sum", "n")], "late_rows"]
        out = [F.sum(n).alias(n) for n in add]
        out += [F.min(n).alias(n) for n in self.least] + [F.max(n).alias(n) for n in self.most]
        out += [F.expr(f"kll_merge_agg_double({c}_sketch)").alias(f"{c}_sketch") for c in self._sketched]
        return stored.groupBy(*self.by).agg(*out)

    def read(self, merged: DataFrame) -> DataFrame:
        means = [F.try_divide(f"{n}_sum", f"{n}_n").alias(n) for n in self.means]
        ranks = [F.expr(f"kll_sketch_get_quantile_double({c}_sketch, {q}D)").alias(n) for n, (c, q) in self.quantiles.items()]
        return merged.select(*self.by, *self.counts, *self.sums, *means, *self.least, *self.most, *ranks, "late_rows")


def _any() -> Column:
    return F.lit(True)


def _failed() -> Column:
    return is_error(F.col("status"))


def _good() -> Column:
    return is_success(F.col("status"))


def _workflow_rows(traces: DataFrame) -> DataFrame:
    return with_attrs(traces.where(has_key("attributes", "n8n.workflow.id")), rollup.WORKFLOW)


def _ai_node_rows(spans: DataFrame) -> DataFrame:
    rows = spans.where((F.col("span_type") == "llm") & has_key("attributes", "n8n.workflow.id"))
    return with_attrs(rows, {"workflow_id": rollup.WORKFLOW["workflow_id"], **rollup.USAGE}).withColumnRenamed("name", "node_name")


def _node_rows(spans: DataFrame) -> DataFrame:
    rows = spans.where((F.col("span_type") != "llm") & has_key("attributes", "n8n.workflow.id"))
    return with_attrs(rows, {"workflow_id": rollup.WORKFLOW["workflow_id"], "node_name": ("n8n.node.name", "str"), "node_type": ("n8n.node.type", "str")})


def _usage_rows(spans: DataFrame) -> DataFrame:
    return with_attrs(spans.where("span_type = 'llm'"), rollup.USAGE)


_DURATION = {"avg_duration_ms": "duration_ms"}
_TOKENS = {"prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "total_tokens": "total_tokens", "total_cost_usd": "cost_usd"}

#: The daily rollups by name; workflow_daily reads traces, the others spans.
DAILY = {
    "workflow_daily": Daily(("project_id", "workflow_id", "workflow_name"), _workflow_rows,
                            {"execution_count": _any, "error_count": _failed, "success_count": _good}, means=_DURATION,
                            least={"min_duration_ms": "duration_ms"}, most={"max_duration_ms": "duration_ms"},
                            quantiles={f"p{n}_duration_ms": ("duration_ms", n / 100) for n in (50, 95, 99)}),
    "ai_node_daily": Daily(("project_id", "workflow_id", "node_name", "model", "vendor"), _ai_node_rows,
                           {"call_count": _any, "error_count": _failed}, _TOKENS, {"avg_latency_ms": "latency_ms"},
                           quantiles={"p95_latency_ms": ("latency_ms", 0.95)}),
    "node_daily": Daily(("project_id", "workflow_id", "node_name", "node_type", "span_type"), _node_rows,
                        {"execution_count": _any, "error_count": _failed, "success_count": _good}, means=_DURATION,
                        quantiles={"p95_duration_ms": ("duration_ms", 0.95)}),
    "span_daily": Daily(("project_id", "service_name", "span_type"), lambda spans: spans, {"span_count": _any, "error_count": _failed}, means=_DURATION,
                        quantiles={"p95_duration_ms": ("duration_ms", 0.95)}),
    "usage_daily": Daily(("project_id", "vendor", "model"), _usage_rows, {"call_count": _any, "success_count": _good}, _TOKENS, {"avg_latency_ms": "latency_ms"}),
}


class RollupUpkeep:
    """Daily rollups of a stream of facts, none of whose rows is lost.

    A row is late if its day was over at the watermark. Late rows go, as they came, to ``late/batch_id=…`` for
    inspection, and their parts are merged into the stored rollup like all others, counted in ``late_rows``.
    """

    def __init__(self, spark: SparkSession, folder: str, names: list[str], ts: str = "started_at", delay: str = "1 day", every: int = 16) -> None:
        self.spark, self.folder, self.ts = spark, folder, ts
        self.rollups = {n: DAILY[n] for n in names}
        self.marks = Marks(spark, f"{folder}/marks", delay)
        self.every = every

    def _stored(self, name: str, like: DataFrame) -> Carried:
        return Carried(self.spark, f"{self.folder}/{name}", like.schema, self.rollups[name].by, self.rollups[name].merge, self.every)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            seen = self.marks.before(batch_id)
            over = F.coalesce(F.date_add(F.to_date(self.ts), 1).cast("timestamp") <= self.marks.watermark(seen), F.lit(False))
            rows.where(over).write.mode("overwrite").parquet(f"{self.folder}/late/batch_id={batch_id}")
            for name, daily in self.rollups.items():
                new = daily.parts(rows.where(~over)).unionByName(daily.parts(rows.where(over), late=True))
                self._stored(name, new).put(batch_id, new)
            newest = rows.agg(F.max(self.ts).cast("string")).first()[0]
            self.marks.put(batch_id, max(filter(None, (seen, newest)), default=None))
        finally:
            rows.unpersist()

    def read(self, name: str, facts: DataFrame) -> DataFrame:
        """The rollup as it stands; ``facts`` is any DataFrame of the stream's schema."""
        daily = self.rollups[name]
        return daily.read(self._stored(name, daily.parts(facts.limit(0))).current())

    def late(self) -> DataFrame | None:
        """Rows that came late, with their batch; None before the first batch."""
        return self.spark.read.parquet(f"{self.folder}/late") if parts(self.spark, f"{self.folder}/late") else None


# ---- traces closed by silence ----------------------------------------------------------------
SESSION = ("project_id string, trace_id string, first_at timestamp, last_at timestamp, completed_at timestamp, failed boolean, "
           "first_span_id string, span_count long")


class TraceAssembly:
    """Trace rows, written once no span of the trace came for ``gap``.

    Spans at most ``gap`` apart are one session. A batch joins its spans to the open sessions of their
    traces; sessions whose last span is ``gap`` behind the watermark are closed and written. A span that
    comes after that re-opens its trace: it starts a session of its own, which closes as one more part.
    ``traces`` puts parts together, so no span is lost, however late.

    Spans are combined per trace and time slot of length ``gap`` before anything is sorted: spans of one slot
    are one session anyway, so even a trace that holds a third of all spans is as many rows as slots.
    """

    def __init__(self, spark: SparkSession, folder: str, gap: str = "30 minutes", delay: str = "10 minutes") -> None:
        self.spark, self.folder = spark, folder
        self.gap = F.expr(f"INTERVAL {gap}")
        self.gap_us = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + self.gap)).first()[0]
        self.marks = Marks(spark, f"{folder}/marks", delay)

    def _sessions(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("project_id", "trace_id").orderBy("first_at", "last_at")
        before = F.max("last_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(before.isNull() | (F.col("first_at") > before + self.gap), 1).otherwise(0)
        numbered = rows.withColumn("_opens", opens).withColumn("_no", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy("project_id", "trace_id", "_no").agg(
            F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("completed_at").alias("completed_at"),
            F.bool_or("failed").alias("failed"), F.min_by("first_span_id", F.struct("first_at", "first_span_id")).alias("first_span_id"),
            F.sum("span_count").alias("span_count")).drop("_no")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        slot = F.floor(F.unix_micros("started_at") / F.lit(self.gap_us))
        new = batch.groupBy("project_id", "trace_id", slot.alias("_slot")).agg(
            F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), F.max("ended_at").alias("completed_at"),
            F.bool_or(_failed()).alias("failed"), F.min_by("span_id", F.struct("started_at", "span_id")).alias("first_span_id"),
            F.count("*").alias("span_count")).drop("_slot")
        if parts(self.spark, f"{self.folder}/open") and batch_id > 0:
            new = new.unionByName(self.spark.read.schema(SESSION).parquet(f"{self.folder}/open/batch_id={batch_id - 1}"))
        sessions = self._sessions(new).persist()
        try:
            newest = max(filter(None, (self.marks.before(batch_id), sessions.agg(F.max("last_at").cast("string")).first()[0])), default=None)
            over = F.coalesce(F.col("last_at") + self.gap <= self.marks.watermark(newest), F.lit(False))
            sessions.where(over).write.mode("overwrite").parquet(f"{self.folder}/closed/batch_id={batch_id}")
            sessions.where(~over).write.mode("overwrite").parquet(f"{self.folder}/open/batch_id={batch_id}")
            self.marks.put(batch_id, newest)
            for b in parts(self.spark, f"{self.folder}/open"):
                if b < batch_id - 1:  # a replay reads the batch before
                    delete(self.spark, f"{self.folder}/open/batch_id={b}")
        finally:
            sessions.unpersist()

    def closed(self) -> DataFrame:
        """Every part written so far, with its batch."""
        return self.spark.read.schema(SESSION + ", batch_id long").parquet(f"{self.folder}/closed")

    def open(self) -> DataFrame:
        return self.spark.read.schema(SESSION).parquet(f"{self.folder}/open/batch_id={parts(self.spark, f'{self.folder}/open')[-1]}")

    def traces(self) -> DataFrame:
        """One row per trace of all its parts; ``closed`` says whether all of them are, ``parts`` how many there were."""
        done = self.closed().drop("batch_id").withColumn("_open", F.lit(False))
        every = done.unionByName(self.open().withColumn("_open", F.lit(True)))
        return every.groupBy("project_id", "trace_id").agg(
            F.min("first_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.bool_or("failed").alias("failed"),
            F.min_by("first_span_id", F.struct("first_at", "first_span_id")).alias("first_span_id"), F.sum("span_count").alias("span_count"),
            F.count("*").alias("parts"), (~F.bool_or("_open")).alias("closed"))


# ---- quotas ---------------------------------------------------------------------------------------
class QuotaUpkeep:
    """Admission of arrivals (row_id, user_id, period, arrived_at, cost, quota) against usage carried per user and period.

    Usage grows on accepted rows only. Where all costs are 1 (``unit``) a user's rows are spread over
    tasks by minute; other costs are judged in order, in a stream that holds one number per user. Decisions
    go to ``data/batch_id=…``. Usage of periods that ended ``keep_periods`` months before the newest one is dropped.
    """

    OUT = ["row_id", "user_id", "period", "cost", "allowed", "usage"]

    def __init__(self, spark: SparkSession, folder: str, unit: bool = True, keep_periods: int = 2, every: int = 16) -> None:
        self.folder, self.unit, self.keep = folder, unit, keep_periods
        self.used = Carried(spark, f"{folder}/used", "user_id long, period string, usage long", ["user_id", "period"], every=every)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("row_id", "user_id", "period", "arrived_at", "cost", F.col("quota").alias("most"))
        before = self.used.before(batch_id)
        args = (rows, ["user_id", "period"], "arrived_at", "row_id", F.col("most"))
        judged = metering.admissions(*args, used=before) if self.unit else metering.cost_admissions(*args, cost="cost", used=before)
        path = f"{self.folder}/data/batch_id={batch_id}"
        judged.select(*self.OUT).write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(judged.select(*self.OUT).schema).parquet(path)
        after = done.groupBy("user_id", "period").agg(F.max("usage").alias("usage")).withColumn("_gone", F.lit(False))
        newest = F.to_date(F.concat(F.lit(done.agg(F.max("period")).first()[0]), F.lit("-01")))
        old = before.where(F.months_between(newest, F.to_date(F.concat("period", F.lit("-01")))) > self.keep)
        stale = old.join(after, ["user_id", "period"], "left_anti").withColumn("_gone", F.lit(True))
        self.used.put(batch_id, after.unionByName(stale))

    def decisions(self) -> DataFrame:
        return self.used.spark.read.parquet(f"{self.folder}/data").drop("batch_id")


# ---- alerts and drift ------------------------------------------------------------------------------
def cooled(due: DataFrame, keys: list[str], at: str, minutes: Column, last: DataFrame | None = None) -> DataFrame:
    """Rows of ``due`` that fire: the first of a key and then the first one ``minutes`` after each that fired.

    ``last`` (keys, last_fired) is when keys fired before. Rows of a key are sorted and pass in a stream that holds one time.
    """
    rows = due.withColumns({"_key": F.struct(*keys), "_at": F.unix_micros(at), "_wait": minutes.cast("long") * MINUTE_US})
    if last is None:
        rows = rows.withColumn("_had", F.lit(None).cast("long"))
    else:
        rows = rows.join(last.select(F.struct(*keys).alias("_key"), F.unix_micros("last_fired").alias("_had")), "_key", "left")
    rows = rows.withColumn("_opens", F.row_number().over(Window.partitionBy("_key").orderBy("_at")) == 1).drop("_key")
    schema = due.schema

    def fold(batches):
        fired = None
        for batch in batches:
            keep = []
            for opens, had, now, wait in zip(*[batch.column(c).to_pylist() for c in ("_opens", "_had", "_at", "_wait")]):
                fired = had if opens else fired
                keep.append(fired is None or now - fired >= (wait or 0))
                fired = now if keep[-1] else fired
            yield batch.select(schema.names).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(fold, schema)


def _instants(first: str | None, last: str | None, step_us: int) -> tuple[Column, Column]:
    """Micros of the instants in (first, last] as bounds; nothing if ``last`` is unknown."""
    low = F.unix_micros(F.lit(first).cast("timestamp")) if first else F.lit(-(1 << 62))
    return low, F.coalesce(F.floor(F.unix_micros(F.lit(last).cast("timestamp")) / F.lit(step_us)) * step_us, F.lit(-(1 << 62)))


class _Evaluated:
    """What alert and drift jobs share: parts per time slot, a watermark, and instants evaluated once each."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], step_minutes: int, keep: str, delay: str, every: int) -> None:
        self.spark, self.folder, self.step = spark, folder, step_minutes * MINUTE_US
        self.marks = Marks(spark, f"{folder}/marks", delay)
        self.horizon: Column = F.lit(None).cast("long")
        self.keep_us = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {keep}"))).first()[0]
        self.parts = Carried(spark, f"{folder}/parts", schema, keys, self._kept, every)

    def _combine(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Parts added up; those too old for any window to come are left out."""
        return self._combine(rows.where(self.horizon.isNull() | (F.col("slot") >= self.horizon)))

    def slot(self, ts: str = "started_at") -> Column:
        """Start of the time slot of an event, in microseconds."""
        return (F.floor(F.unix_micros(ts) / F.lit(self.step)) * self.step).cast("long")

    def advance(self, batch_id: int, fresh: DataFrame) -> tuple[str | None, str | None]:
        """Store a batch's parts; (watermark before, watermark after) as text, or None."""
        fresh = fresh.persist()
        try:
            seen = self.marks.before(batch_id)
            newest = max(filter(None, (seen, fresh.agg(F.max("latest").cast("string")).first()[0])), default=None)
            was, now = (self.spark.range(1).select(self.marks.watermark(x).cast("string")).first()[0] for x in (seen, newest))
            self.horizon = F.unix_micros(F.lit(was).cast("timestamp")) - self.keep_us if was else F.lit(None).cast("long")
            self.parts.put(batch_id, fresh)
            self.marks.put(batch_id, newest)
            return was, now
        finally:
            fresh.unpersist()

    def alerts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data").drop("batch_id")


class AlertUpkeep(_Evaluated):
    """Alert rules over spans, evaluated every ``step_minutes`` for windows that are over.

    An instant is evaluated once the watermark has passed it, over the spans that have come by then; it is never
    evaluated early, so rules of the kind "less than" don't fire on half a window. Spans are kept as sums per project, agent
    and slot, with a KLL sketch for p95 and an HLL sketch for the number of traces. Alerts go to ``data/batch_id=…``;
    when a rule last fired is carried. Windows must be multiples of the step.
    """

    KEYS = ["project_id", "agent", "slot"]
    STATE = ("project_id string, agent string, slot long, latest timestamp, n long, bad long, calls long, ms double, cost double, tokens long, "
             "p95 binary, traces binary")

    def __init__(self, spark: SparkSession, folder: str, rules: DataFrame, step_minutes: int = 5, delay: str = "5 minutes", every: int = 16) -> None:
        self.rules = rules.where("enabled").select("rule_id", "project_id", "agent_name", "metric_type", "window_minutes", "condition", "threshold", "cooldown_minutes")
        bounds = self.rules.agg(F.max("window_minutes").alias("most"), F.max(F.col("window_minutes") % step_minutes).alias("odd")).first()
        if bounds.odd:
            raise ValueError(f"windows of rules must be multiples of {step_minutes} minutes")
        super().__init__(spark, folder, self.STATE, self.KEYS, step_minutes, f"{(bounds.most or 0) + step_minutes} minutes", delay, every)
        self.fired = Carried(spark, f"{folder}/fired", "rule_id string, last_fired timestamp", ["rule_id"], every=every)

    def _combine(self, rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("n", "bad", "calls", "ms", "cost", "tokens")]
        return rows.groupBy(*self.KEYS).agg(F.max("latest").alias("latest"), *sums, F.expr("kll_merge_agg_double(p95)").alias("p95"),
                                            F.hll_union_agg("traces").alias("traces"))

    def _parts(self, spans: DataFrame) -> DataFrame:
        rows = with_attrs(spans, {"agent": ("agent.name", "str"), "_tokens": ("llm.total_tokens", "int"), "_cost": ("llm.cost_usd", "float"),
                                  "_code": ("error.status_code", "int")})
        call = F.col("span_type") == "llm"
        return rows.withColumn("slot", self.slot()).groupBy(*self.KEYS).agg(
            F.max("started_at").alias("latest"), F.count("*").alias("n"), F.count_if((F.col("_code") >= 400) | _failed()).alias("bad"),
            F.count_if(call).alias("calls"), F.sum(F.when(call, F.col("duration_ms"))).alias("ms"), F.sum("_cost").alias("cost"),
            F.sum(F.when(call, F.col("_tokens"))).alias("tokens"),
            F.expr("kll_sketch_agg_double(case when span_type = 'llm' then duration_ms end)").alias("p95"), F.hll_sketch_agg("trace_id").alias("traces"))

    def values(self, rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
        """Value of every rule at the instants in (first, last] whose window holds spans."""
        low, high = _instants(first, last, self.step)
        p, r = rows.alias("p"), self.rules.alias("r")
        met = p.join(r, (F.col("p.project_id") == F.col("r.project_id")) & (F.col("r.agent_name").isNull() | (F.col("r.agent_name") == F.col("p.agent"))))
        # a slot counts at the instants from its end to the end of the window that begins with it
        from_, to = F.col("slot") + self.step, F.col("slot") + F.col("window_minutes").cast("long") * MINUTE_US
        step, at = F.lit(self.step).cast("long"), F.greatest(from_, F.floor(low / F.lit(self.step)).cast("long") * self.step + self.step)
        until = F.least(to, high.cast("long"))
        spread = met.where(at <= until).withColumn("at", F.explode(F.sequence(at, until, step)))
        rule = ["rule_id", "metric_type", "condition", "threshold", "cooldown_minutes"]
        m = F.col("metric_type")
        sums = spread.groupBy(*rule, "at").agg(
            *[F.sum(c).alias(c) for c in ("n", "bad", "calls", "ms", "cost", "tokens")],
            F.expr("kll_merge_agg_double(p95)").alias("p95"), F.hll_sketch_estimate(F.hll_union_agg("traces")).alias("traces"))
        value = (F.when(m == "error_rate", F.try_divide("bad", "n")).when(m == "success_rate", F.try_divide(F.col("n") - F.col("bad"), F.col("n")))
                 .when(m == "latency_mean", F.try_divide("ms", "calls")).when(m == "cost_per_trace", F.try_divide("cost", "traces"))
                 .when(m == "token_usage", F.col("tokens").cast("double"))
                 .when((m == "latency_p95") & (F.col("calls") > 0), F.expr("kll_sketch_get_quantile_double(p95, 0.95D)")))
        return sums.select(*rule, F.timestamp_micros("at").alias("evaluated_at"), value.alias("value"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        was, now = self.advance(batch_id, self._parts(batch))
        due = self.values(self.parts.before(batch_id + 1), was, now).where(metering.condition_met(F.col("value"), F.col("condition"), F.col("threshold")))
        path = f"{self.folder}/data/batch_id={batch_id}"
        out = cooled(due, ["rule_id"], "evaluated_at", F.col("cooldown_minutes"), self.fired.before(batch_id)).select("rule_id", "metric_type", "evaluated_at", "value")
        out.write.mode("overwrite").parquet(path)
        self.fired.put(batch_id, self.spark.read.schema(out.schema).parquet(path).groupBy("rule_id").agg(F.max("evaluated_at").alias("last_fired")))


_MEASURED = {"duration": "duration_ms", "token_usage": "tokens", "tool_calls": "tool_calls", "response_length": "response_length", "cost": "cost_usd"}


class DriftUpkeep(_Evaluated):
    """Agent drift every ``step_minutes`` against baselines as of the last full hour, and hourly baseline snapshots.

    Agent spans are kept as sums, sums of squares and sketches per slot. At an instant the last ``hours`` are compared
    with the ``days`` before the last full hour; both are sums of slots, so no span is read twice.
    Each batch also appends one snapshot of all baselines, as of the last full hour, unless that hour has one.
    """

    STATE = ("project_id string, agent_name string, service_name string, slot long, latest timestamp, n long, good long, errors long, "
             + ", ".join(f"{m}_n long, {m}_sum double, {m}_squares double" for m in _MEASURED)
             + ", duration_min double, duration_max double, duration_sketch binary, token_usage_sketch binary")

    def __init__(self, spark: SparkSession, folder: str, step_minutes: int = 15, hours: int = 24, days: int = 7, sensitivity: float = 2.0,
                 cooldown_minutes: int = 60, delay: str = "15 minutes", every: int = 16, checks: bool = True) -> None:
        self.checks = checks  # without them, only baselines are kept up
        if 60 % step_minutes:
            raise ValueError("the step must divide an hour")
        super().__init__(spark, folder, self.STATE, [*drift.AGENT, "slot"], step_minutes, f"{days * 24 + 2} hours", delay, every)
        self.hours, self.days, self.sensitivity, self.cooldown = hours, days, sensitivity, cooldown_minutes
        self.fired = Carried(spark, f"{folder}/fired", "project_id string, agent_name string, service_name string, last_fired timestamp", drift.AGENT, every=every)

    _ADDED = ["n", "good", "errors", *[f"{m}_{p}" for m in _MEASURED for p in ("n", "sum", "squares")]]

    def _combined(self) -> list[Column]:
        return [*[F.sum(c).alias(c) for c in self._ADDED], F.min("duration_min").alias("duration_min"), F.max("duration_max").alias("duration_max"),
                *[F.expr(f"kll_merge_agg_double({m}_sketch)").alias(f"{m}_sketch") for m in ("duration", "token_usage")]]

    def _combine(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.parts.keys).agg(F.max("latest").alias("latest"), *self._combined())

    def _parts(self, spans: DataFrame) -> DataFrame:
        rows = drift.agent_rows(spans).withColumn("slot", self.slot())
        out = [F.max("started_at").alias("latest"), F.count("*").alias("n"), F.count_if(_good()).alias("good"), F.count_if(_failed()).alias("errors")]
        for name, column in _MEASURED.items():
            v = F.col(column).cast("double")
            out += [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"), F.sum(v * v).alias(f"{name}_squares")]
        out += [F.min("duration_ms").alias("duration_min"), F.max("duration_ms").alias("duration_max")]
        out += [F.expr(f"kll_sketch_agg_double(cast({c} as double))").alias(f"{m}_sketch") for m, c in (("duration", "duration_ms"), ("token_usage", "tokens"))]
        return rows.groupBy(*drift.AGENT, "slot").agg(*out)

    @staticmethod
    def _measures() -> list[Column]:
        """Means and deviations of sums, as ``agent_baselines`` names them."""
        out = [F.col("n").alias("sample_size")]
        for m in _MEASURED:
            mean = F.try_divide(f"{m}_sum", f"{m}_n")
            variance = F.try_divide(f"{m}_squares", f"{m}_n") - mean * mean  # below rounding it is none
            spread = F.when(variance.isNotNull(), F.when(variance > mean * mean * 1e-12, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0))
            out += [mean.alias(f"{m}_mean")] + ([] if m == "cost" else [spread.alias(f"{m}_stddev")])
        return [*out, F.try_divide("good", "n").alias("success_rate")]

    def anomalies(self, rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
        """Scored agents at the instants in (first, last]: AGENT, evaluated_at and the array of anomalies."""
        low, high = _instants(first, last, self.step)
        hour = 60 * MINUTE_US

        def summed(width: int, grid: int, begin: Column) -> DataFrame:
            """Sums at the instants of a grid, from ``begin`` on, over the ``width`` before each; a slot goes to the instants that see it."""
            down = lambda c: (F.floor(c / F.lit(grid)) * grid).cast("long")
            at = F.greatest(down(F.col("slot") + self.step + grid - 1), begin)
            until = F.least(down(F.col("slot") + width), high.cast("long"))
            spread = rows.where(at <= until).withColumn("at", F.explode(F.sequence(at, until, F.lit(grid).cast("long"))))
            return spread.groupBy(*drift.AGENT, "at").agg(*[F.sum(c).alias(c) for c in self._ADDED]).select(*drift.AGENT, "at", *self._measures())

        next_one = (F.floor(low / F.lit(self.step)) * self.step + self.step).cast("long")
        now = summed(self.hours * hour, self.step, next_one)
        now = now.select(*drift.AGENT, "at", (F.floor(F.col("at") / F.lit(hour)) * hour).alias("hour"), "sample_size", "success_rate",
                         *[F.col(f"{m}_mean").alias(m) for m in _MEASURED])
        base = summed(self.days * 24 * hour, hour, (F.floor(low / F.lit(hour)) * hour).cast("long")).withColumnRenamed("at", "hour")
        base = base.withColumn("baseline_id", F.col("hour").cast("string"))
        scored = drift.score_agents(now.withColumn("_at", F.col("at")), base, self.sensitivity, [*drift.AGENT, "hour"], ["_at"])
        return scored.where(F.size("anomalies") > 0).withColumn("evaluated_at", F.timestamp_micros("_at")).drop("_at", "hour", "baseline_id")

    def snapshot(self, rows: DataFrame, at_us: int) -> DataFrame:
        """Baselines of all agents over the ``days`` before an instant."""
        inside = rows.where((F.col("slot") < at_us) & (F.col("slot") >= at_us - self.days * 24 * 60 * MINUTE_US))
        merged = inside.groupBy(*drift.AGENT).agg(*self._combined())
        ranks = [F.expr(f"kll_sketch_get_quantile_double({m}_sketch, {q}D)").alias(f"{m}_p{int(q * 100)}")
                 for m, qs in (("duration", (0.5, 0.95, 0.99)), ("token_usage", (0.5, 0.95))) for q in qs]
        return merged.select(*drift.AGENT, *self._measures(), *ranks, "duration_min", "duration_max", F.col("errors").alias("error_count"),
                             F.col("cost_sum").alias("cost_total"), F.timestamp_micros(F.lit(at_us)).alias("window_end"))

    def refresh(self, batch_id: int, now: str | None) -> None:
        """Append the snapshot of the last full hour; an hour that has one is left alone."""
        if now is None:
            return
        hour = 60 * MINUTE_US
        at = self.spark.range(1).select((F.floor(F.unix_micros(F.lit(now).cast("timestamp")) / F.lit(hour)) * hour).cast("long")).first()[0]
        if at not in parts(self.spark, f"{self.folder}/baselines", "window_us"):
            self.snapshot(self.parts.before(batch_id + 1), at).write.mode("overwrite").parquet(f"{self.folder}/baselines/window_us={at}")

    def baselines(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/baselines").drop("window_us")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        was, now = self.advance(batch_id, self._parts(batch))
        if self.checks:
            self.check(batch_id, was, now)
        self.refresh(batch_id, now)

    def check(self, batch_id: int, was: str | None, now: str | None) -> None:
        scored = self.anomalies(self.parts.before(batch_id + 1), was, now)
        rank = F.array_max(F.transform("anomalies", lambda m: severity_rank(m["severity"])))
        rows = scored.select(*drift.AGENT, "evaluated_at", severity_name(rank).alias("severity"),
                             F.array_sort(F.transform("anomalies", lambda m: m["metric_name"])).alias("metrics"), "anomalies")
        path = f"{self.folder}/data/batch_id={batch_id}"
        out = cooled(rows, drift.AGENT, "evaluated_at", F.lit(self.cooldown), self.fired.before(batch_id))
        out.write.mode("overwrite").parquet(path)
        self.fired.put(batch_id, self.spark.read.schema(out.schema).parquet(path).groupBy(*drift.AGENT).agg(F.max("evaluated_at").alias("last_fired")))
