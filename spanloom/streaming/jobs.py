"""Structured Streaming forms of the batch operators.

Transformations take and return streaming DataFrames; sinks write Parquet below
a shared folder, one sub-folder per micro-batch, so a replayed batch replaces
its own output and a lost executor or driver never doubles rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.attrs import with_attrs
from ..functions.ordering import latest_per_key
from ..operators import metering, security
from ..operators.rollup import USAGE, usage_sums
from ..schema import is_error, is_success
from ..session import checkpoint_root
from ..sources import native
from .upkeep import cooled


# ---- sources ------------------------------------------------------------------
def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet", pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def topic_stream(spark: SparkSession, servers: str, topic: str, offsets_per_batch: int | None = None) -> DataFrame:
    """JSON topic from the earliest offset as (key, payload, received_at); needs the Kafka package on the cluster."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", "false")
    if offsets_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_batch)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload"),
                                F.col("timestamp").alias("received_at"))


# ---- sinks -----------------------------------------------------------------------
def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a replay overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run(stream: DataFrame, folder: str, mode: str = "append", writer: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Process what is there and stop; calling it again with the same folder resumes."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(writer or batch_writer(f"{folder}/data")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_output(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Everything a job wrote, with ``batch_id``."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(full).parquet(f"{folder}/data")


def newest_output(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Newest version of every key of a job in update mode."""
    return latest_per_key(read_output(spark, folder, schema), keys, ["batch_id"]).drop("batch_id")


# ---- parsing -----------------------------------------------------------------------
def trace_fanout(folder: str) -> Callable[[DataFrame, int], None]:
    """Writer for trace messages: trace rows, span rows and rejects from one parsed batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = native.parse_traces(batch).persist()
        try:
            parts = {
                "traces": native.trace_rows(parsed),
                "spans": native.nested_span_rows(parsed, inherit="missing"),
                "rejects": parsed.where("reject_reason IS NOT NULL").drop("t"),
            }
            for name, rows in parts.items():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return write


def trace_feed(payloads: DataFrame) -> DataFrame:
    """Trace-created messages (key, value) per project for a live feed."""
    parsed = native.parse_traces(payloads)
    project = native.project_of(parsed)
    t = lambda name: F.col(f"t.{name}")
    value = F.to_json(F.struct(
        F.lit("trace.created").alias("event"), t("trace_id").alias("trace_id"), project.alias("project_id"),
        F.coalesce(t("service_name"), F.lit("unknown")).alias("service_name"), F.coalesce(t("status"), F.lit("UNKNOWN")).alias("status"),
        F.coalesce(t("duration_ms"), F.lit(0.0)).alias("duration_ms"), F.coalesce(F.size(t("spans")), F.lit(0)).alias("span_count"),
        t("started_at").alias("started_at"), F.nullif(F.get_json_object(t("metadata"), "$.workflow_id"), F.lit("")).alias("workflow_id")))
    return parsed.where("reject_reason IS NULL").select(project.alias("key"), value.alias("value"))


# ---- stateful transformations --------------------------------------------------------
def dedupe(spans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival of each span id within the delay."""
    return spans.withWatermark("started_at", delay).dropDuplicatesWithinWatermark(["span_id"])


def usage_daily(spans: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily model usage kept up to date; run in update mode."""
    rows = with_attrs(spans.where("span_type = 'llm'"), USAGE).withWatermark("started_at", delay)
    return rows.groupBy(F.window("started_at", "1 day").alias("w"), "project_id", "vendor", "model").agg(
        *usage_sums(), F.count_if(is_success(F.col("status"))).alias("success_count")
    ).withColumn("date", F.to_date("w.start")).drop("w")


def span_daily(spans: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily span metrics with a KLL p95; run in update mode."""
    rows = spans.withWatermark("started_at", delay)
    out = rows.groupBy(F.window("started_at", "1 day").alias("w"), "project_id", "service_name", "span_type").agg(
        F.count("*").alias("span_count"), F.count_if(is_error(F.col("status"))).alias("error_count"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.expr("kll_sketch_agg_double(duration_ms)").alias("sketch"))
    return out.withColumns({"date": F.to_date("w.start"), "p95_duration_ms": F.expr("kll_sketch_get_quantile_double(sketch, 0.95D)")}).drop("w", "sketch")


def _trace_aggs() -> list[Column]:
    return [
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("completed_at"), F.bool_or(is_error(F.col("status"))).alias("failed"),
        F.min_by("span_id", F.struct("started_at", "span_id")).alias("first_span_id"), F.count("*").alias("span_count")]


def live_traces(spans: DataFrame, delay: str = "1 day") -> DataFrame:
    """Parts of traces, one per day, that grow with their spans; run in update mode, take the newest
    version per (project_id, trace_id, window_start), then ``merge_parts``."""
    rows = spans.withWatermark("started_at", delay)
    return rows.groupBy(F.window("started_at", "1 day").alias("w"), "project_id", "trace_id").agg(*_trace_aggs()).withColumn("window_start", F.col("w.start")).drop("w")


def closed_traces(spans: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Trace parts, emitted once no span came for ``gap``; a late burst gives one more part."""
    rows = spans.withWatermark("started_at", delay)
    return rows.groupBy(F.session_window("started_at", gap).alias("w"), "project_id", "trace_id").agg(*_trace_aggs()).select(
        "project_id", "trace_id", "started_at", "completed_at", "failed", "first_span_id", "span_count",
        F.col("w.end").alias("closed_at"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per trace from its parts."""
    return parts.groupBy("project_id", "trace_id").agg(
        F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.bool_or("failed").alias("failed"),
        F.min_by("first_span_id", F.struct("started_at", "first_span_id")).alias("first_span_id"), F.sum("span_count").alias("span_count"))


def bursts(hits: DataFrame, key: str, ts: str, limit: int = 100, unit: str = "1 minute", delay: str = "1 day") -> DataFrame:
    """Hits and rejected hits per key and fixed window; run in update mode."""
    counts = hits.withWatermark(ts, delay).groupBy(F.window(ts, unit).alias("w"), key).agg(F.count("*").alias("hits"))
    return counts.select(key, F.col("w.start").alias("window_start"), "hits",
                         F.greatest(F.col("hits") - limit, F.lit(0)).alias("rejected"))


def pair_runs(starts: DataFrame, ends: DataFrame, longest: str = "24 hours", grace: str = "1 hour") -> DataFrame:
    """Workflow starts joined to their ends by execution id; starts without an end come out as running."""
    s = starts.withWatermark("started_at", grace).alias("s")
    e = ends.withWatermark("ended_at", grace).alias("e")
    cond = (
        (F.col("s.execution_id") == F.col("e.execution_id")) & (F.col("e.ended_at") >= F.col("s.started_at"))
        & (F.col("e.ended_at") <= F.col("s.started_at") + F.expr(f"INTERVAL {longest}")))
    return s.join(e, cond, "left_outer").select(
        "s.execution_id", "s.started_at", "e.ended_at", F.coalesce("e.outcome", F.lit("running")).alias("outcome"))


def rule_windows(rules: DataFrame, spans: DataFrame, window: str = "1 hour", slide: str = "5 minutes", delay: str = "1 day") -> DataFrame:
    """Error rate and volume per rule and sliding window; run in update mode."""
    s = with_attrs(spans, {"_agent": ("agent.name", "str")}).withWatermark("started_at", delay).alias("s")
    r = rules.where("enabled").select("rule_id", "project_id", "agent_name", "condition", "threshold", "cooldown_minutes").alias("r")
    hits = s.join(r, (F.col("s.project_id") == F.col("r.project_id"))
                  & (F.col("r.agent_name").isNull() | (F.col("r.agent_name") == F.col("s._agent"))))
    out = hits.groupBy(F.window("started_at", window, slide).alias("w"), "rule_id", "condition", "threshold", "cooldown_minutes").agg(
        F.count("*").alias("n"), F.count_if(is_error(F.col("status"))).alias("errors"))
    return out.select("rule_id", F.col("w.end").alias("evaluated_at"), "condition", "threshold", "cooldown_minutes", "n", "errors",
                      F.try_divide("errors", "n").alias("value"))


def with_cooldown(evaluations: DataFrame, last_fired: DataFrame | None = None) -> DataFrame:
    """Evaluations that fire, at most once per cooldown and rule."""
    due = evaluations.where(metering.condition_met(F.col("value"), F.col("condition"), F.col("threshold")))
    return cooled(due, ["rule_id"], "evaluated_at", F.col("cooldown_minutes"), last_fired).select("rule_id", "evaluated_at", "value")


def scan_stream(spans: DataFrame, delay: str = "1 day") -> DataFrame:
    """Security findings of new model spans, one result per trace within the delay."""
    rows = spans.where("span_type = 'llm'").withWatermark("started_at", delay)
    hits = security.scan(rows).where(F.size("findings") > 0)
    return hits.dropDuplicatesWithinWatermark(["trace_id"]).select(
        "trace_id", "project_id", "span_id", "started_at", "overall_severity", F.size("findings").alias("finding_count"))
