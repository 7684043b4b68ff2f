"""Native trace, span and batch payloads to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.attrs import blank_to
from ..functions.jsontext import duration_or, iso_timestamp
from ..schema import D, L, S, struct

SPAN_IN = struct(
    span_id=S, trace_id=S, parent_span_id=S, name=S, span_type=S, service_name=S, started_at=S, ended_at=S,
    duration_ms=D, status=S, attributes=S, events=S, replay_snapshot=S)
TRACE_IN = T.StructType([
    *struct(trace_id=S, service_name=S, started_at=S, completed_at=S, ended_at=S, duration_ms=D, status=S,
            root_span_id=S, attributes=S, metadata=S).fields,
    T.StructField("spans", T.ArrayType(SPAN_IN))])
BATCH_IN = T.StructType([T.StructField("spans", T.ArrayType(SPAN_IN))])


def parse_traces(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Parsed payloads as struct ``t``; unreadable ones or ones without trace_id get a ``reject_reason``."""
    rows = payloads.withColumn("t", F.from_json(column, TRACE_IN))
    reason = F.when(F.col("t").isNull() | F.col("t.trace_id").isNull(), "missing trace_id")
    return rows.withColumn("reject_reason", reason)


def project_of(parsed: DataFrame) -> Column:
    """Project column of the payload row, else the one named in the metadata, else 'default'."""
    given = F.col("project_id") if "project_id" in parsed.columns else F.lit(None).cast("string")
    return F.coalesce(given, F.get_json_object("t.metadata", "$.project_id"), F.lit("default"))


def trace_rows(parsed: DataFrame, source: str = "native") -> DataFrame:
    """One trace row per accepted payload."""
    t = lambda name: F.col(f"t.{name}")
    started, ended = iso_timestamp(t("started_at")), iso_timestamp(F.coalesce(t("completed_at"), t("ended_at")))
    return parsed.where("reject_reason IS NULL").select(
        t("trace_id").alias("trace_id"), project_of(parsed).alias("project_id"),
        F.coalesce(t("service_name"), F.lit("unknown")).alias("service_name"), started.alias("started_at"),
        ended.alias("completed_at"), duration_or(t("duration_ms"), started, ended).alias("duration_ms"),
        F.coalesce(t("status"), F.lit("unknown")).alias("status"),
        F.coalesce(t("root_span_id"), F.lit("")).alias("root_span_id"),
        F.coalesce(F.size(t("spans")), F.lit(0)).cast("long").alias("span_count"),
        F.coalesce(t("attributes"), t("metadata"), F.lit("{}")).alias("attributes"), F.lit(source).alias("source"))


def span_projection(s: str, trace_id: Column, service: Column, project: Column, source: str) -> list[Column]:
    c = lambda name: F.col(f"{s}.{name}")
    started, ended = iso_timestamp(c("started_at")), iso_timestamp(c("ended_at"))
    return [
        F.coalesce(c("span_id"), F.lit("")).alias("span_id"), trace_id.alias("trace_id"), project.alias("project_id"),
        F.coalesce(c("parent_span_id"), F.lit("")).alias("parent_span_id"), F.coalesce(c("name"), F.lit("")).alias("name"),
        blank_to(c("span_type"), "unknown").alias("span_type"), blank_to(service, "unknown").alias("service_name"),
        started.alias("started_at"), ended.alias("ended_at"),
        duration_or(c("duration_ms"), started, ended).alias("duration_ms"), blank_to(c("status"), "unknown").alias("status"),
        F.coalesce(c("attributes"), F.lit("{}")).alias("attributes"), F.coalesce(c("events"), F.lit("[]")).alias("events"),
        F.coalesce(c("replay_snapshot"), F.lit("{}")).alias("replay_snapshot"), F.lit(source).alias("source")]


def nested_span_rows(parsed: DataFrame, source: str = "native", inherit: str = "always") -> DataFrame:
    """Span rows of accepted trace payloads, with the trace id forced.

    ``inherit='always'`` takes the service of the trace; ``'missing'`` only where the span has none.
    """
    rows = parsed.where("reject_reason IS NULL").withColumn("s", F.explode("t.spans"))
    service = F.col("t.service_name") if inherit == "always" else F.coalesce("s.service_name", "t.service_name")
    return rows.select(*span_projection("s", F.col("t.trace_id"), service, project_of(parsed), source))


def split_batches(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per span of a batch payload, with a reject reason for spans lacking an id."""
    rows = payloads.withColumn("s", F.explode(F.from_json(column, BATCH_IN)["spans"]))
    reason = F.when(F.col("s.span_id").isNull(), "missing span_id").when(F.col("s.trace_id").isNull(), "missing trace_id")
    return rows.withColumn("reject_reason", reason)


def batch_span_rows(split: DataFrame, source: str = "native") -> DataFrame:
    project = F.col("project_id") if "project_id" in split.columns else F.lit("default")
    return split.where("reject_reason IS NULL").select(
        *span_projection("s", F.col("s.trace_id"), F.col("s.service_name"), project, source))


def batch_tally(split: DataFrame, key: str) -> DataFrame:
    """Ingested and total spans per batch."""
    return split.groupBy(key).agg(
        F.count_if(F.col("reject_reason").isNull()).alias("ingested"), F.count("*").alias("total"))


def single_span_rows(payloads: DataFrame, column: str = "payload", source: str = "native") -> DataFrame:
    """Payloads that are one span each."""
    rows = payloads.withColumn("s", F.from_json(column, SPAN_IN))
    project = F.col("project_id") if "project_id" in rows.columns else F.lit("default")
    return rows.where("s.span_id IS NOT NULL AND s.trace_id IS NOT NULL").select(
        *span_projection("s", F.col("s.trace_id"), F.col("s.service_name"), project, source))
