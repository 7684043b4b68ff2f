"""Traces and observations exported by Langfuse to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import iso_timestamp, json_object, json_value, micros_between, truthy
from ..schema import IMPORT_LEVEL_STATUS, OBSERVATION_TYPE, TRACE as TRACE_KEY, is_error, lookup

TRACE = ("struct<id:string,name:string,timestamp:string,userId:string,sessionId:string,tags:variant,release:string,"
         "version:string,metadata:variant>")
OBSERVATION = (
    "struct<id:string,traceId:string,type:string,name:string,startTime:string,endTime:string,level:string,model:string,"
    "modelParameters:variant,usage:struct<promptTokens:bigint,completionTokens:bigint,totalTokens:bigint>,"
    "input:variant,output:variant,metadata:variant,statusMessage:string,version:string,parentObservationId:string>")
SERVICE = "langfuse-import"


def variant_literal(v: Column) -> Column:
    """JSON literal of a variant; NULL and JSON null give NULL."""
    text = F.to_json(v)
    return F.when(text != "null", text)


def observation_rows(payloads: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """Observations as spans; events and unknown types are left out."""
    project = F.col("project_id") if "project_id" in payloads.columns else F.lit("default")
    rows = payloads.select(project.alias("project_id"), F.from_json(column, OBSERVATION).alias("o"))
    o = lambda name: F.col(f"o.{name}")
    text = lambda name: truthy(json_value(o(name)))
    attributes = json_object({
        "name": text("name"),
        "gen_ai.request.model": text("model"),
        "gen_ai.request.parameters": truthy(variant_literal(o("modelParameters"))),
        "gen_ai.usage.prompt_tokens": json_value(o("usage.promptTokens")),
        "gen_ai.usage.completion_tokens": json_value(o("usage.completionTokens")),
        "gen_ai.usage.total_tokens": json_value(o("usage.totalTokens")),
        "input": variant_literal(o("input")),
        "output": variant_literal(o("output")),
        "langfuse.metadata": truthy(variant_literal(o("metadata"))),
        "langfuse.status_message": text("statusMessage"),
        "langfuse.version": text("version"),
    })
    rows = rows.withColumns({
        "span_type": lookup(OBSERVATION_TYPE, F.coalesce(o("type"), F.lit("SPAN"))),
        "started_at": F.coalesce(iso_timestamp(o("startTime")), as_of)})
    rows = rows.withColumn("ended_at", F.coalesce(iso_timestamp(o("endTime")), F.col("started_at")))
    return rows.where("span_type IS NOT NULL").select(
        o("id").alias("span_id"), o("traceId").alias("trace_id"), "project_id",
        F.coalesce(o("parentObservationId"), F.lit("")).alias("parent_span_id"), F.coalesce(o("name"), F.lit("")).alias("name"),
        "span_type", F.lit(SERVICE).alias("service_name"), "started_at", "ended_at",
        (micros_between(F.col("started_at"), F.col("ended_at")) / F.lit(1000.0)).alias("duration_ms"),
        lookup(IMPORT_LEVEL_STATUS, F.coalesce(o("level"), F.lit("DEFAULT")), "success").alias("status"),
        attributes.alias("attributes"), F.lit("[]").alias("events"), F.lit("{}").alias("replay_snapshot"),
        F.lit("langfuse").alias("source"))


def imported_traces(payloads: DataFrame, spans: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """Imported traces with timing, status and root taken from their observation spans."""
    project = F.col("project_id") if "project_id" in payloads.columns else F.lit("default")
    rows = payloads.select(project.alias("project_id"), F.from_json(column, TRACE).alias("t"))
    t = lambda name: F.col(f"t.{name}")
    text = lambda name: truthy(json_value(t(name)))
    attributes = json_object({
        "langfuse.trace.name": text("name"), "langfuse.user_id": text("userId"), "langfuse.session_id": text("sessionId"),
        "langfuse.tags": truthy(variant_literal(t("tags"))), "langfuse.release": text("release"),
        "langfuse.version": text("version"), "langfuse.metadata": truthy(variant_literal(t("metadata")))})
    head = rows.where("coalesce(t.id, '') <> ''").select(
        t("id").alias("trace_id"), "project_id", F.coalesce(t("name"), F.lit(SERVICE)).alias("service_name"),
        iso_timestamp(t("timestamp")).alias("_stamp"), attributes.alias("attributes"))
    has_parent = F.col("parent_span_id") != ""
    per = spans.groupBy(*TRACE_KEY).agg(
        F.min("started_at").alias("_first"), F.max("ended_at").alias("_last"), F.bool_or(is_error(F.col("status"))).alias("_failed"),
        F.min_by("span_id", F.struct(has_parent, F.col("started_at"), F.col("span_id"))).alias("_root"), F.count("*").alias("_n"))
    joined = head.join(per, TRACE_KEY, "left").withColumn("started_at", F.coalesce("_stamp", "_first", as_of))
    joined = joined.withColumn("completed_at", F.coalesce("_last", "started_at"))
    return joined.select(
        "trace_id", "project_id", "service_name", "started_at", "completed_at",
        (micros_between(F.col("started_at"), F.col("completed_at")) / F.lit(1000.0)).alias("duration_ms"),
        F.when(F.coalesce("_failed", F.lit(False)), "error").otherwise("success").alias("status"),
        F.coalesce("_root", F.lit("")).alias("root_span_id"), F.coalesce("_n", F.lit(0)).alias("span_count"), "attributes",
        F.lit("langfuse").alias("source"))
