"""Workflow (n8n) start, span, model-call and end events, and webhooks, to span rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attrs import blank_to
from ..functions.jsontext import json_object, json_value, truthy
from ..schema import lookup
from .validation import EXECUTION_ID, PROJECT_ID

# ---- fixed values: node type to span type ----
NODE_TYPES = {
    "n8n-nodes-langchain.agent": "agent",
    "n8n-nodes-langchain.chainLlm": "llm",
    "n8n-nodes-langchain.chatOpenAi": "llm",
    "n8n-nodes-langchain.chatAnthropic": "llm",
    "n8n-nodes-langchain.openAi": "llm",
    "n8n-nodes-langchain.vectorStoreQdrant": "retrieval",
    "n8n-nodes-langchain.vectorStorePinecone": "retrieval",
    "n8n-nodes-langchain.memoryBufferWindow": "memory",
    "n8n-nodes-langchain.toolCalculator": "tool",
    "n8n-nodes-langchain.toolCode": "tool",
}


def node_span_type(node_type: Column) -> Column:
    return lookup(NODE_TYPES, node_type, "custom")


def stable_id(*parts: Column | str) -> Column:
    """Reproducible id from its key parts, in place of a random one."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def trace_id_of(execution_id: Column) -> Column:
    return F.concat(F.lit("n8n-"), execution_id)


def event_spans(events: DataFrame) -> DataFrame:
    """Spans from typed events of kind start, span, ai_call and end.

    An end event gives a newer version of the root span; span and model-call
    events hang under the root of their execution, which must have a start event.
    """
    kind, ex = F.col("kind"), F.col("execution_id")
    root = stable_id(ex, "root")
    known = events.where(kind == "start").select("execution_id").distinct()
    rows = events.join(known, "execution_id", "left_semi")
    is_root = kind.isin("start", "end")
    tokens_in, tokens_out = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    when_start = lambda v: F.when(kind == "start", v)
    when_ai = lambda v: F.when(kind == "ai_call", v)
    attributes = json_object({
        "n8n.workflow.id": when_start(json_value(F.col("workflow_id"))),
        "n8n.workflow.name": when_start(json_value(F.col("workflow_name"))),
        "llm.vendor": when_ai(json_value(F.col("provider"))), "llm.model": when_ai(json_value(F.col("model"))),
        "llm.prompt_tokens": when_ai(json_value(tokens_in)), "llm.completion_tokens": when_ai(json_value(tokens_out)),
        "llm.total_tokens": when_ai(json_value(tokens_in + tokens_out)),
        "llm.latency_ms": when_ai(truthy(json_value(F.col("latency_ms")))),
        "error.message": F.when(kind == "end", json_value(F.nullif("error_message", F.lit("")))),
        "n8n.execution.id": json_value(ex), "service.name": F.lit('"n8n"')})
    return rows.select(
        F.when(is_root, root).otherwise(stable_id(ex, kind, F.unix_micros("at").cast("string"), F.coalesce("span_name", "model"))).alias("span_id"),
        trace_id_of(ex).alias("trace_id"), "project_id", F.when(is_root, "").otherwise(root).alias("parent_span_id"),
        F.when(kind == "ai_call", F.concat_ws(".", "provider", "model")).when(kind == "span", F.col("span_name"))
        .otherwise(F.coalesce(blank_to(F.col("span_name"), F.col("workflow_name")), F.lit(""))).alias("name"),
        F.when(is_root, "agent").when(kind == "ai_call", "llm").otherwise(F.coalesce("span_type", F.lit("custom"))).alias("span_type"),
        F.lit("n8n").alias("service_name"), F.when(kind != "end", F.col("at")).alias("started_at"),
        F.when(kind != "start", F.col("at")).alias("ended_at"),
        F.when(kind == "start", "running").when((kind == "end") & (F.col("outcome") != "success"), "error")
        .otherwise("completed").alias("status"), attributes.alias("attributes"), F.col("at").alias("updated_at"))


WEBHOOK = ("struct<workflow:struct<id:string,name:string>,execution:struct<id:string>,"
           "node:struct<name:string,type:string>,data:array<string>>")


def parse_webhooks(payloads: DataFrame, column: str = "payload", max_bytes: int | None = None, max_items: int | None = None) -> DataFrame:
    """Webhook payloads with project and reject reason; query project beats header beats 'default'.

    A gateway that limits its payloads passes ``max_bytes`` and ``max_items``; no payload is refused for its size otherwise.
    """
    rows = payloads.withColumn("w", F.from_json(column, WEBHOOK))
    query = F.nullif("query_project", F.lit("default"))
    project = F.coalesce(query, F.nullif("header_project", F.lit("")), F.lit("default"))
    ex, wf = F.col("w.execution.id"), F.col("w.workflow.id")
    rows = rows.withColumn("project_id", project)
    reason = (
        F.when(F.lit(False) if max_bytes is None else F.octet_length(column) > max_bytes, "payload too large")
        .when(~F.col("project_id").rlike(PROJECT_ID), "bad project id")
        .when((F.coalesce(ex, F.lit("")) == "") | (F.coalesce(wf, F.lit("")) == ""), "missing ids")
        .when(~ex.rlike(EXECUTION_ID) | ~wf.rlike(EXECUTION_ID), "bad ids")
        .when(F.lit(False) if max_items is None else F.size("w.data") > max_items, "too many items"))
    return rows.withColumn("reject_reason", reason)


def webhook_spans(parsed: DataFrame) -> DataFrame:
    """Root span per accepted webhook, plus a node span where a node is named."""
    ok = parsed.where("reject_reason IS NULL")
    ex, w, n = F.col("w.execution.id"), F.col("w.workflow"), F.col("w.node")
    name = F.coalesce(w["name"], F.lit("Unknown Workflow"))
    node_name, node_type = F.coalesce(n["name"], F.lit("Unknown Node")), F.coalesce(n["type"], F.lit("custom"))
    root = stable_id(ex, "root")
    common = {"n8n.execution.id": json_value(ex), "service.name": F.lit('"n8n"')}
    workflow_span = F.struct(
        root.alias("span_id"), F.lit("").alias("parent_span_id"), name.alias("name"), F.lit("agent").alias("span_type"),
        json_object({"n8n.workflow.id": json_value(w["id"]), "n8n.workflow.name": json_value(name), **common}).alias("attributes"),
        F.lit("[]").alias("events"))
    output = F.when(F.size("w.data") > 0, F.to_json(F.array(F.struct(
        F.lit("node.output").alias("name"), F.struct(F.col("w.data").alias("data")).alias("attributes")))))
    node_span = F.when(n.isNotNull(), F.struct(
        stable_id(ex, "node", node_name).alias("span_id"), root.alias("parent_span_id"), node_name.alias("name"),
        node_span_type(node_type).alias("span_type"),
        json_object({"n8n.node.name": json_value(node_name), "n8n.node.type": json_value(node_type), **common}).alias("attributes"),
        F.coalesce(output, F.lit("[]")).alias("events")))
    spans = F.filter(F.array(workflow_span, node_span), lambda s: s.isNotNull())
    return ok.select("project_id", trace_id_of(ex).alias("trace_id"), "received_at", F.explode(spans).alias("s")).select(
        "s.span_id", "trace_id", "project_id", "s.parent_span_id", "s.name", "s.span_type", F.lit("n8n").alias("service_name"),
        F.col("received_at").alias("started_at"), F.col("received_at").alias("ended_at"), F.lit("completed").alias("status"),
        "s.attributes", "s.events")
