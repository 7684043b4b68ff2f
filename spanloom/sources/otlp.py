"""OTLP JSON payloads to span rows, and trace rows from spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import json_string, json_value, micros_between
from ..schema import OTLP_STATUS, is_error, lookup

VALUE = ("struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,"
         "arrayValue:string,bytesValue:string>")
ATTRS = f"array<struct<key:string,value:{VALUE}>>"
PAYLOAD = (
    f"struct<resourceSpans:array<struct<resource:struct<attributes:{ATTRS}>,"
    "scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRS},status:struct<code:int>,"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{ATTRS}>>>>>>>>>")
ARRAY = f"struct<values:array<{VALUE}>>"

# ---- fixed values: span type by attribute prefix, in priority order ----
TYPE_PREFIXES = [
    ("llm", ["gen_ai.", "llm."]),
    ("retrieval", ["db.", "retrieval."]),
    ("embedding", ["embedding."]),
    ("tool", ["tool."]),
]
SERVER_KIND = 2


def scalar_literal(v: Column) -> Column:
    """JSON literal of a typed value that is not an array."""
    return F.coalesce(json_string(v["stringValue"]), v["intValue"].try_cast("bigint").cast("string"),
                      json_value(v["doubleValue"]), v["boolValue"].cast("string"), json_string(v["bytesValue"]))


def value_literal(v: Column) -> Column:
    """JSON literal of a typed value; array members are decoded one level, deeper arrays stay as sent."""
    items = F.transform(F.from_json(v["arrayValue"], ARRAY)["values"],
                        lambda x: F.coalesce(scalar_literal(x), x["arrayValue"], F.lit("null")))
    return F.coalesce(scalar_literal(v), F.when(v["arrayValue"].isNotNull(), F.concat(
        F.lit("["), F.array_join(F.coalesce(items, F.array().cast("array<string>")), ","), F.lit("]"))))


def attribute_entries(attrs: Column) -> Column:
    """Map key -> literal without empty keys or NULL values; of a repeated key the last counts (``session.configure`` says so to Spark)."""
    return F.map_from_entries(F.filter(
        F.transform(attrs, lambda a: F.named_struct(F.lit("key"), a["key"], F.lit("literal"), value_literal(a["value"]))),
        lambda e: (F.coalesce(e["key"], F.lit("")) != "") & e["literal"].isNotNull()))


def entries_json(entries: Column) -> Column:
    pairs = F.transform(F.map_entries(entries), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(F.coalesce(pairs, F.array().cast("array<string>")), ","), F.lit("}"))


def span_type_of(keys: Column, kind: Column) -> Column:
    """Span type by key prefix; without a known prefix by span kind."""

    def any_with(prefixes: list[str]) -> Column:
        pattern = "^(" + "|".join(p.replace(".", "\\.") for p in prefixes) + ")"
        return F.exists(keys, lambda k: k.rlike(pattern))

    by_key = F.coalesce(*[F.when(any_with(prefixes), F.lit(name)) for name, prefixes in TYPE_PREFIXES])
    return F.coalesce(by_key, F.when(kind == SERVER_KIND, F.lit("tool")), F.lit("custom"))


def nanos_timestamp(nanos: Column, fallback: Column) -> Column:
    """Nanosecond text to a microsecond timestamp; unreadable text gives ``fallback``."""
    micros = F.floor(F.coalesce(nanos, F.lit("0")).try_cast("decimal(20,0)") / 1000).cast("long")
    return F.coalesce(F.timestamp_micros(micros), fallback)


def events_json(events: Column, fallback: Column) -> Column:
    items = F.transform(events, lambda e: F.concat(
        F.lit('{"timestamp":"'), F.date_format(nanos_timestamp(e["timeUnixNano"], fallback), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        F.lit('","name":'), json_value(F.coalesce(e["name"], F.lit(""))), F.lit(',"attributes":'),
        entries_json(attribute_entries(e["attributes"])), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(F.coalesce(items, F.array().cast("array<string>")), ","), F.lit("]"))


def span_rows(payloads: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """All spans of all payloads, with the service name of their resource."""
    project = F.col("project_id") if "project_id" in payloads.columns else F.lit("default")
    resources = payloads.select(project.alias("project_id"), F.explode(F.from_json(column, PAYLOAD)["resourceSpans"]).alias("r"))
    named = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    service = F.try_element_at(named, F.lit(-1))["value"]["stringValue"]
    scopes = resources.select("project_id", F.coalesce(service, F.lit("unknown")).alias("service_name"),
                              F.explode("r.scopeSpans").alias("sc"))
    rows = scopes.select("project_id", "service_name", F.explode("sc.spans").alias("s"))
    # explode of one element: later columns read the decoded attributes, not decode them again
    rows = rows.select("*", F.explode(F.array(attribute_entries(F.col("s.attributes")))).alias("entries"))
    rows = rows.withColumns({
        "started_at": nanos_timestamp(F.col("s.startTimeUnixNano"), as_of),
        "ended_at": nanos_timestamp(F.col("s.endTimeUnixNano"), as_of)})
    empty = F.lit("")
    return rows.select(
        F.coalesce("s.spanId", empty).alias("span_id"), F.coalesce("s.traceId", empty).alias("trace_id"), "project_id",
        F.coalesce("s.parentSpanId", empty).alias("parent_span_id"), F.coalesce("s.name", empty).alias("name"),
        span_type_of(F.coalesce(F.map_keys("entries"), F.array().cast("array<string>")), F.col("s.kind")).alias("span_type"),
        "service_name", "started_at", "ended_at",
        (micros_between(F.col("started_at"), F.col("ended_at")) / F.lit(1000.0)).alias("duration_ms"),
        lookup(OTLP_STATUS, F.coalesce("s.status.code", F.lit(0)), "pending").alias("status"),
        entries_json(F.col("entries")).alias("attributes"), events_json(F.col("s.events"), as_of).alias("events"),
        F.lit("{}").alias("replay_snapshot"), F.lit("otlp").alias("source"))


def synthesize_traces(spans: DataFrame, source: str | None = None) -> DataFrame:
    """Trace rows from spans: time bounds, any-error status, root span and its service.

    Root is the earliest span without a parent, else the earliest span. Aggregates
    only, so a trace of any length is reduced before the shuffle.
    """
    has_parent = F.coalesce(F.col("parent_span_id"), F.lit("")) != ""
    root = F.min_by(F.struct("span_id", "service_name"), F.struct(has_parent, F.col("started_at"), F.col("span_id")))
    out = spans.groupBy("project_id", "trace_id").agg(
        root.alias("root"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("completed_at"),
        F.bool_or(is_error(F.col("status"))).alias("failed"), F.count("*").alias("span_count"), F.min("source").alias("source"))
    return out.select(
        "trace_id", "project_id", F.col("root.service_name").alias("service_name"), "started_at", "completed_at",
        (micros_between(F.col("started_at"), F.col("completed_at")) / F.lit(1000.0)).alias("duration_ms"),
        F.when(F.col("failed"), "error").otherwise("success").alias("status"), F.col("root.span_id").alias("root_span_id"),
        "span_count", F.lit("{}").alias("attributes"), (F.col("source") if source is None else F.lit(source)).alias("source"))
