"""Evaluation cases mined from production traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attrs import blank_to, with_attrs
from ..functions.jsontext import json_object, json_value
from ..functions.ordering import DAY_US, position, time_bucket, top_per_key
from ..functions.quantiles import exact_quantiles, order_statistic, same_keys
from ..schema import is_error, is_success
from .errors import error_text

# ---- fixed values ----
ASSERTION_TYPES = ["contains", "not_contains", "regex", "length", "json_valid", "tool_called", "tool_args", "tool_sequence"]
DESCRIPTIONS = {
    "failure_mode/rate_limit": "Traces that hit API rate limits",
    "failure_mode/timeout": "Traces that timed out",
    "failure_mode/auth_error": "Traces with authentication failures",
    "failure_mode/context_limit": "Traces exceeding context/token limits",
    "failure_mode/tool_error": "Traces with tool execution failures",
    "failure_mode/other": "Traces with other error types",
    "edge_case/slow_response": "Traces with duration > p95 (%.0fms)",
    "edge_case/empty_response": "Traces with empty or missing LLM responses",
    "positive_example/correct_tool_usage": "Successful traces with all tool calls passing",
    "positive_example/fast_success": "Successful traces faster than median (%.0fms)",
    "positive_example/complete_answer": "Successful traces with complete answers",
}


def candidates(traces: DataFrame, as_of: Column, hours: int = 168, *, service: str | None = None, agent: str | None = None,
               newest: int | None = None) -> DataFrame:
    """Traces of the window, optionally of one service or agent, optionally only the newest per project."""
    rows = traces.where(F.col("started_at") >= as_of - F.expr(f"INTERVAL {hours} HOUR"))
    if service is not None:
        rows = rows.where(F.col("service_name") == service)
    if agent is not None:
        rows = with_attrs(rows, {"_agent": ("agent.name", "str")}).where(F.col("_agent") == agent).drop("_agent")
    if newest is not None:
        rows = top_per_key(rows, ["project_id"], [F.desc("started_at"), F.col("trace_id")], newest)
    return rows


def trace_io(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Input, output, tool calls and error text of each trace.

    Texts are whole. The first and last model span are picked by aggregation, and tool calls are
    kept as counts per (name, status), so long traces stay small; ``tool_steps`` has them in order.
    A prompt is a chat if it parses as a list that begins with an object.
    """
    rows = with_attrs(spans, {
        "_prompt": ("llm.prompt", "str"), "_prompt2": ("gen_ai.prompt", "str"),
        "_response": ("llm.response", "str"), "_response2": ("gen_ai.completion", "str"), "_tool": ("tool.name", "str")})
    llm = F.col("span_type") == "llm"
    prompt, response = blank_to(F.col("_prompt"), F.col("_prompt2")), blank_to(F.col("_response"), F.col("_response2"))
    is_chat = F.coalesce((F.json_array_length(prompt) > 0) & F.startswith(F.get_json_object(prompt, "$[0]"), F.lit("{")), F.lit(False))
    order = F.struct("started_at", "span_id")
    text = error_text(F.col("events"), F.col("attributes"))
    failed = is_error(F.col("status")) & (F.coalesce(text, F.lit("")) != "")
    rows = rows.withColumns({
        "_query": F.when(llm & (prompt != "") & ~is_chat, prompt),
        "_messages": F.when(llm & is_chat, prompt),
        "_answer": F.when(llm, response), "_error": F.when(failed, text)})
    key = ["project_id", "trace_id"]
    per = rows.groupBy(*key).agg(
        F.min_by(F.when(llm, F.struct("_query", "_messages")), F.when(llm, order)).alias("first"),
        F.max_by("_answer", F.when(llm, order)).alias("response"),
        F.min_by("_error", F.when(F.col("_error").isNotNull(), order)).alias("error_text"))
    tools = rows.where("span_type = 'tool'").groupBy(
        *key, blank_to(F.col("_tool"), F.col("name")).alias("tool"), F.col("status").alias("tool_status")).agg(F.count("*").alias("n"))
    tools = tools.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("tool", "tool_status", "n"))).alias("tool_calls"),
        F.bool_and(is_success(F.col("tool_status"))).alias("all_tools_ok"),
        F.bool_or(is_error(F.col("tool_status"))).alias("any_tool_error"))
    joined = same_keys(same_keys(traces, per, key, "left"), tools, key, "left")
    fallback = F.when((F.col("first._messages").isNull()) & (F.col("service_name") != ""),
                      F.concat(F.lit("[Trace from "), F.col("service_name"), F.lit("]")))
    return joined.select(
        *traces.columns, F.coalesce("first._query", fallback).alias("query"), F.col("first._messages").alias("messages"),
        F.coalesce("response", F.lit("")).alias("response"), "tool_calls",
        F.coalesce("all_tools_ok", F.lit(False)).alias("all_tools_ok"), F.coalesce("any_tool_error", F.lit(False)).alias("any_tool_error"),
        F.when(is_error(F.col("status")), F.col("error_text")).alias("error_text"))


def tool_steps(spans: DataFrame) -> DataFrame:
    """Tool calls of each trace in order, one row per call: position, tool and status."""
    tools = with_attrs(spans.where("span_type = 'tool'"), {"_tool": ("tool.name", "str")})
    rows = tools.select("project_id", "trace_id", "span_id", "started_at", blank_to(F.col("_tool"), F.col("name")).alias("tool"), F.col("status").alias("tool_status"))
    bucket = F.coalesce(time_bucket(F.col("started_at")), F.lit(-1 << 40))  # calls without a time come first
    return position(rows, ["project_id", "trace_id"], bucket, [F.col("started_at"), F.col("span_id")], "position").drop("started_at")


def duration_limits(rows: DataFrame) -> DataFrame:
    """Median and index-based p95 of the durations per project."""
    rows = rows.withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0.0)))  # a missing duration counts as 0
    median = exact_quantiles(rows, ["project_id"], "duration_ms", {"p50": 0.5})
    n = F.col("_total")
    index = F.when(n >= 5, F.floor(n * F.lit(0.95))).otherwise(n - 1)
    return median.join(order_statistic(rows, ["project_id"], "duration_ms", index, "p95"), "project_id")


def categorise(io: DataFrame, limits: DataFrame) -> DataFrame:
    """Pattern of each trace: failure mode, edge case or positive example."""
    m = F.lower(F.coalesce("error_text", F.lit("")))
    d = F.coalesce("duration_ms", F.lit(0.0))
    failure = (
        F.when(m.contains("rate limit") | m.contains("429"), "rate_limit")
        .when(m.contains("timeout") | m.contains("timed out"), "timeout")
        .when(m.contains("401") | m.contains("unauthorized") | m.contains("auth"), "auth_error")
        .when(m.contains("context length") | m.contains("token limit"), "context_limit")
        .when(F.col("any_tool_error"), "tool_error").otherwise("other"))
    positive = F.when(F.col("all_tools_ok"), "correct_tool_usage").when(
        (d <= F.col("p50")) & (F.col("p50") > 0), "fast_success").otherwise("complete_answer")
    pattern = (
        F.when(is_error(F.col("status")), F.concat(F.lit("failure_mode/"), failure))
        .when((d > F.col("p95")) & (F.col("p95") > 0), "edge_case/slow_response")
        .when(F.col("response") == "", "edge_case/empty_response")
        .when(is_success(F.col("status")), F.concat(F.lit("positive_example/"), positive)))
    return io.join(limits, "project_id", "left").withColumn("pattern", pattern).where("pattern IS NOT NULL")


def newest_first() -> list[Column]:
    return [F.desc("started_at"), F.col("trace_id")]


def pattern_traces(categorised: DataFrame, per_pattern: int | None = None) -> DataFrame:
    """Traces with their number ``n`` in project and pattern, newest first; all, or the first ``per_pattern``."""
    key = ["project_id", "pattern"]
    if per_pattern is not None:
        return top_per_key(categorised, key, newest_first(), per_pattern, "n")
    bucket = F.coalesce(-time_bucket(F.col("started_at"), DAY_US), F.lit(1 << 40))  # traces without a time come last
    return position(categorised, key, bucket, newest_first(), "n")


def patterns(categorised: DataFrame) -> DataFrame:
    """Patterns with description, trace count and newest trace as representative."""
    key = ["project_id", "pattern"]
    counts = categorised.groupBy(*key).agg(F.count("*").alias("traces"), F.max("p50").alias("p50"), F.max("p95").alias("p95"),
                                             F.min_by("trace_id", F.struct(-F.coalesce(F.unix_micros("started_at"), F.lit(-1 << 62)), "trace_id")).alias("representative_trace_id"))
    entries = [F.lit(p) for kv in DESCRIPTIONS.items() for p in kv]
    plain = F.create_map(*entries)[F.col("pattern")]
    described = F.when(F.col("pattern") == "edge_case/slow_response", F.format_string(DESCRIPTIONS["edge_case/slow_response"], "p95")).when(
        F.col("pattern") == "positive_example/fast_success", F.format_string(DESCRIPTIONS["positive_example/fast_success"], "p50")).otherwise(plain)
    return counts.select(*key, described.alias("description"), "traces", "representative_trace_id")


def fallback_cases(categorised: DataFrame, per_pattern: int | None = None) -> DataFrame:
    """Heuristic cases from the traces of each pattern, or from its newest ``per_pattern``."""
    rows = pattern_traces(categorised, per_pattern).where("query IS NOT NULL OR messages IS NOT NULL")
    sub = F.element_at(F.split("pattern", "/"), 2)
    positive = F.col("pattern").startswith("positive_example") & (F.col("response") != "")
    many_words = F.size(F.filter(F.split("response", r"\s+"), lambda w: w != "")) > 3
    phrases = F.filter(F.transform(F.split("response", r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 10)
    base = F.array(F.lit('{"type":"length","min_length":1}'))
    assertions = F.when(positive & many_words, F.concat(base, F.array(F.lit('{"type":"length","min_length":10}')))).otherwise(base)
    return rows.select(
        "project_id", "pattern", F.concat_ws("_", F.lit("fallback"), sub, F.col("n").cast("string")).alias("case_id"),
        F.concat_ws("_", F.lit("fallback"), sub, F.lit("case"), F.col("n").cast("string")).alias("case_name"), "query", "messages",
        F.when(positive, F.try_element_at(phrases, F.lit(1))).alias("expected_contains"), assertions.alias("assertions"),
        F.concat_ws("|", F.element_at(F.split("pattern", "/"), 1), sub, F.lit("fallback")).alias("tags"), F.col("trace_id").alias("source_trace_id"))


CASE = ("struct<name:string,input:struct<query:string,messages:string,context:string>,"
        "expected:struct<output:string,contains:string,not_contains:string,tool_calls:string>,assertions:array<string>,tags:array<string>>")


def parse_generated(responses: DataFrame, text: str = "response") -> DataFrame:
    """Cases from answer texts that hold a JSON array; ``subcategory`` names unnamed cases.

    Assertions of unknown type are dropped; a case that expects nothing gets a minimum length.
    """
    found = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), f"array<{CASE}>")
    rows = responses.select("*", F.posexplode(found).alias("n", "c")).where("c IS NOT NULL")
    no = (F.col("n") + 1).cast("string")
    name = F.coalesce("c.name", F.concat_ws("_", "subcategory", F.lit("case"), no))
    valid = F.filter(F.coalesce("c.assertions", F.array().cast("array<string>")),
                     lambda a: F.coalesce(F.get_json_object(a, "$.type").isin(*ASSERTION_TYPES), F.lit(False)))
    e = F.col("c.expected")
    expects = F.coalesce(*[F.when(F.coalesce(e[k], F.lit("")).isin("", "[]", "{}"), None).otherwise(e[k])
                           for k in ("output", "contains", "not_contains", "tool_calls")]).isNotNull()
    rows = rows.withColumn("_valid", valid)
    default = F.array(F.lit('{"type":"length","min_length":1}'))
    return rows.select(
        *responses.columns, F.concat_ws("_", "subcategory", name, no).alias("case_id"), name.alias("case_name"),
        F.col("c.input.query").alias("query"), F.col("c.input.messages").alias("messages"), F.col("c.expected.contains").alias("expected_contains"),
        F.when(expects | (F.size("_valid") > 0), F.col("_valid")).otherwise(default).alias("assertions"), F.col("c.tags").alias("case_tags"))


def suite_rows(cases: DataFrame, cap: int | None = None) -> DataFrame:
    """Suite documents, one JSON text per case; all, or at most ``cap`` cases per project."""
    rows = cases if cap is None else top_per_key(cases, ["project_id"], [F.col("pattern"), F.col("case_id")], cap)
    source = json_object({
        "query": F.when(F.col("messages").isNull(), json_value(F.coalesce("query", F.lit("[No input extracted]")))),
        "messages": F.col("messages")})
    expected = F.when(F.col("expected_contains").isNotNull(), F.concat(F.lit('{"contains":['), json_value(F.col("expected_contains")), F.lit("]}")))
    doc = json_object({
        "id": json_value(F.col("case_id")), "name": json_value(F.col("case_name")), "input": source, "timeout_seconds": F.lit("30.0"),
        "metadata": json_object({"source_trace_id": json_value(F.col("source_trace_id")), "source_pattern": json_value(F.col("pattern"))}),
        "expected": expected, "assertions": F.concat(F.lit("["), F.array_join("assertions", ","), F.lit("]")),
        "tags": F.concat(F.lit('["'), F.replace("tags", F.lit("|"), F.lit('","')), F.lit('"]'))})
    return rows.select("project_id", "case_id", doc.alias("case"))


def run_summary(categorised: DataFrame, cases: DataFrame) -> DataFrame:
    """Per project: traces analysed, patterns found, cases generated."""
    a = categorised.groupBy("project_id").agg(F.count("*").alias("traces_analyzed"), F.count_distinct("pattern").alias("patterns_found"))
    c = cases.groupBy("project_id").agg(F.count("*").alias("cases_generated"))
    return a.join(c, "project_id", "left").withColumn("cases_generated", F.coalesce("cases_generated", F.lit(0)))
