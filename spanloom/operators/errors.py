"""Error classification, recommendations, failure chains and debug digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attrs import attr_map, blank_to, with_attrs
from ..functions.ordering import HOUR_US, position, time_bucket, top_per_key
from ..schema import is_error, lookup

ERROR_KEYS = {
    "error_message": ("error.message", "str"), "error_type": ("error.type", "str"),
    "model": ("llm.model", "str"),
}

# ---- fixed values: severity per class ----------------------------------------------
CLASS_SEVERITY = {
    "rate_limit": "high",
    "auth_failure": "critical",
    "token_limit": "medium",
    "model_not_found": "medium",
    "network_error": "high",
    "invalid_request": "low",
    "service_error": "critical",
    "tool_error": "medium",
    "retrieval_error": "medium",
    "unknown": "medium",
}
# ---- fixed values: related patterns per class -----------------------------------------
RELATED_PATTERNS = {
    "rate_limit": ["Common during peak usage hours", "Often resolved by switching to cheaper models",
                   "Can be prevented with exponential backoff"],
    "auth_failure": ["Check API key is not expired", "Verify environment variables are set",
                     "Ensure correct provider credentials"],
    "token_limit": ["Reduce prompt length or max_tokens", "Switch to models with larger context windows",
                    "Implement prompt compression techniques"],
    "model_not_found": ["Verify model name spelling", "Check model availability for your account",
                        "Some models require special access"],
    "network_error": ["Temporary connectivity issues", "Provider API may be experiencing downtime",
                      "Retry with exponential backoff usually works"],
    "tool_error": ["Tool configuration may be incorrect", "Tool function may have bugs",
                   "Check tool input/output schemas"],
    "retrieval_error": ["Vector database connection issues", "Check vector DB credentials",
                        "Verify collection/index exists"],
}
DEFAULT_PATTERNS = ["Review error details carefully"]
FIX_TIME = {
    "rate_limit": "< 1 minute", "model_not_found": "< 1 minute", "token_limit": "< 1 minute",
    "network_error": "5-10 minutes", "auth_failure": "5-10 minutes",
}
DEFAULT_FIX_TIME = "10-30 minutes"
# ---- fixed values: advice per class (title, action, confidence, effect on cost) ------------
ADVICE = {
    "rate_limit": ("Wait and retry with exponential backoff", "replay", 0.95, None),
    "rate_limit_expensive": ("Switch to gpt-4o-mini for lower rate limits", "replay", 0.85, "-83% cost, +200% rate limit capacity"),
    "token_limit": ("Increase max_tokens to %d", "replay", 0.90, "+50%% output capacity, +$%.4f per call"),
    "token_limit_prompt": ("Compress your system prompt", "code_change", 0.70, "-20% input tokens"),
    "auth_failure": ("Check your API key configuration", "config_change", 0.95, None),
    "model_not_found": ("Try %s instead", "replay", 0.80, "Similar pricing and capabilities"),
    "network_error": ("Retry the request", "replay", 0.85, None),
    "network_error_setup": ("Check your network connection", "config_change", 0.70, None),
    "tool_error": ("Verify tool is registered", "code_change", 0.80, None),
    "unknown": ("Review the error message", "code_change", 0.50, None),
}
DEFAULT_ADVICE = "Review error details"
# ---- fixed values: replacement models ----------------------------------------------------
GPT4_ALTERNATIVES = ["gpt-4o", "gpt-4-turbo", "gpt-4o-mini"]
GPT35_ALTERNATIVES = ["gpt-4o-mini", "gpt-3.5-turbo"]
OPUS_ALTERNATIVES = ["claude-sonnet-4-20250514", "claude-3-sonnet-20240229"]
CLAUDE_ALTERNATIVES = ["claude-sonnet-4-20250514", "claude-haiku-4-20250514"]


def any_of(text: Column, *words: str) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def error_class(message: Column, code: Column, error_type: Column) -> Column:
    """Class of an error; the first matching rule decides."""
    m, c = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(code, F.lit(-1))
    return (
        F.when((c == 429) | any_of(m, "rate limit", "429"), "rate_limit")
        .when((c == 401) | any_of(m, "api key", "unauthorized", "authentication", "invalid key"), "auth_failure")
        .when(any_of(m, "context length", "maximum context", "token limit", "max tokens"), "token_limit")
        .when(m.contains("model") & any_of(m, "not found", "does not exist", "not available", "unavailable"), "model_not_found")
        .when(any_of(m, "timeout", "connection", "network") | c.isin(502, 503, 504), "network_error")
        .when((c == 400) | any_of(m, "invalid", "malformed"), "invalid_request")
        .when(c.isin(500, 503) | any_of(m, "server error", "service"), "service_error")
        .when(m.contains("tool") & any_of(F.coalesce(error_type, F.lit("")), "ToolError", "FunctionNotFoundError"), "tool_error")
        .when(any_of(m, "retrieval", "vector", "embedding", "chroma", "pinecone"), "retrieval_error")
        .otherwise("unknown")
    )


def class_severity(category: Column) -> Column:
    return lookup(CLASS_SEVERITY, category, "medium")


def classify(spans: DataFrame) -> DataFrame:
    """Failed spans with class and severity. A status code counts only as a JSON number."""
    rows = with_attrs(spans.where(is_error(F.col("status"))), ERROR_KEYS)
    rows = with_attrs(rows, {"error_code": ("error.status_code", "int"), "max_tokens": ("llm.max_tokens", "int")}, strict=True)
    return rows.withColumn("category", error_class(F.col("error_message"), F.col("error_code"), F.col("error_type"))
                           ).withColumn("severity", class_severity(F.col("category")))


def model_alternatives(model: Column) -> Column:
    m = F.lower(model)

    def two(models: list[str]) -> Column:
        return F.slice(F.array(*[F.lit(x) for x in models]), 1, 2)

    return (F.when(m.contains("gpt-4"), two(GPT4_ALTERNATIVES)).when(m.contains("gpt-3.5"), two(GPT35_ALTERNATIVES))
            .when(m.contains("opus"), two(OPUS_ALTERNATIVES)).when(m.contains("claude"), two(CLAUDE_ALTERNATIVES))
            .otherwise(F.array().cast("array<string>")))


def recommendation(name: str, params: Column | None = None, title: Column | None = None, impact: Column | None = None) -> Column:
    """One entry of ``ADVICE``; title and impact may be filled in."""
    words, action, confidence, effect = ADVICE[name]
    return F.struct((F.lit(words) if title is None else title).alias("title"), F.lit(action).alias("action_type"), F.lit(confidence).alias("confidence"),
                    (F.lit(None).cast("string") if params is None else params).alias("replay_params"),
                    (F.lit(effect).cast("string") if impact is None else impact).alias("cost_impact"))


def recommendations(category: Column, model: Column, max_tokens: Column) -> Column:
    """Ordered advice for an error class as an array of structs."""
    tokens = F.coalesce(max_tokens, F.lit(2048))
    more = F.floor(tokens * 1.5).cast("long")
    expensive = F.lower(model).contains("gpt-4") & ~F.lower(model).contains("mini")
    alternatives = F.transform(model_alternatives(model), lambda alt: recommendation(
        "model_not_found", F.to_json(F.struct(alt.alias("model"))), F.format_string(ADVICE["model_not_found"][0], alt)))
    per_class = {
        "rate_limit": [recommendation("rate_limit", F.lit("{}")),
                       F.when(expensive, recommendation("rate_limit_expensive", F.lit('{"model":"gpt-4o-mini"}')))],
        "token_limit": [
            recommendation("token_limit", F.to_json(F.struct(more.alias("max_tokens"))), F.format_string(ADVICE["token_limit"][0], more),
                           F.format_string(ADVICE["token_limit"][3], (more - tokens) * 0.00001)),
            recommendation("token_limit_prompt")],
        "auth_failure": [recommendation("auth_failure")],
        "network_error": [recommendation("network_error", F.lit("{}")), recommendation("network_error_setup")],
        "tool_error": [recommendation("tool_error")],
        "unknown": [recommendation("unknown")],
    }
    out = F.when(category == "model_not_found", alternatives)
    for name, advice in per_class.items():
        out = out.when(category == name, F.filter(F.array(*advice), lambda r: r.isNotNull()))
    return out


def recommend(classified: DataFrame) -> DataFrame:
    """One row per failed span and piece of advice, in order."""
    advice = recommendations(F.col("category"), F.col("model"), F.col("max_tokens"))
    return classified.select("*", F.posexplode(advice).alias("rank", "advice")).select(
        *classified.columns, (F.col("rank") + 1).alias("rank"), "advice.*")


def with_fix_hints(classified: DataFrame) -> DataFrame:
    arrays = {k: F.array(*[F.lit(p) for p in v]) for k, v in RELATED_PATTERNS.items()}
    entries = [part for k, v in arrays.items() for part in (F.lit(k), v)]
    found = F.try_element_at(F.create_map(*entries), F.col("category"))
    return classified.withColumns({
        "related_patterns": F.coalesce(found, F.array(*[F.lit(p) for p in DEFAULT_PATTERNS])),
        "fix_time": lookup(FIX_TIME, F.col("category"), DEFAULT_FIX_TIME)})


def error_context(spans: DataFrame) -> DataFrame:
    """JSON of the keys that are present; absent ones are left out."""
    rows = with_attrs(spans, {
        "_model": ("llm.model", "str"), "_max": ("llm.max_tokens", "int"), "_temp": ("llm.temperature", "float"),
        "_in": ("llm.prompt_tokens", "int"), "_out": ("llm.completion_tokens", "int")}, strict=True)
    return rows.withColumn("context", F.to_json(F.struct(
        F.col("_model").alias("model"), F.col("_max").alias("max_tokens"), F.col("_temp").alias("temperature"),
        F.col("_in").alias("prompt_tokens"), F.col("_out").alias("completion_tokens"), "span_type",
        F.col("name").alias("span_name"), "duration_ms"))).drop("_model", "_max", "_temp", "_in", "_out")


EVENT = "array<struct<name:string,timestamp:string,attributes:map<string,string>>>"


def error_text(events: Column, attributes: Column) -> Column:
    """Message of the first exception event that has one, else of the attributes."""
    messages = F.filter(F.transform(
        F.filter(F.from_json(events, EVENT), lambda e: e["name"] == "exception"),
        lambda e: F.try_element_at(e["attributes"], F.lit("exception.message"))),
        lambda m: F.coalesce(m, F.lit("")) != "")
    a = attr_map(attributes)
    return F.coalesce(F.try_element_at(messages, F.lit(1)),
                      *[F.try_element_at(a, F.lit(k)) for k in ("error.message", "exception.message", "error")])


def top_issues(classified: DataFrame, k: int = 5, newest: int | None = None) -> DataFrame:
    """Most frequent error classes per project with latest trace and first advice."""
    rows = classified
    if newest is not None:
        rows = top_per_key(rows, ["project_id"], [F.desc("started_at"), F.col("span_id")], newest)
    advice = F.try_element_at(recommendations(F.col("category"), F.col("model"), F.col("max_tokens")), F.lit(1))["title"]
    latest = F.struct("started_at", "span_id")
    out = rows.withColumn("_advice", F.coalesce(advice, F.lit(DEFAULT_ADVICE))).groupBy("project_id", "category").agg(
        F.count("*").alias("error_count"), F.max_by("severity", latest).alias("severity"),
        F.max_by("trace_id", latest).alias("latest_trace_id"), F.max_by("_advice", latest).alias("recommendation"),
        F.max(latest).alias("_latest"))
    w = Window.partitionBy("project_id").orderBy(F.desc("error_count"), F.desc("_latest"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_latest")


def failure_chain(spans: DataFrame) -> DataFrame:
    """Failed spans of each trace in time order; the first is the root cause."""
    failed = spans.where(is_error(F.col("status"))).withColumn(
        "error_text", F.coalesce(error_text(F.col("events"), F.col("attributes")), F.lit("Unknown error")))
    chain = position(failed.select("trace_id", "span_id", "name", "span_type", "started_at", "error_text"), ["trace_id"],
                     time_bucket(F.col("started_at"), HOUR_US), [F.col("started_at"), F.col("span_id")], "position")
    return chain.withColumn("is_root_cause", F.col("position") == 1)


def debug_timeline(spans: DataFrame) -> DataFrame:
    return spans.select(
        "trace_id", "span_id", "name", "span_type", "started_at", "duration_ms", "status",
        F.when(is_error(F.col("status")), error_text(F.col("events"), F.col("attributes"))).alias("error_text"),
        F.nullif("parent_span_id", F.lit("")).alias("parent_span_id"))


def debug_digest(spans: DataFrame, page_spans: int = 200, chars: int | None = None) -> DataFrame:
    """Text of the spans, errors and details of each trace, as pages of ``page_spans`` spans in time order.

    ``chars`` shortens prompts, answers and inputs; by default they are whole.
    """
    numbered = position(spans, ["trace_id"], time_bucket(F.col("started_at"), HOUR_US), [F.col("started_at"), F.col("span_id")], "n")

    def shown(value: Column) -> Column:
        return value if chars is None else F.when(F.length(value) > chars, F.concat(F.substring(value, 1, chars), F.lit("..."))).otherwise(value)

    rows = with_attrs(numbered, {
        "_model": ("llm.model", "str"), "_model2": ("gen_ai.request.model", "str"), "_prompt": ("llm.prompt", "str"),
        "_prompt2": ("gen_ai.prompt", "str"), "_answer": ("llm.response", "str"), "_answer2": ("gen_ai.completion", "str"),
        "_tokens": ("llm.total_tokens", "str"), "_tool": ("tool.name", "str"), "_input": ("tool.input", "str"),
        "_query": ("retrieval.query", "str"), "_sql": ("db.statement", "str")})
    error = F.when(is_error(F.col("status")), error_text(F.col("events"), F.col("attributes")))
    line = F.concat(
        F.format_string("  [%s] %s (%s) - %.0fms", F.when(is_error(F.col("status")), "ERROR").otherwise("OK"),
                        "name", "span_type", "duration_ms"),
        F.coalesce(F.concat(F.lit("\n         Error: "), error), F.lit("")))

    def part(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value)).otherwise("")

    detail = (
        F.when(F.col("span_type") == "llm", F.concat(
            F.format_string("  LLM Call [%s]: model=%s", F.col("name"),
                            blank_to(blank_to(F.col("_model"), F.col("_model2")), "unknown")),
            part(", tokens=", F.col("_tokens")),
            part("\n    Prompt: ", shown(blank_to(F.col("_prompt"), F.col("_prompt2")))),
            part("\n    Response: ", shown(blank_to(F.col("_answer"), F.col("_answer2"))))))
        .when(F.col("span_type") == "tool", F.format_string(
            "  Tool Call [%s]: input=%s", blank_to(F.col("_tool"), F.col("name")), shown(F.col("_input"))))
        .when(F.col("span_type") == "retrieval", F.format_string(
            "  Retrieval [%s]: query=%s", F.col("name"), shown(blank_to(F.col("_query"), F.col("_sql"))))))
    rows = rows.select("trace_id", F.floor((F.col("n") - 1) / page_spans).cast("long").alias("page"), "n", line.alias("line"), detail.alias("detail"))
    text = rows.groupBy("trace_id", "page").agg(F.array_sort(F.collect_list(F.struct("n", "line", "detail"))).alias("r"))
    details = F.array_join(F.filter(F.transform("r", lambda x: x["detail"]), lambda x: x.isNotNull()), "\n")
    return text.select("trace_id", "page", F.concat(
        F.lit("Spans by start:\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"),
        F.lit("\n\nCalls:\n"), blank_to(details, "  none")).alias("digest"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_analysis(responses: DataFrame, text: str = "response") -> DataFrame:
    """Sections ROOT_CAUSE, EXPLANATION, FIX_SUGGESTIONS and CONFIDENCE of an answer text.

    A section goes from its first mark to the first occurrence of the first of its end marks that follows at all.
    Suggestions are the lines that begin with a digit and hold a dot; confidence is a number in 0 to 1, else 0.5.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def after(name: str) -> Column:
        return F.when(F.contains(t, F.lit(name)), F.substr(t, F.locate(name, t) + F.lit(len(name))))

    def section(name: str, *ends: str) -> Column:
        rest = after(f"{name}:")
        cuts = [F.when(F.contains(rest, F.lit(f"{e}:")), F.substring_index(rest, f"{e}:", 1)) for e in ends]
        return _stripped(F.coalesce(*cuts, rest))

    lines = F.transform(F.split(section("FIX_SUGGESTIONS", "CONFIDENCE"), "\n"), _stripped)
    fixes = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^\d.*\.")), lambda x: _stripped(F.regexp_replace(x, r"^[^.]*\.", ""))), lambda x: x != "")
    number = _stripped(F.substring_index(_stripped(after("CONFIDENCE:")), "\n", 1))
    conf = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double"))
    return responses.withColumns({
        "root_cause": blank_to(section("ROOT_CAUSE", "EXPLANATION", "FIX_SUGGESTIONS", "CONFIDENCE"),
                               "The answer names no root cause."),
        "explanation": blank_to(section("EXPLANATION", "FIX_SUGGESTIONS", "CONFIDENCE"),
                                "The answer explains nothing."),
        "fix_suggestions": F.when(F.size(fixes) > 0, fixes).otherwise(F.array(F.lit("The answer proposes no fix."))),
        "confidence": F.when(conf.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))})


def parse_explanation(responses: DataFrame, text: str = "response") -> DataFrame:
    """WHY and WHAT sections of an explanation text."""
    why = F.trim(F.regexp_extract(text, r"(?s)WHY:\s*(.*?)\s*(?:WHAT:|\z)", 1))
    what = F.trim(F.regexp_extract(text, r"(?s)WHY:.*?WHAT:\s*(.*?)\s*\z", 1))
    return responses.withColumns({
        "why_it_happened": blank_to(why, "The answer gives no reason."),
        "what_to_do": blank_to(what, "The answer gives no advice.")})
