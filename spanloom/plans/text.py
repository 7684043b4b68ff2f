"""Registered queries: grounding and evaluation-case mining over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsontext import json_value
from ..functions.vectors import jaccard, words
from ..operators import evalmine as L, grounding as K
from ..sources.readers import table
from . import bind as B
from .bind import AS_OF_SQL, as_of, cat, ts_sql, with_
from .registry import Registry

reg = Registry()


def turns(spark, d):
    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return t.withColumn("span_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")))


TURNS = "turns AS (SELECT *, conv_id || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS span_id FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations))"


def answer_spans(spark, d):
    """Assistant turns as model spans; the turn before (lines as chunks) and their own first line are the context."""
    t = turns(spark, d)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    context = F.concat(F.replace("prev", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n"), F.element_at(F.split("text", "\n"), 1))
    rows = t.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    return rows.select(
        "span_id", cat("conv", F.col("conv_id")).alias("trace_id"), cat("p", F.col("conv_id") % 5).alias("project_id"), F.lit("llm").alias("span_type"),
        F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("llm.response"),
                           F.when(F.col("turn") % 2 == 1, F.col("text")).alias("output"), context.alias("context"))).alias("attributes"))


ANSWERS = r"""
answers AS (SELECT a.span_id, 'conv' || a.conv_id AS trace_id, 'p' || (a.conv_id % 5) AS project_id, a.text AS output_text,
    replace(b.text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || split_part(a.text, chr(10), 1) AS context
  FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
chunk0 AS (SELECT span_id, unnest(string_split(context, chr(10) || chr(10))) AS c, generate_subscripts(string_split(context, chr(10) || chr(10)), 1) AS n FROM answers),
chunk1 AS (SELECT span_id, regexp_replace(c, '^\s+|\s+$', '', 'g') AS chunk, min(n) AS n FROM chunk0 GROUP BY 1, 2),
chunks AS (SELECT span_id, chunk, row_number() OVER (PARTITION BY span_id ORDER BY n) - 1 AS context_index,
  list_distinct(list_filter(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS cw FROM chunk1 WHERE chunk <> ''),
cut AS (SELECT span_id, trace_id, project_id, string_split(regexp_replace(output_text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM answers
  WHERE output_text <> '' AND span_id IN (SELECT span_id FROM chunks)),
claim0 AS (SELECT span_id, trace_id, project_id, regexp_replace(unnest(s), '^\s+|\s+$', '', 'g') AS claim, generate_subscripts(s, 1) - 1 AS sentence_index FROM cut),
claims AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(claim), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM claim0 WHERE claim <> ''),
pairs AS (SELECT c.*, k.context_index, CASE WHEN len(list_distinct(c.w || k.cw)) = 0 THEN 0 ELSE
    len(list_intersect(c.w, k.cw)) / len(list_distinct(c.w || k.cw))::DOUBLE END AS score FROM claims c JOIN chunks k USING (span_id)),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY span_id, sentence_index ORDER BY score DESC, context_index) = 1),
verdict AS (SELECT a.span_id, a.trace_id, a.project_id, count(b.claim) AS claim_count, count(*) FILTER (score < 0.7) AS ungrounded_count,
    count(*) FILTER (score >= 0.7) AS grounded_count, coalesce(bool_or(score < 0.7), false) AS detected, coalesce(avg(score), 1.0) AS confidence
  FROM cut a LEFT JOIN best b USING (span_id) GROUP BY ALL)"""
GROUND = with_(TURNS, ANSWERS)


@reg.add("k1_claims", GROUND + "SELECT span_id, sentence_index, claim FROM claims")
def _(spark, d):
    rows = K.with_claims(answer_spans(spark, d))
    return rows.select("span_id", F.explode("claims").alias("c")).select(
        "span_id", F.col("c.index").alias("sentence_index"), F.col("c.text").alias("claim"))


@reg.add("k2_context_chunks", GROUND + "SELECT span_id, context_index, chunk FROM chunks")
def _(spark, d):
    chunks = K.context_chunks(F.col("attributes"))
    return answer_spans(spark, d).select("span_id", F.posexplode(chunks).alias("context_index", "chunk"))


@reg.add("k3_output_texts", GROUND + "SELECT span_id, md5(output_text) AS output_md5 FROM answers")
def _(spark, d):
    return K.output_text(answer_spans(spark, d)).select("span_id", F.md5("output_text").alias("output_md5"))


@reg.add("k4_claim_grounding", GROUND + """
SELECT span_id, sentence_index, claim, score >= 0.7 AS is_grounded, round(score, 6) AS similarity,
  CASE WHEN score >= 0.7 THEN context_index END AS context_index FROM best""")
def _(spark, d):
    return K.assess(K.with_claims(answer_spans(spark, d))).select(
        "span_id", "sentence_index", "claim", "is_grounded", "similarity", "context_index")


@reg.add("c10_claims_by_chunks", GROUND + "SELECT span_id, count(*) AS pairs, round(max(score), 6) AS best FROM pairs GROUP BY span_id")
def _(spark, d):
    rows = K.with_claims(answer_spans(spark, d))
    best = K.assess(rows).groupBy("span_id").agg(F.max("similarity").alias("best"))
    return rows.where(F.size("claims") > 0).select("span_id", (F.size("claims") * F.size("chunks")).alias("pairs")).join(best, "span_id")


@reg.add("k5_turn_similarity", with_(TURNS) + r"""
SELECT a.span_id, round(CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE END, 6) AS similarity
FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM turns) a
JOIN (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM turns) b
  ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def _(spark, d):
    t = turns(spark, d).withColumn("w", words(F.col("text")))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return t.join(after, ["conv_id", "turn"]).select("span_id", jaccard(F.col("w"), F.col("w2")).alias("similarity"))


@reg.add("k6_span_verdicts", GROUND + """
SELECT span_id, claim_count, ungrounded_count, grounded_count, detected, round(confidence, 6) AS confidence FROM verdict""")
def _(spark, d):
    return K.verdicts(K.with_claims(answer_spans(spark, d))).drop("trace_id", "project_id", "span_type")


@reg.add("k7_trace_verdicts", GROUND + """
SELECT project_id, trace_id, count(*) AS spans_checked, CAST(sum(claim_count) AS BIGINT) AS claims, CAST(sum(ungrounded_count) AS BIGINT) AS ungrounded,
  bool_or(detected) AS detected, round(avg(confidence), 6) AS confidence FROM verdict GROUP BY ALL""")
def _(spark, d):
    return K.trace_verdicts(answer_spans(spark, d))


# ---- L: evaluation cases ---------------------------------------------------------------
def start_of(conv_id, turn):
    return (as_of() - F.make_dt_interval(F.lit(0), F.lit(0), (conv_id % 20000).cast("int")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), turn.cast("decimal(18,6)")))


def conversation_spans(spark, d):
    """Every turn a span: users and assistants are model spans, the rest tool spans that sometimes fail."""
    c, n = F.col("conv_id"), F.col("turn")
    tool = F.col("role") == "system"
    failed = (tool & ((c + n) % 4 == 0)) | (~tool & ((c * 7 + n) % 29 == 0))
    message = B.pick(["Rate limit exceeded", "request timed out", "authentication failed", "context length exceeded", "boom"], c % 5)
    return turns(spark, d).select(
        "span_id", cat("conv", c).alias("trace_id"), cat("p", c % 5).alias("project_id"), cat("svc", c % 3).alias("service_name"),
        F.when(tool, "tool").otherwise("llm").alias("span_type"), F.col("role").alias("name"), start_of(c, n).alias("started_at"),
        start_of(c, n).alias("ended_at"), F.length("text").cast("double").alias("duration_ms"), F.when(failed, "error").otherwise("success").alias("status"),
        F.lit("").alias("parent_span_id"), F.lit("native").alias("source"),
        F.to_json(F.struct(F.when(F.col("role") == "user", F.col("text")).alias("llm.prompt"),
                           F.when(F.col("role") == "assistant", F.col("text")).alias("llm.response"),
                           F.when(tool & (n % 2 == 0), "search").alias("tool.name"),
                           F.when(failed & (n % 2 == 0), message).alias("error.message"))).alias("attributes"),
        F.when(failed & (n % 2 == 1), F.to_json(F.array(F.struct(F.lit("exception").alias("name"), F.struct(
            message.alias("exception.message")).alias("attributes"))))).otherwise("[]").alias("events"))


def conversation_traces(spark, d):
    s = conversation_spans(spark, d)
    return s.groupBy("trace_id").agg(
        F.min("project_id").alias("project_id"), F.min("service_name").alias("service_name"), F.min("started_at").alias("started_at"),
        F.sum("duration_ms").alias("duration_ms"),
        F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("success").alias("status"))


CONV = f"""
cs AS (SELECT span_id, 'conv' || conv_id AS trace_id, 'p' || (conv_id % 5) AS project_id, 'svc' || (conv_id % 3) AS service_name, turn, role, text,
    role = 'system' AS tool, {AS_OF_SQL} - to_minutes(conv_id % 20000) + to_seconds(turn) AS started_at, length(text) AS d,
    (role = 'system' AND (conv_id + turn) % 4 = 0) OR (role <> 'system' AND (conv_id * 7 + turn) % 29 = 0) AS failed,
    (['Rate limit exceeded', 'request timed out', 'authentication failed', 'context length exceeded', 'boom'])[conv_id % 5 + 1] AS message FROM turns),
ct AS (SELECT trace_id, min(project_id) AS project_id, min(service_name) AS service_name, min(started_at) AS started_at, sum(d)::DOUBLE AS duration_ms,
    CASE WHEN bool_or(failed) THEN 'error' ELSE 'success' END AS status FROM cs GROUP BY trace_id),
cio AS (SELECT trace_id, arg_min(CASE WHEN role = 'user' THEN text ELSE '' END, ROW(started_at, span_id)) FILTER (NOT tool) AS prompt,
    arg_max(CASE WHEN role = 'assistant' THEN text ELSE '' END, ROW(started_at, span_id)) FILTER (NOT tool) AS answer,
    arg_min(message, ROW(started_at, span_id)) FILTER (failed) AS error_text, coalesce(bool_and(NOT failed) FILTER (tool), false) AS all_tools_ok,
    coalesce(bool_or(failed) FILTER (tool), false) AS any_tool_error FROM cs GROUP BY trace_id),
io AS (SELECT ct.*, CASE WHEN coalesce(prompt, '') = '' THEN '[Trace from ' || service_name || ']' ELSE prompt END AS query,
    coalesce(answer, '') AS response, error_text, all_tools_ok, any_tool_error
  FROM ct JOIN cio USING (trace_id)),
lim AS (SELECT project_id, quantile_cont(duration_ms, 0.5) AS p50, list_sort(list(duration_ms))[CASE WHEN count(*) >= 5 THEN CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1 ELSE count(*) END] AS p95
  FROM io GROUP BY project_id),
cats AS (SELECT * FROM (SELECT io.*, p50, p95, lower(coalesce(error_text, '')) AS m, CASE WHEN status = 'error' THEN 'failure_mode/' || CASE
    WHEN regexp_matches(lower(error_text), 'rate limit|429') THEN 'rate_limit' WHEN regexp_matches(lower(error_text), 'timeout|timed out') THEN 'timeout'
    WHEN regexp_matches(lower(error_text), '401|unauthorized|auth') THEN 'auth_error' WHEN regexp_matches(lower(error_text), 'context length|token limit') THEN 'context_limit'
    WHEN any_tool_error THEN 'tool_error' ELSE 'other' END
  WHEN duration_ms > p95 AND p95 > 0 THEN 'edge_case/slow_response' WHEN response = '' THEN 'edge_case/empty_response'
  ELSE 'positive_example/' || CASE WHEN all_tools_ok THEN 'correct_tool_usage' WHEN duration_ms <= p50 AND p50 > 0 THEN 'fast_success' ELSE 'complete_answer' END END AS pattern
  FROM io JOIN lim USING (project_id)) WHERE pattern IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, pattern ORDER BY started_at DESC, trace_id) AS n FROM cats)"""
EVAL = with_(TURNS, CONV)


def io(spark, d):
    return L.trace_io(conversation_traces(spark, d), conversation_spans(spark, d))


def categorised(spark, d):
    rows = io(spark, d)
    return L.categorise(rows, L.duration_limits(conversation_traces(spark, d)))


@reg.add("l1_candidates", EVAL + f"""
SELECT trace_id, project_id, {ts_sql('started_at')} AS started_at FROM ct WHERE service_name = 'svc1' AND ct.started_at >= {AS_OF_SQL} - INTERVAL 168 HOUR""")
def _(spark, d):
    return L.candidates(conversation_traces(spark, d), as_of(), service="svc1").select("trace_id", "project_id", "started_at")


@reg.add("l2_trace_io", EVAL + """
SELECT trace_id, query, response, all_tools_ok, any_tool_error, CASE WHEN status = 'error' THEN error_text END AS error_text FROM io""")
def _(spark, d):
    return io(spark, d).select("trace_id", "query", "response", "all_tools_ok", "any_tool_error", "error_text")


@reg.add("l3_duration_limits", EVAL + "SELECT project_id, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM lim")
def _(spark, d):
    return L.duration_limits(conversation_traces(spark, d))


@reg.add("l4_categories", EVAL + "SELECT trace_id, project_id, pattern FROM cats")
def _(spark, d):
    return categorised(spark, d).select("trace_id", "project_id", "pattern")


@reg.add("l5_patterns", EVAL + """
SELECT project_id, pattern, count(*) AS traces, arg_min(trace_id, n) AS representative_trace_id FROM ranked GROUP BY ALL""")
def _(spark, d):
    return L.patterns(categorised(spark, d)).drop("description")


@reg.add("l5_pattern_traces", EVAL + "SELECT project_id, pattern, n, trace_id FROM ranked")
def _(spark, d):
    return L.pattern_traces(categorised(spark, d)).select("project_id", "pattern", "n", "trace_id")


@reg.add("l2_tool_steps", EVAL + """
SELECT project_id, trace_id, span_id, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY started_at, span_id) AS position,
  CASE WHEN turn % 2 = 0 THEN 'search' ELSE role END AS tool, CASE WHEN failed THEN 'error' ELSE 'success' END AS tool_status FROM cs WHERE tool""")
def _(spark, d):
    return L.tool_steps(conversation_spans(spark, d))


CASES = r"""
, cases AS (SELECT project_id, pattern, 'fallback_' || split_part(pattern, '/', 2) || '_' || n AS case_id, query,
  CASE WHEN pattern LIKE 'positive%' AND response <> '' THEN list_filter(list_transform(string_split(response, '.'),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10)[1] END AS expected_contains,
  CASE WHEN pattern LIKE 'positive%' AND len(list_filter(regexp_split_to_array(response, '\s+'), lambda w: w <> '')) > 3 THEN 2 ELSE 1 END AS assertions,
  trace_id AS source_trace_id FROM ranked)"""


@reg.add("l6_fallback_cases", EVAL + CASES + "SELECT * FROM cases")
def _(spark, d):
    return L.fallback_cases(categorised(spark, d)).select(
        "project_id", "pattern", "case_id", "query", "expected_contains", F.size("assertions").alias("assertions"), "source_trace_id")


def answers_with_cases(spark, d):
    """Answer texts with a JSON array of cases around the whole text of each turn."""
    t = turns(spark, d)
    typed = B.pick(L.ASSERTION_TYPES + ["telepathy"], F.col("turn") % 9)
    body = F.format_string('Here: ```json\n[{"name":"case","input":{"query":%s},"assertions":[{"type":"%s"}],"expected":{"contains":%s}},{"input":{"query":"b"}}]\n```',
                           json_value(F.col("text")), typed, F.when(F.col("turn") % 2 == 0, '["x"]').otherwise("[]"))
    return t.select("span_id", F.lit("slow").alias("subcategory"), body.alias("response"))


@reg.add("l7_parsed_cases", with_(TURNS) + r"""
SELECT span_id, 'slow_case_1' AS case_id, 'case' AS case_name, text AS query, CASE WHEN turn % 9 = 8 AND turn % 2 = 0 THEN 0 ELSE 1 END AS assertions FROM turns
UNION ALL SELECT span_id, 'slow_slow_case_2_2', 'slow_case_2', 'b', 1 FROM turns""")
def _(spark, d):
    out = L.parse_generated(answers_with_cases(spark, d))
    return out.select("span_id", "case_id", "case_name", "query", F.size("assertions").alias("assertions"))


@reg.add("l8_suite_documents", EVAL + CASES + """
SELECT project_id, case_id, query, source_trace_id FROM cases""")
def _(spark, d):
    docs = L.suite_rows(L.fallback_cases(categorised(spark, d)))
    doc = F.from_json("case", "struct<input:struct<query:string>,metadata:struct<source_trace_id:string>>")
    return docs.select("project_id", "case_id", doc["input"]["query"].alias("query"), doc["metadata"]["source_trace_id"].alias("source_trace_id"))


@reg.add("l9_run_summary", EVAL + CASES + """
SELECT project_id, count(*) AS traces_analyzed, count(DISTINCT pattern) AS patterns_found, any_value(c.n) AS cases_generated
FROM cats JOIN (SELECT project_id, count(*) AS n FROM cases GROUP BY 1) c USING (project_id) GROUP BY project_id""")
def _(spark, d):
    rows = categorised(spark, d)
    return L.run_summary(rows, L.fallback_cases(rows))
