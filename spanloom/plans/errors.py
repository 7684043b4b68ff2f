"""Registered queries: error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, errors as E
from . import bind as B
from .bind import EV, SPANS, spans, ts_sql, with_
from .registry import Registry

reg = Registry()

SEVERITY_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.CLASS_SEVERITY.items()) + " END"
# the ten rules written independently of the column expression, over the CTE columns
J1 = f"""
msg AS (SELECT *, lower(coalesce(error_message, '')) AS m, coalesce(error_code, -1) AS c FROM spans WHERE status = 'error'),
j1 AS (SELECT *, {SEVERITY_SQL} AS severity FROM (SELECT *, CASE
    WHEN c = 429 OR m LIKE '%rate limit%' OR m LIKE '%429%' THEN 'rate_limit'
    WHEN c = 401 OR regexp_matches(m, 'api key|unauthorized|authentication|invalid key') THEN 'auth_failure'
    WHEN regexp_matches(m, 'context length|maximum context|token limit|max tokens') THEN 'token_limit'
    WHEN m LIKE '%model%' AND regexp_matches(m, 'not found|does not exist|not available|unavailable') THEN 'model_not_found'
    WHEN regexp_matches(m, 'timeout|connection|network') OR c IN (502, 503, 504) THEN 'network_error'
    WHEN c = 400 OR regexp_matches(m, 'invalid|malformed') THEN 'invalid_request'
    WHEN c IN (500, 503) OR regexp_matches(m, 'server error|service') THEN 'service_error'
    WHEN regexp_matches(m, 'retrieval|vector|embedding|chroma|pinecone') THEN 'retrieval_error'
    ELSE 'unknown' END AS category FROM msg))"""
ALTS = """
alts(category, pat, rank, title, action_type, confidence) AS (VALUES
  ('rate_limit', '', 1, 'Wait and retry with exponential backoff', 'replay', 0.95),
  ('rate_limit', 'gpt-4$|gpt-4o$', 2, 'Switch to gpt-4o-mini for lower rate limits', 'replay', 0.85),
  ('token_limit', '', 1, 'Increase max_tokens to 3072', 'replay', 0.90), ('token_limit', '', 2, 'Compress your system prompt', 'code_change', 0.70),
  ('model_not_found', '^gpt-4', 1, 'Try gpt-4o instead', 'replay', 0.80), ('model_not_found', '^gpt-4', 2, 'Try gpt-4-turbo instead', 'replay', 0.80),
  ('model_not_found', 'opus', 1, 'Try claude-sonnet-4-20250514 instead', 'replay', 0.80),
  ('model_not_found', 'opus', 2, 'Try claude-3-sonnet-20240229 instead', 'replay', 0.80),
  ('auth_failure', '', 1, 'Check your API key configuration', 'config_change', 0.95),
  ('network_error', '', 1, 'Retry the request', 'replay', 0.85), ('network_error', '', 2, 'Check your network connection', 'config_change', 0.70),
  ('unknown', '', 1, 'Review the error message', 'code_change', 0.50))"""


@reg.add("j1_error_classes", with_(SPANS, J1) + "SELECT span_id, trace_id, error_message, error_code, category FROM j1")
def _(spark, d):
    return E.classify(spans(spark, d)).select("span_id", "trace_id", "error_message", "error_code", "category")


@reg.add("j2_error_severity", with_(SPANS, J1) + "SELECT category, severity, count(*) AS n FROM j1 GROUP BY ALL")
def _(spark, d):
    return E.classify(spans(spark, d)).groupBy("category", "severity").agg(F.count("*").alias("n"))


@reg.add("j3_recommendations", with_(SPANS, J1, ALTS) + """
SELECT span_id, category, rank, title, action_type, confidence::DOUBLE AS confidence
FROM j1 JOIN alts USING (category) WHERE regexp_matches(model, pat)""")
def _(spark, d):
    return E.recommend(E.classify(spans(spark, d))).select("span_id", "category", "rank", "title", "action_type", "confidence")


@reg.add("j4_model_alternatives", with_(SPANS, J1) + """
SELECT span_id, model, alt FROM j1, LATERAL (SELECT unnest(CASE WHEN model LIKE 'gpt-4%' THEN ['gpt-4o', 'gpt-4-turbo']
  ELSE ['claude-sonnet-4-20250514', 'claude-3-sonnet-20240229'] END) AS alt) WHERE category = 'model_not_found'""")
def _(spark, d):
    rows = E.classify(spans(spark, d)).where("category = 'model_not_found'")
    return rows.select("span_id", "model", F.explode(E.model_alternatives(F.col("model"))).alias("alt"))


@reg.add("j5_error_context", with_(SPANS) + """
SELECT span_id, model, prompt_tokens, completion_tokens, span_type, name AS span_name, duration_ms FROM spans WHERE status = 'error'""")
def _(spark, d):
    rows = E.error_context(spans(spark, d).where("status = 'error'")).select("span_id", "context")
    schema = "struct<model:string,prompt_tokens:bigint,completion_tokens:bigint,span_type:string,span_name:string,duration_ms:double>"
    return rows.select("span_id", F.from_json("context", schema).alias("c")).select("span_id", "c.*")


@reg.add("j7_fix_hints", with_(SPANS, J1) + """
SELECT span_id, category, CASE category WHEN 'rate_limit' THEN 'Common during peak usage hours' WHEN 'auth_failure' THEN 'Check API key is not expired'
    WHEN 'token_limit' THEN 'Reduce prompt length or max_tokens' WHEN 'model_not_found' THEN 'Verify model name spelling'
    WHEN 'network_error' THEN 'Temporary connectivity issues' ELSE 'Review error details carefully' END AS first_pattern,
  CASE WHEN category IN ('rate_limit', 'model_not_found', 'token_limit') THEN '< 1 minute'
    WHEN category IN ('network_error', 'auth_failure') THEN '5-10 minutes' ELSE '10-30 minutes' END AS fix_time FROM j1""")
def _(spark, d):
    return E.with_fix_hints(E.classify(spans(spark, d))).select(
        "span_id", "category", F.col("related_patterns")[0].alias("first_pattern"), "fix_time")


J8 = """
j8 AS (SELECT project_id, category, count(*) AS error_count, arg_max(severity, ROW(started_at, span_id)) AS severity,
    arg_max(trace_id, ROW(started_at, span_id)) AS latest_trace_id, arg_max(title, ROW(started_at, span_id)) AS recommendation,
    row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, max(ROW(started_at, span_id)) DESC) AS rank
  FROM (SELECT j1.*, coalesce(a.title, 'Review error details') AS title FROM j1
    LEFT JOIN alts a ON a.category = j1.category AND a.rank = 1 AND regexp_matches(j1.model, a.pat)) GROUP BY project_id, category)"""


@reg.add("j8_top_issues", with_(SPANS, J1, ALTS, J8) + "SELECT * FROM j8 WHERE rank <= 5")
def _(spark, d):
    return E.top_issues(E.classify(spans(spark, d)))


@reg.add("j9_failure_chain", with_(SPANS) + f"""
SELECT trace_id, span_id, name, span_type, {ts_sql('started_at')} AS started_at, coalesce(error_message, 'Unknown error') AS error_text,
  row_number() OVER w AS position, row_number() OVER w = 1 AS is_root_cause
FROM spans WHERE status = 'error' WINDOW w AS (PARTITION BY trace_id ORDER BY spans.started_at, span_id)""")
def _(spark, d):
    return E.failure_chain(spans(spark, d))


@reg.add("j10_debug_timeline", with_(SPANS) + f"""
SELECT trace_id, span_id, name, span_type, {ts_sql('started_at')} AS started_at, duration_ms, status,
  CASE WHEN status = 'error' THEN error_message END AS error_text, nullif(parent_span_id, '') AS parent_span_id FROM spans""")
def _(spark, d):
    return E.debug_timeline(spans(spark, d, parents=True))


@reg.add("j11_debug_digest", with_(SPANS) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) AS n FROM spans)
SELECT trace_id, (n - 1) // 200 AS page, 'Spans by start:' || chr(10) || string_agg('  [' || CASE WHEN status = 'error' THEN 'ERROR' ELSE 'OK' END
    || '] ' || name || ' (' || span_type || ') - ' || CAST(CAST(round(CAST(duration_ms AS DECIMAL(18, 4)), 0) AS BIGINT) AS VARCHAR) || 'ms'
    || coalesce(chr(10) || '         Error: ' || error_message, ''), chr(10) ORDER BY n)
  || chr(10) || chr(10) || 'Calls:' || chr(10) || coalesce(string_agg(CASE span_type
    WHEN 'llm' THEN '  LLM Call [' || name || ']: model=' || model || ', tokens=' || total_tokens
    WHEN 'tool' THEN '  Tool Call [' || name || ']: input=' WHEN 'retrieval' THEN '  Retrieval [' || name || ']: query=' END,
    chr(10) ORDER BY n) FILTER (span_type <> 'agent'), '  none') AS digest
FROM r GROUP BY trace_id, page""")
def _(spark, d):
    return E.debug_digest(spans(spark, d))


@reg.add("f11_trace_errors", with_(SPANS, J1) + """
SELECT trace_id, count(j1.span_id) AS error_count, coalesce(bool_or(j1.severity = 'critical'), false) AS has_critical
FROM spans LEFT JOIN j1 USING (trace_id, span_id) GROUP BY trace_id""")
def _(spark, d):
    s = spans(spark, d)
    return analytics.trace_errors(s, E.classify(s)).drop("project_id")


def answers(spark, d):
    """Answer texts of six shapes: whole, without or with odd parts, in another order, without marks."""
    k, e = F.col("k"), F.col("event_type")
    cause, why = F.concat(F.lit("ROOT_CAUSE: "), e, F.lit(" failed\n")), F.concat(F.lit("EXPLANATION:\n  step "), k, F.lit(" broke\nit\n\n"))
    fixes = F.concat(F.lit("FIX_SUGGESTIONS:\n1. retry "), k, F.lit(". twice\n2.\n- no number\n 3. check "), e, F.lit("\n"))
    sure = F.concat(F.lit("CONFIDENCE: "), k / F.lit(50.0), F.lit("\nend"))
    return B.events(spark, d).select("event_id", F.when(k % 6 == 0, F.concat(cause, why, fixes, sure)).when(k % 6 == 1, F.concat(cause, fixes, F.lit("CONFIDENCE: high")))
                                     .when(k % 6 == 2, F.concat(F.lit("Well. "), why, cause)).when(k % 6 == 3, F.concat(cause, fixes, why, sure))
                                     .when(k % 6 == 4, F.concat(e, F.lit(" without marks"))).alias("response"))


def _section_sql(name, *ends):
    rest = f"substr(t, strpos(t, '{name}:') + {len(name) + 1})"
    cuts = " ".join(f"WHEN contains({rest}, '{e}:') THEN split_part({rest}, '{e}:', 1)" for e in ends)
    return f"regexp_replace(CASE WHEN contains(t, '{name}:') THEN CASE {cuts} ELSE {rest} END END, '^\\s+|\\s+$', '', 'g')"


@reg.add("j12_analysis_sections", with_(EV) + f"""
, shapes AS (SELECT event_id, k % 6 AS shape, 'ROOT_CAUSE: ' || event_type || ' failed' || chr(10) AS cause,
  'EXPLANATION:' || chr(10) || '  step ' || k || ' broke' || chr(10) || 'it' || chr(10) || chr(10) AS why,
  'FIX_SUGGESTIONS:' || chr(10) || '1. retry ' || k || '. twice' || chr(10) || '2.' || chr(10) || '- no number' || chr(10) || ' 3. check ' || event_type || chr(10) AS fixes,
  'CONFIDENCE: ' || (k / 50.0::DOUBLE) || chr(10) || 'end' AS sure, event_type || ' without marks' AS plain FROM ev),
texts AS (SELECT event_id, coalesce(CASE shape WHEN 0 THEN cause || why || fixes || sure WHEN 1 THEN cause || fixes || 'CONFIDENCE: high' WHEN 2 THEN 'Well. ' || why || cause
  WHEN 3 THEN cause || fixes || why || sure WHEN 4 THEN plain END, '') AS t FROM shapes),
cut AS (SELECT event_id, t, {_section_sql('ROOT_CAUSE', 'EXPLANATION', 'FIX_SUGGESTIONS', 'CONFIDENCE')} AS cause, {_section_sql('EXPLANATION', 'FIX_SUGGESTIONS', 'CONFIDENCE')} AS why,
  list_filter(list_transform(list_filter(list_transform(string_split({_section_sql('FIX_SUGGESTIONS', 'CONFIDENCE')}, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^\\d.*\\.')),
    lambda x: trim(regexp_replace(x, '^[^.]*\\.', ''))), lambda x: x <> '') AS fixes,
  CASE WHEN contains(t, 'CONFIDENCE:') THEN TRY_CAST(trim(split_part(trim(substr(t, strpos(t, 'CONFIDENCE:') + 11)), chr(10), 1)) AS DOUBLE) END AS sure FROM texts)
SELECT event_id, CASE WHEN coalesce(cause, '') = '' THEN 'The answer names no root cause.' ELSE cause END AS root_cause,
  CASE WHEN coalesce(why, '') = '' THEN 'The answer explains nothing.' ELSE why END AS explanation,
  CASE WHEN coalesce(len(fixes), 0) = 0 THEN 'The answer proposes no fix.' ELSE array_to_string(fixes, '|') END AS fix_suggestions,
  CASE WHEN sure IS NULL THEN 0.5 ELSE round(greatest(0, least(1, sure)), 6) END AS confidence FROM cut""")
def _(spark, d):
    return E.parse_analysis(answers(spark, d)).drop("response")
