"""Security scanning of prompts and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attrs import blank_to, with_attrs
from ..functions.ordering import latest_per_key, top_per_key
from ..functions.patterns import FINDING_TYPE, injection_findings, leak_findings, redact
from ..schema import SCAN_SEVERITY_RANK, lookup
from .aggregates import finding_breakdown

TEXTS = {
    "_prompt": ("llm.prompt", "str"), "_prompt2": ("gen_ai.prompt", "str"),
    "_response": ("llm.response", "str"), "_response2": ("gen_ai.completion", "str"),
}


def with_texts(spans: DataFrame) -> DataFrame:
    """Prompt and response of a span, with the alternative keys as fallback."""
    rows = with_attrs(spans, TEXTS)
    return rows.withColumns({
        "prompt": blank_to(F.col("_prompt"), F.col("_prompt2")),
        "response": blank_to(F.col("_response"), F.col("_response2")),
    }).drop("_prompt", "_prompt2", "_response", "_response2")


def severity_rank(severity: Column) -> Column:
    return lookup(SCAN_SEVERITY_RANK, severity)


def max_severity(findings: Column) -> Column:
    """Highest severity of an array of findings, LOW when there is none."""
    rank = F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"])))
    return lookup({v: k for k, v in SCAN_SEVERITY_RANK.items()}, rank, "LOW")


def scan(spans: DataFrame) -> DataFrame:
    """Findings, overall severity and confidence of every span."""
    none = F.array().cast(FINDING_TYPE)
    findings = F.concat(
        F.when(F.trim("prompt") != "", F.concat(
            injection_findings("prompt", "prompt"), leak_findings("prompt", "prompt"))).otherwise(none),
        F.when(F.trim("response") != "", F.concat(
            leak_findings("response", "response"), injection_findings("response", "response"))).otherwise(none))
    # explode of a one-element array keeps later filters from repeating the pattern search
    rows = with_texts(spans)
    kept = [c for c in rows.columns if c not in ("prompt", "response")]
    rows = rows.select(*kept, F.explode(F.array(findings)).alias("findings"))
    return rows.withColumns({
        "overall_severity": max_severity(F.col("findings")),
        "overall_confidence": F.coalesce(F.array_max(F.transform("findings", lambda f: f["confidence"])), F.lit(0.0)),
    })


def text_findings(texts: DataFrame, text: str, detector, location: str = "prompt") -> DataFrame:
    """One row per finding of one detector over a text column."""
    return texts.select(*[c for c in texts.columns if c != text], F.explode(detector(text, location)).alias("f")).select(
        *[c for c in texts.columns if c != text], "f.*")


def scan_new_traces(spans: DataFrame, scanned: DataFrame, as_of: Column, hours: int = 24, limit: int | None = None) -> DataFrame:
    """Result rows for traces not scanned yet: the newest model span with findings of each trace."""
    recent = spans.where((F.col("span_type") == "llm") & (F.col("started_at") >= as_of - F.expr(f"INTERVAL {hours} HOUR")))
    fresh = recent.join(scanned.select("trace_id").distinct(), "trace_id", "left_anti")
    if limit is not None:
        fresh = fresh.orderBy(F.desc("started_at"), "span_id").limit(limit)
    hits = scan(fresh).where(F.size("findings") > 0)
    result = F.to_json(F.struct("span_id", "findings", "overall_severity", "overall_confidence"))
    rows = hits.select("trace_id", "project_id", "started_at", "span_id", "overall_severity", result.alias("result"))
    newest = latest_per_key(rows, ["trace_id"], ["started_at", "span_id"])
    return newest.select(
        F.sha2(F.concat_ws("|", "trace_id", F.lit("security"), "span_id"), 256).alias("result_id"), "trace_id", "project_id",
        F.lit("security").alias("analysis_type"), "result", "overall_severity", as_of.alias("created_at"))


def scan_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans with findings of one trace."""
    return scan(spans.where(F.col("trace_id") == trace_id)).where(F.size("findings") > 0)


def summary(results: DataFrame) -> DataFrame:
    """Findings per severity and per type for every project."""
    return finding_breakdown(results, ["project_id"])


def recent_examples(results: DataFrame, k: int = 5) -> DataFrame:
    return top_per_key(results, ["project_id"], [F.desc("created_at"), F.col("trace_id")], k, "recent_rank")


def redact_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: redact(F.col(c)) for c in columns})


def evaluate_guardrails(spans: DataFrame, configs: DataFrame) -> DataFrame:
    """Violation rows of enabled guardrails.

    ``configs``: project_id, guard_name, guard_type (pii, injection, max_tokens,
    content_filter), phase (input, output), action, limit (tokens or NULL), words.
    They are settings that people write, so they go to the spans: dealt by project, all texts of a project would be one task's.
    """
    enabled = F.broadcast(configs.where("enabled"))

    def asked(kind: str, phase: str) -> Column:
        return F.bool_or((F.col("guard_type") == kind) & (F.col("phase") == phase))

    # what a project asks for comes first: other scans don't run on its texts, and spans of projects without guards are dropped unread
    wanted = enabled.groupBy("project_id").agg(*[asked(k, p).alias(f"_{k}_{p}") for k in ("pii", "injection") for p in ("input", "output")])
    rows = with_attrs(with_texts(spans.join(F.broadcast(wanted), "project_id")), {"_tokens": ("llm.total_tokens", "int")})
    scans = {"pii_in": ("_pii_input", leak_findings("prompt", "prompt")), "pii_out": ("_pii_output", leak_findings("response", "response")),
             "inj_in": ("_injection_input", injection_findings("prompt", "prompt")), "inj_out": ("_injection_output", injection_findings("response", "response"))}
    checks = F.struct(*[F.when(F.col(need), F.size(found) > 0).otherwise(False).alias(name) for name, (need, found) in scans.items()])
    flags = rows.select("span_id", "trace_id", "project_id", "started_at", "_tokens", "prompt", "response",
                        F.inline(F.array(checks)))
    joined = flags.join(enabled, "project_id")
    into = F.col("phase") == "input"
    text = F.when(into, F.col("prompt")).otherwise(F.col("response"))
    kind = F.col("guard_type")
    broken = (
        F.when(kind == "pii", F.when(into, F.col("pii_in")).otherwise(F.col("pii_out")))
        .when(kind == "injection", F.when(into, F.col("inj_in")).otherwise(F.col("inj_out")))
        .when(kind == "max_tokens", F.col("_tokens") > F.col("limit"))
        .when(kind == "content_filter", F.exists("words", lambda w: F.contains(F.lower(text), F.lower(w)))))
    return joined.where(F.coalesce(broken, F.lit(False))).select(
        F.sha2(F.concat_ws("|", "span_id", "guard_name", "phase"), 256).alias("violation_id"), "project_id", "span_id",
        "trace_id", "guard_name", "guard_type", "phase", "action", F.col("started_at").alias("detected_at"))
