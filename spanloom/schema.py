"""Table schemas, ordinal maps and small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

S, L, D, TS, B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


TRACES = struct(
    trace_id=S, project_id=S, service_name=S, started_at=TS, completed_at=TS, duration_ms=D,
    status=S, root_span_id=S, span_count=L, attributes=S, source=S, created_at=TS,
)

SPANS = struct(
    span_id=S, trace_id=S, project_id=S, parent_span_id=S, name=S, span_type=S, service_name=S,
    started_at=TS, ended_at=TS, duration_ms=D, status=S, attributes=S, events=S,
    replay_snapshot=S, source=S, created_at=TS,
)

#: key of a trace; ids are only unique inside a project
TRACE = ["project_id", "trace_id"]

# ---- fixed values: ordered enumerations ------------------------------------
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SCAN_SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
TIER_RANK = {"free": 0, "lunch-money": 1, "pro": 2, "enterprise": 3}
ROLE_RANK = {"viewer": 0, "member": 1, "admin": 2, "owner": 3}

# ---- fixed values: status words ---------------------------------------------
STATUS_WORDS = {
    "success": "success",
    "completed": "success",
    "ok": "success",
    "error": "error",
    "failed": "error",
    "running": "running",
    "pending": "pending",
}
IMPORT_LEVEL_STATUS = {
    "DEBUG": "success",
    "DEFAULT": "success",
    "WARNING": "success",
    "ERROR": "error",
}
OTLP_STATUS = {0: "pending", 1: "success", 2: "error"}

# ---- fixed values: import and workflow type maps ------------------------------
OBSERVATION_TYPE = {
    "GENERATION": "llm",
    "SPAN": "custom",
    "CHAIN": "custom",
    "AGENT": "custom",
    "RETRIEVER": "retrieval",
    "EMBEDDING": "embedding",
    "TOOL": "tool",
    "EVALUATOR": "custom",
    "GUARDRAIL": "custom",
}


def lookup(mapping: dict, key: Column, default: str | None = None) -> Column:
    """Literal map lookup; an unknown or NULL key gives ``default``."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, F.lower(severity)), F.lit(0))


def severity_name(rank: Column) -> Column:
    return lookup({v: k for k, v in SEVERITY_RANK.items()}, rank)


def status_norm(status: Column) -> Column:
    """One spelling per status: success, error, running, pending or unknown."""
    return lookup(STATUS_WORDS, F.lower(status), "unknown")


def is_success(status: Column) -> Column:
    return F.coalesce(status_norm(status) == "success", F.lit(False))


def is_error(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin("error", "failed"), F.lit(False))
