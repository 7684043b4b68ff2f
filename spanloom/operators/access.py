"""Joins between projects, users, teams, subscriptions and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attrs import with_attrs
from ..functions.ordering import latest_per_key
from ..schema import ROLE_RANK, TIER_RANK, TRACE, is_error, lookup


def project_stats(projects: DataFrame, traces: DataFrame, as_of: Column, parity: bool = False) -> DataFrame:
    """Projects with their traces of the last 24 hours and distinct workflows.

    ``parity=True`` counts the empty workflow id as a workflow.
    """
    wf = with_attrs(traces, {"_wf": ("n8n.workflow.id", "str")})
    per_project = wf.groupBy("project_id").agg(
        F.count_if(F.col("started_at") >= as_of - F.expr("INTERVAL 24 HOUR")).alias("_n24"),
        F.count_distinct("_wf" if parity else F.nullif("_wf", F.lit(""))).alias("_wfs"))
    fill = 1 if parity else 0
    return projects.join(per_project, "project_id", "left").withColumns({
        "trace_count_24h": F.coalesce("_n24", F.lit(0)),
        "workflow_count": F.coalesce("_wfs", F.lit(fill)),
    }).drop("_n24", "_wfs")


def with_llm_span_count(traces: DataFrame, spans: DataFrame) -> DataFrame:
    counts = spans.where("span_type = 'llm'").groupBy(*TRACE).agg(F.count("*").alias("_n"))
    return traces.join(counts, TRACE, "left").withColumn(
        "llm_span_count", F.coalesce("_n", F.lit(0))).drop("_n")


def traces_with_error_span(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Semi-join on the distinct traces, so a long trace is one join row."""
    failed = spans.where(is_error(F.col("status"))).select(*TRACE).distinct()
    return traces.join(failed, TRACE, "left_semi")


def missing_projects(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects seen in the facts but not registered."""
    seen = facts.groupBy("project_id").agg(F.min("started_at").alias("created_at"))
    return seen.join(projects, "project_id", "left_anti")


def span_totals_by_trace(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Traces joined to their spans in one shuffle, as counts per span type."""
    types = ["agent", "llm", "tool", "retrieval"]
    per = spans.groupBy(*TRACE).agg(
        *[F.count_if(F.col("span_type") == t).alias(f"{t}_spans") for t in types])
    return traces.join(per, TRACE)


def match_rules(rules: DataFrame, alerts: DataFrame, honour_metric: bool = False) -> DataFrame:
    """Rules that apply to an alert: same project, agent equal or open, severity reached."""
    a, r = alerts.alias("a"), rules.where("enabled").alias("r")
    cond = (
        (F.col("a.project_id") == F.col("r.project_id"))
        & (F.col("r.agent_name").isNull() | (F.col("r.agent_name") == F.col("a.agent_name")))
        & (F.col("r.severity_rank") <= F.col("a.severity_rank"))
    )
    if honour_metric:
        cond = cond & (F.col("r.metric_name").isNull() | (F.col("r.metric_name") == F.col("a.metric_name")))
    return a.join(r, cond).select("a.*", "r.rule_id", "r.channels")


def key_owners(keys: DataFrame, users: DataFrame, subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """Valid keys with their user and the newest subscription of that user."""
    valid = keys.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    newest = latest_per_key(subscriptions, ["user_id"], ["created_at", "subscription_id"])
    return valid.join(users, "user_id").join(newest.drop("created_at"), "user_id")


def member_list(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users, "user_id")


def backfill_team(subscriptions: DataFrame, personal_teams: DataFrame) -> DataFrame:
    """Fill a missing team id with the personal team of the owner."""
    teams = personal_teams.select(F.col("owner_id").alias("user_id"), F.col("team_id").alias("_team"))
    return subscriptions.join(teams, "user_id", "left").withColumn(
        "team_id", F.coalesce("team_id", "_team")).drop("_team")


def missing_personal_teams(users: DataFrame, teams: DataFrame) -> DataFrame:
    """A personal team row for every user who owns none."""
    slug = F.concat(F.lit("personal-"), F.col("user_id").cast("string"))
    want = users.withColumn("slug", slug)
    return want.join(teams.select(F.col("owner_id").alias("user_id"), "slug"), ["user_id", "slug"], "left_anti")


def accessible_projects(members: DataFrame, project_teams: DataFrame, min_role: str = "viewer") -> DataFrame:
    """(user, project) pairs granted through a team with at least ``min_role``."""
    rank = lookup(ROLE_RANK, F.col("role"))
    allowed = members.where(rank >= ROLE_RANK[min_role]).select("user_id", "team_id")
    return allowed.join(project_teams, "team_id").select("user_id", "project_id").distinct()


def unassigned_projects(projects: DataFrame, project_teams: DataFrame) -> DataFrame:
    """Projects without a team, open to every user."""
    return projects.join(project_teams, "project_id", "left_anti")


def visible_facts(facts: DataFrame, user_projects: DataFrame, open_projects: DataFrame, user: int) -> DataFrame:
    """Row filter for one user: granted or unassigned projects only."""
    ids = user_projects.where(F.col("user_id") == user).select("project_id").union(
        open_projects.select("project_id")).distinct()
    return facts.join(ids, "project_id", "left_semi")


def comment_threads(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Comments with author columns and the text of the comment they answer."""
    parents = comments.select(
        "trace_id", F.col("comment_id").alias("parent_comment_id"), F.col("content").alias("parent_content"))
    return comments.join(users, "user_id").join(parents, ["trace_id", "parent_comment_id"], "left")


def tier_at_least(subscriptions: DataFrame, tier: str) -> DataFrame:
    return subscriptions.where(F.coalesce(lookup(TIER_RANK, F.col("tier")), F.lit(0)) >= TIER_RANK[tier])
