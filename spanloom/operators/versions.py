"""Versioned tables: newest version, appended changes, prompt versions and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import latest_per_key, previous


def current(df: DataFrame, keys: list[str], version: list[str], deleted: str | None = None) -> DataFrame:
    """Newest row per key; keys whose newest row is a tombstone are dropped."""
    out = latest_per_key(df, keys, version)
    return out if deleted is None else out.where(~F.coalesce(F.col(deleted), F.lit(False)))


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str], version: list[str],
                  deleted: str | None = None) -> DataFrame:
    """Append changed versions and read the newest state."""
    return current(base.unionByName(changes), keys, version, deleted)


def retain(df: DataFrame, column: str, as_of: Column, days: int, override: str | None = None) -> DataFrame:
    """Rows not older than ``days``, or than a per-row override in days."""
    keep = F.lit(days) if override is None else F.coalesce(F.col(override), F.lit(days))
    return df.where(F.col(column) >= as_of - F.make_dt_interval(keep))


def evolve(old: DataFrame, new: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Old and new files under one schema; added columns get their default."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# ---- prompt templates -----------------------------------------------------------
PROMPT_KEY = ["project_id", "name"]


def latest_prompts(prompts: DataFrame, *, tag: str | None = None, name_like: str | None = None) -> DataFrame:
    """Newest version per prompt, then filtered: an older version with the tag does not count."""
    rows = latest_per_key(prompts, PROMPT_KEY, ["version"])
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    return rows if name_like is None else rows.where(F.col("name").contains(name_like))


def prompt_at_stage(prompts: DataFrame, stage: str) -> DataFrame:
    return latest_per_key(prompts.where(F.array_contains("promoted_stages", stage)), PROMPT_KEY, ["version"])


def prompt_history(prompts: DataFrame, versions_per_bucket: int = 1000) -> DataFrame:
    """Versions in order, each with flags for what changed since the one before."""
    bucket = F.floor(F.col("version") / versions_per_bucket)
    rows = previous(prompts, PROMPT_KEY, bucket, ["version"],
                    {"_prev_template": "template", "previous_version": "version"})
    return rows.withColumn(
        "template_changed", F.col("previous_version").isNotNull() & ~F.col("template").eqNullSafe(F.col("_prev_template"))
    ).drop("_prev_template")


def new_prompts(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Creation requests whose name is still free, as version 1."""
    return requests.join(existing.select(*PROMPT_KEY).distinct(), PROMPT_KEY, "left_anti").withColumn(
        "version", F.lit(1).cast("long"))


def next_prompt_versions(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Next version per request; absent tags and model are inherited."""
    prev = latest_per_key(existing, PROMPT_KEY, ["version"]).select(
        *PROMPT_KEY, F.col("version").alias("_v"), F.col("tags").alias("_tags"), F.col("model").alias("_model"))
    return requests.join(prev, PROMPT_KEY).select(
        *PROMPT_KEY, "template", (F.col("_v") + 1).alias("version"),
        F.coalesce("tags", "_tags").alias("tags"), F.coalesce("model", "_model").alias("model"))


def promote(prompts: DataFrame, promotions: DataFrame) -> DataFrame:
    """Move each ``(prompt, version, stage)`` promotion: the stage leaves all other versions."""
    known = promotions.join(prompts.select(*PROMPT_KEY, "version"), [*PROMPT_KEY, "version"], "left_semi")
    target = known.select(*PROMPT_KEY, F.col("version").alias("_to"), F.col("stage").alias("_stage"))
    moved = prompts.join(target, PROMPT_KEY, "left")
    without = F.array_remove("promoted_stages", F.col("_stage"))
    kept = F.when(F.col("_to") == F.col("version"), F.array_union("promoted_stages", F.array("_stage"))).otherwise(without)
    return moved.withColumn(
        "promoted_stages", F.when(F.col("_stage").isNull(), F.col("promoted_stages")).otherwise(kept)
    ).drop("_to", "_stage")
