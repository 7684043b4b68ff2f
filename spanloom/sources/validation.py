"""Validity checks that split rows into accepted and rejected, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import iso_timestamp

# ---- fixed values: accepted shapes ----
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PROJECT_ID = r"^[a-zA-Z0-9_-]{1,100}$"
EXECUTION_ID = r"^[a-zA-Z0-9\-_]{1,100}$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
KEY_BODY = r"[A-Za-z0-9_-]{32,}"


def api_key(prefixes: tuple[str, ...] = ("sk_",)) -> str:
    return f"^({'|'.join(prefixes)}){KEY_BODY}$"


def matches(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(pattern), F.lit(False))


def is_timestamp(value: Column) -> Column:
    return iso_timestamp(value).isNotNull()


def has_length(value: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(value).between(low, high), F.lit(False))


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reject_reason``: the first rule (``{reason: must hold}``) a row breaks, else NULL."""
    reasons = F.coalesce(*[F.when(~ok, F.lit(reason)) for reason, ok in rules.items()])
    return df.withColumn("reject_reason", reasons)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    bad = F.col("reject_reason").isNotNull()
    return checked.where(~bad).drop("reject_reason"), checked.where(bad)
