"""Small aggregation building blocks used by many reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import agg_with_quantiles
from ..schema import is_error
from .rollup import cents


def error_ratio(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(is_error(F.col("status"))).alias("errors"),
        F.try_divide(F.count_if(is_error(F.col("status"))), F.count("*")).alias("error_ratio"),
    )


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.sum(v).alias("sum"))


def quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return agg_with_quantiles(df, keys, {"n": ("count_of", value)},
                              {value: {"p50": 0.5, "p95": 0.95, "p99": 0.99}})


def distinct_counts(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Exact distinct counts; Spark spreads a hot key by the counted value first."""
    return df.groupBy(*keys).agg(*[F.count_distinct(src).alias(out) for out, src in columns.items()])


def any_value(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Deterministic ``any``: the smallest value."""
    return df.groupBy(*keys).agg(F.min(column).alias(out))


def having(df: DataFrame, keys: list[str], at_least: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def most_common(df: DataFrame, key: str, first_seen: str, k: int = 5) -> DataFrame:
    """The k most frequent values; ties go to the value seen first."""
    return (
        df.groupBy(key).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen"))
        .orderBy(F.desc("n"), "first_seen", key).limit(k)
    )


FINDINGS = "struct<findings:array<struct<finding_type:string,severity:string>>>"


def finding_breakdown(results: DataFrame, keys: list[str]) -> DataFrame:
    """Findings by severity and by type in one pass over the result JSON."""
    rows = (
        results.select(*keys, F.explode(F.from_json("result", FINDINGS)["findings"]).alias("f"))
        .select(*keys, F.coalesce("f.severity", F.lit("MEDIUM")).alias("severity"),
                F.coalesce("f.finding_type", F.lit("unknown")).alias("finding_type"))
    )
    sets = [[*keys, "severity"], [*keys, "finding_type"]]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "severity", "finding_type").agg(
        F.count("*").alias("findings"))


def usage_breakdown(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, per model and per vendor from one scan."""
    sets = [keys, [*keys, "model"], [*keys, "vendor"]]
    return usage.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "model", "vendor").agg(
        F.grouping_id().alias("level"),
        F.sum("call_count").alias("total_calls"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.try_divide(F.sum("total_cost_usd"), F.sum("call_count")).alias("cost_per_call"),
        F.try_divide(F.sum("total_tokens"), F.sum("call_count")).alias("tokens_per_call"),
    )


def cost_map(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Per group one map model -> rounded cost (one entry per model)."""
    per_model = usage.groupBy(*keys, "model").agg(cents(F.sum("total_cost_usd")).cast("double").alias("cost"))
    entries = F.array_sort(F.collect_list(F.struct("model", "cost")))
    return per_model.groupBy(*keys).agg(F.map_from_entries(entries).alias("cost_by_model"))
