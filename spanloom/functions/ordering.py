"""Ordered operations per key that do not put a whole key into one task.

A plain ``row_number() over (partition by key)`` sends a hot key to a single
task. The helpers here carry the key as one struct column (never NULL, so NULL
keys join by plain equality and the window reuses the join's partitioning), cut each key into time buckets, carry a small summary
(a count, a sum, the last row) across the buckets, and finish inside buckets.
Top-k by ``row_number() <= k`` needs none of this: Spark prunes to k rows per
task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


def time_bucket(ts: Column, width_us: int = HOUR_US) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width_us))


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
            sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums per key in ``order``.

    ``bucket`` must not decrease along ``order``.
    """
    rows = df.withColumns({"_key": F.struct(*keys), "_b": bucket})
    for name, expr in sums.items():
        rows = rows.withColumn(f"_x_{name}", expr)
    totals = rows.groupBy("_key", "_b").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_key", "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_key", "_b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(offsets, ["_key", "_b"])
    out = joined.withColumns({n: F.col(f"_o_{n}") + F.sum(f"_x_{n}").over(inside) for n in sums})
    return out.drop("_key", "_b", *[f"_x_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def position(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """1-based row number per key over whole groups."""
    return running(df, keys, bucket, order, {out: F.lit(1).cast("long")})


def previous(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
             values: dict[str, str]) -> DataFrame:
    """``lag`` per key: ``{output: source column}``; ``order`` are ascending column names."""
    rows = df.withColumns({"_key": F.struct(*keys), "_b": bucket})
    payload = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    tail = rows.groupBy("_key", "_b").agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    by_bucket = Window.partitionBy("_key").orderBy("_b")
    carried = tail.select("_key", "_b", F.lag("_tail").over(by_bucket).alias("_carry"))
    inside = Window.partitionBy("_key", "_b").orderBy(*order)
    joined = rows.join(carried, ["_key", "_b"]).withColumn("_first", F.row_number().over(inside) == 1)
    return joined.withColumns({
        out: F.when(F.col("_first"), F.col(f"_carry.{out}")).otherwise(F.lag(src).over(inside))
        for out, src in values.items()
    }).drop("_key", "_b", "_carry", "_first")


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest row per key by the ``version`` columns (partial aggregation, no window)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key; Spark limits each task to k rows per key before the shuffle."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = ranked.where(F.col(name) <= k)
    return out if rank else out.drop(name)
