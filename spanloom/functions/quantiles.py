"""Exact quantiles that survive a hot group.

``percentile`` keeps every distinct value of a group in one task. Here the
values are first counted per (group, bin, value), where the bin is a monotone
function of the value; a running sum over the few bins of a group finds the bin
that holds each wanted rank, and only those bins are ranked value by value. No
task ever sees more than one bin of one group.

Groups are carried as one struct column: a struct is never NULL, so groups with
NULL keys join by plain equality, and the window after the join reuses the
partitioning of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS_PER_E_FOLD = 64


def value_bin(value: Column, resolution: int = BINS_PER_E_FOLD) -> Column:
    """Monotone bin of a double: of equal relative width at every magnitude, zero apart."""
    v = value.cast("double")
    size = F.least(F.abs(v), F.lit(1.7e308))  # infinities share the outermost bin
    # ln of the least double is above -746, so bins of non-zero values are positive before the sign
    place = F.floor((F.log(size) + 746) * resolution)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise((F.signum(v) * place).cast("long"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL as a value; the key columns appear once."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, keys: list[str], value: str, resolution: int = BINS_PER_E_FOLD) -> DataFrame:
    """Rows per (group, bin, value); counted before the shuffle and spread over bins and values.

    NULL and NaN values are left out. The bin filter only states what the later
    join implies, so that both readers of the counts share one exchange.
    """
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v"))
        .withColumn("_bin", value_bin(F.col("_v"), resolution))
        .where(F.col("_bin").isNotNull())
        .groupBy("_key", "_bin", "_v").agg(F.count("*").alias("_n"))
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float],
                    resolution: int = BINS_PER_E_FOLD) -> DataFrame:
    """One row per group with linearly interpolated quantiles ``{column: q}``."""
    counts = value_counts(df, keys, value, resolution)
    per_bin = counts.groupBy("_key", "_bin").agg(F.sum("_n").alias("_in_bin"))
    group = Window.partitionBy("_key")
    running = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.floor((F.col("_total") - 1) * F.lit(q)).alias("lo"),
                 F.ceil((F.col("_total") - 1) * F.lit(q)).alias("hi"),
                 ((F.col("_total") - 1) * F.lit(q)).alias("pos"))
        for name, q in wanted.items()
    ])
    located = (
        per_bin.withColumns({
            "_end": F.sum("_in_bin").over(running),
            "_total": F.sum("_in_bin").over(group),
        })
        .withColumn("_start", F.col("_end") - F.col("_in_bin"))
        .withColumn("_ranks", ranks)
        .where(F.exists("_ranks", lambda r: (
            ((r["lo"] >= F.col("_start")) & (r["lo"] < F.col("_end")))
            | ((r["hi"] >= F.col("_start")) & (r["hi"] < F.col("_end"))))))
        .select("_key", "_bin", "_start", "_ranks")
    )
    in_bin = Window.partitionBy("_key", "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.join(located, ["_key", "_bin"])
        .withColumn("_to", F.col("_start") + F.sum("_n").over(in_bin))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )

    def holds(i: int, side: str) -> Column:
        rank = F.col("_ranks")[i][side]
        return (rank >= F.col("_from")) & (rank < F.col("_to"))

    aggs = []
    for i, name in enumerate(wanted):
        lo = F.max(F.when(holds(i, "lo"), F.col("_v")))
        hi = F.max(F.when(holds(i, "hi"), F.col("_v")))
        frac = F.max(F.col("_ranks")[i]["pos"] - F.col("_ranks")[i]["lo"])
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return ranked.groupBy("_key").agg(*aggs).select("_key.*", *wanted)


# ---- aggregates and quantiles in one pass -------------------------------------------------
#: bin of rows without a value, before all others
NO_VALUE = -(1 << 62)
#: kind of an aggregate and its column or condition; "count" has none, "count_of" leaves nulls out
Measure = tuple[str, Column | str | None]

_PLAIN = {
    "count": lambda c: F.count("*"), "count_of": F.count, "count_if": F.count_if, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop,
    "rate": lambda c: F.try_divide(F.count_if(c), F.count("*")),
}
#: parts a kind is made of
_PARTS = {"count": "n", "count_of": "k", "count_if": "c", "sum": "s", "avg": "tk", "min": "l", "max": "h", "stddev": "tkq", "rate": "nc"}


def _part(kind: str, value: Column, counted: Column) -> Column:
    """A part over the rows of ``counted``; parts of smaller groups add up to those of larger ones."""
    held = F.when(counted, value)
    return {"n": lambda: F.count_if(counted), "c": lambda: F.count_if(counted & value), "s": lambda: F.sum(held), "t": lambda: F.sum(held.cast("double")),
            "k": lambda: F.count(held), "q": lambda: F.sum(held.cast("double") * held.cast("double")), "l": lambda: F.min(held), "h": lambda: F.max(held)}[kind]()


def _added(part: str) -> Column:
    return {"l": F.min, "h": F.max}.get(part[0], F.sum)(part)


def _read(kind: str, parts: dict[str, Column]) -> Column:
    if kind in ("count", "count_of", "count_if", "sum", "min", "max"):
        return next(iter(parts.values()))
    if kind == "rate":
        return F.try_divide(parts["c"], parts["n"])
    mean = F.try_divide(parts["t"], parts["k"])
    if kind == "avg":
        return mean
    variance = F.try_divide(parts["q"], parts["k"]) - mean * mean  # below rounding there is none
    return F.when(variance.isNotNull(), F.when(variance > mean * mean * 1e-12, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0))


def agg_with_quantiles(df: DataFrame, keys: list[str], aggs: dict[str, Measure], quantiles: dict[str, dict[str, float]],
                       resolution: int = BINS_PER_E_FOLD) -> DataFrame:
    """Aggregates per group plus exact, interpolated quantiles ``{value column: {alias: q}}``, from one read of the rows.

    Rows are counted per (group, measure, bin, value), and that one table also carries the parts of all other
    aggregates (sums, counts, extremes), added before the shuffle. Bins, summed up, give the aggregates and tell
    which bins hold the wanted ranks; of these the values are ranked. Several value columns are stacked.
    """
    if not quantiles:
        return df.groupBy(*keys).agg(*[_PLAIN[kind](c).alias(name) for name, (kind, c) in aggs.items()])
    values = list(quantiles)
    used = {name: (kind, F.col(c) if isinstance(c, str) else c) for name, (kind, c) in aggs.items()}
    given = [c.alias(f"_c{i}") for i, (kind, c) in enumerate(used.values()) if c is not None]
    number = [F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")) for v in values]
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("_m"), v.alias("_v")) for i, v in enumerate(number)]))
    rows = df.select(F.struct(*keys).alias("_key"), *given, stacked.alias("_s") if len(values) > 1 else F.struct(F.lit(0).alias("_m"), number[0].alias("_v")).alias("_s"))
    rows = rows.withColumns({"_m": F.col("_s._m"), "_v": F.col("_s._v")}).withColumn(
        "_bin", F.coalesce(value_bin(F.col("_v"), resolution), F.lit(NO_VALUE))).drop("_s")  # never null, so joins add no filter of their own
    counted = F.col("_m") == 0  # of the stacked copies of a row one counts
    parts = {"n": _part("n", F.lit(True), counted)}
    for i, (kind, c) in enumerate(used.values()):
        parts |= {f"{p}{i}": _part(p, F.col(f"_c{i}"), counted) for p in _PARTS[kind] if p != "n"}
    counts = rows.groupBy("_key", "_m", "_bin", "_v").agg(F.count("*").alias("_n"), *[c.alias(p) for p, c in parts.items()])

    bins = counts.groupBy("_key", "_m", "_bin").agg(F.sum("_n").alias("_in_bin"), *[_added(p).alias(p) for p in parts])
    group, measure = Window.partitionBy("_key"), Window.partitionBy("_key", "_m")
    bins = bins.withColumns({**{f"_g_{p}": _added(p).over(group) for p in parts}, "_first": F.row_number().over(group.orderBy("_m", "_bin")) == 1})
    ranked_rows = F.when(F.col("_bin") != NO_VALUE, F.col("_in_bin")).otherwise(0)
    running = measure.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumns({"_end": F.sum(ranked_rows).over(running), "_total": F.sum(ranked_rows).over(measure)})
    wanted = [(values.index(v), name, q) for v, names in quantiles.items() for name, q in names.items()]
    at = [(F.col("_total") - 1) * F.lit(q) for _, _, q in wanted]
    bins = bins.withColumn("_start", F.col("_end") - F.col("_in_bin")).withColumn("_ranks", F.array(*[
        F.struct(F.lit(m).alias("m"), F.floor(p).alias("lo"), F.ceil(p).alias("hi"), p.alias("pos")) for (m, _, _), p in zip(wanted, at)]))
    inside = lambda r, side: (r[side] >= F.col("_start")) & (r[side] < F.col("_end"))
    holds = F.exists("_ranks", lambda r: (r["m"] == F.col("_m")) & (inside(r, "lo") | inside(r, "hi")))
    # every group keeps one row, also without any value
    picked = bins.where(F.col("_first") | ((F.col("_bin") != NO_VALUE) & holds))
    picked = picked.select("_key", "_m", "_bin", "_start", "_ranks", *[f"_g_{p}" for p in parts])

    # a test that all pass keeps the parts in this reader too: both readers share one exchange, and the rows are read once
    same = counts.where(F.xxhash64(*parts) >= F.lit(-(1 << 63))).select("_key", "_m", "_bin", "_v", "_n")
    order = Window.partitionBy("_key", "_m", "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = picked.join(same, ["_key", "_m", "_bin"], "left").withColumn("_to", F.col("_start") + F.sum("_n").over(order)).withColumn("_from", F.col("_to") - F.col("_n"))
    found = []
    for i, (m, name, _) in enumerate(wanted):
        rank = F.col("_ranks")[i]
        value = {side: F.max(F.when((F.col("_m") == m) & (rank[side] >= F.col("_from")) & (rank[side] < F.col("_to")), F.col("_v"))) for side in ("lo", "hi")}
        part = F.max(F.when(F.col("_m") == m, rank["pos"] - rank["lo"]))
        found.append((value["lo"] + (value["hi"] - value["lo"]) * part).alias(name))
    names = [name for _, name, _ in wanted]
    out = ranked.groupBy("_key").agg(*[F.max(f"_g_{p}").alias(f"_g_{p}") for p in parts], *found)
    plain = [_read(kind, {p: F.col("_g_n" if p == "n" else f"_g_{p}{i}") for p in _PARTS[kind]}).alias(name) for i, (name, (kind, _)) in enumerate(used.items())]
    return out.select("_key.*", *plain, *names)


def order_statistic(df: DataFrame, keys: list[str], value: str, position: Column, out: str) -> DataFrame:
    """Value at a 0-based rank ``position`` (an expression over ``_total``) per group."""
    counts = value_counts(df, keys, value)
    group = Window.partitionBy("_key")
    running = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (
        counts.groupBy("_key", "_bin").agg(F.sum("_n").alias("_in_bin"))
        .withColumns({"_end": F.sum("_in_bin").over(running), "_total": F.sum("_in_bin").over(group)})
        .withColumn("_start", F.col("_end") - F.col("_in_bin"))
        .withColumn("_rank", position.cast("long"))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
        .select("_key", "_bin", "_start", "_rank")
    )
    in_bin = Window.partitionBy("_key", "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        counts.join(located, ["_key", "_bin"])
        .withColumn("_to", F.col("_start") + F.sum("_n").over(in_bin))
        .where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n")))
        .select("_key.*", F.col("_v").alias(out))
    )
