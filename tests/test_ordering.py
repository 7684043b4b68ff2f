"""Skew-safe helpers against brute force, with one key holding a third of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions.ordering import HOUR_US, first_per_key, latest_per_key, position, previous, running, time_bucket, top_per_key
from spanloom.functions.quantiles import agg_with_quantiles, exact_quantiles, order_statistic, value_bin


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, "c"])
        ts = pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rnd.randrange(0, 3000))
        out.append((key, i, ts, round(rnd.choice([rnd.uniform(-5, 5), rnd.uniform(0, 1e6), 0.0, 3.25]), 2)))
    return pd.DataFrame(out, columns=["key", "id", "ts", "v"])


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, ts timestamp, v double").cache()


def groups(rows):
    for key, part in rows.assign(key=rows["key"].fillna("<null>")).groupby("key"):
        yield (None if key == "<null>" else key), part


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 0.99, 1.0])
def test_exact_quantiles(df, rows, q):
    got = {r["key"]: r["x"] for r in exact_quantiles(df, ["key"], "v", {"x": q}).collect()}
    for key, part in groups(rows):
        assert got[key] == pytest.approx(part["v"].quantile(q), abs=1e-9)


def test_quantiles_with_aggregates_and_null_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "key string, v double")
    got = {r["key"]: (r["n"], r["p"]) for r in agg_with_quantiles(df, ["key"], {"n": ("count", None)}, {"v": {"p": 0.5}}).collect()}
    assert got == {"a": (2, 1.0), "b": (1, None)}


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", float("-inf")), ("a", 1.0), ("a", float("nan")), ("b", -0.0)], "key string, v double")
    got = {r["key"]: (r["lo"], r["mid"], r["hi"]) for r in exact_quantiles(df, ["key"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert got["a"][1] == 1.0 and got["b"][1] == 0.0


def test_order_statistic(df, rows):
    got = {r["key"]: r["p"] for r in order_statistic(df, ["key"], "v", F.floor(F.col("_total") * F.lit(0.95)), "p").collect()}
    for key, part in groups(rows):
        assert got[key] == sorted(part["v"])[int(len(part) * 0.95)]


def test_position_and_running_sum(df, rows):
    order = [F.col("ts"), F.col("id")]
    bucket = time_bucket(F.col("ts"), HOUR_US)
    pos = {r["id"]: r["n"] for r in position(df, ["key"], bucket, order, "n").collect()}
    sums = {r["id"]: r["s"] for r in running(df, ["key"], bucket, order, {"s": F.col("v")}).collect()}
    for _, part in groups(rows):
        part = part.sort_values(["ts", "id"])
        for n, (i, total) in enumerate(zip(part["id"], part["v"].cumsum()), 1):
            assert pos[i] == n
            assert sums[i] == pytest.approx(total, abs=1e-6)


def test_previous_is_lag(df, rows):
    got = {r["id"]: r["p"] for r in previous(df, ["key"], time_bucket(F.col("ts"), HOUR_US), ["ts", "id"], {"p": "id"}).collect()}
    for _, part in groups(rows):
        ids = list(part.sort_values(["ts", "id"])["id"])
        assert [got[i] for i in ids] == [None, *ids[:-1]]


def test_latest_first_and_top(df, rows):
    latest = {r["key"]: r["id"] for r in latest_per_key(df, ["key"], ["ts", "id"]).collect()}
    first = {r["key"]: r["id"] for r in first_per_key(df, ["key"], ["ts", "id"]).collect()}
    top = top_per_key(df, ["key"], [F.desc("ts"), F.desc("id")], 3).collect()
    for key, part in groups(rows):
        ids = list(part.sort_values(["ts", "id"])["id"])
        assert (first[key], latest[key]) == (ids[0], ids[-1])
        assert {r["id"] for r in top if r["key"] == key} == set(ids[-3:])


def test_top_k_is_pruned_before_the_shuffle(df):
    plan = top_per_key(df, ["key"], [F.desc("ts")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_empty_input(df):
    assert exact_quantiles(df.where("false"), ["key"], "v", {"x": 0.5}).collect() == []
    assert position(df.where("false"), ["key"], time_bucket(F.col("ts")), [F.col("ts")], "n").collect() == []


def test_small_values_have_many_bins(spark):
    df = spark.range(1, 1001).select((F.col("id") / 1e6).alias("v"), (F.col("id") / -1e9).alias("w"), F.lit(5e-324).alias("least"))
    for c in ("v", "w"):
        bins = [r[0] for r in df.orderBy(c).select(value_bin(F.col(c))).collect()]
        # about 64 values lie a bin apart, the rest span ln(1000 / 64) * 64 = 176 bins
        assert bins == sorted(bins) and len(set(bins)) > 230
    assert df.select(value_bin(F.col("least")) > 0, value_bin(-F.col("least")) < 0, value_bin(F.lit(0.0)) == 0).first() == (True, True, True)


# ---- aggregates and quantiles from one read ------------------------------------------------
def test_one_pass_equals_separate_aggregates(spark):
    import math
    import random

    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 0.0, -1.5, 2.0, rng.uniform(-1e6, 1e6)]), rng.choice([None, rng.randrange(50)]), rng.random() < 0.3)
            for _ in range(600)] + [("only nulls", None, None, True)] * 3 + [("one", 7.25, 7, False)]
    df = spark.createDataFrame(rows, "key string, v double, w long, bad boolean").repartition(5)
    got = {r["key"]: r for r in agg_with_quantiles(
        df, ["key"], {"n": ("count", None), "nv": ("count_of", "w"), "bad": ("count_if", F.col("bad")), "s": ("sum", "w"), "m": ("avg", "w"), "lo": ("min", "w"),
                      "hi": ("max", "w"), "sd": ("stddev", "w"), "share": ("rate", F.col("bad"))},
        {"v": {"v0": 0.0, "v50": 0.5, "v95": 0.95}, "w": {"w25": 0.25, "w100": 1.0}}).collect()}
    assert set(got) == {"a", "b", None, "only nulls", "one"}

    def quantile(values, q):
        values = sorted(values)
        at = (len(values) - 1) * q
        lo, hi = values[math.floor(at)], values[math.ceil(at)]
        return lo + (hi - lo) * (at - math.floor(at))

    for key, r in got.items():
        mine = [x for x in rows if x[0] == key]
        w = [x[2] for x in mine if x[2] is not None]
        v = [x[1] for x in mine if x[1] is not None and not math.isnan(x[1])]
        assert (r["n"], r["nv"], r["bad"]) == (len(mine), len(w), sum(x[3] for x in mine))
        assert r["share"] == pytest.approx(r["bad"] / r["n"])
        if not w:
            assert (r["s"], r["m"], r["lo"], r["hi"], r["sd"], r["v50"], r["w25"]) == (None,) * 7
            continue
        mean = sum(w) / len(w)
        assert (r["s"], r["lo"], r["hi"]) == (sum(w), min(w), max(w)) and r["m"] == pytest.approx(mean)
        assert r["sd"] == pytest.approx((sum((x - mean) ** 2 for x in w) / len(w)) ** 0.5, abs=1e-9)
        assert [r["v0"], r["v50"], r["v95"]] == pytest.approx([quantile(v, q) for q in (0, 0.5, 0.95)])
        assert [r["w25"], r["w100"]] == pytest.approx([quantile(w, q) for q in (0.25, 1)])


@pytest.mark.parametrize("name", ["e2_ai_node_daily", "e3_node_daily", "e4_span_daily", "g1_agent_baselines"])
def test_rollups_read_the_facts_once(spark, small, name):
    """In the plan that ran, the facts are scanned once; the other reader takes the same exchange."""
    from spanloom import plans

    df = plans.all_queries()[name](spark, small)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    ran = plan.split("Initial Plan")[0]
    assert ran.count("FileScan parquet") == 1 and "Reused" in ran
