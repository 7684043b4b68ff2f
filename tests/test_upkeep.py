"""Jobs that carry tables over micro-batches: late rows, replays, compaction, hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import metering as M
from spanloom.streaming import carried, upkeep as U
from spanloom.streaming.carried import Carried

T0 = dt.datetime(2024, 1, 1)
SPAN = ("span_id string, trace_id string, project_id string, service_name string, name string, span_type string, status string, "
        "started_at timestamp, ended_at timestamp, duration_ms double, attributes string")


def spans(spark, rows):
    """(id, trace, minute, status) to spans of one second."""
    data = [(str(i), t, "p", "s", "n", "llm", status, T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m, seconds=1), 1000.0, '{"agent.name":"a"}')
            for i, t, m, status in rows]
    return spark.createDataFrame(data, SPAN)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- carried tables ------------------------------------------------------------------
@pytest.mark.parametrize("every", [2, 3, 100])
def test_carried_tables_replay_and_compact(spark, tmp_path, every):
    table = Carried(spark, str(tmp_path / "t"), "k long, v long", ["k"], every=every)
    want = {}
    rng = random.Random(every)
    for b in range(9):
        change = {rng.randrange(6): rng.randrange(100) for _ in range(3)}
        gone = rng.choice(list(want)) if want and b % 3 == 2 else None
        before = rows_of(table.before(b))
        assert before == sorted(want.items(), key=str)
        if gone is not None:
            change.pop(gone, None)
        rows = [(k, v, False) for k, v in change.items()] + ([(gone, 0, True)] if gone is not None else [])
        df = spark.createDataFrame(rows, "k long, v long, _gone boolean")
        table.put(b, df)
        assert rows_of(table.before(b)) == before  # a replay sees what the first run saw
        table.put(b, df)
        want.update(change)
        want.pop(gone, None)
    assert rows_of(table.current()) == sorted(want.items(), key=str)
    if every == 2:  # old parts are deleted
        assert len(carried.parts(spark, f"{table.path}/changes")) <= 4 and len(carried.parts(spark, f"{table.path}/base", "upto")) <= 2


# ---- rollups --------------------------------------------------------------------------
def test_late_rows_are_set_aside_and_counted(spark, tmp_path):
    job = U.RollupUpkeep(spark, str(tmp_path), ["span_daily"], delay="1 hour", every=2)
    first = spans(spark, [(i, "t", i * 60, "success") for i in range(60)])  # two and a half days
    late = spans(spark, [(100, "t", 5, "error"), (101, "t", 50 * 60, "error")])  # one of a day that is over, one of an open day
    for b, batch in enumerate((first, late, late.limit(0))):
        job(batch, b)
        job(batch, b)  # a replayed batch changes nothing
    got = {str(r.date): r for r in job.read("span_daily", first).collect()}
    assert {d: (r.span_count, r.error_count, r.late_rows) for d, r in got.items()} == {
        "2024-01-01": (25, 1, 1), "2024-01-02": (24, 0, 0), "2024-01-03": (13, 1, 0)}
    assert got["2024-01-01"].avg_duration_ms == 1000.0 and got["2024-01-01"].p95_duration_ms == 1000.0
    assert [r.span_id for r in job.late().collect()] == ["100"]


def test_rollup_of_nothing(spark, tmp_path):
    job = U.RollupUpkeep(spark, str(tmp_path), list(U.DAILY)[1:])
    none = spans(spark, [(1, "t", 0, "success")]).limit(0)
    assert job.late() is None
    job(none, 0)
    assert all(job.read(n, none).count() == 0 for n in job.rollups)


# ---- traces by silence ---------------------------------------------------------------------
def assemble(spark, path, batches):
    job = U.TraceAssembly(spark, str(path), gap="30 minutes", delay="10 minutes")
    for b, rows in enumerate(batches):
        df = spans(spark, rows)
        job(df, b)
        job(df, b)
    return job, {r.trace_id: r for r in job.traces().collect()}


def test_silence_closes_and_late_spans_reopen(spark, tmp_path):
    night = 23 * 60 + 50
    batches = [
        [(1, "a", 0, "success"), (2, "a", 20, "error"), (3, "b", 5, "success")],
        [(4, "c", 200, "success")],  # a and b have been silent for long: closed
        [(5, "a", 10, "success"), (6, "m", night, "success"), (7, "m", night + 25, "success")],  # late span of a; m goes over midnight
        [(8, "z", night + 500, "success")],
    ]
    job, got = assemble(spark, tmp_path, batches)
    assert (got["a"].span_count, got["a"].parts, got["a"].closed, got["a"].failed, got["a"].first_span_id) == (3, 2, True, True, "1")
    assert (got["m"].span_count, got["m"].parts, got["m"].closed) == (2, 1, True)
    assert got["m"].completed_at == T0 + dt.timedelta(minutes=night + 25, seconds=1)
    assert not got["z"].closed
    when = {(r.trace_id, r.span_count): r.batch_id for r in job.closed().collect()}
    assert when["a", 2] == 1 and when["a", 1] == 2  # the late span closes at once, as a part of its own


def test_sessions_join_over_batches_and_slots(spark, tmp_path):
    """Any split into batches gives the sessions of all spans at once, as long as none is late."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(2000), i, f"t{rng.randrange(3)}") for i in range(150))
    spans_ = [(i, t, m, "success") for m, i, t in rows]
    cuts = [0, 30, 75, 76, 150]
    job, got = assemble(spark, tmp_path, [spans_[a:b] for a, b in zip(cuts, cuts[1:])] + [[(999, "end", 9000, "success")]])
    sessions = 0
    for t in {r[1] for r in spans_}:
        at = sorted(m for _, x, m, _ in spans_ if x == t)
        n = 1 + sum(b - a > 30 for a, b in zip(at, at[1:]))
        sessions += n
        assert (got[t].span_count, got[t].parts, got[t].closed) == (len(at), n, True)
    assert job.closed().count() == sessions


# ---- quotas ----------------------------------------------------------------------------------
ARRIVALS = "row_id long, user_id long, period string, arrived_at timestamp, cost long, quota long"


def judged(rows, unit):
    usage, out = {}, {}
    for i, u, p, at, cost, quota in sorted(rows, key=lambda r: (r[3], r[0])):
        had, price = usage.get((u, p), 0), 1 if unit else cost
        ok = quota is None or had + price <= quota
        usage[u, p] = had + (price if ok else 0)
        out[i] = (ok, usage[u, p])
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_quota_over_batches_with_a_hot_user(spark, tmp_path, unit):
    rng = random.Random(7)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(40), "2024-01", T0 + dt.timedelta(seconds=i // 2), 1 if unit else rng.randrange(1, 6),
             rng.choice([5, 50, 200, None]) if i % 7 == 0 else 120) for i in range(3000)]
    job = U.QuotaUpkeep(spark, str(tmp_path), unit, every=2)
    for b in range(3):
        part = spark.createDataFrame(rows[b * 1000:(b + 1) * 1000], ARRIVALS).repartition(4)
        job(part, b)
        job(part, b)
    got = {r.row_id: (r.allowed, r.usage) for r in job.decisions().collect()}
    assert got == judged(rows, unit)


def test_old_periods_are_forgotten(spark, tmp_path):
    job = U.QuotaUpkeep(spark, str(tmp_path), keep_periods=1)
    for b, month in enumerate(("2024-01", "2024-02", "2024-05")):
        job(spark.createDataFrame([(b, 1, month, T0, 1, 5)], ARRIVALS), b)
    assert [tuple(r) for r in job.used.current().collect()] == [(1, "2024-05", 1)]


def test_a_limit_that_changes_at_every_row(spark):
    """A hundred thousand runs of one key are a stream, not an array."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("u"), F.col("id"), F.timestamp_seconds(F.col("id") / 50).alias("at"), (F.col("id") % 2 * 20_000 + 10_000).alias("most"))
    out = M.admissions(df, ["u"], "at", "id", F.col("most")).agg(
        F.max("usage").alias("most"), F.count_if("allowed").alias("ok"), F.max("arrival").alias("n"), F.sum("usage").alias("all")).first()
    usage = total = ok = 0
    for i in range(n):
        fits = usage + 1 <= (i % 2) * 20_000 + 10_000
        usage, ok = usage + fits, ok + fits
        total += usage
    assert tuple(out) == (usage, ok, n, total)


# ---- alerts and drift --------------------------------------------------------------------------
RULE = ("rule_id string, project_id string, agent_name string, metric_type string, window_minutes int, condition string, threshold double, "
        "cooldown_minutes int, enabled boolean")


def alerts(spark, path, rule, batches):
    job = U.AlertUpkeep(spark, str(path), spark.createDataFrame([("r", "p", None, *rule, True)], RULE), every=2)
    for b, rows in enumerate(batches):
        df = spans(spark, rows)
        job(df, b)
        job(df, b)
    return sorted(int((r.evaluated_at - T0).total_seconds() // 60) for r in job.alerts().collect())


def test_less_than_does_not_fire_on_half_a_window(spark, tmp_path):
    """Every full window of ten minutes is half good, whatever part of it a batch brings."""
    rows = [(i, "t", i, "error" if i % 10 < 5 else "success") for i in range(40)]
    fired = alerts(spark, tmp_path, ("success_rate", 10, "lt", 0.4, 0), [rows[i:i + 7] for i in range(0, 40, 7)])
    assert fired == [5]  # the first instant, before which there was nothing but errors


def test_cooldown_is_carried_over_batches(spark, tmp_path):
    rows = [(i, "t", i, "error") for i in range(0, 121)]
    whole = alerts(spark, tmp_path / "a", ("error_rate", 5, "gte", 1.0, 30), [rows])
    parts = alerts(spark, tmp_path / "b", ("error_rate", 5, "gte", 1.0, 30), [rows[i:i + 13] for i in range(0, 121, 13)])
    assert whole == parts == [5, 35, 65, 95]


def test_windows_must_fit_the_step(spark, tmp_path):
    with pytest.raises(ValueError):
        alerts(spark, tmp_path, ("error_rate", 7, "gt", 0.5, 30), [])


def agent_spans(spark, first, last, duration):
    """One agent span every ten minutes."""
    rows = spark.range(first, last).select(
        F.col("id").cast("string").alias("span_id"), F.lit("t").alias("trace_id"), F.lit("p").alias("project_id"), F.lit("s").alias("service_name"),
        F.lit("n").alias("name"), F.lit("agent").alias("span_type"), F.lit("success").alias("status"),
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 10).cast("int"))).alias("started_at"),
        (duration + F.col("id") % 5).cast("double").alias("duration_ms"), F.lit('{"agent.name":"a"}').alias("attributes"))
    return rows.withColumn("ended_at", F.col("started_at"))


def test_drift_is_found_and_baselines_are_appended_once(spark, tmp_path):
    job = U.DriftUpkeep(spark, str(tmp_path), hours=2, every=2)
    calm, slow = agent_spans(spark, 0, 1000, F.lit(100)), agent_spans(spark, 1000, 1020, F.lit(900))
    job(calm, 0)
    assert job.alerts().count() == 0 and job.baselines().count() == 1
    job(calm.limit(0), 1)  # no news: the hour has its snapshot
    assert job.baselines().count() == 1
    job(slow, 2)
    job(slow, 2)
    found = job.alerts().collect()
    assert found and all("duration" in r.metrics for r in found)
    times = sorted(r.evaluated_at for r in found)
    assert all(b - a >= dt.timedelta(hours=1) for a, b in zip(times, times[1:]))
    snaps = sorted(job.baselines().collect(), key=lambda r: r.window_end)
    assert len(snaps) == 2 and snaps[0].sample_size == 1008 - 8 - (1000 - int((snaps[0].window_end - T0).total_seconds() // 600))
    assert snaps[0].duration_p50 == 102.0 and abs(snaps[0].duration_stddev - 2 ** 0.5) < 0.01
