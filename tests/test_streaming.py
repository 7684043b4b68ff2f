"""Streaming jobs over the events split by day, compared with their batch twins."""

import pytest
from pyspark.sql import functions as F

from spanloom.plans import bind as B
from spanloom.sources.otlp import synthesize_traces
from spanloom.streaming import jobs as Q, upkeep as U


@pytest.fixture(scope="module")
def days(spark, small, tmp_path_factory):
    """Events as one file per day; day 10 is there twice."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    ev = spark.read.parquet(f"{small}/events.parquet").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    ev.repartition(1).sortWithinPartitions("ts").write.partitionBy("day").parquet(path)
    ev.where("day = '20240110'").drop("day").coalesce(1).write.parquet(f"{path}/day=20240110b")
    return path, ev.drop("day").schema


def span_stream(spark, days, files=5):
    path, schema = days
    ev = B.typed(Q.file_stream(spark, f"{path}/*", schema, files_per_batch=files))
    return B.spans_from(B._with_trace_id(ev).withColumn("parent_span_id", F.lit("")))


def batch_spans(spark, days):
    path, schema = days
    return B.spans_from(B._with_trace_id(B.typed(spark.read.schema(schema).parquet(f"{path}/*"))).withColumn("parent_span_id", F.lit("")))


def test_duplicates_are_dropped(spark, small, days):
    folder = Q.new_folder(spark, "t-dedupe")
    out = Q.dedupe(span_stream(spark, days).select("span_id", "started_at"), "40 days")
    Q.run(out, folder)
    got = Q.read_output(spark, folder, out.schema)
    total = spark.read.parquet(f"{small}/events.parquet").count()
    assert got.count() == got.select("span_id").distinct().count() == total < batch_spans(spark, days).count()


def test_closed_and_merged_traces(spark, days):
    folder = Q.new_folder(spark, "t-closed")
    stream = Q.closed_traces(span_stream(spark, days, files=100), gap="3 hours", delay="1 minute")
    Q.run(stream, folder)
    parts = Q.read_output(spark, folder, stream.schema)
    merged = {r["trace_id"]: r for r in Q.merge_parts(parts).collect()}
    last = batch_spans(spark, days).agg(F.max("started_at")).first()[0]
    cut = F.lit(last) - F.expr("INTERVAL 1 DAY")
    twin = synthesize_traces(batch_spans(spark, days)).where(F.col("completed_at") < cut).collect()
    assert len(twin) > 100
    for t in twin:
        m = merged[t["trace_id"]]
        assert (m["started_at"], m["completed_at"], m["span_count"], m["failed"]) == (
            t["started_at"], t["completed_at"], t["span_count"], t["status"] == "error")


def test_live_traces_read_newest_version(spark, days):
    folder = Q.new_folder(spark, "t-live")
    stream = Q.live_traces(span_stream(spark, days, files=7), delay="40 days")
    Q.run(stream, folder, "update")
    got = {r["trace_id"]: r["span_count"] for r in Q.merge_parts(Q.newest_output(spark, folder, stream.schema, ["project_id", "trace_id", "window_start"])).collect()}
    want = {r["trace_id"]: r["n"] for r in batch_spans(spark, days).groupBy("trace_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_resume_processes_only_new_files(spark, small, tmp_path):
    ev = spark.read.parquet(f"{small}/events.parquet")
    path, folder = str(tmp_path / "in"), Q.new_folder(spark, "t-resume")
    ev.where("event_id % 2 = 0").coalesce(1).write.parquet(path)
    stream = Q.file_stream(spark, path, ev.schema).select("event_id")
    Q.run(stream, folder)
    first = Q.read_output(spark, folder, stream.schema).count()
    ev.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(path)
    Q.run(Q.file_stream(spark, path, ev.schema).select("event_id"), folder)
    out = Q.read_output(spark, folder, stream.schema)
    assert first == ev.where("event_id % 2 = 0").count()
    assert out.count() == out.distinct().count() == ev.count()


def test_replayed_batch_replaces_its_output(spark, tmp_path):
    write = Q.batch_writer(str(tmp_path))
    write(spark.range(5), 3)
    write(spark.range(5), 3)
    assert spark.read.parquet(str(tmp_path)).count() == 5


def test_unmatched_starts_stay_running(spark, tmp_path):
    s, e = str(tmp_path / "s"), str(tmp_path / "e")
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:10:00"), ("z", "2024-01-05 00:00:00")]
    starts = spark.createDataFrame(rows, "execution_id string, t string").select("execution_id", F.col("t").cast("timestamp").alias("started_at"))
    ends = spark.createDataFrame([("a", "2024-01-01 01:00:00", "success"), ("z", "2024-01-05 00:30:00", "error")], "execution_id string, t string, outcome string").select(
        "execution_id", F.col("t").cast("timestamp").alias("ended_at"), "outcome")
    starts.coalesce(1).write.parquet(s)
    ends.coalesce(1).write.parquet(e)
    stream = Q.pair_runs(Q.file_stream(spark, s, starts.schema), Q.file_stream(spark, e, ends.schema))
    folder = Q.new_folder(spark, "t-pairs")
    Q.run(stream, folder)
    got = {r["execution_id"]: r["outcome"] for r in Q.read_output(spark, folder, stream.schema).collect()}
    assert got == {"a": "success", "b": "running", "z": "error"}


def test_quota_skips_rejected_rows(spark, tmp_path):
    cols = "row_id long, user_id long, period string, arrived_at timestamp, cost long, quota long"
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 0, 0, i) for i in range(5)]
    df = spark.createDataFrame([(0, 1, "2024-01", at[0], 3, 5), (1, 1, "2024-01", at[1], 4, 5), (2, 1, "2024-01", at[2], 2, 5), (3, 1, "2024-01", at[3], 1, 5), (4, 2, "2024-01", at[4], 9, None)], cols)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    folder = Q.new_folder(spark, "t-quota")
    job = U.QuotaUpkeep(spark, folder, unit=False)
    Q.run(Q.file_stream(spark, str(tmp_path / "in"), df.schema), folder, writer=job)
    got = {r["row_id"]: (r["allowed"], r["usage"]) for r in job.decisions().collect()}
    assert got == {0: (True, 3), 1: (False, 3), 2: (True, 5), 3: (False, 5), 4: (True, 9)}


def test_cooldown(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", t0 + dt.timedelta(minutes=5 * i), "gt", 0.5, 30, 1.0 if i != 1 else 0.1) for i in range(13)]
    df = spark.createDataFrame(rows, "rule_id string, evaluated_at timestamp, condition string, threshold double, cooldown_minutes int, value double")
    minutes = sorted((r["evaluated_at"] - t0).seconds // 60 for r in Q.with_cooldown(df).collect())
    assert minutes == [0, 30, 60]
    earlier = spark.createDataFrame([("r", t0 - dt.timedelta(minutes=20))], "rule_id string, last_fired timestamp")
    assert sorted((r["evaluated_at"] - t0).seconds // 60 for r in Q.with_cooldown(df, earlier).collect()) == [10, 40]
