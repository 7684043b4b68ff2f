from pyspark.sql import functions as F

from spanloom.operators import security


def test_spans_are_not_dealt_by_project(spark):
    """All texts of a project would be one task's."""
    spans = spark.range(50).select(F.col("id").cast("string").alias("span_id"), F.lit("t").alias("trace_id"), F.lit("p0").alias("project_id"),
                                   F.lit("2024-01-01").cast("timestamp").alias("started_at"),
                                   F.lit('{"llm.prompt":"mail ann@example.com","llm.total_tokens":5}').alias("attributes"))
    configs = spark.createDataFrame([("p0", "no-pii", "pii", "input", "redact", None, [], True), ("p0", "long", "max_tokens", "input", "log", 9, [], True)],
                                    "project_id string, guard_name string, guard_type string, phase string, action string, limit int, words array<string>, enabled boolean")
    found = security.evaluate_guardrails(spans, configs)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.guard_name for r in found.collect()}) == ["no-pii"] and found.count() == 50
