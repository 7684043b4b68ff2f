"""Operators on small literal inputs with hand-written expectations."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanloom.operators import cost as H, drift as G, errors as E, evalmine as L, lookup, metering as M, rollup as R, versions as V
from spanloom.plans.bind import spans
from spanloom.schema import is_success, status_norm


def ts(text):
    return dt.datetime.fromisoformat(text)


# ---- drift ---------------------------------------------------------------------
AGENT = ("p", "a", "s")
CURRENT = "project_id string, agent_name string, service_name string, sample_size long, duration double, token_usage double, tool_calls double, response_length double, success_rate double, cost double"
BASE = ("project_id string, agent_name string, service_name string, baseline_id string, sample_size long, duration_mean double, duration_stddev double, token_usage_mean double, "
        "token_usage_stddev double, tool_calls_mean double, tool_calls_stddev double, success_rate double, cost_mean double")


def scored(spark, current, base=(5000.0, 800.0, 1800.0, 250.0, 3.0, 1.0, 0.95, 0.025)):
    return G.score_agents(spark.createDataFrame([(*AGENT, 10, *current)], CURRENT), spark.createDataFrame([(*AGENT, "b", 100, *base)], BASE))


def test_duration_anomaly(spark):
    found = {a["metric_name"]: a for a in scored(spark, (8500.0, 1800.0, 3.0, 0.0, 0.95, 0.025)).first()["anomalies"]}
    assert set(found) == {"duration"}
    a = found["duration"]
    assert (a["z_score"], a["severity"], a["direction"], a["unit"]) == (4.375, "critical", "increased", "ms")
    assert a["change_percent"] == pytest.approx(70.0)


@pytest.mark.parametrize("z, severity", [(1.99, None), (2.0, "medium"), (3.0, "high"), (4.0, "critical"), (-3.5, "high")])
def test_severity_ladder(spark, z, severity):
    found = scored(spark, (5000.0 + z * 800, 1800.0, 3.0, 0.0, 0.95, 0.025)).first()["anomalies"]
    assert [a["severity"] for a in found] == ([] if severity is None else [severity])


@pytest.mark.parametrize("rate, severity", [(0.86, None), (0.80, "medium"), (0.70, "high"), (0.60, "critical")])
def test_success_rate_ladder(spark, rate, severity):
    found = scored(spark, (5000.0, 1800.0, 3.0, 0.0, rate, 0.025)).first()["anomalies"]
    assert [(a["metric_name"], a["severity"], a["direction"]) for a in found] == ([] if severity is None else [("success_rate", severity, "decreased")])


def test_no_stddev_no_anomaly_and_causes(spark):
    base = (5000.0, 0.0, 1800.0, 250.0, 3.0, 1.0, 0.95, 0.0)
    drifted = scored(spark, (9999.0, 3000.0, 3.0, 0.0, 0.5, 1.0), base)
    assert {a["metric_name"] for a in drifted.first()["anomalies"]} == {"token_usage", "success_rate"}
    models = spark.createDataFrame([(*AGENT, ["m1", "m2"])], "project_id string, agent_name string, service_name string, models array<string>")
    causes = {r["cause"]: r for r in G.root_causes(drifted, models).collect()}
    assert set(causes) == {"model_change", "input_complexity_increase", "error_rate_increase"}
    assert causes["model_change"]["description"] == "Model changed: m1, m2"
    alert = G.build_alerts(G.with_causes(drifted, models), F.lit("2024-01-01").cast("timestamp")).first()
    assert (alert["severity"], alert["score"], alert["anomaly_count"]) == ("critical", 1.0, 2)


def test_recent_alerts_suppress_only_their_agent(spark):
    cols = "project_id string, agent_name string, status string, detected_at timestamp"
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    alerts = spark.createDataFrame([("p", a, "active", ts("2024-01-01T12:00:00")) for a in "xyz"], cols)
    old = spark.createDataFrame([("p", "x", "active", ts("2024-01-01T11:30:00")), ("p", "y", "active", ts("2024-01-01T10:30:00")), ("p", "z", "dismissed", ts("2024-01-01T11:59:00"))], cols)
    assert sorted(r["agent_name"] for r in G.suppress_recent(alerts, old, now).collect()) == ["y", "z"]


# ---- errors ----------------------------------------------------------------------
@pytest.mark.parametrize("message, code, kind, expected", [
    ("", 429, None, "rate_limit"), ("got 429", None, None, "rate_limit"), ("Rate Limit and api key", 401, None, "rate_limit"), ("Unauthorized", None, None, "auth_failure"),
    ("max tokens reached", None, None, "token_limit"), ("The model does not exist", None, None, "model_not_found"), ("x", 503, None, "network_error"), ("x", 400, None, "invalid_request"),
    ("malformed", None, None, "invalid_request"), ("x", 500, None, "service_error"), ("tool failed", None, "MyToolError", "tool_error"), ("tool failed", None, None, "unknown"),
    ("vector store", None, None, "retrieval_error"), (None, None, None, "unknown")])
def test_error_classes(spark, message, code, kind, expected):
    df = spark.createDataFrame([(message, code, kind)], "m string, c int, t string")
    assert df.select(E.error_class(F.col("m"), F.col("c"), F.col("t"))).first()[0] == expected


def test_code_counts_only_as_number(spark):
    rows = [("a", "error", json.dumps({"error.status_code": "429"})), ("b", "error", json.dumps({"error.status_code": 429})), ("c", "success", "{}")]
    got = {r["span_id"]: r["category"] for r in E.classify(spark.createDataFrame(rows, "span_id string, status string, attributes string")).collect()}
    assert got == {"a": "unknown", "b": "rate_limit"}


def test_token_limit_advice(spark):
    df = spark.createDataFrame([("token_limit", "m", 1000), ("token_limit", "m", None), ("rate_limit", "gpt-4o", None), ("rate_limit", "gpt-4o-mini", None)], "c string, m string, t int")
    titles = [[x["title"] for x in r[0]] for r in df.select(E.recommendations(F.col("c"), F.col("m"), F.col("t"))).collect()]
    assert titles[0][0] == "Increase max_tokens to 1500" and titles[1][0] == "Increase max_tokens to 3072"
    assert len(titles[2]) == 2 and len(titles[3]) == 1


def test_error_text_prefers_exception_event(spark):
    rows = [(json.dumps([{"name": "log", "attributes": {}}, {"name": "exception", "attributes": {"exception.message": "from event"}}]), json.dumps({"error.message": "attr"})),
            ("[]", json.dumps({"exception.message": "second", "error": "third"})), (None, "{}"), ("broken", None)]
    df = spark.createDataFrame(rows, "e string, a string")
    assert [r[0] for r in df.select(E.error_text(F.col("e"), F.col("a"))).collect()] == ["from event", "second", None, None]


def test_analysis_sections(spark):
    text = "ROOT_CAUSE: a thing\nbroke.\n\nEXPLANATION: because\nFIX_SUGGESTIONS:\n1. do x. now\n2.  \n- skip\n3. do y\nCONFIDENCE: 1.7\n"
    rows = {r["id"]: r for r in E.parse_analysis(spark.createDataFrame([(1, text), (2, "nothing"), (3, "CONFIDENCE: high")], "id int, response string")).collect()}
    assert rows[1]["root_cause"] == "a thing\nbroke." and rows[1]["explanation"] == "because" and rows[1]["fix_suggestions"] == ["do x. now", "do y"] and rows[1]["confidence"] == 1.0
    assert rows[2]["fix_suggestions"] == ["The answer proposes no fix."] and rows[2]["confidence"] == 0.5 == rows[3]["confidence"]
    why = E.parse_explanation(spark.createDataFrame([("WHY: x\nWHAT: y",), ("WHY: only",), ("",)], "response string")).collect()
    assert [(r["why_it_happened"], r["what_to_do"][:6]) for r in why] == [("x", "y"), ("only", "The an"), ("The answer gives no reason.", "The an")]


# ---- metering ----------------------------------------------------------------------
def overage(spark, **used):
    cols = ["traces", "users", "ai_hallucination_checks", "ai_drift_baselines", "ai_nlp_searches", "retention_days", "ai_debug_sessions", "ai_eval_generations"]
    df = spark.createDataFrame([("s", *[used.get(c) for c in cols])], "sub string, " + ", ".join(f"{c} long" for c in cols))
    lines = M.overage_lines(df, ["sub"])
    return {r["meter"]: r["cost"] for r in lines.collect()}, M.overage_totals(lines, ["sub"]).first()["total"]


@pytest.mark.parametrize("used, total", [({"traces": 1_500_000}, "40.00"), ({"users": 8}, "36.00"), ({"ai_hallucination_checks": 25_000}, "7.50"), ({}, "0.00"),
                                         ({"ai_drift_baselines": 110}, "2.00"), ({"retention_days": 120}, "10.00"), ({"traces": 1_000_000, "users": 5}, "0.00"),
                                         ({"traces": 1_500_000, "users": 8, "ai_hallucination_checks": 60_000, "ai_drift_baselines": 110, "ai_nlp_searches": 2_000}, "106.00")])
def test_overage(spark, used, total):
    assert overage(spark, **used)[1] == Decimal(total)


def test_half_cents_go_to_even(spark):
    costs = [overage(spark, ai_nlp_searches=1000 + n)[0]["ai_nlp"] for n in (5, 15, 25, 35)]
    assert costs == [Decimal("0.02"), Decimal("0.04"), Decimal("0.08"), Decimal("0.10")]


def test_conditions(spark):
    cases = [(1.0, "gt", 0.5, True), (0.5, "gt", 0.5, False), (0.5, "gte", 0.5, True), (None, "lt", 1.0, False), (0.1, "weird", 0.0, False)]
    df = spark.createDataFrame([c[:3] for c in cases], "v double, c string, t double")
    assert [r[0] for r in df.select(M.condition_met(F.col("v"), F.col("c"), F.col("t"))).collect()] == [c[3] for c in cases]


def test_quota_unknown_tier_is_free(spark):
    rows = [(i, 1, ts(f"2024-01-01T00:00:0{i}"), "who") for i in range(4)] + [(9, 2, ts("2024-01-01T00:00:00"), None)]
    df = spark.createDataFrame(rows, "id int, u int, at timestamp, tier string")
    got = {r["id"]: (r["allowed"], r["remaining"]) for r in M.quota_decisions(df, "u", "at", "id", "tier", {"free": 2, "pro": None}).collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (False, 0), 9: (True, 1)}


def test_health_score_is_clamped(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (1.0, 50.0, 1.0, 1.0), (0.1, 0.2, 0.0, 0.01)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(M.health_score(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [100.0, 0.0, 93.9]


# ---- cost ----------------------------------------------------------------------------
def test_recommendation_text_and_numbers(spark):
    usage = spark.createDataFrame([("p", "gpt-4", "openai", 1000, 1_000_000, 700_000, 300_000, 39.0, 1000.0, 990), ("p", "gpt-4o", "openai", 200, 200_000, 140_000, 60_000, 0.95, 900.0, 200)],
                                  "project_id string, model string, vendor string, call_count long, total_tokens long, prompt_tokens long, completion_tokens long, total_cost_usd double, "
                                  "avg_latency_ms double, success_count long")
    recs = {r["recommended_model"]: r for r in H.recommend_models(H.model_stats(usage)).filter("model = 'gpt-4'").collect()}
    assert set(recs) == {"gpt-4-turbo", "gpt-4o", "gpt-4o-mini"}
    known = recs["gpt-4o"]
    assert known["monthly_savings"] == pytest.approx(34.25) and known["performance_impact"] == "minor" and known["confidence"] == pytest.approx(0.95)
    assert known["reasoning"].startswith("gpt-4 -> gpt-4o | saves 34.25 USD a month | latency -10.0% | measured on 200 calls")
    assert recs["gpt-4-turbo"]["monthly_savings"] == pytest.approx(39.0 - 16.0)


def test_exact_cluster_of_five(spark):
    rows = [(i, "same", 100, 0.01, ts(f"2024-01-01T0{i}:00:00")) for i in range(5)] + [(9, "other", 1, 0.1, ts("2024-01-01T00:00:00"))]
    c = H.exact_clusters(spark.createDataFrame(rows, "prompt_id int, text string, tokens int, cost double, asked_at timestamp")).collect()
    assert len(c) == 1 and c[0]["member_count"] == 5 and c[0]["frequency_per_day"] == 5.0 and c[0]["potential_cache_savings"] == pytest.approx(0.04)


# ---- rollups, versions, lookup ----------------------------------------------------------------
def test_status_words(spark):
    df = spark.createDataFrame([("completed",), ("ERROR",), (None,), ("odd",)], "s string")
    assert [tuple(r) for r in df.select(status_norm(F.col("s")), is_success(F.col("s"))).collect()] == [("success", True), ("error", False), ("unknown", False), ("unknown", False)]


def test_merged_rollup_equals_direct(spark, small):
    rows = spans(spark, small)
    merged = R.read_span_state(R.merge_span_state(R.span_state(rows.where("span_id % 3 = 0")), R.span_state(rows.where("span_id % 3 <> 0"))))
    direct = R.span_daily(rows).select("project_id", "service_name", "span_type", "date", F.col("p95_duration_ms").alias("p95"), F.col("span_count").alias("n"),
                                       F.col("avg_duration_ms").alias("mean"))
    both = merged.join(direct, ["project_id", "service_name", "span_type", "date"]).collect()
    assert len(both) == direct.count()
    for r in both:
        assert r["span_count"] == r["n"] and r["avg_duration_ms"] == pytest.approx(r["mean"])
        assert r["duration_min"] <= r["p95_duration_ms"] <= r["duration_max"]


def test_missing_json_keys_count_as_zero(spark):
    rows = spark.createDataFrame([("p", "llm", "success", ts("2024-01-01T00:00:00"), a) for a in ("{}", None, "broken", '{"llm.total_tokens": 8, "llm.model": "m"}')],
                                 "project_id string, span_type string, status string, started_at timestamp, attributes string")
    got = {r["model"]: (r["call_count"], r["total_tokens"]) for r in R.llm_usage_daily(rows).collect()}
    assert got == {"": (3, 0), "m": (1, 8)}


def test_tombstone_hides_key(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 2, False)], "k string, v int, gone boolean")
    assert [r["k"] for r in V.current(df, ["k"], ["v"], "gone").collect()] == ["b"]


def test_latest_prompt_ignores_older_tag(spark):
    df = spark.createDataFrame([("p", "x", 1, ["t"]), ("p", "x", 2, ["u"]), ("p", "y", 1, ["t"])], "project_id string, name string, version int, tags array<string>")
    assert [r["name"] for r in V.latest_prompts(df, tag="t").collect()] == ["y"]


def test_slug(spark):
    df = spark.createDataFrame([("  My Project! 2 ",), ("---",), ("x" * 60,)], "n string")
    assert [r[0] for r in df.select(lookup.project_slug(F.col("n"))).collect()] == ["my-project-2", "", "x" * 60]
    assert [r[0] for r in df.select(lookup.project_slug(F.col("n"), 50)).collect()] == ["my-project-2", "", "x" * 50]


# ---- evaluation cases ----------------------------------------------------------------------------
def test_generated_cases(spark):
    text = 'Sure:\n```json\n[{"name":"n","input":{"query":"q"},"assertions":[{"type":"contains","value":"x"},{"type":"nope"}]},{"input":{"query":"r"}},{"expected":{"output":"o"}}]\n```'
    got = L.parse_generated(spark.createDataFrame([("sub", text), ("sub", "no array"), ("sub", "[broken")], "subcategory string, response string")).collect()
    assert [r["case_name"] for r in got] == ["n", "sub_case_2", "sub_case_3"]
    assert [len(r["assertions"]) for r in got] == [1, 1, 0] and "min_length" in got[1]["assertions"][0]


def test_suite_document_is_json(spark):
    cases = spark.createDataFrame([("p", "positive_example/fast", "c1", "n1", 'say "hi"', None, "expected", ['{"type":"length","min_length":1}'], "a|b", "t1")],
                                  "project_id string, pattern string, case_id string, case_name string, query string, messages string, expected_contains string, assertions array<string>, "
                                  "tags string, source_trace_id string")
    doc = json.loads(L.suite_rows(cases).first()["case"])
    assert doc["input"] == {"query": 'say "hi"'} and doc["expected"] == {"contains": ["expected"]} and doc["tags"] == ["a", "b"] and doc["assertions"][0]["min_length"] == 1


# ---- quotas over a change of tier --------------------------------------------------
def test_quota_counts_accepted_rows_only(spark):
    at = [ts(f"2024-01-01 00:{i:02d}:00") for i in range(8)]
    tiers = ["free"] * 4 + ["pro"] * 3 + ["free"]
    df = spark.createDataFrame([(i, 1, at[i], t) for i, t in enumerate(tiers)], "id long, u long, at timestamp, tier string")
    got = {r["id"]: (r["arrival"], r["allowed"], r["usage"]) for r in M.quota_decisions(df, "u", "at", "id", "tier", {"free": 2, "pro": 4}).collect()}
    assert got == {0: (1, True, 1), 1: (2, True, 2), 2: (3, False, 2), 3: (4, False, 2), 4: (5, True, 3), 5: (6, True, 4), 6: (7, False, 4), 7: (8, False, 4)}


def test_refused_feature_calls_are_no_usage(spark):
    tiers = ["free"] * 3 + ["pro", "pro", "other", None]
    df = spark.createDataFrame([(i, 1, "drift", ts(f"2024-01-01 00:{i:02d}:00"), t) for i, t in enumerate(tiers)],
                               "call_id long, user_id long, feature string, used_at timestamp, tier string")
    got = {r["call_id"]: r["decision"] for r in M.feature_decisions(df, "call_id", {"drift": 1}, {"drift": 2}).collect()}
    assert got == {0: "refused", 1: "refused", 2: "refused", 3: "allowed", 4: "allowed", 5: "overage", 6: "overage"}


# ---- evaluation cases from whole texts ------------------------------------------------
def test_trace_io_keeps_whole_texts_and_projects_apart(spark):
    long = "word " * 2000 + "end."
    chat = '[\n {"role": "user", "content": "hi"}]'
    prompts = [("p", "t", long), ("q", "t", chat), ("p", "u", "[1, 2]"), ("p", "v", "[{broken"), (None, "t", "none")]
    traces = spark.createDataFrame([(p, t, "svc", "success", ts("2024-01-01")) for p, t, _ in prompts],
                                   "project_id string, trace_id string, service_name string, status string, started_at timestamp")
    spans = spark.createDataFrame([(p, t, "s", "llm", "x", ts("2024-01-01"), "success", json.dumps({"llm.prompt": m, "llm.response": long}), "[]") for p, t, m in prompts],
                                  "project_id string, trace_id string, span_id string, span_type string, name string, started_at timestamp, status string, attributes string, events string")
    got = {(r["project_id"], r["trace_id"]): (r["query"], r["messages"], r["response"]) for r in L.trace_io(traces, spans).collect()}
    assert got == {("p", "t"): (long, None, long), ("q", "t"): (None, chat, long), ("p", "u"): ("[1, 2]", None, long),
                   ("p", "v"): ("[{broken", None, long), (None, "t"): ("none", None, long)}


def test_all_traces_of_a_pattern_give_cases(spark):
    rows = [("p", "edge_case/slow_response", f"t{i:03d}", ts("2024-01-01") + dt.timedelta(hours=i) if i else None, f"q{i}", None, "") for i in range(120)]
    df = spark.createDataFrame(rows, "project_id string, pattern string, trace_id string, started_at timestamp, query string, messages string, response string")
    cases = L.fallback_cases(df)
    assert cases.count() == L.suite_rows(cases).count() == 120
    numbers = {r["trace_id"]: r["n"] for r in L.pattern_traces(df).collect()}
    assert numbers == {f"t{i:03d}": 120 - i for i in range(120)}
    assert L.fallback_cases(df, per_pattern=3).count() == 3
