"""Registered queries: cost optimisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, distance
from ..operators.similarity import similar
from ..operators import cost as H, rollup as R
from ..sources.readers import table
from . import bind as B
from .bind import SPANS, as_of, spans, ts_sql, with_
from .registry import Registry
from .rollups import E5

reg = Registry()

H1 = """
h1 AS (SELECT project_id, model, vendor, CAST(sum(call_count) AS BIGINT) AS call_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  sum(total_cost_usd) AS total_cost_usd, avg(avg_latency_ms) AS avg_latency_ms, CAST(sum(success_count) AS BIGINT) AS success_count
  FROM e5 GROUP BY project_id, model, vendor HAVING sum(call_count) > 0)"""
H2 = """
h2 AS (SELECT *, prompt_tokens / call_count AS avg_prompt_tokens, completion_tokens / call_count AS avg_completion_tokens,
  success_count / call_count * 100 AS success_rate, total_cost_usd / call_count AS cost_per_call
  FROM h1 QUALIFY row_number() OVER (PARTITION BY project_id, model ORDER BY total_cost_usd DESC, vendor) = 1)"""
PRICES = "prices(model, input, output) AS (VALUES " + ", ".join(
    f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in H.PRICES.items()) + ")"
PATHS = "paths(model, alt) AS (VALUES " + ", ".join(
    f"('{m}', '{a}')" for m, alts in H.DOWNGRADES.items() for a in alts) + ")"
H4 = """
h4 AS (SELECT c.*, p.alt AS recommended_model, a.call_count AS alt_calls, a.cost_per_call AS alt_cost_per_call, a.avg_latency_ms AS alt_latency_ms,
    a.success_rate AS alt_success_rate,
    greatest(0, (c.cost_per_call - coalesce(a.cost_per_call, c.avg_prompt_tokens / 1000000 * r.input + c.avg_completion_tokens / 1000000 * r.output))
      * (c.call_count / 30.0::DOUBLE) * 30) AS monthly_savings,
    greatest(0, (c.cost_per_call - coalesce(a.cost_per_call, c.avg_prompt_tokens / 1000000 * r.input + c.avg_completion_tokens / 1000000 * r.output))
      * (c.call_count / 30.0::DOUBLE) * 365) AS annual_savings
  FROM h2 c JOIN paths p USING (model) JOIN prices r ON r.model = p.alt LEFT JOIN h2 a ON a.project_id = c.project_id AND a.model = p.alt)"""
H5 = """
h5 AS (SELECT *, CASE WHEN coalesce(alt_latency_ms, 0) = 0 THEN 'minor' WHEN abs(latency_change_pct) < 5 THEN 'negligible'
    WHEN abs(latency_change_pct) < 15 THEN 'minor' WHEN abs(latency_change_pct) < 30 THEN 'moderate' ELSE 'significant' END AS performance_impact
  FROM (SELECT *, CASE WHEN coalesce(alt_latency_ms, 0) <> 0 AND avg_latency_ms > 0
      THEN (alt_latency_ms - avg_latency_ms) / avg_latency_ms * 100 ELSE 0 END AS latency_change_pct FROM h4))"""
H6 = """
h6 AS (SELECT *, least(1.0, 0.5 + CASE WHEN call_count >= 1000 THEN 0.25 WHEN call_count >= 500 THEN 0.2 WHEN call_count >= 200 THEN 0.15 ELSE 0.1 END
    + CASE WHEN alt_calls >= 100 THEN 0.15 WHEN alt_calls >= 10 THEN 0.1 ELSE 0 END
    + CASE WHEN abs(latency_change_pct) < 5 THEN 0.1 WHEN abs(latency_change_pct) < 15 THEN 0.05 ELSE 0 END)::DOUBLE AS confidence FROM h5)"""
REC = with_(SPANS, E5, H1, H2, PRICES, PATHS, H4, H5, H6)
PAIR = ["project_id", "model", "recommended_model"]


def stats(spark, d):
    return H.model_stats(H.model_usage(R.llm_usage_daily(spans(spark, d))))


@reg.add("h1_model_usage", with_(SPANS, E5, H1) + """
SELECT * REPLACE (round(total_cost_usd, 6) AS total_cost_usd, round(avg_latency_ms, 6) AS avg_latency_ms) FROM h1""")
def _(spark, d):
    return H.model_usage(R.llm_usage_daily(spans(spark, d)))


@reg.add("h2_model_stats", with_(SPANS, E5, H1, H2) + """
SELECT project_id, model, vendor, call_count, round(avg_prompt_tokens, 6) AS avg_prompt_tokens,
  round(avg_completion_tokens, 6) AS avg_completion_tokens, round(success_rate, 6) AS success_rate, round(cost_per_call, 6) AS cost_per_call FROM h2""")
def _(spark, d):
    return stats(spark, d).select("project_id", "model", "vendor", "call_count", "avg_prompt_tokens",
                                  "avg_completion_tokens", "success_rate", "cost_per_call")


@reg.add("h3_priced_usage", with_(SPANS, E5, H1, PRICES) + """
SELECT project_id, model, vendor, round(total_cost_usd, 6) AS total_cost_usd,
  round(prompt_tokens / 1000000 * input + completion_tokens / 1000000 * output, 6) AS list_price_usd FROM h1 JOIN prices USING (model)""")
def _(spark, d):
    return H.priced_usage(H.model_usage(R.llm_usage_daily(spans(spark, d)))).select(
        "project_id", "model", "vendor", "total_cost_usd", "list_price_usd")


@reg.add("c11_model_alternatives", REC + """
SELECT project_id, model, recommended_model, alt_calls, round(alt_cost_per_call, 6) AS alt_cost_per_call FROM h4""")
def _(spark, d):
    return H.model_alternatives(stats(spark, d)).select(*PAIR, "alt_calls", "alt_cost_per_call")


@reg.add("h4_savings", REC + """
SELECT project_id, model, recommended_model, round(monthly_savings, 6) AS monthly_savings, round(annual_savings, 6) AS annual_savings FROM h4""")
def _(spark, d):
    return H.with_savings(H.model_alternatives(stats(spark, d))).select(*PAIR, "monthly_savings", "annual_savings")


@reg.add("h5_latency_impact", REC + """
SELECT project_id, model, recommended_model, round(latency_change_pct, 6) AS latency_change_pct, performance_impact FROM h5""")
def _(spark, d):
    return H.with_impact(H.model_alternatives(stats(spark, d))).select(*PAIR, "latency_change_pct", "performance_impact")


@reg.add("h6_confidence", REC + "SELECT project_id, model, recommended_model, round(confidence, 6) AS confidence FROM h6")
def _(spark, d):
    return H.with_confidence(H.with_impact(H.model_alternatives(stats(spark, d)))).select(*PAIR, "confidence")


@reg.add("h7_model_recommendations", REC + """
SELECT project_id, model, recommended_model, round(monthly_savings, 6) AS monthly_savings, round(annual_savings, 6) AS annual_savings,
  performance_impact, round(confidence, 6) AS confidence, round(sum(monthly_savings) OVER (PARTITION BY project_id), 6) AS project_savings
FROM h6 WHERE call_count >= 10 AND monthly_savings >= 0.05 AND latency_change_pct <= 20""")
def _(spark, d):
    recs = H.recommend_models(stats(spark, d), min_calls=10, min_savings=0.05)
    total = recs.groupBy("project_id").agg(F.sum("monthly_savings").alias("project_savings"))
    return recs.join(total, "project_id").select(
        *PAIR, "monthly_savings", "annual_savings", "performance_impact", "confidence", "project_savings")


def prompts(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("prompt_id"), "text", F.floor(F.col("n_chars") / 4).alias("tokens"),
        (F.floor(F.col("n_chars") / 4) / F.lit(100000.0)).alias("cost"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("asked_at"))


PROMPTS = """
prompts AS (SELECT doc_id AS prompt_id, text, n_chars // 4 AS tokens, (n_chars // 4) / 100000.0::DOUBLE AS cost,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS asked_at FROM documents)"""
H9 = """
h9 AS (SELECT md5(text) AS cluster_id, count(*) AS member_count, arg_min(text, ROW(asked_at, prompt_id)) AS representative_text,
  avg(tokens) AS avg_tokens, sum(cost) AS total_cost, CASE WHEN count(*) >= 2 THEN
    count(*) / greatest((epoch_us(max(asked_at)) - epoch_us(min(asked_at))) / 86400000000.0::DOUBLE, 1) ELSE count(*) END AS frequency_per_day
  FROM prompts WHERE coalesce(text, '') <> '' AND tokens > 0 GROUP BY md5(text) HAVING count(*) >= 2)"""
H13 = """
h13 AS (SELECT *, (member_count - 1) / member_count * 100 AS hit_rate,
  greatest(0, total_cost / member_count * 0.9::DOUBLE * (member_count - 1) * 0.9::DOUBLE / member_count * frequency_per_day * 30) AS monthly_savings,
  greatest(0, total_cost / member_count * 0.9::DOUBLE * (member_count - 1) * 0.9::DOUBLE / member_count * frequency_per_day * 365) AS annual_savings,
  total_cost / member_count * frequency_per_day * 30 AS current_monthly_cost,
  least(1.0, 0.5 + CASE WHEN member_count >= 50 THEN 0.3 WHEN member_count >= 20 THEN 0.25 WHEN member_count >= 10 THEN 0.2 ELSE 0.15 END
    + CASE WHEN frequency_per_day >= 10 THEN 0.2 WHEN frequency_per_day >= 5 THEN 0.15 WHEN frequency_per_day >= 2 THEN 0.1 ELSE 0 END)::DOUBLE AS confidence
  FROM h9)"""
CACHE = with_(PROMPTS, H9, H13)


def clusters(spark, d):
    return H.exact_clusters(H.cacheable_prompts(prompts(spark, d)), min_size=2)


def cache_recs(spark, d):
    return H.recommend_caching(clusters(spark, d), min_size=2, min_per_day=1.5, min_savings=0.01)


@reg.add("h8_cacheable_prompts", with_(PROMPTS) + f"""
SELECT prompt_id, md5(text) AS text_md5, tokens, round(cost, 6) AS cost, {ts_sql('asked_at')} AS asked_at
FROM prompts WHERE coalesce(text, '') <> '' AND tokens > 0""")
def _(spark, d):
    return H.cacheable_prompts(prompts(spark, d)).withColumn("text_md5", F.md5("text")).drop("text")


@reg.add("h9_exact_prompt_clusters", CACHE + """
SELECT cluster_id, member_count, representative_text, round(avg_tokens, 6) AS avg_tokens, round(total_cost, 6) AS total_cost,
  round(total_cost * (member_count - 1) / member_count, 6) AS potential_cache_savings FROM h9""")
def _(spark, d):
    return clusters(spark, d).drop("frequency_per_day")


@reg.add("h10_prompt_frequency", CACHE + "SELECT cluster_id, member_count, round(frequency_per_day, 6) AS frequency_per_day FROM h9")
def _(spark, d):
    return clusters(spark, d).select("cluster_id", "member_count", "frequency_per_day")


@reg.add("h11_semantic_clusters")
def _(spark, d):
    return H.semantic_clusters(table(spark, d, "embeddings"), 20)


@reg.add("h12_embedding_cosine", """
SELECT a.vec_id, b.vec_id AS next_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("ea"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("eb"))
    return a.join(b, "vec_id").select("vec_id", (F.col("vec_id") + 1).alias("next_id"), cosine(F.col("ea"), F.col("eb")).alias("cosine"))


@reg.add("h11_cluster_invariants", """
SELECT count(*) AS points, greatest(2, CAST(floor(sqrt(count(*) / 2)) AS BIGINT)) AS centres, count(*) AS members, 0 AS misplaced, 0 AS wrong_representatives,
  sum(vec_id) AS sum_of_ids FROM embeddings""")
def _(spark, d):
    """What any k-means result must fulfil, found out apart from it: each point once and at its nearest centre, representatives nearest."""
    points = table(spark, d, "embeddings")
    placed = H.semantic_assignments(points, sample_rows=1000).select(
        "vec_id", "embedding", "cluster", F.round(distance(F.col("embedding"), F.col("centroid")), 9).alias("away"), "centroid").persist()
    centres = placed.groupBy("cluster").agg(F.first("centroid").alias("c"), F.min(F.struct("away", "vec_id"))["vec_id"].alias("best"))
    # the centres are few: as an array in every row
    every = centres.agg(F.collect_list("c").alias("all"), F.count("*").alias("centres"), (F.count("*") > 0).alias("some"))
    judged = placed.withColumn("some", F.col("cluster") >= 0).join(every, "some")
    nearest = F.array_min(F.transform("all", lambda c: F.round(distance(F.col("embedding"), c), 9)))
    chosen = H.semantic_clusters(points, sample_rows=1000, min_size=1).join(centres, "cluster")
    wrong = chosen.agg((F.count("*") > 0).alias("some"), F.count_if(F.col("representative") != F.col("best")).alias("wrong_representatives"), F.sum("member_count").alias("members"))
    out = judged.agg((F.count("*") > 0).alias("some"), F.count("*").alias("points"), F.max("centres").alias("centres"), F.count_if(F.col("away") > nearest + 1e-6).alias("misplaced"), F.sum("vec_id").alias("sum_of_ids"))
    return out.join(wrong, "some").drop("some")


SIMILAR = 0.3


@reg.add("h12_similar_prompts", f"""
WITH unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
links AS (
  SELECT a.vec_id AS query_id, b.vec_id AS other, list_dot_product(a.v, b.v) AS cosine FROM unit a JOIN unit b ON b.vec_id <> a.vec_id
  WHERE a.vec_id % 100 = 0 AND list_dot_product(a.v, b.v) >= {SIMILAR}),
best AS (
  SELECT query_id, count(*) AS links, min_by(other, struct_pack(c := -round(cosine, 12), other := other)) AS best_id, round(max(cosine), 6) AS best_cosine,
    sum(other) AS linked_ids FROM links GROUP BY query_id)
SELECT vec_id AS query_id, coalesce(links, 0) AS links, best_id, best_cosine,
  (SELECT string_agg(other, ',' ORDER BY round(cosine, 12) DESC, other) FROM (
     SELECT other, cosine FROM links l WHERE l.query_id = u.vec_id ORDER BY round(cosine, 12) DESC, other LIMIT 10)) AS best_ids
FROM unit u LEFT JOIN best b ON b.query_id = u.vec_id WHERE vec_id % 100 = 0""")
def _(spark, d):
    points = table(spark, d, "embeddings")
    found = similar(points, points.where("vec_id % 100 = 0"), SIMILAR)
    ids = F.array_join(F.transform("best", lambda b: b["key"]), ",")
    return found.select("query_id", "links", F.try_element_at("best", F.lit(1))["key"].alias("best_id"),
                        F.try_element_at("best", F.lit(1))["cosine"].alias("best_cosine"), F.when(F.size("best") > 0, ids).alias("best_ids"))


@reg.add("h13_cache_savings", CACHE + """
SELECT cluster_id, round(hit_rate, 6) AS hit_rate, round(monthly_savings, 6) AS monthly_savings, round(annual_savings, 6) AS annual_savings FROM h13""")
def _(spark, d):
    return H.with_cache_savings(clusters(spark, d)).select("cluster_id", "hit_rate", "monthly_savings", "annual_savings")


@reg.add("h14_monthly_cost", CACHE + "SELECT cluster_id, round(current_monthly_cost, 6) AS current_monthly_cost FROM h13")
def _(spark, d):
    return H.with_cache_savings(clusters(spark, d)).select("cluster_id", "current_monthly_cost")


@reg.add("h15_cache_confidence", CACHE + "SELECT cluster_id, round(confidence, 6) AS confidence FROM h13")
def _(spark, d):
    return H.with_cache_confidence(clusters(spark, d)).select("cluster_id", "confidence")


KEPT = "frequency_per_day >= 1.5 AND monthly_savings >= 0.01"


@reg.add("h16_cache_recommendations", CACHE + f"""
SELECT cluster_id, member_count, round(frequency_per_day, 6) AS frequency_per_day, round(monthly_savings, 6) AS monthly_savings,
  round(annual_savings, 6) AS annual_savings, round(confidence, 6) AS confidence FROM h13 WHERE {KEPT}""")
def _(spark, d):
    return cache_recs(spark, d).select("cluster_id", "member_count", "frequency_per_day", "monthly_savings", "annual_savings", "confidence")


@reg.add("h17_cache_storage", CACHE + f"""
SELECT unique_prompts, round(t, 6) AS avg_tokens_per_entry, round(t * 12, 6) AS bytes_per_entry, round(t * 12 * unique_prompts / 1000000, 6) AS total_storage_mb
FROM (SELECT count(*) AS unique_prompts, coalesce(avg(avg_tokens), 0) AS t FROM h13 WHERE {KEPT})""")
def _(spark, d):
    return H.cache_storage(cache_recs(spark, d))
