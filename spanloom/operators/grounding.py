"""Grounding of model answers in their retrieved context.

Claims and context chunks both come from one span, so everything is array work
inside that row: nothing is paired across rows and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attrs import with_attrs
from ..functions.vectors import jaccard, words

# ---- fixed values ----
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+(?=[A-Z])"
THRESHOLD = 0.7
OUTPUT_KEYS = ["llm.response", "response", "output", "content"]

EMPTY = "array<string>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def claims_of(text: Column) -> Column:
    """Sentences of a text: array of (index, text, start, end) with character offsets."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.split(t, SENTENCE_GAP)
    gaps = F.transform(F.regexp_extract_all(t, F.lit(SENTENCE_GAP), F.lit(0)), lambda g: F.length(g))
    # length of each piece plus the gap after it, as running offsets
    steps = F.zip_with(F.transform(pieces, lambda p: F.length(p)), gaps, lambda a, b: a + F.coalesce(b, F.lit(0)))
    start0 = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(steps, start0, lambda acc, step: F.struct(
        (acc["pos"] + step).alias("pos"), F.concat(acc["starts"], F.array(acc["pos"])).alias("starts")))["starts"]
    rows = F.zip_with(pieces, starts, lambda p, s: F.named_struct(F.lit("p"), p, F.lit("s"), s))
    built = F.transform(rows, lambda r, i: F.named_struct(
        F.lit("index"), i, F.lit("text"), _strip(r["p"]),
        F.lit("start"), r["s"] + F.length(r["p"]) - F.length(F.regexp_replace(r["p"], r"(?U)^\s+", "")),
        F.lit("end"), r["s"] + F.length(F.regexp_replace(r["p"], r"(?U)\s+$", ""))))
    return F.filter(built, lambda c: c["text"] != "")


def context_chunks(attributes: Column) -> Column:
    """Context texts of a span, trimmed and distinct in order."""
    docs = F.from_json(attributes, "struct<`retrieval.documents`:array<string>,`retrieval.results`:array<string>,`context`:string>")
    one_doc = "struct<text:string,content:string,page_content:string>"

    def texts(values: Column, keys: list[str]) -> Column:
        return F.transform(F.coalesce(values, F.array().cast(EMPTY)), lambda v: F.when(
            v.startswith("{"), F.coalesce(*[F.nullif(F.from_json(v, one_doc)[k], F.lit("")) for k in keys])).otherwise(v))

    context = docs["context"]
    as_list = F.from_json(context, "array<string>")
    generic = F.when(F.coalesce(context, F.lit("")) == "", F.array().cast(EMPTY)).when(
        context.startswith("[") & as_list.isNotNull(), as_list).otherwise(F.split(context, "\n\n"))
    chunks = F.concat(texts(docs["retrieval.documents"], ["text", "content", "page_content"]),
                      texts(docs["retrieval.results"], ["text", "content"]), generic)
    trimmed = F.transform(chunks, _strip)
    return F.array_distinct(F.filter(trimmed, lambda c: F.coalesce(c, F.lit("")) != ""))


def output_text(spans: DataFrame) -> DataFrame:
    """The first non-empty output key of a span."""
    keys = {f"_o{i}": (key, "str") for i, key in enumerate(OUTPUT_KEYS)}
    rows = with_attrs(spans, keys)
    return rows.withColumn("output_text", F.coalesce(*[F.nullif(c, F.lit("")) for c in keys], F.lit(""))).drop(*keys)


def with_claims(spans: DataFrame) -> DataFrame:
    """Spans having both an output and context, with their claims and chunks."""
    rows = output_text(spans).withColumn("chunks", context_chunks(F.col("attributes")))
    rows = rows.where((F.col("output_text") != "") & (F.size("chunks") > 0))
    return rows.withColumn("claims", claims_of(F.col("output_text")))


def assess(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per claim with its best context chunk by shared words; the first chunk wins ties."""
    sets = rows.withColumn("_words", F.transform("chunks", words))
    claims = sets.select("*", F.explode("claims").alias("c")).withColumn("_cw", words(F.col("c.text")))
    scored = F.transform("_words", lambda w, i: F.named_struct(F.lit("score"), jaccard(F.col("_cw"), w), F.lit("order"), -i))
    best = claims.withColumn("_best", F.array_max(scored))
    score = F.coalesce(F.col("_best.score"), F.lit(0.0))
    grounded = score >= threshold
    index = F.when(grounded & (score > 0), -F.col("_best.order"))
    return best.select(
        *[c for c in rows.columns if c not in ("claims", "chunks", "attributes", "output_text")],
        F.col("c.index").alias("sentence_index"), F.col("c.text").alias("claim"), F.col("c.start").alias("start_char"),
        F.col("c.end").alias("end_char"), grounded.alias("is_grounded"), score.alias("similarity"), index.alias("context_index"),
        F.try_element_at("chunks", (index + 1).cast("int")).alias("supporting_context"))


def verdicts(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per span: whether any claim is ungrounded, mean confidence and counts, within the row."""
    # a claim is cut into words once, not once per chunk
    best = F.transform(F.transform("claims", lambda c: words(c["text"])), lambda said: F.coalesce(F.array_max(F.transform(
        "_words", lambda w: jaccard(said, w))), F.lit(0.0)))
    scored = rows.withColumn("_words", F.transform("chunks", words)).withColumn("_scores", best)
    n, total = F.size("_scores"), F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x)
    ungrounded = F.size(F.filter("_scores", lambda s: s < threshold))
    kept = [c for c in rows.columns if c not in ("claims", "chunks", "attributes", "output_text")]
    return scored.select(
        *kept, n.alias("claim_count"), ungrounded.alias("ungrounded_count"), (n - ungrounded).alias("grounded_count"),
        (ungrounded > 0).alias("detected"), F.when(n > 0, total / n).otherwise(1.0).alias("confidence"))


def trace_verdicts(spans: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Grounding per trace over its model spans that have output and context."""
    per_span = verdicts(with_claims(spans.where("span_type = 'llm'")), threshold)
    return per_span.groupBy("project_id", "trace_id").agg(
        F.count("*").alias("spans_checked"), F.sum("claim_count").alias("claims"), F.sum("ungrounded_count").alias("ungrounded"),
        F.bool_or("detected").alias("detected"), F.avg("confidence").alias("confidence"))
