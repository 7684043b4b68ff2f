"""The operators as queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure
from . import bpe, chat, decontam, langid, neardup, pagetext, periodic, pii, quality, search, tokencount, toxicity, whitening
from .batches import fold


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(_read(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.languages(docs, langid.model(docs)).select("doc_id", (fold("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fitted = toxicity.model(docs, _read(spark, sf_dir, "labels"))
    return toxicity.scores(docs, fitted).select("doc_id", (fold("doc_id") % 4 == 2).alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.described(_read(spark, sf_dir, "documents"))
    kernel = quality.model(quality.labelled_rows(stats, _read(spark, sf_dir, "labels")))
    return quality.scores(stats, kernel).select("doc_id", (fold("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extracted(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return bpe.digests(docs, bpe.vocabulary(spark))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 100 = 0"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return tokencount.token_counts(docs, bpe.vocabulary(spark))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.periodic_runs(_read(spark, sf_dir, "documents"), alter="doc_id"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.formatted(chat.with_probe(spark, _read(spark, sf_dir, "conversations"))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.scaled(_read(spark, sf_dir, "embeddings"))
    return whitening.report(rows, whitening.model(rows))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_language, op4_toxicity, op5_near_duplicates, op6_quality, op7_page_text, op8_bpe, op9_search, op10_token_counts,
                                op11_periodic_runs, op12_chat, op13_whitening)}
SQL = {"op2_decontamination": decontam.REPORT_SQL, "op12_chat": chat.REPORT_SQL}
