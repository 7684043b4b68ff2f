"""Documents to training tokens: toxic ones out, one of each near-duplicate group, no benchmark passages, personal data masked, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the docs of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import bpe, decontam, neardup, pii, toxicity
from spanloom.llm.shared import release, settled
from spanloom.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same columns under names of their own, which no operator's column can clash with, and these names by old name."""
    names = {c: f"__{k}_of_docs" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(new).alias(old) for old, new in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models rate below the threshold."""
    fitted = toxicity.model(docs, _table(spark, sf_dir, "labels"))
    rows, names = _apart(docs)
    rated = toxicity.scores(rows, fitted, text=names["text"], keep=tuple(names.values()))
    return _back(rated.where("predicted = 0"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each near-duplicate class; rows are compared each for itself, also those that share an id or have none."""
    docs, names = _apart(docs)
    doc_id, text = names["doc_id"], names["text"]
    rows, hashed = neardup.keyed(docs, "__key", text=text, doc_id=doc_id)
    found = neardup.row_classes(rows, text=text, key="__key").withColumnRenamed("key", "__key")
    if not hashed:
        gone = found.where("__key <> class").select(F.col("__key").alias(doc_id))
        return _back(docs.join(gone, doc_id, "left_anti"), names)
    found = settled(found)
    order = F.struct(F.col(doc_id).isNull(), doc_id, "__key")
    lead = rows.select("__key", doc_id).join(found, "__key").groupBy("class").agg(F.min_by("__key", order).alias("__key")).select("__key")
    kept = rows.join(lead, "__key", "left_semi")
    # rows of one id and text are copies; of those the least in all columns stays. Texts without words and id are nobody's copy
    alone = F.col(doc_id).isNull() & ~F.coalesce(text, F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    twice = kept.where(~alone).groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key")
    again = kept.join(twice, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("s")).select("s.*")
    return _back(kept.join(twice, "__key", "left_anti").select(*docs.columns).unionByName(again), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    rows, names = _apart(docs)
    found = decontam.contamination(rows, _table(spark, sf_dir, "benchmark"), text=names["text"], keep=tuple(names.values()))
    return _back(found.where("not contaminated"), names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced by its kind."""
    masked = pii.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the text they decode to."""
    return bpe.encode(docs, bpe.vocabulary(spark), decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: Stages that SQL can't express (models, sampling) stand before all others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs)
            release(spark, before)
    return docs
