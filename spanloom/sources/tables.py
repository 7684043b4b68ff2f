"""Fact table layout: attribute index, project registration, sinks, incremental pull."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.attrs import attr_map


def attribute_rows(spans: DataFrame) -> DataFrame:
    """One row per span attribute (key, value)."""
    return spans.select("project_id", "trace_id", "span_id", "started_at",
                        F.explode(attr_map("attributes")).alias("key", "value"))


def month(ts: str = "started_at") -> Column:
    return F.date_format(ts, "yyyyMM")


def write_facts(df: DataFrame, path: str, sort: list[str], mode: str = "append") -> None:
    """Parquet partitioned by project and month, sorted inside files.

    Range partitioning over project, month and the sort columns samples the data,
    so a project with a large share of the rows is cut into many tasks and files.
    """
    rows = df.withColumn("month", month())
    order = ["project_id", "month", *[c for c in sort if c != "project_id"]]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("project_id", "month").parquet(path)


class FactSink:
    """Micro-batches of facts into one table, partitioned by project, month and batch.

    A batch overwrites the partitions of its own number only, so a job that runs twice leaves the rows of one run. Readers
    prune by project and month; the batch tells what came when. Rows are range partitioned like in ``write_facts``.
    """

    def __init__(self, path: str, sort: tuple[str, ...] = ("started_at",)) -> None:
        self.path, self.sort = path, sort

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"month": month(), "batch_id": F.lit(batch_id).cast("long")})
        order = ["project_id", "month", *self.sort]
        (rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("project_id", "month", "batch_id").parquet(self.path))


def read_facts(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Facts between two timestamps; the bounds also prune month partitions."""
    df = spark.read.parquet(path)
    if start is not None:
        at = F.lit(start).cast("timestamp")
        df = df.where((F.col("started_at") >= at) & (F.col("month").cast("string") >= start[:7].replace("-", "")))
    if end is not None:
        at = F.lit(end).cast("timestamp")
        df = df.where((F.col("started_at") <= at) & (F.col("month").cast("string") <= end[:7].replace("-", "")))
    return df


def drop_expired(spark: SparkSession, path: str, cutoff_month: str) -> DataFrame:
    """Facts of the months not older than ``cutoff_month`` (yyyyMM); a partition filter only."""
    return spark.read.parquet(path).where(F.col("month").cast("string") >= cutoff_month)


def pull_since(landing: DataFrame, marks: DataFrame, seen: DataFrame | None = None, key: str = "event_id") -> DataFrame:
    """Landing rows newer than the high-water mark of their source; unknown sources start from the beginning.

    Without ``seen`` only later timestamps are new. With it (source_id and ``key`` of the rows at the mark that were pulled) a row
    that arrives later with just the mark's timestamp is found, and found once.
    """
    at = marks.select("source_id", F.col("high_water").alias("_mark"))
    rows = landing.join(at, "source_id", "left")
    if seen is None:
        return rows.where(F.col("_mark").isNull() | (F.col("ts") > F.col("_mark"))).drop("_mark")
    rows = rows.where(F.col("_mark").isNull() | (F.col("ts") >= F.col("_mark")))
    return rows.drop("_mark").join(seen.select("source_id", key), ["source_id", key], "left_anti").select(*landing.columns)


def next_marks(pulled: DataFrame, marks: DataFrame) -> DataFrame:
    """High-water marks after a pull; sources without news keep theirs."""
    new = pulled.groupBy("source_id").agg(F.max("ts").alias("high_water"))
    return marks.unionByName(new).groupBy("source_id").agg(F.max("high_water").alias("high_water"))


class Pull:
    """Repeated pulls from a landing table that grows: each row at or after its source's mark comes once.

    Carried below ``folder``: the mark of each source, and the keys of the rows pulled at the mark. Pull number n reads
    only what pulls before n left, so one that broke off may be run again.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "event_id", key_type: str = "long", every: int = 16) -> None:
        from ..streaming.carried import Carried

        self.spark, self.folder, self.key = spark, folder, key
        self.marks = Carried(spark, f"{folder}/marks", "source_id string, high_water timestamp", ["source_id"], every=every)
        self.seen = Carried(spark, f"{folder}/seen", f"source_id string, {key} {key_type}", ["source_id", key], every=every)

    def __call__(self, landing: DataFrame, number: int) -> None:
        marks, seen = self.marks.before(number), self.seen.before(number)
        path = f"{self.folder}/data/batch_id={number}"
        pull_since(landing, marks, seen, self.key).write.mode("overwrite").parquet(path)
        new = self.spark.read.schema(landing.schema).parquet(path)
        after = next_marks(new, marks)
        moved = after.join(marks, ["source_id", "high_water"], "left_anti")
        self.marks.put(number, moved)
        at_mark = new.join(after.withColumnRenamed("high_water", "ts"), ["source_id", "ts"], "left_semi").select("source_id", self.key, F.lit(False).alias("_gone"))
        passed = seen.join(moved.select("source_id"), "source_id", "left_semi").select("source_id", self.key, F.lit(True).alias("_gone"))
        self.seen.put(number, at_mark.unionByName(passed))

    def pulled(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data")
