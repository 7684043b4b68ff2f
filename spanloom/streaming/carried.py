"""Keyed tables that a job carries from micro-batch to micro-batch.

Structured Streaming drops rows behind the watermark of a stateful operator. Jobs that must keep such rows
are written as functions of a micro-batch and of what earlier batches left in the shared folder. A batch reads
only what batches before it wrote and overwrites its own part, so a replayed batch gives the same result, and
a lost executor or driver loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.ordering import latest_per_key


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def parts(spark: SparkSession, path: str, name: str = "batch_id") -> list[int]:
    """Numbers n of the sub-folders ``name=n``, rising; none if the folder doesn't exist."""
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def latest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Newest row per key; a newest row marked ``_gone`` removes the key."""

    def merge(rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, keys, ["_at"]).where("not _gone")

    return merge


class Carried:
    """Rows written per batch, merged on reading.

    ``merge`` makes the current table of all parts (columns of ``schema``, ``_gone`` and ``_at``, the batch);
    by default the newest row per key counts. Every ``every`` batches the merged table is written as a new base; parts that a
    replay of the newest batch can't need any more are deleted then.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str],
                 merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 16) -> None:
        self.spark, self.path, self.keys, self.every = spark, path, keys, every
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_at", T.LongType())])
        self.merge = merge or latest(keys)

    def _base(self, upto: int) -> str:
        return f"{self.path}/base/upto={upto}"

    def _change(self, batch: int) -> str:
        return f"{self.path}/changes/batch_id={batch}"

    def before(self, batch_id: int) -> DataFrame:
        """The table as the batches before ``batch_id`` left it."""
        bases = [u for u in parts(self.spark, f"{self.path}/base", "upto") if u < batch_id]
        since = max(bases, default=-1)
        paths = [self._base(since)] if bases else []
        paths += [self._change(b) for b in parts(self.spark, f"{self.path}/changes") if since < b < batch_id]
        rows = self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)
        return self.merge(rows).select(*self.schema.names)

    def current(self) -> DataFrame:
        return self.before(1 << 62)

    def put(self, batch_id: int, changed: DataFrame) -> None:
        """Store what a batch changed; ``_gone`` may mark keys to be removed."""
        gone = F.coalesce("_gone", F.lit(False)) if "_gone" in changed.columns else F.lit(False)
        rows = changed.select(*self.schema.names, gone.alias("_gone"), F.lit(batch_id).cast("long").alias("_at"))
        rows.write.mode("overwrite").parquet(self._change(batch_id))
        if (batch_id + 1) % self.every == 0:
            whole = self.before(batch_id + 1).select("*", F.lit(False).alias("_gone"), F.lit(batch_id).cast("long").alias("_at"))
            whole.write.mode("overwrite").parquet(self._base(batch_id))
            self._clear(batch_id)

    def _clear(self, newest: int) -> None:
        """A replay of batch ``newest`` reads the base before it; anything older than that base goes."""
        older = [u for u in parts(self.spark, f"{self.path}/base", "upto") if u < newest]
        needed = max(older, default=-1)
        for u in older:
            if u < needed:
                delete(self.spark, self._base(u))
        for b in parts(self.spark, f"{self.path}/changes"):
            if b <= needed:
                delete(self.spark, self._change(b))


class Marks:
    """The greatest event time each batch had seen, and so a watermark that a replay finds unchanged."""

    def __init__(self, spark: SparkSession, path: str, delay: str) -> None:
        self.spark, self.path, self.delay = spark, path, F.expr(f"INTERVAL {delay}")

    def _seen(self, batches: Iterable[int]) -> DataFrame | None:
        last = max(batches, default=None)
        return None if last is None else self.spark.read.schema("latest timestamp").parquet(f"{self.path}/batch_id={last}")

    def before(self, batch_id: int):
        """Greatest event time of all earlier batches (a Python timestamp), or None."""
        rows = self._seen(b for b in parts(self.spark, self.path) if b < batch_id)
        return None if rows is None else rows.agg(F.max("latest").cast("string")).first()[0]

    def put(self, batch_id: int, latest_event: str | None) -> None:
        row = self.spark.createDataFrame([(latest_event,)], "latest string").select(F.col("latest").cast("timestamp").alias("latest"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        for b in parts(self.spark, self.path):
            if b < batch_id - 1:
                delete(self.spark, f"{self.path}/batch_id={b}")

    def watermark(self, latest_event: str | None):
        """Column of the watermark after ``latest_event``; null before the first event."""
        return F.lit(latest_event).cast("timestamp") - self.delay
