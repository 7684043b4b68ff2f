"""Results kept in the shared folder, so that a lost executor loses nothing."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where none is named and
    the session is local (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spanloom-")
    context.setCheckpointDir(named)


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read from there; its lineage ends there."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # writers hold one block each
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, and let the driver drop the shuffle files of finished steps.

    Spark removes shuffle files once no plan refers to them, but only when the driver collects garbage.
    """
    for df in done:
        path = getattr(df, "_settled_at", None)
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark._jvm.System.gc()
