"""Collects named queries together with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""

        def wrap(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return tidy(fn(configure(spark), sf_dir))

            run.__name__ = name
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap


def tidy(df: DataFrame) -> DataFrame:
    """Plain output types: text timestamps, rounded doubles, joined string arrays."""
    cols = []
    for field in df.schema.fields:
        col, dtype = F.col(f"`{field.name}`"), field.dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
            col = F.array_join(col, "|")
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col)
        cols.append(col.alias(field.name))
    return df.select(*cols)
