"""Reading flat dotted keys out of the ``attributes`` JSON column.

All keys an operator needs are read by one ``from_json`` with a narrow struct,
so each row is parsed once. Absent keys become '' or 0 by default; pass
``strict=True`` to keep NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import lookup

_DTYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType()}
_ZERO = {"str": "", "int": 0, "float": 0.0}


def with_attrs(df: DataFrame, keys: dict[str, tuple[str, str]], *, json: str = "attributes",
               strict: bool = False) -> DataFrame:
    """Add one column per entry of ``{column: (json key, 'str'|'int'|'float')}``."""
    fields = {}
    for key, kind in keys.values():
        fields.setdefault(key, kind)
    schema = T.StructType([T.StructField(k, _DTYPES[v]) for k, v in fields.items()])
    parsed = df.withColumn("_attrs", F.from_json(F.col(json), schema))
    new = {}
    for name, (key, kind) in keys.items():
        value = F.col(f"_attrs.`{key}`")
        new[name] = value if strict else F.coalesce(value, F.lit(_ZERO[kind]))
    return parsed.withColumns(new).drop("_attrs")


def has_key(json: Column | str, key: str) -> Column:
    """True when the object has ``key``, also with a JSON null as its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(_col(json)), key), F.lit(False))


def attr_map(json: Column | str) -> Column:
    return F.from_json(_col(json), "map<string,string>")


def json_or(json: Column | str, schema: str, default: Column) -> Column:
    """Tolerant parse: bad or empty text gives ``default``."""
    return F.coalesce(F.from_json(_col(json), schema), default)


def blank_to(value: Column, default: Column | str) -> Column:
    """``value`` unless it is NULL or '' (truthiness fallback)."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


__all__ = ["with_attrs", "has_key", "attr_map", "json_or", "blank_to", "lookup"]
