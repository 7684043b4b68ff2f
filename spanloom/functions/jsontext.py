"""Building JSON text from column parts, and tolerant time parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_value(value: Column) -> Column:
    """JSON literal of a scalar column; NULL stays NULL."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def json_string(text: Column) -> Column:
    """JSON literal of a text column, the same as ``json_value``; only texts with something to escape take a JSON writer."""
    return F.when(text.rlike(r'["\\\x00-\x1f]'), json_value(text)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def json_object(parts: dict[str, Column]) -> Column:
    """Object of ``{key: JSON literal}``; NULL literals are left out."""
    fields = [F.concat(F.lit(f'"{key}":'), literal) for key, literal in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def truthy(literal: Column) -> Column:
    """The literal unless it is an empty or false value."""
    empty = F.coalesce(literal, F.lit("null")).isin("null", '""', "[]", "{}", "0", "0.0", "false")
    return F.when(~empty, literal)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text with Z, an offset or none (UTC); anything else gives NULL."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([+-]\d{2}:?\d{2})?$"
    t = F.regexp_replace(F.trim(text), "[Zz]$", "+00:00")
    colon = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    dated = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(colon)
    return F.when(dated.rlike(shape), F.try_to_timestamp(dated))


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def duration_or(given: Column, start: Column, end: Column) -> Column:
    """Given duration in ms; where it is 0 or absent and the end is known, end minus start."""
    g = F.coalesce(given, F.lit(0.0))
    return F.when((g == 0) & end.isNotNull() & start.isNotNull(), micros_between(start, end) / F.lit(1000.0)).otherwise(g)
