"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(ns: Column) -> Column:
    """Nanoseconds since the epoch as UTC text; the fraction loses its trailing zeros, and its point when nothing is left."""
    seconds = F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")
    rest = F.rtrim(F.lpad((ns - seconds * 1_000_000_000).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit("Z"))


def quoted(value: Column, delimiter: str = " ", boundary: str = '"') -> Column:
    """value in boundaries, its own ones escaped, if it is empty or holds the delimiter or the boundary."""
    if not boundary:
        return value
    wrapped = F.concat(F.lit(boundary), F.replace(value, F.lit(boundary), F.lit("\\" + boundary)), F.lit(boundary))
    odd = (value == "") | value.contains(boundary)
    return F.when(odd | value.contains(delimiter) if delimiter else odd, wrapped).otherwise(value)


def go_quoted(value: Column) -> Column:
    """value as a double-quoted literal with backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def number_text(value: Column) -> Column:
    """A double in plain notation without trailing zeros."""
    return F.regexp_replace(F.format_string("%.9f", value), r"\.?0+$", "")
