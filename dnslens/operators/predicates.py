"""Rules on the nested record, compiled once to a Column.

    match(nested, include={"dns.qname": "^www", "dnstap.latency": {"greater-than": 0.2}})

A path names fields by dots; `.N.` takes an element of a list, `.*.` all of them, and a rule on a list holds if it holds
for any element. An absent field is false, an unknown path or a wrong operand an error, an empty rule set never true.
"""

from __future__ import annotations

import functools
import operator
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnslens.operators.filters import any_of


def path(schema: T.StructType, dotted: str) -> tuple[Column, T.DataType, bool]:
    """The Column of a path, its type, and whether it is a list of values."""
    kind: T.DataType = schema
    column, listed = None, False
    for name in dotted.split("."):
        if isinstance(kind, T.ArrayType) and not listed:
            if name == "*":
                kind, listed = kind.elementType, True
            elif name.isdigit():
                column, kind = F.get(column, int(name)), kind.elementType
            else:
                raise ValueError(f"{dotted}: {name} isn't an index of a list")
            continue
        if not isinstance(kind, T.StructType) or name not in kind.names:
            raise ValueError(f"{dotted}: no field {name}")
        kind = kind[name].dataType
        if column is None:
            column = F.col(f"`{name}`")
        elif listed:
            column = F.transform(column, _getter(name))
        else:
            column = column.getField(name)
    if isinstance(kind, T.ArrayType) and not listed:
        return column, kind.elementType, True
    return column, kind, listed


def _getter(name: str):
    return lambda x: x.getField(name)


def _holds(column: Column, listed: bool, test) -> Column:
    return F.coalesce(F.exists(column, test) if listed else test(column), F.lit(False))


def rule(schema: T.StructType, dotted: str, want: Any, spark: SparkSession | None = None) -> Column:
    """One rule: a value, a pattern, a list of either, bounds, or a list from a source."""
    column, kind, listed = path(schema, dotted)
    number = isinstance(kind, (T.NumericType,))
    text = isinstance(kind, T.StringType)
    holds = functools.partial(_holds, column, listed)
    if isinstance(want, bool):
        if not isinstance(kind, T.BooleanType):
            raise ValueError(f"{dotted} isn't true or false")
        return holds(lambda x: x == want)
    if isinstance(want, (int, float)):
        if not number:
            raise ValueError(f"{dotted} isn't a number")
        return holds(lambda x: x == want)
    if isinstance(want, str):
        if not text:
            raise ValueError(f"{dotted} isn't text")
        re.compile(want)
        return holds(lambda x: x.rlike(want))
    if isinstance(want, list):
        if not want:
            return F.lit(False)
        return functools.reduce(operator.or_, (rule(schema, dotted, w, spark) for w in want))
    if not isinstance(want, dict):
        raise ValueError(f"{dotted}: can't match {want!r}")
    if "match-source" in want:
        lines = _lines(spark, want["match-source"])
        if want.get("source-kind", "string_list") == "regexp_list":
            return holds(lambda x: x.rlike(any_of(lines))) if lines else F.lit(False)
        return holds(lambda x: x.isin(lines))
    out = None
    for name, test in (("greater-than", operator.gt), ("lower-than", operator.lt)):
        if name in want:
            bound = want[name]
            if isinstance(bound, bool) or not isinstance(bound, (int, float)) or not number:
                raise ValueError(f"{dotted}: {name} compares numbers")
            now = holds(_bound(test, bound))
            out = now if out is None else out & now
    if out is None or set(want) - {"greater-than", "lower-than"}:
        raise ValueError(f"{dotted}: unknown operators {sorted(want)}")
    return out


def _bound(test, bound):
    return lambda x: test(x, F.lit(bound))


def _lines(spark: SparkSession | None, source: str | list[str]) -> list[str]:
    """A list's lines: given, or read from a path. Lists are configuration: they become literals of the plan."""
    if isinstance(source, list):
        return source
    return [r[0] for r in (spark or SparkSession.active()).read.text(source).collect() if r[0]]


def rules(schema: T.StructType, wanted: dict[str, Any], spark: SparkSession | None = None) -> Column:
    if not wanted:
        return F.lit(False)
    return functools.reduce(operator.and_, (rule(schema, k, v, spark) for k, v in wanted.items()))


def matching(df: DataFrame, include: dict | None = None, exclude: dict | None = None) -> Column:
    """All rules of include hold (if given), and not all of exclude."""
    out = rules(df.schema, include, df.sparkSession) if include is not None else F.lit(True)
    return out & ~rules(df.schema, exclude, df.sparkSession) if exclude is not None else out


def match(df: DataFrame, include: dict | None = None, exclude: dict | None = None) -> DataFrame:
    return df.where(matching(df, include, exclude))
