"""Composition: steps in a row, branches, the dropped route, counts of each step."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.operators.filters import split
from dnslens.plans.shared import scratch

__all__ = ["accounting", "chain", "fan_in", "fan_out", "observed", "routes", "scratch", "slow_and_errors"]

Step = Callable[[DataFrame], DataFrame]
#: The order in which a chain runs its steps unless told otherwise: latency before scoring, places before masking.
ORDER = ("normalize", "filtering", "reducer", "atags", "relabel", "latency", "suspicious", "geoip", "privacy", "extract", "ml", "rewrite", "new_domain", "reorder")
#: The order of the message pipeline that this library's steps are modelled on.
# The order in which stages ran classically.
CLASSIC_ORDER = ("normalize", "filtering", "reducer", "atags", "relabel", "privacy", "extract", "suspicious", "ml", "latency", "geoip", "rewrite", "new_domain", "reorder")


def chain(df: DataFrame, steps: dict[str, Step], order: str = "default") -> DataFrame:
    """Runs named steps in the fixed order; a name that the order doesn't have is an error."""
    names = CLASSIC_ORDER if order == "reference" else ORDER
    if unknown := set(steps) - set(names):
        raise ValueError(f"unknown steps {sorted(unknown)}")
    return functools.reduce(lambda d, n: d.transform(steps[n]), (n for n in names if n in steps), df)


def fan_in(*dfs: DataFrame) -> DataFrame:
    """All rows of several sources; absent columns are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def fan_out(df: DataFrame, branches: dict[str, Step]) -> dict[str, DataFrame]:
    """Each branch's own plan over one source."""
    return {name: step(df) for name, step in branches.items()}


def routes(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The forwarded and the dropped rows; each row is in exactly one."""
    return split(df, keep)


def observed(df: DataFrame, name: str):
    """df with a count of its rows that costs no extra pass, and the Observation to read it from after an action (batch)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def accounting(df: DataFrame, stages: Iterable[tuple[str, Column]]) -> DataFrame:
    """stage, ingress, egress, dropped of filters in a row, in one pass."""
    before, parts = F.lit(True), []
    for name, keep in stages:
        after = before & F.coalesce(keep, F.lit(False))
        parts.append((name, F.count_if(before), F.count_if(after)))
        before = after
    counts = df.agg(F.array(*(F.struct(F.lit(n).alias("stage"), i.alias("ingress"), o.alias("egress"), (i - o).alias("dropped")) for n, i, o in parts)).alias("s"))
    return counts.select(F.inline("s"))


def slow_and_errors(log: DataFrame, slow: float = 0.2) -> DataFrame:
    """Slow replies and failed replies: lower-case names, latency, two matched branches, one output with its branch."""
    from dnslens.operators.normalize import qname_lowercase, replace_nonprintable
    from dnslens.operators.pairing import measure_latency

    df = measure_latency(replace_nonprintable(qname_lowercase(log)))
    reply = F.col("operation") == "CLIENT_RESPONSE"
    out = fan_out(df, {"slow": lambda d: d.where(reply & (F.col("latency") > slow)), "errors": lambda d: d.where(reply & ~F.col("rcode").isin("NOERROR", "NXDOMAIN"))})
    return fan_in(*(d.withColumn("branch", F.lit(n)) for n, d in out.items()))
