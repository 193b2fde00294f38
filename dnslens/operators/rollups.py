"""Rollups whose distinct counts and top-N lists can be merged: a sketch of each a minute, combined over hours and labels.

Distinct counts are HyperLogLog sketches (with 2 ** 14 registers about 0.8 % standard error, and nearly exact while small);
top-N lists are frequent-items sketches, exact while a group has fewer different values than three quarters of what is
tracked, and else off by at most about 3.5 / `tracked` of a group's messages. Both have a bounded size, whatever they count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct count, and values tracked for a top-N list (a power of two or near one).
REGISTERS, TRACKED = 14, 8192


def _start(df: DataFrame, seconds: int) -> Column:
    if df.isStreaming:
        return F.unix_seconds(F.window("ts", f"{seconds} seconds")["start"])
    return F.floor(F.col("ts_ns") / F.lit(seconds * 1_000_000_000).cast("decimal(20,0)")).cast("long") * seconds


def rollup(df: DataFrame, labels: list[str], uniques: list[str], tops: list[str], seconds: int = 60, tracked: int = TRACKED) -> DataFrame:
    """labels, start, messages, bytes, uniq_<column>, top_<column> of each tick; a stream needs the column ts with its watermark."""
    sketches = [F.hll_sketch_agg(c, REGISTERS).alias(f"uniq_{c}") for c in uniques]
    sketches += [F.expr(f"approx_top_k_accumulate({c}, {tracked})").alias(f"top_{c}") for c in tops]
    if df.isStreaming:
        out = df.groupBy(*labels, F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("messages"), F.sum("length").alias("bytes"), *sketches)
        return out.select(*labels, F.unix_seconds("window.start").alias("start"), *(c for c in out.columns if c not in {*labels, "window"}))
    return df.groupBy(*labels, _start(df, seconds).alias("start")).agg(F.count("*").alias("messages"), F.sum("length").alias("bytes"), *sketches)


def combine(rollups: DataFrame, labels: list[str], seconds: int, tracked: int = TRACKED) -> DataFrame:
    """Rollups of longer ticks, and of fewer labels if some are left out."""
    sketches = [F.hll_union_agg(c).alias(c) for c in rollups.columns if c.startswith("uniq_")]
    sketches += [F.expr(f"approx_top_k_combine({c}, {tracked})").alias(c) for c in rollups.columns if c.startswith("top_")]
    start = F.floor(F.col("start") / seconds).cast("long") * seconds
    return rollups.groupBy(*labels, start.alias("start")).agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"), *sketches)


def estimates(rollups: DataFrame, n: int = 10) -> DataFrame:
    """Sketches as numbers: uniq_<column> a count, top_<column> a list of (item, count), highest first."""
    out = rollups
    for c in rollups.columns:
        if c.startswith("uniq_"):
            out = out.withColumn(c, F.hll_sketch_estimate(c))
        elif c.startswith("top_"):
            out = out.withColumn(c, F.expr(f"approx_top_k_estimate({c}, {n})"))
    return out
