"""Counters, distinct counts, histograms, rates and top-N tables, by chosen labels.

All are partial aggregates first (Spark's default), so a hot label costs a row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAMED = {"stream_id": "identity", "resolver": "response_ip"}


def label_columns(labels: list[str | Column]) -> list[Column]:
    """Dimensions by name (stream_id, resolver, stream_global) or as Columns of your own."""
    return [x if not isinstance(x, str) else F.lit("global").alias(x) if x == "stream_global" else F.col(_NAMED[x]).alias(x) for x in labels]


def _named(labels: list) -> list[Column]:
    return label_columns(labels or ["stream_id"])


def metric_totals(df: DataFrame, labels: list | None = None) -> DataFrame:
    query = F.col("dns_type") == "QUERY"
    return df.groupBy(*_named(labels)).agg(
        F.count("*").alias("messages"), F.count_if(query).alias("queries"), F.count_if(F.col("dns_type") == "REPLY").alias("replies"), F.sum("length").alias("bytes"),
        F.coalesce(F.sum(F.when(query, F.col("length"))), F.lit(0)).alias("bytes_received"), F.coalesce(F.sum(F.when(F.col("dns_type") == "REPLY", F.col("length"))), F.lit(0)).alias("bytes_sent"),
    )


def metric_flags(df: DataFrame, labels: list | None = None, flags: tuple[str, ...] = ("flag_tc", "flag_aa", "flag_ra", "flag_ad", "malformed", "ip_defragmented", "tcp_reassembled")) -> DataFrame:
    """How often each flag is set; flags that the log doesn't carry count as never."""
    return df.groupBy(*_named(labels)).agg(*(F.count_if(F.col(f) if f in df.columns else F.lit(False)).alias(f"{f}_total") for f in flags))


def metric_by(df: DataFrame, column: str, labels: list | None = None, skip: str | None = None) -> DataFrame:
    rows = df if skip is None else df.where(F.col(column) != skip)
    return rows.groupBy(*_named(labels), F.col(column)).agg(F.count("*").alias("messages"))


def uniques(df: DataFrame, column: str, labels: list | None = None, where: Column | None = None, exact: bool = True) -> DataFrame:
    """Different values of a column. exact=False uses a mergeable sketch of fixed size."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*_named(labels)).agg((F.count_distinct(column) if exact else F.approx_count_distinct(column)).alias("uniques"))


def eps(df: DataFrame, labels: list | None = None, seconds: int = 1) -> DataFrame:
    """Messages of each tick."""
    tick = F.floor(F.col("ts_ns") / F.lit(seconds * 1_000_000_000).cast("decimal(20,0)")).cast("long") * seconds
    return df.groupBy(*_named(labels), tick.alias("tick")).agg(F.count("*").alias("events"))


def eps_max(df: DataFrame, labels: list | None = None) -> DataFrame:
    names = [x if isinstance(x, str) else None for x in (labels or ["stream_id"])]
    return eps(df, labels).groupBy(*names).agg(F.max("events").alias("events_max"))


def histogram(df: DataFrame, column: str, buckets: list[float], labels: list | None = None, where: Column | None = None) -> DataFrame:
    """Cumulative counts le_<bound>, the sum and the count."""
    rows = df if where is None else df.where(where)
    name = lambda b: f"le_{b:g}".replace(".", "_")
    return rows.groupBy(*_named(labels)).agg(*(F.count_if(F.col(column) <= b).alias(name(b)) for b in buckets), F.sum(column).alias("total"), F.count("*").alias("n"))


def hits(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("hit"))


def top_n(df: DataFrame, column: str, n: int = 10, labels: list | None = None, where: Column | None = None) -> DataFrame:
    """The n most frequent values by labels; ties by value. Ranks are of counts, not of rows; without labels a sort with limit."""
    rows = df if where is None else df.where(where)
    key = F.make_valid_utf8(F.col(column))
    if labels is not None and not labels:
        return hits(rows.withColumn(column, key), column).orderBy(F.desc("hit"), "key").limit(n)
    named = _named(labels)
    counts = rows.groupBy(*named, key.alias("key")).agg(F.count("*").alias("hit"))
    names = [c for c in counts.columns if c not in ("key", "hit")]
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("hit"), "key"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def approx_top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """A top-N of fixed memory for key spaces too large to count exactly."""
    return df.agg(F.expr(f"approx_top_k({column}, {n})").alias("top")).select(F.inline("top"))


def statsd_stats(df: DataFrame, top: int = 50) -> DataFrame:
    """identity, metric, value: totals, distinct counts, and counts by transport, family, type, rcode, operation (top 50)."""
    one = F.col("dns_type") == "QUERY"
    totals = df.groupBy("identity").agg(
        F.count("*").alias("total_packets"), F.coalesce(F.sum(F.when(one, F.col("length"))), F.lit(0)).alias("total_bytes_received"), F.coalesce(F.sum(F.when(~one, F.col("length"))), F.lit(0)).alias("total_bytes_sent"),
        F.count_distinct("query_ip").alias("total_requesters"), F.count_distinct("qname").alias("total_domains"), F.count_distinct(F.when(F.col("rcode") == "NXDOMAIN", F.col("qname"))).alias("total_domains_nx"),
    )
    out = totals.unpivot("identity", [c for c in totals.columns if c != "identity"], "metric", "value")
    for column, prefix in (("protocol", "total_packets_"), ("family", "total_packets_"), ("qtype", "total_replies_rrtype_"), ("rcode", "total_replies_rcode_"), ("operation", "total_packets_operation_")):
        best = top_n(df.withColumnRenamed("identity", "stream"), column, top, [F.col("stream").alias("identity")])
        out = out.unionByName(best.select("identity", F.concat(F.lit(prefix), "key").alias("metric"), F.col("hit").alias("value")))
    return out


def suspicious_domains(scored: DataFrame) -> DataFrame:
    """Of each name with a score its first record."""
    first = F.min_by(F.struct("msg_id", "identity", "query_ip", "suspicious_score"), F.struct("ts_ns", "msg_id"))
    return scored.where("suspicious_score > 0").groupBy("qname").agg(first.alias("f")).select("qname", "f.*")


def client_domain_hits(df: DataFrame) -> DataFrame:
    """Hits by stream, client and domain, with totals by stream and client, by stream, and of all (null: all)."""
    return df.rollup("identity", "query_ip", "qname").agg(F.count("*").alias("hit"))


def increase(df: DataFrame, seconds: int = 60, kept: Column | None = None) -> DataFrame:
    """Per stream and interval: rows that came in, went on and were dropped."""
    tick = F.floor(F.col("ts_ns") / F.lit(seconds * 1_000_000_000).cast("decimal(20,0)")).cast("long") * seconds
    kept = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    return df.groupBy("identity", tick.alias("tick")).agg(F.count("*").alias("ingress"), F.count_if(kept).alias("egress"), F.count_if(~kept).alias("dropped"))


def search_lines(lines: DataFrame, identity: str, patterns: list[str]) -> DataFrame:
    """Lines of one stream that all patterns find."""
    out = lines.where(F.col("identity") == identity)
    for p in patterns:
        out = out.where(F.col("line").rlike(p))
    return out
