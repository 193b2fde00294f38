"""Queries with their replies: latency, timeouts, trace spans.

All partition by (query_ip, query_port, dns_id) or by message id, keys that no client can make hot for long; the window
needs one shuffle on that key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("query_ip", "query_port", "dns_id")
#: Parts of a key of rows that can't pair.
SALTS = 4096


def _pairable(df: DataFrame):
    return ~F.col("malformed") & (F.col("query_port") != "-") & F.col("dns_type").isin("QUERY", "REPLY")


def measure_latency(df: DataFrame, timeout: float = 2.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """latency: of a reply the seconds since the query just before it in its key, if inside the timeout; else 0.

    A later query of the key overwrites an earlier one, and a reply uses its query up: the row before a reply decides.
    Rows that can't pair form keys of their own, so they are between no query and its reply; these are salted, as a client
    without ports may have any number of them.
    """
    ok = _pairable(df)
    w = Window.partitionBy(*key, "__ok", "__salt").orderBy("ts_ns", "msg_id")
    gap = F.col("ts_ns") - F.lag("ts_ns").over(w)
    paired = F.col("__ok") & (F.col("dns_type") == "REPLY") & (F.lag("dns_type").over(w) == "QUERY") & (gap < int(timeout * 1e9))
    salt = F.when(ok, F.lit(-1)).otherwise(F.pmod(F.xxhash64("msg_id"), F.lit(SALTS)).cast("int"))
    return df.withColumns({"__ok": ok, "__salt": salt}).withColumn("latency", F.when(paired, gap / 1e9).otherwise(0.0)).drop("__ok", "__salt")


def unanswered(df: DataFrame, timeout: float = 2.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """The rows, and for each query without a reply of its key in [ts, ts + timeout) a copy with rcode TIMEOUT."""
    ok = df.where(_pairable(df))
    replies = ok.where("dns_type = 'REPLY'").select(*(F.col(k).alias(f"__{k}") for k in key), F.col("ts_ns").alias("__ts"))
    same = [F.col(k) == F.col(f"__{k}") for k in key]
    late = ok.where("dns_type = 'QUERY'").join(replies, [*same, F.col("__ts") >= F.col("ts_ns"), F.col("__ts") < F.col("ts_ns") + int(timeout * 1e9)], "left_anti")
    return df.unionByName(late.withColumn("rcode", F.lit("TIMEOUT")))


def trace_spans(df: DataFrame, max_span: float = 120.0) -> DataFrame:
    """Spans of messages with message_id and initial_request_id.

    A query opens a span, the first response of its message id (in its stream, within max_span) closes it. A resolver's
    span is the child of the client span that its initial_request_id names, else a root. A response other than NOERROR is
    an error, a span without a response a timeout. trace_id is the hash of the root's message id.
    """
    q = df.where(F.col("operation").endswith("_QUERY")).select("identity", "message_id", "initial_request_id", "operation", "qname", F.col("ts_ns").alias("start_ns"))
    r = df.where(F.col("operation").endswith("_RESPONSE")).groupBy("identity", "message_id").agg(F.min(F.struct("ts_ns", "rcode")).alias("r"))
    spans = q.join(r, ["identity", "message_id"], "left").withColumn("r", F.when((F.col("r.ts_ns") >= F.col("start_ns")) & (F.col("r.ts_ns") - F.col("start_ns") < int(max_span * 1e9)), F.col("r")))
    parents = q.where("operation = 'CLIENT_QUERY'").select(F.col("identity").alias("__stream"), F.col("message_id").alias("__parent")).distinct()
    spans = spans.join(parents, (F.col("identity") == F.col("__stream")) & (F.col("initial_request_id") == F.col("__parent")) & (F.col("operation") != "CLIENT_QUERY"), "left")
    error = F.when(F.col("r").isNull(), F.lit("timeout")).when(F.col("r.rcode") != "NOERROR", F.col("r.rcode")).otherwise("")
    return spans.select("identity", F.sha1(F.coalesce("__parent", "message_id").cast("binary")).alias("trace_id"), F.col("message_id").alias("span_id"), F.col("__parent").alias("parent_id"), "operation", "qname", "start_ns", F.col("r.ts_ns").alias("end_ns"), error.alias("error"))
