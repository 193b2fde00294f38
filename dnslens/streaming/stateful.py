"""Streaming forms: pairing with state, continuously updated metrics, first sightings, reordering of micro-batches."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.operators.pairing import KEY
from dnslens.streaming.buckets import Bucket, in_buckets, ms, packed


def with_time(df: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """ts from ts_ns, with a watermark."""
    return df.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("ts", delay)


class _Latency(Bucket):
    """The time of each key's open query; forgotten when no reply can pair with it."""

    def __init__(self, step: int):
        self.step = step

    def take(self, states: dict, rows: list) -> Iterator[tuple]:
        for ts_ns, msg_id, key, query in rows:
            if query:
                states[key] = ts_ns
            else:
                opened = states.pop(key, None)
                if opened is not None and ts_ns - opened < self.step:
                    yield msg_id, (ts_ns - opened) / 1e9

    def due(self, state: int) -> int:
        return state + self.step


def _pairable(stream: DataFrame) -> DataFrame:
    return stream.where(~F.col("malformed") & (F.col("query_port") != "-") & F.col("dns_type").isin("QUERY", "REPLY") & F.col("ts_ns").isNotNull())


#: Stands for no msg_id inside buckets.
_NONE = -(1 << 63)


def _paired() -> dict:
    return {"ts_ns": F.col("ts_ns"), "msg_id": F.coalesce("msg_id", F.lit(_NONE)), "key": packed(*KEY), "query": F.col("dns_type") == "QUERY"}


def measure_latency(stream: DataFrame, timeout: float = 2.0) -> DataFrame:
    """msg_id, latency of the replies of a stream that find their query; the state is the open query's time of each key.

    Needs the column ts of with_time(). An open query is forgotten once the watermark has passed it by the timeout.
    """
    return in_buckets(_pairable(stream), KEY, _paired(), _Latency(int(timeout * 1e9)), "msg_id long, latency double").withColumn("msg_id", F.nullif("msg_id", F.lit(_NONE)))


class _Unanswered(Bucket):
    """The times of each key's open queries (with msg_id) and of its replies; a query leaves at its timeout or with its reply."""

    def __init__(self, step: int):
        self.step = step

    def take(self, states: dict, rows: list) -> Iterator[tuple]:
        touched = {}
        for ts_ns, msg_id, key, query in rows:
            queries, replies = touched[key] = states.setdefault(key, ([], []))
            queries.append((ts_ns, msg_id)) if query else replies.append(ts_ns)
        for queries, replies in touched.values():
            replies.sort()
            at = lambda q, replies=replies: bisect.bisect_left(replies, q[0])
            queries[:] = [q for q in queries if at(q) == len(replies) or replies[at(q)] >= q[0] + self.step]
        return ()

    def due(self, state: tuple) -> int:
        queries, replies = state
        return min((*(q[0] for q in queries), *replies[:1])) + self.step

    def end(self, states: dict, key, now: int) -> Iterator[tuple]:
        queries, replies = states[key]
        over = [q for q in queries if ms(q[0] + self.step) <= now]
        left = [q for q in queries if ms(q[0] + self.step) > now], [t for t in replies if ms(t + self.step) > now]
        if left[0] or left[1]:
            states[key] = left
        else:
            del states[key]
        for _, msg_id in over:
            yield (msg_id,)


def unanswered(stream: DataFrame, timeout: float = 2.0) -> DataFrame:
    """msg_id of queries without a reply of their key in [ts, ts + timeout), once the watermark has passed it."""
    return in_buckets(_pairable(stream), KEY, _paired(), _Unanswered(int(timeout * 1e9)), "msg_id long").withColumn("msg_id", F.nullif("msg_id", F.lit(_NONE)))


def metrics(stream: DataFrame, window: str = "1 minute") -> DataFrame:
    """Totals by window and stream; for update, append or complete mode."""
    w = stream.groupBy(F.window("ts", window), "identity").agg(F.count("*").alias("messages"), F.sum("length").alias("bytes"))
    return w.select(F.unix_seconds("window.start").alias("start"), "identity", "messages", "bytes")


def new_domains(stream: DataFrame) -> DataFrame:
    """The first row of each name within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(["qname"])


def reordered(stream: DataFrame, write) -> object:
    """A stream writer that hands each micro-batch, in time order, to write(df, batch_id)."""
    return stream.writeStream.foreachBatch(lambda df, k: write(df.orderBy("ts_ns", "msg_id"), k))


def in_time_order(log: DataFrame, path: str, files: int = 6) -> None:
    """Writes a log as files that a stream reads in the order of their rows' times, whichever task wrote them first."""
    log.repartitionByRange(files, "ts_ns").sortWithinPartitions("ts_ns", "msg_id").write.parquet(path)
    jvm = log.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(log.sparkSession._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for k, part in enumerate(parts):  # a source takes files by the time they were changed
        fs.setTimes(part, 1_000_000_000_000 + 1000 * k, -1)


def closing_row(log: DataFrame, after_ns: int = 3_600_000_000_000) -> DataFrame:
    """A row well after the log's last, with msg_id -1: its time lets a watermark pass all rows before it."""
    last = log.agg(F.max_by(F.struct("*"), "ts_ns").alias("r")).where("r is not null").select("r.*")
    return last.withColumns({"msg_id": F.lit(-1).cast("long"), "ts_ns": F.col("ts_ns") + F.lit(after_ns), "dns_type": F.lit("QUERY"), "malformed": F.lit(False), "query_port": F.lit("0")})


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now, into Parquet below folder, and reads it."""
    spark = stream.sparkSession
    out = f"{folder}/out"

    def put(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
