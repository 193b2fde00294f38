"""Keyed state with timers: repeats folded into their first row, first sightings of names that outlive a run, ordered flushes.

Streams need the column ts of `stateful.with_time`, whose watermark moves the timers. State lies in RocksDB (`use_state_store`),
so it may be larger than memory; of a bucket of keys, the state and the rows of one micro-batch are in memory (see `buckets`).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from dnslens.operators.filters import any_of
from dnslens.operators.state import REDUCE_KEYS
from dnslens.streaming.buckets import Bucket, bucket_of, in_buckets, packed, unpacked, use_state_store

SORTED_BY = "__us"


def _plain(schema: StructType) -> StructType:
    """Without the watermark's mark on ts."""
    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def _order() -> dict:
    """The columns by which rows are ordered; rows without a msg_id are first."""
    return {"ts_ns": F.col("ts_ns"), "msg_id": F.coalesce("msg_id", F.lit(-(1 << 63)).cast("long"))}


class _Repeats(Bucket):
    """The open interval of each key: its begin, first row, occurrences, summed length; it closes when due or at a row past its end."""

    def __init__(self, step: int):
        self.step = step

    def take(self, states: dict, rows: list) -> Iterator[tuple]:
        for ts_ns, _, length, key, row in rows:
            held = states.get(key)
            if held is not None and ts_ns < held[0] + self.step:
                held[2] += 1
                held[3] += length
                continue
            if held is not None:
                yield self._row(held)
            states[key] = [ts_ns, row, 1, length]

    def due(self, state: list) -> int:
        return state[0] + self.step

    def end(self, states: dict, key, now: int) -> Iterator[tuple]:
        yield self._row(states.pop(key))

    def _row(self, held: list) -> tuple:
        return tuple(held[1:])


def reduce_traffic(stream: DataFrame, keys: tuple[str, ...] = REDUCE_KEYS, interval: float = 2.0) -> DataFrame:
    """As operators.state.reduce_traffic: each interval's first row, emitted when the watermark reaches first sighting + interval.

    Rows of a key that arrive after a later one, but not after the watermark, count to the interval that is open. Rows without a
    time are dropped. Names that should become registrable domains are mapped before.
    """
    columns = _order() | {"length": F.coalesce("length", F.lit(0)).cast("long"), "key": packed(*keys), "row": packed(*stream.columns)}
    found = in_buckets(stream.where("ts_ns IS NOT NULL"), keys, columns, _Repeats(int(interval * 1e9)), "row string, occurrences long, cumulative_length long")
    return found.select(unpacked("row", _plain(stream.schema)).alias("row"), "occurrences", "cumulative_length").select("row.*", "occurrences", "cumulative_length")


class _Sightings(Bucket):
    """The last first sighting of each name; forgotten once its time to live has passed."""

    def __init__(self, step: int):
        self.step = step

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        states, before = self.load()
        for x in chain(*initialState["names"]):
            states[x["qname"]] = max(x["ts_ns"], states.get(x["qname"], x["ts_ns"]))
        self.save(states, before)

    def take(self, states: dict, rows: list) -> Iterator[tuple]:
        for ts_ns, _, name, row in rows:
            last = states.get(name)
            if last is None or ts_ns - last >= self.step:
                states[name] = ts_ns
                yield (row,)

    def due(self, state: int) -> int:
        return state + self.step


def new_domains(stream: DataFrame, ttl: float = 3600.0, whitelist: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows that show a name not seen for `ttl` since its last first sighting, as operators.state.new_domains.

    known: a table of qname and ts_ns, such as `known_names` of an earlier run, that a new checkpoint starts from.
    """
    rows = stream if whitelist is None else stream.where(~F.col("qname").rlike(any_of(whitelist)))
    first = None
    if known is not None:
        last = known.groupBy("qname").agg(F.max("ts_ns").alias("ts_ns"))
        first = last.groupBy(bucket_of("qname")).agg(F.collect_list(F.struct("qname", "ts_ns")).alias("names"))  # a bucket's share
    columns = _order() | {"qname": F.col("qname"), "row": packed(*stream.columns)}
    found = in_buckets(rows.where("ts_ns IS NOT NULL"), ("qname",), columns, _Sightings(int(ttl * 1e9)), "row string", first)
    return found.select(unpacked("row", _plain(stream.schema)).alias("row")).select("row.*")


def known_names(spark: SparkSession, checkpoint: str) -> DataFrame:
    """qname, ts_ns: the names that a run of `new_domains` knows, read from its checkpoint: what the next run starts from."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)

    def run(batches):
        for b in batches:
            for held in b.column("held").to_pylist():
                names = pickle.loads(held)
                yield pa.record_batch([pa.array(names.keys(), pa.string()), pa.array(names.values(), pa.int64())], names=["qname", "ts_ns"])

    return state.select(F.col("value.held").alias("held")).where("held IS NOT NULL").mapInArrow(run, "qname string, ts_ns long")


class _Ordered(StatefulProcessor):
    """The rows of a stream since its last flush; flushed in time order when there are enough of them, or at a timer."""

    def __init__(self, schema: StructType, rows: int, step: int):
        self.schema, self.rows, self.step, self.names = schema, rows, step, schema.names

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.flush = handle.getValueState("flush", "n long, due long")

    def _flushed(self, held: list[tuple], n: int) -> Iterator[Row]:
        at = self.names.index(SORTED_BY)
        good = iter(sorted((r for r in held if r[at] is not None), key=lambda r: r[at]))
        for k, r in enumerate(held):  # a row whose time can't be read keeps its place
            yield Row(*self.names, "flush", "position")(*(r if r[at] is None else next(good)), n, k + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, due = self.flush.get() if self.flush.exists() else (0, 0)
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        for r in sorted(rows, key=lambda r: r["msg_id"]):  # as they came
            if not held and not due:
                due = timerValues.getCurrentWatermarkInMs() + self.step
                self.handle.registerTimer(due)
            held.append(tuple(r[c] for c in self.names))
            if len(held) >= self.rows:
                yield from self._flushed(held, n)
                held, n = [], n + 1
        self.flush.update((n, due))
        if held:
            self.held.put(held)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, _ = self.flush.get()
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        if held:
            yield from self._flushed(held, n)
            self.held.clear()
            n += 1
        self.flush.update((n, 0))

    def close(self) -> None:
        pass


def reorder(stream: DataFrame, by: str = "identity", rows: int = 100, buffer: float = 30.0) -> DataFrame:
    """Each stream's rows in flushes (flush, position): when `rows` of them are held, or when the watermark has moved `buffer` seconds.

    The rows of a micro-batch come in the order of msg_id. A flush sorts by `timestamp` (a timestamp column, null where the text
    of a time can't be read): such rows keep their place, the others fill the other places in time order.
    """
    use_state_store(stream.sparkSession)
    stream = stream.withColumn(SORTED_BY, F.unix_micros("timestamp"))
    schema = _plain(stream.schema)
    out = StructType([*schema.fields, StructField("flush", LongType()), StructField("position", LongType())])
    return stream.groupBy(by).transformWithState(_Ordered(schema, rows, int(buffer * 1000)), out, "Append", "EventTime").drop(SORTED_BY)
