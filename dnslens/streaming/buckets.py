"""Keyed state in buckets: keys are dealt by hash to BUCKETS groups, and each group keeps the states of its keys as one value.

A call into the state store costs far more than a row; with a group for each key it would be made for every key of a
micro-batch. Columns that a processor only hands on travel as one text (`packed`, `unpacked`); whole numbers that it takes must
not be null, as pandas would make them fractions. A bucket's rows of one micro-batch and its keys' states are in a task's memory at a time, which the size of a
trigger and the number of live keys bound.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def ms(ns: int) -> int:
    return -(-ns // 1_000_000)


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def packed(*columns: str) -> Column:
    """One text of some columns: equal for equal values, nulls included."""
    return F.to_json(F.struct(*columns), _JSON)


def unpacked(text: str, schema: StructType) -> Column:
    """The struct of columns that a text was packed from."""
    return F.from_json(text, schema, _JSON)


class Bucket(StatefulProcessor):
    """States of keys in a dict. Subclasses fold rows into it (`take`), and say when a state is due and what it leaves (`due`, `end`).

    Rows are taken as tuples of the columns, in order, and given as tuples of `out`.
    """

    columns: list[str]
    out: list[str]

    #: How many of the first columns order a bucket's rows.
    order = 2

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held binary, due long")

    def take(self, states: dict, rows: list) -> Iterable[tuple]:
        raise NotImplementedError

    def due(self, state) -> int:
        """The time in ns at which a state ends."""
        raise NotImplementedError

    def end(self, states: dict, key, now: int) -> Iterable[tuple]:
        """What a state that is due leaves; it must be deleted, or made due later than now (ms)."""
        del states[key]
        return ()

    def load(self) -> tuple[dict, int | None]:
        held, due = self.held.get() if self.held.exists() else (None, None)
        return pickle.loads(held) if held is not None else {}, due

    def save(self, states: dict, before: int | None) -> None:
        """Stores the states, with one timer for the first of them that is due."""
        due = min((ms(self.due(s)) for s in states.values()), default=None)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if states:
            self.held.update((pickle.dumps(states, 5), due))
        else:
            self.held.clear()

    def _ended(self, states: dict, now: int) -> Iterator[tuple]:
        for key in [k for k, s in states.items() if ms(self.due(s)) <= now]:
            yield from self.end(states, key, now)

    def _frame(self, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        if found := list(rows):
            yield pd.DataFrame(found, columns=self.out, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states, before = self.load()
        got = [r for part in rows for r in zip(*(part[c].tolist() for c in self.columns), strict=True)]
        got.sort(key=lambda r: r[: self.order])
        yield from self._frame(chain(self.take(states, got), self._ended(states, timerValues.getCurrentWatermarkInMs())))
        self.save(states, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        states, before = self.load()
        yield from self._frame(self._ended(states, timerValues.getCurrentWatermarkInMs()))
        self.save(states, before)

    def close(self) -> None:
        pass


def in_buckets(rows: DataFrame, keys: tuple[str, ...], columns: dict[str, Column], processor: Bucket, out: str | StructType, first: DataFrame | None = None) -> DataFrame:
    """The output of a processor over columns of rows (with the column ts of `stateful.with_time`). first: a row a bucket to begin with."""
    use_state_store(rows.sparkSession)
    processor.out = (StructType.fromDDL(out) if isinstance(out, str) else out).names
    processor.columns = list(columns)
    dealt = rows.select(bucket_of(*keys), "ts", *(c.alias(n) for n, c in columns.items())).groupBy("bucket")
    return dealt.transformWithStateInPandas(processor, out, "Append", "EventTime", None if first is None else first.groupBy("bucket"))
