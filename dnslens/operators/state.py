"""Repeats, first sightings and order, in batch. The streaming forms are in dnslens.streaming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnslens.operators.filters import any_of
from dnslens.operators.lookup import add_tld_plus_one
from dnslens.operators.running import sums_before
from dnslens.plans.shared import stored

#: The default key of repeats.
REDUCE_KEYS = ("identity", "operation", "query_ip", "response_ip", "qname", "qtype")


def _beside(ticks: DataFrame) -> DataFrame:
    """Ticks of a key whose next or last tick has rows too."""
    near = ticks.select("__k", "__tick", F.lit(0).alias("__by"))
    for by in (-1, 1):
        near = near.unionByName(ticks.select("__k", (F.col("__tick") + by).alias("__tick"), F.lit(1).alias("__by")))
    return near.groupBy("__k", "__tick").agg(F.min("__by").alias("__own"), F.max("__by").alias("__near")).where("__own = 0 AND __near = 1").select("__k", "__tick")


def _anchors(times: DataFrame, step: int) -> DataFrame:
    """__k, __tick, __anchor: the times at which intervals of `step` begin, among the different times (__k, __tick, __ts) of keys.

    A time that no row of the last tick precedes begins one. Each time points to the first time at or past its own plus
    step, which lies in the next tick or begins the one after (unless the next one is empty, as that begins an interval anyway);
    pointers are doubled until none is left, and each turn adds the times that those already found reach. No step groups more than a key's times of one tick.
    """
    first = times.groupBy("__k", "__tick").agg(F.min("__ts").alias("__ts"))
    before = first.select("__k", (F.col("__tick") + 1).alias("__tick"))
    roots = first.join(before, ["__k", "__tick"], "left_anti").select("__k", F.col("__ts").alias("__anchor"))
    probes = times.select("__k", (F.col("__tick") + 1).alias("__tick"), (F.col("__ts") + step).alias("__at"), F.lit(None).cast("long").alias("__hit"), F.col("__ts").alias("__of"))
    rows = times.select("__k", "__tick", F.col("__ts").alias("__at"), F.col("__ts").alias("__hit"), F.lit(None).cast("long").alias("__of"))
    ahead = Window.partitionBy("__k", "__tick").orderBy("__at").rangeBetween(0, Window.unboundedFollowing)
    found = rows.unionByName(probes).withColumn("__next", F.min("__hit").over(ahead)).where("__of IS NOT NULL")
    later = first.join(before, ["__k", "__tick"], "left_semi").select("__k", (F.col("__tick") - 1).alias("__tick"), F.col("__ts").alias("__later"))
    links = found.join(later, ["__k", "__tick"], "left").select("__k", F.col("__of").alias("__ts"), F.coalesce("__next", "__later").alias("__next"))
    links = stored(links.where("__next IS NOT NULL"), "links")
    begun = stored(roots, "anchors")
    while not links.isEmpty():
        reached = begun.join(links, (begun["__k"] == links["__k"]) & (begun["__anchor"] == links["__ts"])).select(begun["__k"], F.col("__next").alias("__anchor"))
        begun = stored(begun.unionByName(reached), "anchors")
        onward = links.select(F.col("__k").alias("__k2"), F.col("__ts").alias("__mid"), F.col("__next").alias("__far"))
        links = stored(links.join(onward, (F.col("__k") == F.col("__k2")) & (F.col("__next") == F.col("__mid"))).select("__k", "__ts", F.col("__far").alias("__next")), "links")
    return begun.select("__k", _tick("__anchor", step).alias("__tick"), "__anchor")


def _tick(column: str, step: int) -> Column:
    """The column over step, rounded down: whole numbers of 64 bits only."""
    return F.expr(f"{column} div {step}L") - F.when(F.expr(f"{column} % {step}L < 0"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


#: A key's rows are dealt to chunks of so many ticks, and followed past a chunk's end for REACH ticks (the bits of a long).
CHUNK, REACH = 1024, 64
#: Rows of a task, about.
TASK_ROWS = 1_000_000


def _long_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The keys (__k) with rows in each of the first REACH ticks of a chunk.

    Rows less than a tick apart leave no tick between them empty. So of any other key, the rows that follow those of the chunk before
    without a gap of a tick end within REACH ticks.
    """
    at = F.pmod("__tick", F.lit(CHUNK))
    ticks = rows.where(at < REACH).groupBy(*keys, F.expr(f"(__tick - pmod(__tick, {CHUNK}))").alias("__chunk")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).alias("__bits"))
    return stored(ticks.where("__bits = -1").select(F.struct(*keys).alias("__k")).distinct(), "long")


def _folded(rows: DataFrame, keys: tuple[str, ...], columns: list[str], step: int, parts: int) -> DataFrame:
    """The intervals of keys that aren't long, in one pass over rows sorted by key, chunk and time.

    A chunk's task also gets the key's rows in the last tick before it and in the REACH ticks after it. Rows that follow others
    without a gap of a tick belong to the chunk in which the first of them lies; a time after such a gap begins an interval anyway.
    """
    at, chunk = F.pmod("__tick", F.lit(CHUNK)), F.expr(f"__tick - pmod(__tick, {CHUNK})")
    place = lambda by, side: F.struct((chunk + by * CHUNK).alias("__chunk"), F.lit(side).alias("__side"))
    places = F.when(at < REACH, F.array(place(0, 0), place(-1, 1))).when(at == CHUNK - 1, F.array(place(0, 0), place(1, -1))).otherwise(F.array(place(0, 0)))
    dealt = rows.select(*columns, F.inline(places)).withColumn("__hash", F.xxhash64(*keys, "__chunk"))
    dealt = dealt.repartition(parts, "__hash").sortWithinPartitions("__hash", *keys, "__chunk", "ts_ns", "msg_id")
    group = ["__hash", "__chunk", *keys]

    def changes(b, last) -> list:
        """Whether each row is the first of its key and chunk."""
        new = np.zeros(b.num_rows, bool)
        for name in group:
            c = b.column(name)
            c = pa.concat_arrays([c.slice(0, 1) if last is None else last.column(name), c])
            one, other = c.slice(1), c.slice(0, len(c) - 1)
            new |= pc.fill_null(pc.not_equal(one, other), False).to_numpy(zero_copy_only=False)
            if c.null_count:
                new |= pc.xor(pc.is_null(one), pc.is_null(other)).to_numpy(zero_copy_only=False)
        new[0] |= last is None
        return new.tolist()

    def run(batches):
        anchor = time = last = opened = None  # opened: the first row of the last interval, with its count and sum
        foreign = over = False
        for b in batches:
            if not b.num_rows:
                continue
            firsts, counts, sums = ([-1], [opened[1]], [opened[2]]) if opened else ([], [], [])
            for i, (new, side, ts, size) in enumerate(zip(changes(b, last), b.column("__side").to_pylist(), b.column("ts_ns").to_pylist(), b.column("length").to_pylist(), strict=True)):
                if new:
                    anchor = time = None
                    foreign = over = False
                if over:
                    continue
                if ts is None:
                    begin = new
                else:
                    if side < 0 or foreign and ts - time < step:
                        foreign, time = True, ts
                        continue
                    foreign = False
                    if side > 0 and (anchor is None or ts - time >= step):
                        over = True
                        continue
                    begin, time = anchor is None or ts - anchor >= step, ts
                if begin:
                    anchor = ts
                    firsts.append(i)
                    counts.append(1)
                    sums.append(size)
                else:
                    counts[-1] += 1
                    sums[-1] = size if sums[-1] is None else sums[-1] if size is None else sums[-1] + size
            last = b.slice(b.num_rows - 1, 1)
            if not firsts:
                continue
            held = opened[0] if opened else None
            heads = b.select(columns)
            if firsts[0] < 0 and len(firsts) > 1:
                yield with_sums(held, counts[:1], sums[:1])
            whole = slice(1 if firsts[0] < 0 else 0, -1)
            if firsts[whole]:
                yield with_sums(heads.take(pa.array(firsts[whole])), counts[whole], sums[whole])
            opened = held if firsts[-1] < 0 else heads.take(pa.array(firsts[-1:])), counts[-1], sums[-1]
        if opened:
            yield with_sums(opened[0], [opened[1]], [opened[2]])

    def with_sums(heads, counts, sums):
        return pa.record_batch([*heads.columns, pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=[*columns, "occurrences", "cumulative_length"])

    fields = [T.StructField(f.name, f.dataType) for f in rows.select(*columns).schema]
    return dealt.mapInArrow(run, T.StructType([*fields, T.StructField("occurrences", T.LongType()), T.StructField("cumulative_length", T.LongType())]))


_PLAIN = (T.StringType, T.IntegralType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def reduce_traffic(df: DataFrame, keys: tuple[str, ...] = REDUCE_KEYS, interval: float = 2.0, psl: DataFrame | None = None) -> DataFrame:
    """The first row of each key and interval with occurrences and cumulative_length; with psl, names first become registrable domains.

    An interval begins at the first row of a key that lies outside the one before, and holds the rows of the key before its
    begin + interval. Null keys equal each other; rows without a time are one interval of their key; of rows at one time the
    least msg_id is first. Rows are sorted once and folded by tasks of a chunk of time (see `_folded`); only keys with rows in
    each tick for long are followed from interval to interval, by pointer doubling (see `_followed`).
    """
    rows = df
    if psl is not None:
        rows = add_tld_plus_one(df, psl).withColumn("qname", F.when(F.col("etld_plus_one") == "-", F.col("qname")).otherwise(F.col("etld_plus_one"))).drop("etld_plus_one")
    step = int(interval * 1e9)
    rows = rows.withColumn("__tick", _tick("ts_ns", step))
    types = {f.name: f.dataType for f in rows.schema}
    if not all(isinstance(types[k], _PLAIN) for k in keys) or not isinstance(types["length"], T.IntegralType):
        return _followed(rows.withColumn("__k", F.struct(*keys)), keys, df.columns, step)
    many = _long_keys(rows, keys)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    if many.isEmpty():
        return _folded(rows, keys, df.columns, step, parts)
    keyed = rows.withColumn("__k", F.struct(*keys))
    same = keyed["__k"].eqNullSafe(many["__k"])
    short = keyed.join(many, same, "left_anti").drop("__k")
    return _folded(short, keys, df.columns, step, parts).unionByName(_followed(keyed.join(many, same, "left_semi"), keys, df.columns, step))


def _followed(rows: DataFrame, keys: tuple[str, ...], columns: list[str], step: int) -> DataFrame:
    """The intervals of any keys (__k, with __tick of each row): only a key's rows in neighbouring ticks are followed (see `_anchors`)."""
    rest = [c for c in columns if c not in keys]

    def folded(part: DataFrame, begin: str) -> DataFrame:
        first = F.min_by(F.struct(*rest), F.struct("ts_ns", "msg_id"))
        out = part.groupBy("__k", begin).agg(first.alias("__first"), F.count("*").alias("occurrences"), F.sum("length").alias("cumulative_length"))
        return out.select(*(F.col(f"__first.{c}" if c in rest else f"__k.{c}").alias(c) for c in columns), "occurrences", "cumulative_length")

    beside = stored(_beside(rows.where("ts_ns IS NOT NULL").select("__k", "__tick").distinct()), "ticks")
    if beside.isEmpty():
        return folded(rows, "__tick")
    near = rows.join(beside, ["__k", "__tick"], "left_semi")
    anchors = _anchors(near.select("__k", "__tick", F.col("ts_ns").alias("__ts")).distinct(), step)
    own = near.join(anchors, ["__k", "__tick"], "left")
    last = anchors.select("__k", (F.col("__tick") + 1).alias("__tick"), F.col("__anchor").alias("__last"))
    placed = own.join(last, ["__k", "__tick"], "left").withColumn("__begin", F.when(F.col("__anchor") <= F.col("ts_ns"), F.col("__anchor")).otherwise(F.col("__last")))
    return folded(rows.join(beside, ["__k", "__tick"], "left_anti"), "__tick").unionByName(folded(placed, "__begin"))


def new_domains(df: DataFrame, ttl: float = 3600.0, whitelist: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows that show a name not seen for `ttl` since its last first sighting; whitelisted and known names are never new.

    The anchor moves with each first sighting, so the rows of a name are folded in time order: a task streams through its
    names' rows, sorted on disk if need be, and keeps one number.
    """
    rows = df if whitelist is None else df.where(~F.col("qname").rlike(any_of(whitelist)))
    if known is not None:
        rows = rows.join(known.select("qname").distinct(), "qname", "left_anti").select(*df.columns)
    step = int(ttl * 1e9)

    def run(batches):
        name, anchor = None, 0
        for b in batches:
            keep = []
            for q, ts in zip(b.column("qname").to_pylist(), b.column("ts_ns").to_pylist(), strict=True):
                new = q != name or ts - anchor >= step
                if new:
                    name, anchor = q, ts
                keep.append(new)
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("qname").sortWithinPartitions("qname", "ts_ns", "msg_id").mapInArrow(run, rows.schema)


def reorder(df: DataFrame) -> DataFrame:
    """All rows in time order."""
    return df.orderBy("ts_ns", "msg_id")


def with_position(df: DataFrame, by: str = "identity", buffer: float = 30.0) -> DataFrame:
    """position: of each row in its stream's flush interval (buffer seconds) by time."""
    rows = sums_before(df.withColumn("flush", _tick("ts_ns", int(buffer * 1e9))), [by, "flush"], ["ts_ns", "msg_id"], "position")
    return rows.withColumn("position", F.col("position") + 1)


def flushed(df: DataFrame, by: str = "identity", buffer: float = 30.0, rows: int = 100) -> DataFrame:
    """Each stream's rows in flushes of a buffer: flush (its tick of `buffer` seconds), part (so many times it was full), position.

    Rows arrive in the order of ts_ns and msg_id. A flush is sorted by `timestamp`; a row whose timestamp is null (its text
    can't be read) keeps its place, the others fill the other places in time order, earlier arrivals first among equals.
    """
    out = with_position(df, by, buffer).withColumnRenamed("position", "__at")
    out = out.withColumns({"part": F.expr(f"(__at - 1) div {rows}"), "__at": (F.col("__at") - 1) % rows + 1, "__good": F.col("timestamp").isNotNull()})
    full = Window.partitionBy(by, "flush", "part")
    places = F.array_sort(F.collect_list(F.when(F.col("__good"), F.col("__at"))).over(full))  # at most `rows`
    order = F.row_number().over(Window.partitionBy(by, "flush", "part", "__good").orderBy("timestamp", "__at"))
    out = out.withColumns({"__places": places, "__order": order})
    return out.withColumn("position", F.when(F.col("__good"), F.get("__places", F.col("__order") - 1)).otherwise(F.col("__at"))).drop("__at", "__good", "__places", "__order")
