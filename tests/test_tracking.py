"""Repeats, first sightings and ordered flushes, in batch and as streams, against folds in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from dnslens.operators import state
from dnslens.streaming import stateful, tracking

S = 1_000_000_000
SCHEMA = "msg_id long, ts_ns long, key string, other long, length long"


def folded(rows, interval):
    """(msg_id of the first row, occurrences, summed length) of each interval."""
    out, open_ = [], {}
    for msg_id, ts, key, other, length in sorted(rows, key=lambda r: (r[1], r[0])):
        got = open_.get((key, other))
        if got is None or ts >= got[3] + interval:
            got = open_[key, other] = [msg_id, 0, 0, ts]
            out.append(got)
        got[1] += 1
        got[2] += length
    return sorted((a, b, c) for a, b, c, _ in out)


def some_rows(seed, n, keys):
    """Most rows are of one key, dense enough for chains of many intervals; others are sparse; times repeat."""
    rng = random.Random(seed)
    return [(i, 1000 * S + rng.randrange(0, 60 * 1000) * S // 1000 if (k := rng.choice([*keys, keys[0], keys[0]])) else (1000 + rng.randrange(5) * 30) * S, k, rng.choice([1, None]), rng.randrange(9)) for i in range(n)]


@pytest.mark.parametrize("interval", [2.0, 0.5, 100.0])
def test_repeats_fold_at_anchors(spark, interval):
    rows = some_rows(5, 700, ["a", "b", None])
    got = state.reduce_traffic(spark.createDataFrame(rows, SCHEMA), ("key", "other"), interval)
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "occurrences", "cumulative_length"]
    assert sorted((r.msg_id, r.occurrences, r.cumulative_length) for r in got.collect()) == folded(rows, int(interval * S))


def test_repeats_across_a_tick_are_one(spark):
    """1.9 s and 2.1 s lie in different ticks of 2 s, but in one interval."""
    rows = [(1, 19 * S // 10, "a", 1, 5), (2, 21 * S // 10, "a", 1, 6), (3, 39 * S // 10, "a", 1, 7), (4, None, "a", 1, 8)]
    got = state.reduce_traffic(spark.createDataFrame(rows, SCHEMA), ("key",))
    assert sorted((r.msg_id, r.occurrences, r.cumulative_length) for r in got.collect()) == [(1, 2, 11), (3, 1, 7), (4, 1, 8)]
    assert state.reduce_traffic(spark.createDataFrame([], SCHEMA), ("key",)).count() == 0


def test_repeats_are_folded_in_one_pass_unless_long(spark, monkeypatch):
    """Runs of rows over the ends of chunks, gaps of just a tick, null keys, times and lengths, and keys that fill all ticks."""
    rng, step, rows = random.Random(4), 1000, []
    span = step * state.CHUNK
    for k in range(60):
        key = f"k{k}" if k else None
        for edge in (-1, 0, 1, 3):
            width, n = (150 * step, 4000) if k % 20 == 19 else (rng.randrange(step, 40 * step), rng.randrange(1, 80))
            rows += [(key, edge * span + rng.randrange(-width, width) // (500 if k % 4 else 1) * (500 if k % 4 else 1)) for _ in range(n)]
        rows += [(key, None)] * (k % 3)
    rows = [(i, t, key, 1, None if i % 7 == 0 else i % 90) for i, (key, t) in enumerate(rows)]
    df, seen, real = spark.createDataFrame(rows, SCHEMA).repartition(5), [], state._followed
    monkeypatch.setattr(state, "_followed", lambda part, *more: seen.append({r.key for r in part.select("key").distinct().collect()}) or real(part, *more))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = state.reduce_traffic(df, ("key", "other"), step / 1e9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.msg_id, r.occurrences, r.cumulative_length or 0) for r in got) == folded([(i, -10 * span if t is None else t, key, 1, n or 0) for i, t, key, _, n in rows], step)
    assert seen == [{f"k{k}" for k in range(60) if k % 20 == 19}]  # the others aren't followed from interval to interval
    assert state.reduce_traffic(df.where("false"), ("key", "other"), step / 1e9).count() == 0
    assert state.reduce_traffic(df.where("ts_ns is null"), ("key", "other"), step / 1e9).count() == sum(1 for k in range(60) if k % 3)


def stream_of(spark, path, df):
    stateful.in_time_order(df, path)
    return stateful.with_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))


def test_stream_of_repeats(spark, tmp_path):
    rows = some_rows(6, 400, ["a", "b", None])
    df = spark.createDataFrame([*rows, (-1, 9_000 * S, "end", 1, 0)], SCHEMA)
    out = stateful.run_once(tracking.reduce_traffic(stream_of(spark, f"{tmp_path}/in", df), ("key", "other")), f"{tmp_path}/run")
    assert sorted((r.msg_id, r.occurrences, r.cumulative_length) for r in out.where("msg_id >= 0").collect()) == folded(rows, 2 * S)


def test_seeded_stream_of_names(spark, tmp_path):
    """A name that the seed knows is new again only after its time to live; names of the last run become the next seed."""
    df = spark.createDataFrame([(1, 5 * S, "seeded"), (2, 12 * S, "seeded"), (3, 5 * S, "fresh"), (4, 6 * S, "fresh"), (5, 7 * S, "x.skip"), (6, None, "none")], "msg_id long, ts_ns long, qname string")
    known = spark.createDataFrame([("seeded", 1 * S), ("seeded", 2 * S)], "qname string, ts_ns long")
    out = stateful.run_once(tracking.new_domains(stream_of(spark, f"{tmp_path}/in", df), 10.0, ["skip$"], known), f"{tmp_path}/run")
    assert sorted(r.msg_id for r in out.collect()) == [2, 3]
    names = {r.qname: r.ts_ns for r in tracking.known_names(spark, f"{tmp_path}/run/checkpoint").collect()}
    assert names["seeded"] == 12 * S


def flushes(rows, size):
    """Rows in flushes of `size`; in each, rows without a time keep their place and the others are sorted."""
    out = []
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        good = iter(sorted((r for r in part if r[1] is not None), key=lambda r: r[1]))
        out += [(lo // size, k + 1, (r if r[1] is None else next(good))[0]) for k, r in enumerate(part)]
    return out


def test_reorder_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, None if rng.random() < 0.2 else rng.randrange(1000), 990 * S + i * S // 10, "s") for i in range(57)]
    df = spark.createDataFrame(rows, "msg_id long, sec long, ts_ns long, identity string").withColumn("timestamp", F.timestamp_seconds("sec"))
    want = flushes(rows, 10)
    got = state.flushed(df, "identity", 30.0, 10)
    assert sorted((r.part, r.position, r.msg_id) for r in got.collect()) == want
    end = df.limit(1).withColumns({"msg_id": F.lit(-1).cast("long"), "ts_ns": F.lit(2000 * S), "identity": F.lit("end")})
    stream = stream_of(spark, f"{tmp_path}/in", df.unionByName(end))
    out = stateful.run_once(tracking.reorder(stream, rows=10), f"{tmp_path}/run").where("msg_id >= 0")
    assert sorted((r.flush, r.position, r.msg_id) for r in out.collect()) == want


def test_reorder_flushes_by_time(spark):
    """The second trigger: rows that arrive in another tick of the buffer are in another flush."""
    df = spark.createDataFrame([(1, 10, 1 * S), (2, 5, 29 * S), (3, 1, 31 * S)], "msg_id long, sec long, ts_ns long").withColumns({"timestamp": F.timestamp_seconds("sec"), "identity": F.lit("s")})
    got = state.flushed(df, "identity", 30.0, 100)
    assert sorted((r.flush, r.part, r.position, r.msg_id) for r in got.collect()) == [(0, 0, 1, 2), (0, 0, 2, 1), (1, 0, 1, 3)]


def test_streams_keep_one_state_a_bucket(spark, tmp_path):
    """Many keys cost a few calls into the state store, not one each; replies, timeouts and columns with nulls come out as in batch."""
    from dnslens.operators import pairing
    from dnslens.streaming import buckets

    big = (1 << 60) + 1
    rows = [(i, 1000 * S + i * S // 100, "192.0.2.1", str(1024 + i // 2), 5, "QUERY" if i % 2 == 0 else "REPLY", False, None if i % 4 else big) for i in range(0, 400) if i % 10 != 9]
    log = spark.createDataFrame(rows, "msg_id long, ts_ns long, query_ip string, query_port string, dns_id long, dns_type string, malformed boolean, length long")
    stream = stream_of(spark, f"{tmp_path}/in", log.unionByName(stateful.closing_row(log)))
    out = stateful.run_once(stateful.unanswered(stream), f"{tmp_path}/run").where("msg_id >= 0")
    want = pairing.unanswered(log.withColumn("rcode", F.lit("-"))).where("rcode = 'TIMEOUT'")
    assert sorted(r.msg_id for r in out.collect()) == sorted(r.msg_id for r in want.collect()) == [i for i in range(0, 400, 2) if (i + 1) % 10 == 9]
    state = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/run/checkpoint")
    assert set(state.select("key.*").columns) == {"bucket"} and state.count() <= buckets.BUCKETS
    row = log.select(buckets.packed(*log.columns).alias("x"), "length")
    assert row.where(~buckets.unpacked("x", log.schema)["length"].eqNullSafe(F.col("length"))).count() == 0
