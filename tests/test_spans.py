"""Trace spans of a stream: the batch form's rows, with parents that come late and spans that expire."""

from pyspark.sql import functions as F

from dnslens.operators import pairing
from dnslens.streaming import spans, stateful

S = 1_000_000_000
SCHEMA = "msg_id long, identity string, message_id string, initial_request_id string, operation string, qname string, rcode string, ts_ns long"


def test_stream_of_spans_equals_batch(spark, tmp_path):
    rows, k = [], 0
    for t in range(60):
        at = 1000 * S + t * 7 * S
        late = 30 * S if t % 4 == 0 else 0  # the client's query comes after what it caused
        rows.append((f"c{t}", None, "CLIENT_QUERY", "NOERROR", at + late))
        if t % 3:
            rows.append((f"c{t}", None, "CLIENT_RESPONSE", "SERVFAIL" if t % 5 == 0 else "NOERROR", at + late + 2 * S))
        for j in range(t % 4):
            rows.append((f"r{t}-{j}", f"c{t}" if j else None, "RESOLVER_QUERY", "NOERROR", at + S + j))
            if j != 1:
                rows.append((f"r{t}-{j}", f"c{t}" if j else None, "RESOLVER_RESPONSE", "NXDOMAIN", at + S + 5 * j * S))
        rows.append((f"orphan{t}", f"none{t}", "FORWARDER_QUERY", "NOERROR", at))
        rows.append((f"orphan{t}", f"none{t}", "FORWARDER_RESPONSE", "NOERROR", at + 130 * S))  # after the span's end
    log = spark.createDataFrame([(k, "ns", m, i, o, f"q{m}", r, ts) for k, (m, i, o, r, ts) in enumerate(rows)], SCHEMA)
    last = spark.createDataFrame([(-1, "ns", "last", None, "CLIENT_QUERY", "", "", 5000 * S)], SCHEMA)
    path = str(tmp_path / "in")
    stateful.in_time_order(log.unionByName(last), path)
    stream = stateful.with_time(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path))
    got = stateful.run_once(spans.trace_spans(stream), str(tmp_path / "run")).where("span_id <> 'last'")
    want = pairing.trace_spans(log)
    assert got.columns == want.columns
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted(map(tuple, want.collect()), key=str)
    assert len({r[8] for r in found}) == 4 and any(r[3] for r in found) and len(found) == log.where(F.col("operation").endswith("QUERY")).count()


def test_traces_of_a_bucket_share_a_state():
    """What is open stays in the bucket's dict under its trace, and leaves as a timeout when the trace is due."""
    traces, states = spans._Traces(120 * S), {}
    row = lambda at, kind, trace, rcode=None: (at, f"CLIENT_{kind}", "ns", trace, trace, None, f"q{trace}", rcode)
    out = list(traces.take(states, [row(S, "QUERY", "a"), row(S, "QUERY", "b"), row(2 * S, "RESPONSE", "a", "NOERROR")]))
    assert [(r[1], r[-1]) for r in out] == [("a", "")] and set(states) == {("ns", "a"), ("ns", "b")}
    assert [(r[1], r[-1]) for r in traces._ended(states, 121_000)] == [("b", "timeout")] and set(states) == {("ns", "a")}
