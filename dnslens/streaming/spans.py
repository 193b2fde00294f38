"""Trace spans as a stream: the state of a trace is its open spans, its responses and whether its client query was seen."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.streaming.buckets import Bucket, in_buckets

SPAN = "identity string, message_id string, parent_id string, operation string, qname string, start_ns long, end_ns long, error string"
CLIENT = "CLIENT_QUERY"


class _Traces(Bucket):
    """Of each trace: open spans, responses, its end and whether its client query was seen.

    Spans leave when they have their response and their parent; the others when their trace has had no row for `step`.
    """

    def __init__(self, step: int):
        self.step = step

    def take(self, states: dict, rows: list) -> Iterator[tuple]:
        touched = {}
        for ts_ns, operation, identity, root, message_id, asked, qname, rcode in rows:
            key = (identity, root)
            touched[key] = None
            state = states.get(key)
            if state is not None and ts_ns >= state[2]:  # the trace of before is over, whatever its timer
                yield from self.end(states, key, 0)
                state = None
            held, replies, until, client = state or ([], {}, 0, False)
            if operation.endswith("_QUERY"):
                held.append((message_id, asked is not None and operation != CLIENT, operation, qname, ts_ns))
                client = client or operation == CLIENT
            else:
                reply = (ts_ns, rcode)
                replies[message_id] = min(reply, replies.get(message_id, reply), key=lambda x: (x[0], x[1] or ""))
            states[key] = (held, replies, max(until, ts_ns + self.step), client)
        for key in touched:
            held, replies, until, client = states[key]
            settled = [x for x in held if self._reply(x, replies) and (client or not x[1])]
            yield from self._spans(key, settled, replies, client)
            states[key] = ([x for x in held if x not in settled], replies, until, client)

    def due(self, state: tuple) -> int:
        return state[2]

    def end(self, states: dict, key, now: int) -> Iterator[tuple]:
        held, replies, _, client = states.pop(key)
        yield from self._spans(key, held, replies, client)

    def _reply(self, span: tuple, replies: dict) -> tuple | None:
        reply = replies.get(span[0])
        return reply if reply and span[4] <= reply[0] < span[4] + self.step else None

    def _spans(self, key: tuple, held: list, replies: dict, client: bool) -> Iterator[tuple]:
        for x in held:
            message_id, child, operation, qname, start = x
            end, rcode = self._reply(x, replies) or (None, None)
            error = "timeout" if end is None else "" if rcode is None or rcode == "NOERROR" else rcode
            yield (key[0], message_id, key[1] if child and client else None, operation, qname, start, end, error)


def trace_spans(stream: DataFrame, max_span: float = 120.0) -> DataFrame:
    """As operators.pairing.trace_spans, for a stream with the column ts of `stateful.with_time`.

    A trace is what a client's message id holds together: rows of CLIENT operations by their message_id, others by their
    initial_request_id, which responses carry as their queries do (without one a row is a trace by its message_id). It is over
    when it has had no row for max_span: a parent may come that much later than its children, and what is still open then is a
    timeout or a root. Of several responses that have come the first in time counts; a span that was emitted isn't changed. Rows
    without a time, an operation or a message id are dropped. A bucket of traces' rows of one micro-batch are sorted in memory.
    """
    client = F.col("operation").startswith("CLIENT_")
    root = F.when(client, F.col("message_id")).otherwise(F.coalesce("initial_request_id", "message_id"))
    rows = stream.where("ts_ns IS NOT NULL AND message_id IS NOT NULL AND (operation LIKE '%\\_QUERY' OR operation LIKE '%\\_RESPONSE')")
    columns = {c: F.col(c) for c in ("ts_ns", "operation", "identity", "root", "message_id", "initial_request_id", "qname", "rcode")}
    spans = in_buckets(rows.withColumn("root", root), ("identity", "root"), columns, _Traces(int(max_span * 1e9)), SPAN)
    trace = F.sha1(F.coalesce("parent_id", "message_id").cast("binary"))
    return spans.select("identity", trace.alias("trace_id"), F.col("message_id").alias("span_id"), "parent_id", "operation", "qname", "start_ns", "end_ns", "error")
