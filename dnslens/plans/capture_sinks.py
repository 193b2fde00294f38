"""Writers of capture files: a task streams through its rows, sorted by file, and holds one file open."""

from __future__ import annotations

import ipaddress
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.plans.shared import filesystem

FILES = "path string, records long, bytes long"


def _write_files(rows: DataFrame, folder: str, suffix: str, start: bytes, end: bytes, encode: Callable[[dict, dict], bytes], order: list[str]) -> DataFrame:
    """One file for each value of `file`, written under a temporary name and moved, so that a task may run twice; returns FILES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        done, memory, n, size = [], {}, 0, 0

        def close():
            out.write(end)
            out.close()
            store.move(temp, path)
            done.append((f"{folder}/{name}.{suffix}", n, size + len(end)))

        for b in batches:
            for r in b.to_pylist():
                if r["file"] != name:
                    if out is not None:
                        close()
                    name, memory, n, size = r["file"], {}, 0, len(start)
                    store, path = filesystem(f"{folder}/{name}.{suffix}")
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    temp = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                    out.write(start)
                record = encode(r, memory)
                out.write(record)
                n, size = n + 1, size + len(record)
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return rows.repartition("file").sortWithinPartitions("file", *order).mapInArrow(run, FILES)


def by_flow(identity: str, flow: list[str], files: int) -> Column:
    """The file of a packet: its stream and a hash of its flow, both ways alike."""
    return F.concat_ws("-", F.col(identity), F.pmod(F.xxhash64(F.array_sort(F.array(*flow))), F.lit(files)).cast("string"))


def _frame(r: dict, sent: dict) -> bytes:
    """A pcap record of an Ethernet frame; sent: the next sequence number of each TCP flow of the file."""
    ends = tuple(ipaddress.ip_address(r[k]) for k in ("src_ip", "dst_ip"))
    body, sport, dport = r["payload"], int(r["src_port"]), int(r["dst_port"])
    if r["protocol"] == "TCP":
        flow = (r["src_ip"], sport, r["dst_ip"], dport)
        body = len(body).to_bytes(2) + body
        seq = sent.get(flow, (1 << 32) - 100)  # soon past the end of the numbers
        sent[flow] = (seq + len(body)) % (1 << 32)
        segment = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 5 << 4, 16, 1024, 0, 0) + body
    else:
        segment = struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body
    number = 6 if r["protocol"] == "TCP" else 17
    if ends[0].version == 4:
        packet = b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(segment), 0, 0, 64, number, 0) + ends[0].packed + ends[1].packed + segment
    else:
        packet = b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(segment), number, 64) + ends[0].packed + ends[1].packed + segment
    frame = b"\0" * 12 + packet
    return struct.pack("<IIII", r["ts_ns"] // 10**9, r["ts_ns"] % 10**9, len(frame), len(frame)) + frame


def write_pcap(rows: DataFrame, folder: str) -> DataFrame:
    """Packets (file, ts_ns, protocol, the ends, payload) as pcap files with times in nanoseconds; returns FILES (lazily: act on it)."""
    start = b"\x4d\x3c\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 1 << 16, 1)
    columns = ["file", "ts_ns", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "payload"]
    return _write_files(rows.select(*columns), folder, "pcap", start, b"", _frame, ["ts_ns", "src_ip", "src_port"])


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(k: int, v: int | bytes) -> bytes:
    return _varint(k << 3) + _varint(v) if isinstance(v, int) else _varint(k << 3 | 2) + _varint(len(v)) + v


def _dnstap(r: dict, _: dict) -> bytes:
    query = r["dns_type"] == "QUERY"
    at, body = (8, 10) if query else (12, 14)
    nsec = _varint((at + 1) << 3 | 5) + int(r["ts_ns"] % 10**9).to_bytes(4, "little")
    message = _field(1, 5 if query else 6) + _field(4, ipaddress.ip_address(r["query_ip"]).packed) + _field(6, int(r["query_port"])) + _field(at, r["ts_ns"] // 10**9) + nsec + _field(body, r["payload"])
    top = _field(1, r["identity"].encode()) + _field(14, message) + _field(15, 1)
    return len(top).to_bytes(4) + top


def write_fstrm(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (file, identity, dns_type, ts_ns, query_ip, query_port, payload) as frame-stream files of dnstap messages; returns FILES (lazily)."""
    control = lambda kind: b"\0\0\0\0\0\0\0\x04" + kind.to_bytes(4)
    columns = ["file", "identity", "dns_type", "ts_ns", "query_ip", "query_port", "payload"]
    return _write_files(rows.select(*columns), folder, "fstrm", control(2), control(3), _dnstap, ["ts_ns", "query_ip", "query_port"])
