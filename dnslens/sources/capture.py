"""Capture files: packets of pcap files and messages of frame-stream files.

Large files are read by byte range with the data source of `capture_source`; small ones may come whole as rows (path,
content) from Spark's binaryFile source. Fragments of IP datagrams are put together by datagram, and TCP payloads that span
packets by flow, in sequence order, wherever in the file their parts were read.
"""

from __future__ import annotations

import ipaddress
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "path string, ts_ns long, protocol string, src_ip string, src_port string, dst_ip string, dst_port string, seq long, body binary, ip_defragmented boolean"


def read_files(spark: SparkSession, folder: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """path, content. As a stream, new files are read as they come."""
    if not stream:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    kind = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", pattern).load(folder).select("path", "content")


#: IPv6 extension headers before the payload, and the one of fragments.
_EXTENSIONS, _FRAGMENT = {0, 43, 60}, 44
#: Fragments that are older by the capture's clock wait no longer.
FRAGMENT_NS = 30_000_000_000


def _datagram(frame: bytes):
    """(protocol, src, dst, payload, fragment) of an Ethernet frame; fragment: None or (id, offset, more follow)."""
    kind = frame[12:14]
    if kind == b"\x08\x00" and len(frame) >= 34:
        head, size, ident, part = (frame[14] & 15) * 4, *struct.unpack_from(">HHH", frame, 16)
        fragment = (ident, (part & 0x1FFF) * 8, bool(part & 0x2000)) if part & 0x3FFF else None
        return frame[23], frame[26:30], frame[30:34], frame[14 + head : 14 + size], fragment
    if kind == b"\x86\xdd" and len(frame) >= 54:
        proto, rest, fragment = frame[20], frame[54 : 54 + int.from_bytes(frame[18:20])], None
        while (proto in _EXTENSIONS or proto == _FRAGMENT) and len(rest) >= 8:
            if proto == _FRAGMENT:
                part, ident = struct.unpack_from(">HI", rest, 2)
                fragment = (ident, part & 0xFFF8, bool(part & 1))
                proto, rest = rest[0], rest[8:]
                break
            proto, rest = rest[0], rest[(rest[1] + 1) * 8 :]
        return proto, frame[22:38], frame[38:54], rest, fragment
    return None


class Fragments:
    """Datagrams whose parts are still missing, by ends, protocol and id; the oldest go first."""

    def __init__(self):
        self.open: dict[tuple, tuple[int, dict[int, bytes], list[int]]] = {}

    def add(self, key: tuple, at: int, more: bool, part: bytes, ts: int) -> bytes | None:
        """The whole datagram, if this part completes it. Of parts that overlap, the first bytes count."""
        while self.open and ts - (oldest := next(iter(self.open.items())))[1][0] > FRAGMENT_NS:
            del self.open[oldest[0]]
        _, parts, end = self.open.setdefault(key, (ts, {}, []))
        parts.setdefault(at, part)
        if not more:
            end.append(at + len(part))
        whole = b""
        for offset in sorted(parts):
            if offset > len(whole):
                return None
            whole += parts[offset][len(whole) - offset :]
        if not end or len(whole) < end[0]:
            return None
        del self.open[key]
        return whole[: end[0]]


def split_packets(content: bytes, port: int):
    """(ts_ns, protocol, src, sport, dst, dport, seq, body, ip_defragmented) of UDP and TCP packets of a port, from Ethernet frames."""
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}.get(content[:4])
    if order is None:
        return
    end, scale = order
    at = 24
    while at + 16 <= len(content):
        sec, frac, size, _ = struct.unpack_from(f"{end}IIII", content, at)
        frame, at = content[at + 16 : at + 16 + size], at + 16 + size
        if (found := packet(frame, sec * 1_000_000_000 + frac * scale, port)) is not None:
            yield found


def packet(frame: bytes, ts: int, port: int) -> tuple | None:
    """A row of PACKETS (without path) of an Ethernet frame; None if it is of no concern. A fragment is a row of protocol FRAGMENT."""
    found = _datagram(frame)
    if found is None:
        return None
    proto, src, dst, rest, fragment = found
    if fragment is not None:
        ident, offset, more = fragment
        return ts, "FRAGMENT", str(ipaddress.ip_address(src)), str(proto), str(ipaddress.ip_address(dst)), str(ident), offset << 1 | more, rest, True
    return transport(proto, str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst)), rest, ts, port, False)


def transport(proto: int, src: str, dst: str, rest: bytes, ts: int, port: int, fragmented: bool) -> tuple | None:
    """A row of PACKETS (without path) of a whole datagram, if it is UDP or TCP of the port."""
    if proto == 17 and len(rest) >= 8:
        sport, dport = struct.unpack_from(">HH", rest)
        if port in (sport, dport):
            return ts, "UDP", src, str(sport), dst, str(dport), 0, rest[8:], fragmented
    elif proto == 6 and len(rest) >= 20:
        sport, dport, seq = struct.unpack_from(">HHI", rest)
        body = rest[(rest[12] >> 4) * 4 :]
        if port in (sport, dport) and body:
            return ts, "TCP", src, str(sport), dst, str(dport), seq, body, fragmented
    return None


#: Packets in one record batch.
ROWS = 4096
_NAMES = [x.split()[0] for x in PACKETS.split(", ")]
_KINDS = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.bool_()]


def packet_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of PACKETS in batches of ROWS."""
    while some := list(itertools.islice(rows, ROWS)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _KINDS, strict=True)], names=_NAMES)


def packets(files: DataFrame, port: int = 53) -> DataFrame:
    """PACKETS of whole files (path, content)."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from packet_batches((path, *p) for p in split_packets(content or b"", port))

    return defragmented(files.mapInArrow(run, PACKETS), port)


def defragmented(rows: DataFrame, port: int = 53) -> DataFrame:
    """PACKETS in which the parts of a datagram (rows of protocol FRAGMENT) became its packet, at the time of the part that completed it."""
    datagram = ["path", "src_ip", "dst_ip", "src_port", "dst_port"]  # the ports hold protocol and id

    def run(batches):
        def whole():
            at, open_parts = None, Fragments()
            for b in batches:
                for path, ts, _, src, proto, dst, ident, place, body, _ in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
                    if (path, src, dst, proto, ident) != at:
                        at, open_parts = (path, src, dst, proto, ident), Fragments()
                    rest = open_parts.add(at, place >> 1, bool(place & 1), body, ts)
                    if rest is not None and (found := transport(int(proto), src, dst, rest, ts, port, True)) is not None:
                        yield path, *found

        yield from packet_batches(whole())

    parts = rows.where("protocol = 'FRAGMENT'").repartition(*datagram).sortWithinPartitions(*datagram, "ts_ns", "seq")
    return rows.where("protocol <> 'FRAGMENT'").unionByName(parts.mapInArrow(run, PACKETS))


def messages(rows: DataFrame) -> DataFrame:
    """Packets as DNS messages: ts_ns, protocol, the ends, payload, tcp_reassembled, ip_defragmented.

    Each TCP flow is read in sequence order, which may pass 2 ** 32: a segment's place is that of the segment before it in
    time plus the shorter way round. Bytes that were sent before are cut; after a gap the message that it broke is given up,
    and the next segment is taken as the start of a message.
    """
    keep = ["path", "ts_ns", "protocol", "src_ip", "src_port", "dst_ip", "dst_port"]
    udp = rows.where("protocol = 'UDP'").select(*keep, F.col("body").alias("payload"), F.lit(False).alias("tcp_reassembled"), "ip_defragmented")

    ends = ["path", "src_ip", "src_port", "dst_ip", "dst_port"]

    def unwrapped(batches):
        # packets in flow and time order
        at, place, last = None, 0, 0
        for b in batches:
            places = []
            for *key, seq in zip(*(b.column(c).to_pylist() for c in (*ends, "seq")), strict=True):
                place = seq if key != at else place + (seq - last + (1 << 31)) % (1 << 32) - (1 << 31)
                at, last = key, seq
                places.append(place)
            yield b.set_column(_NAMES.index("seq"), "seq", pa.array(places, pa.int64()))

    def flows(batches):
        # packets in flow and sequence order: a task holds one message at a time
        at, expected, data, parts = None, 0, b"", False
        for b in batches:
            out = []
            for r in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
                path, ts, _, src, sport, dst, dport, seq, body, fragmented = r
                if (path, src, sport, dst, dport) != at:
                    at, expected, data, parts = (path, src, sport, dst, dport), seq, b"", False
                if seq + len(body) <= expected:  # sent again
                    continue
                if seq > expected:
                    data, parts = b"", False
                else:
                    body = body[expected - seq :]
                expected = max(expected, seq) + len(body)
                whole, data, parts = not data, data + body, parts or fragmented
                while len(data) >= 2 and len(data) >= 2 + int.from_bytes(data[:2]):
                    n = int.from_bytes(data[:2])
                    out.append((path, ts, "TCP", src, sport, dst, dport, data[2 : 2 + n], not whole, parts))
                    whole, data = True, data[2 + n :]
                parts = parts and bool(data)
            cols = list(zip(*out, strict=True)) or [[]] * 10
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.bool_(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*keep, "payload", "tcp_reassembled", "ip_defragmented"])

    timed = rows.where("protocol = 'TCP'").repartition(*ends).sortWithinPartitions(*ends, "ts_ns", "seq").mapInArrow(unwrapped, PACKETS)
    tcp = timed.sortWithinPartitions(*ends, "seq", "ts_ns").mapInArrow(flows, udp.schema)
    return udp.unionByName(tcp)


def capture_files(spark: SparkSession, folder: str, port: int = 53, split_bytes: int = 64 << 20) -> DataFrame:
    """The DNS messages of a folder of pcap files, read in parts of about split_bytes."""
    from dnslens.sources.capture_source import CaptureSource

    spark.dataSource.register(CaptureSource)
    rows = spark.read.format("dns_capture").options(path=folder, port=port, splitBytes=split_bytes).load()
    return messages(defragmented(rows, port))


def _fields(raw: bytes):
    """(number, value) of a protobuf message: varints as numbers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            x = raw[at]
            at += 1
            n |= (x & 127) << shift
            if x < 128:
                return n
            shift += 7

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


#: Field numbers of the public dnstap schema.
_MESSAGE = {1: "type", 2: "socket_family", 3: "socket_protocol", 4: "query_address", 5: "response_address", 6: "query_port", 7: "response_port", 8: "query_time_sec", 9: "query_time_nsec", 10: "query_message", 12: "response_time_sec", 13: "response_time_nsec", 14: "response_message"}
FRAMES = "path string, identity string, version string, type long, query_address string, query_port long, response_address string, response_port long, query_time_sec long, query_time_nsec long, response_time_sec long, response_time_nsec long, payload binary"


def split_frames(content: bytes):
    """Data frames of a frame-stream file; control frames (length 0, then their own length) are passed over."""
    at = 0
    while at + 4 <= len(content):
        n = int.from_bytes(content[at : at + 4])
        if n == 0:
            at += 8 + int.from_bytes(content[at + 4 : at + 8])
            continue
        if at + 4 + n > len(content):
            return
        yield content[at + 4 : at + 4 + n]
        at += 4 + n


def frame_row(path: str, raw: bytes) -> dict:
    """A row of FRAMES of a dnstap message."""
    top = dict(_fields(raw))
    m = {_MESSAGE[k]: v for k, v in _fields(top.get(14, b"")) if k in _MESSAGE}
    text = lambda a: str(ipaddress.ip_address(a)) if a else None
    known = {k: m.get(k) for k in ("type", "query_port", "response_port", "query_time_sec", "response_time_sec")}
    nsec = {k: int.from_bytes(m[k], "little") if k in m else None for k in ("query_time_nsec", "response_time_nsec")}
    payload = m.get("query_message") if (m.get("type") or 0) % 2 else m.get("response_message")
    return {"path": path, "identity": top.get(1, b"").decode("utf-8", "replace"), "version": top.get(2, b"").decode("utf-8", "replace"), **known, **nsec, "query_address": text(m.get("query_address")), "response_address": text(m.get("response_address")), "payload": payload}


def frame_batches(found: Iterator[tuple[str, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of FRAMES in batches of ROWS."""
    while some := list(itertools.islice(found, ROWS)):
        yield pa.RecordBatch.from_pylist([frame_row(*f) for f in some], schema=schema)


def frames(files: DataFrame) -> DataFrame:
    """One row per dnstap message of frame-stream files."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FRAMES))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from frame_batches(((path, f) for f in split_frames(content or b"")), schema)

    return files.mapInArrow(run, StructType.fromDDL(FRAMES))


def fstrm_files(spark: SparkSession, folder: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The dnstap messages of a folder of frame-stream files, read in parts of about split_bytes."""
    from dnslens.sources.capture_source import CaptureSource

    spark.dataSource.register(CaptureSource)
    return spark.read.format("dns_capture").options(path=folder, kind="fstrm", splitBytes=split_bytes).load()
