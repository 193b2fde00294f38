"""A data source of capture files that reads each file in byte ranges, in batch and as a stream.

    spark.dataSource.register(CaptureSource)
    spark.read.format("dns_capture").options(path=folder, kind="pcap", splitBytes=64 << 20).load()

A part begins at the first record head at or after its first byte, and ends with the record that begins before its last. A
head is found by its plausibility, by what its record holds (an IP packet that fits its frame, a message whose fields end where
it ends), and by the plausibility of the CHAIN records after it (fewer at the end of the file); these alone can't tell, as the
length of a false head may lead to a true one far away. The search begins BACK bytes before the part, so that a file that is
cut off at its end has records enough for a chain. Small parts, of one file or several, are read by one
task: about TASKS tasks in all until a task has TASK_BYTES. Files are opened by pyarrow, so their store must be one that it knows. As a stream, a file is read once, when it appears in the folder: files are
taken in the order of their times of change and paths, and the last of them is the offset.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dnslens.plans.shared import filesystem
from dnslens.sources import capture

#: Records that must follow in a row before bytes count as a head; the longest record; bytes read at once.
CHAIN, LONGEST, READ = 16, 1 << 20, 4 << 20
#: Bytes before a part at which the search for its first record begins.
BACK = 1 << 14
#: Tasks that parts are dealt to, about, while each has fewer bytes than TASK_BYTES.
TASKS, TASK_BYTES = 64, 64 << 20
#: Tags of the fields of a dnstap frame: identity, version, extra, message (with a size) and type (a number).
TAGS = (10, 18, 26, 114, 120)


@dataclass
class Part(InputPartition):
    path: str
    lo: int
    hi: int
    size: int

    def __post_init__(self):
        super().__init__(self.lo)


class Group(InputPartition):
    """Parts that one task reads."""

    def __init__(self, parts: list[Part]):
        super().__init__(None)
        self.parts = parts


class _Bytes:
    """A file's bytes from a place on, held in a window that moves forward."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes at a place not before the last one; fewer at the end of the file."""
        if at + n > self.at + len(self.data):
            self.data = self.data[at - self.at :] if at <= self.at + len(self.data) else b""
            self.at = at
            need = max(READ, n) - len(self.data)
            start = self.at + len(self.data)
            self.data += self.file.read_at(min(need, max(0, self.size - start)), start)
        return self.data[at - self.at : at - self.at + n]


class _Pcap:
    """Records of a pcap file: a head of 16 bytes and a frame."""

    first, head = 24, 16

    def __init__(self, start: bytes):
        order = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}.get(start[:4])
        self.known = order is not None and len(start) >= 40
        if self.known:
            self.end, self.scale = order
            self.limit = 1_000_000_000 // self.scale
            self.since = struct.unpack_from(f"{self.end}I", start, 24)[0]

    def length(self, head: bytes) -> int | None:
        """The bytes of a record whose head this can be."""
        sec, frac, size, whole = struct.unpack(f"{self.end}IIII", head)
        near = abs(sec - self.since) < 10 * 366 * 86400
        return 16 + size if near and frac < self.limit and 14 <= size <= min(whole, LONGEST) else None

    def holds(self, head: bytes, body: bytes) -> bool:
        """Whether a frame holds an IP packet that fits it, as it was before the capture cut it; others become no row, so a part need not begin at one."""
        kind, whole = body[12:14], struct.unpack(f"{self.end}IIII", head)[3]
        if kind == b"\x08\x00":
            return len(body) >= 34 and body[14] >> 4 == 4 and 20 <= int.from_bytes(body[16:18]) <= whole - 14
        if kind == b"\x86\xdd":
            return len(body) >= 54 and body[14] >> 4 == 6 and int.from_bytes(body[18:20]) <= whole - 54
        return False

    def row(self, head: bytes, body: bytes, port: int) -> tuple | None:
        sec, frac, _, _ = struct.unpack(f"{self.end}IIII", head)
        return capture.packet(body, sec * 1_000_000_000 + frac * self.scale, port)


class _Fstrm:
    """Frames of a frame stream: a length and a message, or 0, a length and a control frame."""

    first, head = 0, 8
    known = True

    def __init__(self, start: bytes):
        pass

    def length(self, head: bytes) -> int | None:
        n, next_ = struct.unpack(">II", head)
        if n == 0:
            return 8 + next_ if 4 <= next_ <= 512 else None
        return 4 + n if 4 <= n <= LONGEST and head[4] in TAGS else None

    @staticmethod
    def holds(head: bytes, body: bytes) -> bool:
        """Whether a message's fields are those of dnstap and end where it ends."""
        if head[:4] == b"\0\0\0\0":
            return len(body) == int.from_bytes(head[4:])
        raw, at = head[4:] + body, 0
        while at < len(raw):
            tag, size, shift = raw[at], 0, 0
            at += 1
            if tag not in TAGS:
                return False
            while True:  # a varint: the value itself, or the size of what follows
                if at >= len(raw) or shift > 63:
                    return False
                byte, at = raw[at], at + 1
                size, shift = size | (byte & 127) << shift, shift + 7
                if byte < 128:
                    break
            if tag & 7 == 2:
                at += size
        return at == len(raw)

    def row(self, head: bytes, body: bytes, port: int) -> bytes | None:
        return None if head[:4] == b"\0\0\0\0" else head[4:] + body


def _synced(data: _Bytes, kind: _Pcap | _Fstrm, at: int, size: int) -> int:
    """The first record head at or after a place; the end of the file if there is none."""
    while at < size:
        place, left = at, CHAIN
        while left and place < size:
            head = data.file.read_at(min(kind.head, size - place), place) if place + kind.head > data.at + len(data.data) or place < data.at else data.get(place, kind.head)
            length = kind.length(head) if len(head) == kind.head else None
            if length is None or place + length > size:
                break
            if place == at and not kind.holds(head, data.file.read_at(length - kind.head, place + kind.head)):
                break
            place, left = place + length, left - 1
        if not left or place == size:
            return at
        at += 1
        data.get(at, min(kind.head, size - at))
    return size


def records(part: Part, kind_name: str, port: int) -> Iterator:
    """What the records of a part hold."""
    store, path = filesystem(part.path)
    with store.open_input_file(path) as file:
        kind = (_Pcap if kind_name == "pcap" else _Fstrm)(file.read_at(min(64, part.size), 0))
        if not kind.known:
            return
        at = max(part.lo - BACK, kind.first)
        data = _Bytes(file, at, part.size)
        if at > kind.first:
            at = _synced(data, kind, at, part.size)
            data = _Bytes(file, at, part.size)
        while at < part.hi:
            head = data.get(at, kind.head)
            length = kind.length(head) if len(head) == kind.head else None
            if length is None or at + length > part.size:
                return  # a record that is cut off, as at the end of a file that was being written
            if at < part.lo:
                at += length
                continue
            row = kind.row(head, data.get(at, length)[kind.head :], port)
            if row is not None:
                yield row
            at += length


class _Source:
    """What batch and stream share: options, files, parts, rows."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.arrow_schema = to_arrow_schema(schema)
        self.path, self.kind, self.port = options["path"], options.get("kind", "pcap"), int(options.get("port", 53))
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))

    def files(self) -> list[tuple[int, str, int]]:
        """(time of change, path, size) of the files of the folder, or of the one file."""
        store, path = filesystem(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else "file:" if self.path.startswith("file:") else ""
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        shown = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted((f.mtime_ns or 0, prefix + f.path, f.size) for f in shown)

    def parts(self, files: list[tuple[int, str, int]]) -> list[Group]:
        share = max(self.split, min(TASK_BYTES, sum(size for _, _, size in files) // TASKS))
        groups, left = [], 0
        for _, path, size in files:
            for lo in range(0, size, share):
                part = Part(path, lo, min(lo + share, size), size)
                if part.hi - lo > left:
                    groups.append([])
                    left = share
                groups[-1].append(part)
                left -= part.hi - lo
        return [Group(g) for g in groups]

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        found = ((part.path, r) for part in group.parts for r in records(part, self.kind, self.port))
        if self.kind == "pcap":
            yield from capture.packet_batches((path, *r) for path, r in found)
        else:
            yield from capture.frame_batches(found, self.arrow_schema)


class _Reader(_Source, DataSourceReader):
    def partitions(self) -> list[Group]:
        return self.parts(self.files())


class _StreamReader(_Source, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        changed, path, _ = max(self.files(), default=(-1, "", 0))
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        return self.parts([f for f in self.files() if after < f[:2] <= upto])

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """Options: path; kind (pcap or fstrm); splitBytes; port (pcap)."""

    @classmethod
    def name(cls) -> str:
        return "dns_capture"

    def schema(self) -> str:
        return capture.PACKETS if self.options.get("kind", "pcap") == "pcap" else capture.FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)
