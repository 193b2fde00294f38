"""Token ids in binary shard files by bit-plane shuffling.

A shard file holds the ids of a run of documents in ascending doc_id order. Ids are cut into blocks of fixed size; a
block is transposed into bit planes (plane k has bit k of every id) or byte planes, and each plane is compressed with
zstandard. The chunk index at the end has each block's place and plane sizes, and the documents' ids and lengths.

    "DLTP1\\0\\0\\0" | planes of block 0, 1, ... | index (zstandard JSON) | u64 size of the index | "DLTP1END"

Files are written under a temporary name and moved into place, so a task that runs twice leaves one whole file.
Null text counts as empty; every document ends with `end_id`; null doc_ids come first; rows of one doc_id are separate
documents, in the order of their texts' hashes; an empty table gives no files and no rows; other columns are not read. A text
of any length is encoded in parts and lies over as many blocks as it needs. A shard holds about 128 MB of text.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import new_folder, parts_for, store, texts_of
from dnslens.llm.tokens import default_path, encoder

MAGIC, TAIL = b"DLTP1\0\0\0", b"DLTP1END"
BLOCK = 1 << 16
#: Documents read back in one batch.
ROWS = 10_000


def to_planes(ids: np.ndarray, planes: str = "bit") -> list[bytes]:
    """The planes of a block of ids, lowest first; planes above the highest bit that is set are left out."""
    ids = ids.astype("<u4")
    if planes == "byte":
        raw = ids.view(np.uint8).reshape(-1, 4)
        top = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
        return [raw[:, k].tobytes() for k in range(top)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(max(1, int(ids.max(initial=0)).bit_length()))]


def from_planes(parts: list[bytes], n: int, planes: str = "bit") -> np.ndarray:
    """The ids of a block of n."""
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(parts):
        row = np.frombuffer(p, np.uint8) if planes == "byte" else np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        out |= row.astype(np.uint32) << np.uint32(8 * k if planes == "byte" else k)
    return out


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """path: with its scheme, as new_folder gives it (one without is a folder of this machine)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def crc_of(pieces: list[np.ndarray]) -> int:
    crc = 0
    for p in pieces:
        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
    return crc


class ShardWriter:
    """Writes one shard file. add() takes documents in order; close() moves the file into place."""

    def __init__(self, path: str, planes: str = "bit", block: int = BLOCK, level: int = 3):
        self.fs, self.path = _open(path)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.planes, self.block, self.packer = planes, block, zstandard.ZstdCompressor(level)
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.index = {"planes": planes, "block": block, "chunks": [], "doc_ids": [], "n_tokens": []}

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index["doc_ids"].append(doc_id)
        self.index["n_tokens"].append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for lo in range(0, whole, self.block):
                self._chunk(ids[lo : lo + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        parts = [self.packer.compress(p) for p in to_planes(ids, self.planes)]
        self.index["chunks"].append([self.at, len(ids), [len(p) for p in parts]])
        self.out.write(b"".join(parts))
        self.at += sum(map(len, parts))

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        tail = self.packer.compress(json.dumps(self.index).encode())
        self.out.write(tail + len(tail).to_bytes(8, "little") + TAIL)
        self.out.close()
        self.fs.move(self.temp, self.path)


class ShardReader:
    """Reads a shard file: blocks by number, or documents in order."""

    def __init__(self, path: str):
        filesystem, path = _open(path)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(16, size - 16)
        if end[8:] != TAIL:
            raise ValueError(f"not a whole shard file: {path}")
        n = int.from_bytes(end[:8], "little")
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unpacker.decompress(self.file.read_at(n, size - 16 - n)))

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        raw, parts, lo = self.file.read_at(sum(sizes), at), [], 0
        for s in sizes:
            parts.append(self.unpacker.decompress(raw[lo : lo + s]))
            lo += s
        return from_planes(parts, n, self.index["planes"])

    def documents(self):
        """doc_id, start in the shard, and the pieces of its ids, block by block."""
        k, left, start = 0, np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.index["doc_ids"], self.index["n_tokens"], strict=True):
            pieces, need = [], n
            while need:
                if not len(left):
                    left, k = self.block(k), k + 1
                pieces.append(left[:need])
                left, need = left[need:], need - len(pieces[-1])
            yield doc_id, start, n, pieces
            start += n


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, planes: str = "bit") -> DataFrame:
    """Writes docs as shard files below folder; returns their manifest: shard, path, n_docs, n_ids, start (of its first id)."""
    path = tokenizer or default_path("word_bpe_49k.json")

    def run(batches):
        writer, shard, n_docs, n_ids = None, TaskContext.get().partitionId(), 0, 0
        words = encoder(path, drop_space=True)
        name = f"{folder}/shard-{shard:08d}.dltp"
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), words.encode_column(b.column("text")), strict=True):
                writer = writer or ShardWriter(name, planes)
                ids = np.append(ids, np.uint32(end_id))
                writer.add(doc_id, ids)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    ordered = texts_of(docs).repartitionByRange(parts_for(docs), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = store(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard file: few
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for m in b.to_pylist():
                documents = ShardReader(m["path"]).documents()
                while rows := [(doc_id, m["start"] + start, n, crc_of(pieces)) for doc_id, start, n, pieces in itertools.islice(documents, ROWS)]:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs to shard files in the shared folder and reads them back."""
    return read_shards(write_shards(docs, new_folder(docs.sparkSession, "shards"), tokenizer, end_id))
