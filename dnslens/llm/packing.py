"""Packing along a space-filling curve.

A document's hashed word vector is projected to four dimensions; the place on a Hilbert curve through them is its sort
key. Documents are range-partitioned by that key (a hash of doc_id breaks ties, so a large group of copies spreads
over partitions), and each partition's ids are cut, in curve order, into sequences of `size`; what is left at its end goes to
sequences whose lengths are powers of two, so nothing is padded.

Null text counts as empty (its only id is the end id). Repeated rows are separate documents. A document of any length is
cut over as many sequences as it needs. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dnslens.llm.common import mix, parts_for, slices, text_buffer, texts_of, word_hashes, word_spans
from dnslens.llm.tokens import default_path, encoder

SIZE, DIMS, DEPTH = 1024, 4, 12
#: One document in so many places the cuts between partitions.
SAMPLE = 16


def hilbert_keys(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The place of each point (rows of non-negative integers below 2 ** depth) on the Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (depth - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (depth - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_points(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS, depth: int = DEPTH) -> np.ndarray:
    """Mean hashed word vectors of documents in a buffer, squashed to integers below 2 ** depth."""
    out = np.zeros((len(offsets) - 1, dims))
    for lo, hi in slices(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, offs)
        words = mix(word_hashes(part, starts, ends))
        sums = np.zeros((len(words) + 1, dims))
        np.cumsum(words.view(np.uint16).reshape(-1, 4)[:, :dims] / 32767.5 - 1, axis=0, out=sums[1:])
        out[lo:hi] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))[:, None]
    return np.clip(((np.tanh(6 * out) + 1) / 2 * (1 << depth)).astype(np.int64), 0, (1 << depth) - 1)


def _orders(ids: pa.Array, texts: pa.Array) -> np.ndarray:
    """What documents are sorted by: the place on the curve (48 bits), then 15 bits of the id's hash, which spread copies."""
    keys = hilbert_keys(document_points(*text_buffer(texts)))
    spread = mix(np.asarray(ids.fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)) >> np.uint64(49)
    return keys << 15 | spread.view(np.int64)


def with_orders(docs: DataFrame, bounds: np.ndarray | None = None) -> DataFrame:
    """doc_id, text, key, part: the number of the range (between bounds) that the key falls in."""
    cuts = np.zeros(0, np.int64) if bounds is None else bounds

    def run(batches):
        for b in batches:
            keys = _orders(b.column("doc_id"), b.column("text"))
            yield pa.record_batch([b.column("doc_id"), b.column("text"), pa.array(keys), pa.array(np.searchsorted(cuts, keys, "right").astype(np.int32))], names=["doc_id", "text", "key", "part"])

    return texts_of(docs).mapInArrow(run, "doc_id long, text string, key long, part int")


def range_bounds(docs: DataFrame, parts: int, share: int = SAMPLE) -> np.ndarray:
    """parts - 1 cuts of the curve from the keys of one document in `share`: only the balance depends on the sample."""
    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(9)), F.lit(share)) == 0)
    found = with_orders(some).agg(F.percentile_approx("key", [(i + 1) / parts for i in range(parts - 1)], 10 * parts)).first()[0] if parts > 1 else []
    return np.array(sorted(found or []), np.int64)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, key long"


class _Packer:
    """Cuts a row of documents into pieces; finish() places what doesn't fill a sequence."""

    def __init__(self, first_sequence: int, size: int):
        self.sequence, self.size, self.fill, self.open, self.rows = first_sequence, size, 0, [], []

    def add(self, doc_id, ids: np.ndarray, key: int) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.size - self.fill]
            self.open.append([doc_id, start, part, len(ids), key])
            self.fill, start = self.fill + len(part), start + len(part)
            if self.fill == self.size:
                self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, part, total, key in pieces:
            self.rows.append((doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, at, key))
            at += len(part)
        self.sequence += 1

    def finish(self) -> None:
        left, rest = self.fill, self.open
        while left:
            room = 1 << (left.bit_length() - 1)
            left, taken = left - room, []
            while room:
                doc_id, start, part, total, key = rest[0]
                taken.append([doc_id, start, part[:room], total, key])
                if len(part) > room:
                    rest[0] = [doc_id, start + room, part[room:], total, key]
                else:
                    rest.pop(0)
                room -= len(taken[-1][2])
            self._close(taken)
        self.open, self.fill = [], 0

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 8
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Pieces of sequences, as in PIECES. sequence_id: unique, ascending along the curve within a partition."""
    path = tokenizer or default_path("byte_bpe_50k.json")

    def run(batches):
        packer = _Packer(TaskContext.get().partitionId() << 36, size)
        words = encoder(path, drop_space=False)
        for b in batches:
            for doc_id, ids, key in zip(b.column("doc_id").to_pylist(), words.encode_column(b.column("text")), b.column("key").to_pylist(), strict=True):
                packer.add(doc_id, np.append(ids, np.uint32(end_id)), key)
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    n = parts_for(docs)
    ordered = with_orders(docs, range_bounds(docs, n)).repartitionById(n, "part").sortWithinPartitions("key", "doc_id")
    return ordered.mapInArrow(run, PIECES)
