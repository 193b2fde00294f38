"""Exact dedup with an extendible-hash index on shared files.

1. Rows are numbered and written to the shared folder, so that all later reads see the same rows.
2. Tasks combine equal texts (a hot text leaves a task once per HELD bytes of others): a group has a number, the bytes of
   its normalised text, a 64-bit key, a count and its first row.
3. The directory maps the leading bits of a key to a bucket. An overfull bucket splits by its next bit, and where it used
   all directory bits already, the directory doubles; a bucket of one key alone can't split, one of DEEPEST bits doesn't.
4. A bucket is a key range of one owner task. Groups arrive in key order; those of one key form a chain, and two are one
   text only if all their bytes are equal. The chains decide which row stays and how large a group is; they are the index.
5. Documents get their result by the number of their group.

Defined results: null text counts as empty; rows with a null doc_id come last among equal texts, and of one doc_id the
first row as read; repeated rows are members like any other, and one of them is kept; an empty table gives an empty result;
a text of any length is one group. Other columns are ignored by `exact_groups` and kept by `keep_first`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import SPACE, numbered, store, without_rows

#: Most bytes of texts in a bucket; less where an eighth of an even share of a task is less. At 64 MB the driver's directory
#: has some 2 million entries for 100 TB.
CAPACITY = 64 << 20
#: Bytes of different texts that a task combines at once.
HELD = 16 << 20
#: Directory bits that are looked at in one pass over the keys, and the most counts (as a power of two) that it gives.
STEP, COUNTS = 12, 20
#: Directory bits at which a bucket overflows instead of splitting: 64 MB of entries, and full buckets of 1 PB.
DEEPEST = 24
NONE = np.iinfo(np.int64).max


def normalise(raw: bytes) -> bytes:
    """Each run of white space becomes one space; nothing is trimmed."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    out = b" ".join(words)
    return (b" " if raw[0] in SPACE else b"") + out + (b" " if raw[-1] in SPACE else b"")


def _key(norm: bytes, key_bits: int) -> int:
    k = xxhash.xxh64_intdigest(norm) >> (64 - key_bits) << (64 - key_bits)
    return k - (1 << 64) if k >> 63 else k


def _normal(column: pa.Array):
    for t in column:
        yield normalise(t.as_buffer().to_pybytes() if t.is_valid else b"")


class _Combiner:
    """Groups of equal texts, by their bytes; numbered by task in order of arrival, the same in every run over the same rows."""

    def __init__(self, held: int):
        self.at, self.limit, self.groups, self.bytes = TaskContext.get().partitionId() << 36, held, {}, 0

    def add(self, norm: bytes) -> list:
        """The group of a text: number, rows, first (doc_id or NONE, row)."""
        g = self.groups.get(norm)
        if g is None:
            g = self.groups[norm] = [self.at, 0, (NONE, NONE)]
            self.at, self.bytes = self.at + 1, self.bytes + len(norm)
        return g

    def full(self) -> bool:
        return self.bytes >= self.limit

    def clear(self) -> None:
        self.groups, self.bytes = {}, 0


def _members(rows: DataFrame, row: str, key_bits: int, held: int) -> DataFrame:
    """doc_id, row_id, group_id of each row; key and n_bytes with the row that opens a group."""

    def run(batches):
        found = _Combiner(held)
        for b in batches:
            ids, keys, sizes = [], [], []
            for norm in _normal(b.column("text")):
                g = found.add(norm)
                ids.append(g[0])
                keys.append(None if g[1] else _key(norm, key_bits))
                sizes.append(None if g[1] else len(norm))
                g[1] += 1
                if found.full():
                    found.clear()
            yield pa.record_batch([b.column("doc_id"), b.column("row_id"), *(pa.array(x, pa.int64()) for x in (ids, keys, sizes))], names=["doc_id", "row_id", "group_id", "key", "n_bytes"])

    return _texts(rows, row).mapInArrow(run, "doc_id long, row_id long, group_id long, key long, n_bytes long")


GROUP = "group_id long, key long, n long, doc_id long, row_id long, bucket int, norm binary"


def _groups(rows: DataFrame, row: str, key_bits: int, held: int, directory: Directory) -> DataFrame:
    """The combined groups with their buckets: GROUP. doc_id and row_id are the first row's."""
    shared, depth = rows.sparkSession.sparkContext.broadcast(directory.entries), directory.depth

    def run(batches):
        found = _Combiner(held)

        def out():
            names = [x.split()[0] for x in GROUP.split(", ")]
            items = list(found.groups.items())
            for lo in range(0, len(items), 2000):
                part = items[lo : lo + 2000]
                docs = [None if g[2][0] == NONE else g[2][0] for _, g in part]
                keys = np.array([_key(t, key_bits) for t, _ in part], np.int64)
                cols = [[g[0] for _, g in part], keys, [g[1] for _, g in part], docs, [g[2][1] for _, g in part]]
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols), pa.array(find(keys, depth, shared.value)), pa.array([t for t, _ in part], pa.binary())], names=names)

        for b in batches:
            for doc, r, norm in zip(b.column("doc_id").to_pylist(), b.column("row_id").to_pylist(), _normal(b.column("text")), strict=True):
                g = found.add(norm)
                g[1], g[2] = g[1] + 1, min(g[2], (NONE if doc is None else doc, r))
                if found.full():
                    yield from out()
                    found.clear()
        yield from out()

    return _texts(rows, row).mapInArrow(run, GROUP)


def _texts(rows: DataFrame, row: str) -> DataFrame:
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row_id"), F.col("text").cast("string").alias("text"))


def find(keys: np.ndarray, depth: int, entries: np.ndarray) -> np.ndarray:
    """The bucket of each key."""
    return entries[(keys.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(keys), np.int32)


class Directory:
    """Which bucket a key is in. Entry i of 2 ** depth has the bucket of the keys whose leading bits are i."""

    def __init__(self):
        self.depth, self.entries, self.prefixes, self.locals = 0, np.zeros(1, np.int32), [0], [0]

    def split(self, bucket: int) -> int:
        """Splits a bucket by its next bit, doubling the directory if it has no such bit yet; returns the new bucket."""
        if self.locals[bucket] == self.depth:
            self.entries, self.depth = np.repeat(self.entries, 2), self.depth + 1
        new, local = len(self.locals), self.locals[bucket] + 1
        self.locals[bucket] = local
        self.prefixes[bucket] *= 2
        self.locals.append(local)
        self.prefixes.append(self.prefixes[bucket] + 1)
        width = self.depth - local
        self.entries[self.prefixes[new] << width : (self.prefixes[new] + 1) << width] = new
        return new

    def grow(self, counts: dict[int, list[tuple[int, int, int]]], step: int, capacity: int) -> list[int]:
        """Splits overfull buckets as far as counts tell; returns those that are still overfull and hold several keys.

        counts: of each bucket to look at (suffix of its next `step` bits, bytes, keys) for those bits that occur.
        """
        left = []
        for bucket, rows in counts.items():
            todo = [(bucket, 0, sorted(rows))]
            while todo:
                b, bits, rows = todo.pop()
                if sum(r[1] for r in rows) <= capacity or sum(r[2] for r in rows) <= 1:
                    continue
                if bits == step:
                    left.append(b)
                    continue
                half = 1 << (step - bits - 1)
                low, high = [r for r in rows if not r[0] & half], [r for r in rows if r[0] & half]
                new = self.split(b)
                todo += [(b, bits + 1, low), (new, bits + 1, high)]
        return left


def build_directory(sizes: DataFrame, capacity: int, key_bits: int = 64) -> Directory:
    """The directory over sizes (key, n_bytes): passes over the keys of overfull buckets until none can split."""
    directory, todo = Directory(), [0]
    spark = sizes.sparkSession
    while todo:
        done = directory.locals[todo[0]]  # all of one pass
        step = min(STEP, min(key_bits, DEEPEST) - done, max(1, COUNTS - len(todo).bit_length()))
        if step <= 0:
            break
        part = sizes
        if done:
            chosen = spark.createDataFrame([(b, directory.prefixes[b]) for b in todo], "bucket int, prefix long")
            part = sizes.join(F.broadcast(chosen), F.shiftrightunsigned("key", 64 - done) == F.col("prefix"))
        else:
            part = sizes.withColumn("bucket", F.lit(0))
        bits = F.shiftrightunsigned("key", 64 - done - step).bitwiseAND(F.lit((1 << step) - 1))
        keys = part.groupBy("bucket", bits.alias("bits"), "key").agg(F.sum("n_bytes").alias("n_bytes"))
        counts: dict = {}
        for r in keys.groupBy("bucket", "bits").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("k")).collect():  # 2 ** COUNTS rows at most, or two for each bucket
            counts.setdefault(r["bucket"], []).append((r["bits"], r["n"], r["k"]))
        todo = directory.grow(counts, step, capacity)
    return directory


INDEX = "bucket int, key long, slot int, keep_id long, keep_row long, group_size long, sha binary, n_bytes long, groups array<long>"


def _owner(batches):
    """Groups in (bucket, key) order: chains the different texts of a key, comparing bytes. One row for each text: INDEX."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    at, chain, rows = None, {}, []

    def close():
        for slot, (norm, (n, first, groups)) in enumerate(chain.items()):
            rows.append((at[0], at[1], slot, None if first[0] == NONE else first[0], first[1], n, hashlib.sha256(norm).digest(), len(norm), groups))

    def out():
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    for b in batches:
        for bucket, key, group, n, doc, r, norm in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "group_id", "n", "doc_id", "row_id", "norm")), strict=True):
            if (bucket, key) != at:
                close()
                at, chain = (bucket, key), {}
            entry = chain.setdefault(norm, [0, (NONE, NONE), []])  # a dict compares the bytes of its keys
            entry[0], entry[1] = entry[0] + n, min(entry[1], (NONE if doc is None else doc, r))
            entry[2].append(group)
        yield out()
        rows.clear()
    close()
    yield out()


def build_index(rows: DataFrame, row: str, members: DataFrame, capacity: int | None = None, key_bits: int = 64, held: int = HELD) -> DataFrame:
    """The index over numbered rows, in the shared folder: INDEX, one row for each different text. members: of _members."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.where("key is not null").select("key", "n_bytes")
    if capacity is None:
        capacity = min(CAPACITY, (sizes.agg(F.sum("n_bytes")).first()[0] or 0) // (8 * parts) + 1)
    directory = build_directory(sizes, capacity, key_bits)
    n = max(parts, len(directory.locals) // 8)
    owned = _groups(rows, row, key_bits, held, directory).repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", "key", "group_id")
    return store(owned.mapInArrow(_owner, INDEX), "index")


def _resolve(rows: DataFrame, row: str, capacity: int | None = None, key_bits: int = 64, held: int = HELD) -> DataFrame:
    members = store(_members(rows, row, key_bits, held), "members")
    index = build_index(rows, row, members, capacity, key_bits, held)
    found = index.select(F.explode("groups").alias("group_id"), "keep_id", "keep_row", "group_size", "sha", "bucket", "slot")
    return members.join(found, "group_id").select("doc_id", "row_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "sha", "bucket", "slot")


def exact_groups(docs: DataFrame, capacity: int | None = None, key_bits: int = 64, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, row_id, keep_id, group_size, kept, sha (binary), bucket, slot."""
    return _resolve(*numbered(docs.select("doc_id", "text")), capacity, key_bits, held)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without all but the first of equal texts; all columns stay."""
    rows, row = numbered(docs)
    return without_rows(rows, row, _resolve(rows, row).where("not kept").select("row_id"))
