"""Substring dedup by relative Lempel-Ziv parsing of every document against the indexed blocks of the whole corpus.

1. Documents are cut into reference blocks (whole documents, zstd-compressed, one row each) in the shared folder,
   bucketed by block, so that only what is asked about them is shuffled later.
2. Each block indexes its phrases: the 8-word gram that is least by hash in each 35-word window. Equal windows have equal
   phrases at equal places, so a window that occurs twice always has a phrase that occurs twice. Phrases meet across all
   blocks; only windows whose phrase occurs elsewhere go on.
3. These windows meet across all blocks, and the index names a reference for each: in its own block the first place that
   has it; for that place the next block before it that has it (for the first block the second one). No place is the
   reference of more than two blocks, so a hot passage loads none of them.
4. Each document is parsed greedily: where the next window has a reference, a factor (block, place, length) begins and
   goes on as long as the windows go on along that reference; what lies between is literal. At a factor's end the windows
   over the boundary are looked at too, so the next factor may reach back over it, and is then cut to begin at the boundary.
5. Every factor's words are compared, byte for byte, with those of its reference: in the block itself, or by sending them
   to the reference block. Words differ only if two windows share a 64-bit hash; then all is done again with other hashes.
   Factors decide: their words are removed.

Hash buckets are sized from the corpus. Null and empty texts have no words; repeated rows count as other documents; a null
doc_id is kept as is; a text of any length lies in one block; an empty table gives an empty result; other columns are not
read by `repeated_spans`, and stay in `remove_repeats`.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import gram_hashes, new_folder, numbered, store, texts_of, word_hashes, word_spans

WINDOW, PHRASE = 35, 8
BLOCK_BYTES = 2 << 20
HASHES_PER_BUCKET = 2_000_000
BLOCKS_PER_FILE = 64
#: Sets of hash functions to try.
SEEDS = 4
BLOCKS = "block long, doc_ids array<long>, n_words array<int>, body binary"


def reference_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole documents in blocks: words joined by one space, documents by a line feed, compressed."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids, counts, parts, size = [], [], [], 0
        packer = zstandard.ZstdCompressor(3)

        def row():
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([packer.compress(b"\n".join(parts))], pa.binary())], names=["block", "doc_ids", "n_words", "body"])

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                ids.append(doc_id)
                counts.append(len(words))
                parts.append(b" ".join(words))
                size += len(parts[-1]) + 1
                if size >= block_bytes:
                    yield row()
                    block, ids, counts, parts, size = block + 1, [], [], [], 0
        if ids:
            yield row()

    return texts_of(docs).mapInArrow(run, BLOCKS)


class Block:
    """A block's words, phrases and windows. seed: other hashes of the same words."""

    def __init__(self, block: int, doc_ids, n_words, body: bytes, window: int, phrase: int, seed: int = 0):
        self.block, self.doc_ids, self.n_words, self.window = block, doc_ids, np.array(n_words, np.int64), window
        self.body = zstandard.ZstdDecompressor().decompress(body)
        data = np.frombuffer(self.body, np.uint8)
        self.starts, self.ends, _ = word_spans(data, np.array([0, len(data)]))
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        words = word_hashes(data if not seed else np.random.default_rng(seed).permutation(256).astype(np.uint8)[data], self.starts, self.ends)
        n = len(words)
        whole = np.arange(max(0, n - window + 1))
        end = np.repeat(self.first[1:], self.n_words)
        self.valid = whole + window <= end[: len(whole)]
        self.window_hashes = gram_hashes(words, window)
        grams = gram_hashes(words, phrase)
        self.anchor = self._least(grams, window - phrase + 1)  # of each window: where its least phrase is
        self.at = np.unique(self.anchor[self.valid])
        self.phrases = grams[self.at]

    @staticmethod
    def _least(grams: np.ndarray, width: int) -> np.ndarray:
        """For each run of `width` grams the place of the first least one, by doubling."""
        if len(grams) < width:
            return np.zeros(0, np.int64)
        at, have = np.arange(len(grams)), 1
        while have < width:
            step = min(have, width - have)
            left, right = at[: len(at) - step], at[step:]
            at, have = np.where(grams[right] < grams[left], right, left), have + step
        return at

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Windows that may be in factors: valid ones whose phrase is repeated. repeated: by phrase, in the order of self.at."""
        hot = np.zeros(len(self.starts) + 1, bool)
        hot[self.at[repeated]] = True
        return np.flatnonzero(self.valid & hot[self.anchor])

    def words(self, place: int, n: int) -> bytes:
        """n words of one document, joined by one space."""
        return self.body[self.starts[place] : self.ends[place + n - 1]]

    def factors(self, at: np.ndarray, reply: list, buckets: int) -> np.ndarray:
        """start, length (words), block, place of all factors, one under the other. at: candidates; reply: of the index."""
        unique, one, inverse, count = np.unique(self.window_hashes[at], return_index=True, return_inverse=True, return_counts=True)
        block, place = np.full(len(unique), -1), np.zeros(len(unique), np.int64)
        for k, b, p in _answers(unique, reply, buckets):
            block[k], place[k] = b, p
        order = np.argsort(inverse, kind="stable")
        again = np.flatnonzero((count > 1) & (block < 0))  # here alone: the first place refers to the second
        block[again], place[again] = self.block, at[order[(np.cumsum(count) - count)[again] + 1]]
        is_first = one[inverse] == np.arange(len(at))
        block, place = np.where(is_first, block[inverse], self.block), np.where(is_first, place[inverse], at[one[inverse]])
        at, block, place = at[block >= 0], block[block >= 0], place[block >= 0]
        goes_on = (np.diff(at) == 1) & (np.diff(block) == 0) & (np.diff(place) == 1)
        begin = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(at) else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(at))) + self.window - 1
        return np.stack([at[begin], length, block[begin], place[begin]], 1) if len(at) else np.zeros((0, 4), np.int64)

    def rows(self, factors: np.ndarray) -> pa.RecordBatch:
        """What is left of each document when the words of its factors go: as MADE, requests empty."""
        n = len(self.starts)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, factors[:, 0], 1)
        np.add.at(cover, factors[:, 0] + factors[:, 1], -1)
        gone = np.cumsum(cover)[:n] > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        removed = lost[self.first[1:]] - lost[self.first[:-1]]
        cuts = np.searchsorted(factors[:, 0], self.first)
        shas, spans, parses = [], [], []
        for k, (lo, hi, r) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), removed.tolist(), strict=True)):
            parse, done = [], lo
            for start, length, block, place in factors[cuts[k] : cuts[k + 1]].tolist():
                if start + length > done:
                    skip = max(0, done - start)
                    parse += [start + skip - lo, length - skip, block, place + skip]
                    done = start + length
            parses.append(parse)
            if lo == hi or r == hi - lo:
                shas.append(hashlib.sha256(b"").hexdigest())
                spans.append([0, hi - lo] if r else [])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[1], gone[lo:hi], [1]]).astype(np.int8)))
            runs = [(int(x), int(y)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
            kept = b" ".join(self.words(lo + x, y - x) for x, y in runs)
            shas.append(hashlib.sha256(kept).hexdigest())
            flat = [0, *(z for xy in runs for z in xy), hi - lo]
            spans.append([z for x, y in zip(flat[::2], flat[1::2], strict=True) if y > x for z in (x, y)])
        m = len(shas)
        cols = [pa.array(self.doc_ids, pa.int64()), pa.array(self.n_words), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(parses, pa.list_(pa.int64())), pa.array(shas, pa.string())]
        return pa.record_batch([*cols, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=_NAMES)

    def requests(self, factors: np.ndarray) -> pa.RecordBatch:
        """Factors of other blocks with their words, as MADE; and those of this block whose words differ (they get block -1)."""
        rows = []
        for start, length, block, place in factors.tolist():
            own = self.words(start, length)
            if block != self.block:
                rows.append((block, place, length, own))
            elif self.words(place, length) != own:
                rows.append((-1, place, length, own))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        m = len(rows)
        empty = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string())]
        return pa.record_batch([*empty, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=_NAMES)


MADE = "doc_id long, n_words long, n_removed long, spans array<int>, factors array<long>, kept_sha256 string, block long, place long, length long, words binary"
_NAMES = [x.split()[0] for x in MADE.split(", ")]


def _cuts(unique: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin among sorted ones."""
    number = ((unique >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(number, np.arange(buckets + 1, dtype=np.uint64))


ASK = "block long, bucket int, hashes binary, places binary"
REPLY = "block long, bucket int, bits binary, blocks binary, places binary"


def _ask(block: int, hashes: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """A block's different hashes and the first place of each, one row a bucket."""
    unique, one = np.unique(hashes, return_index=True)
    place, cuts = at[one].astype(np.int32), _cuts(unique, buckets)
    rows = [(k, unique[cuts[k] : cuts[k + 1]].tobytes(), place[cuts[k] : cuts[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist()]
    if not rows:
        return None
    return pa.record_batch([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "bucket", "hashes", "places"])


def _meet(t: pa.Table) -> pa.Table:
    """A bucket's hashes of all blocks. For each block a bit for each of its hashes, set if another block has it, and the reference of each that is set."""
    names = np.array(t.column("block").to_pylist())
    parts = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
    size = np.array([len(x) for x in parts])
    hashes, row = np.concatenate(parts), np.repeat(np.argsort(np.argsort(names)), size)
    place = np.concatenate([np.frombuffer(x, np.int32) for x in t.column("places").to_pylist()])
    names = np.sort(names)
    by = np.lexsort((row, hashes))
    same = np.concatenate([[False], hashes[by[1:]] == hashes[by[:-1]]])
    before = np.concatenate([same[1:], [False]])
    other = np.where(same, np.arange(len(by)) - 1, np.where(before, np.arange(len(by)) + 1, -1))
    found = np.full(len(by), -1)
    found[by] = np.where(other >= 0, by[other], -1)
    rows, lo = [], 0
    for block, n in zip(t.column("block").to_pylist(), size.tolist(), strict=True):
        f = found[lo : lo + n]
        lo += n
        if (f >= 0).any():
            rows.append((block, np.packbits(f >= 0).tobytes(), names[row[f[f >= 0]]].astype(np.int64).tobytes(), place[f[f >= 0]].tobytes()))
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    bucket = pa.array([t.column("bucket")[0].as_py()] * len(rows), pa.int32())
    return pa.table([pa.array(cols[0], pa.int64()), bucket, *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "bucket", "bits", "blocks", "places"])


def _answers(unique: np.ndarray, reply: list, buckets: int):
    """(which of the sorted different hashes, blocks, places) of each bucket's reply."""
    cuts = _cuts(unique, buckets)
    for r in reply or []:
        lo, hi = cuts[r["bucket"]], cuts[r["bucket"] + 1]
        at = lo + np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo))
        yield at, np.frombuffer(r["blocks"], np.int64), np.frombuffer(r["places"], np.int32)


def _repeated(hashes: np.ndarray, reply: list, buckets: int) -> np.ndarray:
    """For each hash whether it occurs more than once in the corpus."""
    unique, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    again = count > 1
    for at, _, _ in _answers(unique, reply, buckets):
        again[at] = True
    return again[inverse]


def _exchange(blocks: DataFrame, hashes, buckets: int, tag: str) -> DataFrame:
    """block, reply (list of bucket, bits, blocks, places). hashes: from a row to the block's hashes and their places."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                if (out := _ask(row["block"], *hashes(row), buckets)) is not None:
                    yield out

    met = blocks.mapInArrow(run, ASK).groupBy("bucket").applyInArrow(_meet, REPLY)
    return met.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits", "blocks", "places")).alias(tag))


def _store_blocks(blocks: DataFrame, n_bytes: int) -> DataFrame:
    """Writes blocks bucketed by block: joins on it move the other side alone. n_bytes: of all texts."""
    spark = blocks.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // (BLOCKS_PER_FILE * BLOCK_BYTES))
    n = min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"dnslens_blocks_{uuid.uuid4().hex}"
    blocks.repartition(n, "block").write.bucketBy(n, "block").format("parquet").option("path", f"{new_folder(spark, 'blocks')}/t").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry in the catalog alone: the files stay until the application ends
    return stored


def _differing(blocks: DataFrame, requests: DataFrame) -> int:
    """How many requests have other words than their reference."""

    def run(batches):
        for b in batches:
            wrong = 0
            for row in b.to_pylist():
                ref = Block(row["block"], row["doc_ids"], row["n_words"], row["body"], WINDOW, PHRASE)
                wrong += sum(ref.words(r["place"], r["length"]) != r["words"] for r in row["requests"])
            yield pa.record_batch([pa.array([wrong], pa.int64())], names=["wrong"])

    asked = requests.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("place", "length", "words")).alias("requests"))  # each window of a block for two others at most
    wrong = blocks.join(asked, "block").mapInArrow(run, "wrong long").agg(F.sum("wrong")).first()[0] or 0
    return wrong + requests.where("block < 0").count()


def parse(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """The blocks, and one row per document: doc_id, n_words, n_removed, spans, factors (start, length, block, place, ...), kept_sha256."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = _store_blocks(reference_blocks(docs), n_bytes)
    words = blocks.agg(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(max(512, words // HASHES_PER_BUCKET))
    for seed in range(SEEDS):

        def block(row, seed=seed) -> Block:
            return Block(row["block"], row["doc_ids"], row["n_words"], row["body"], window, phrase, seed)

        def phrase_hashes(row, block=block) -> tuple:
            b = block(row)
            return b.phrases, b.at

        def window_hashes(row, block=block) -> tuple:
            b = block(row)
            at = b.candidates(_repeated(b.phrases, row["phrases"], buckets))
            return b.window_hashes[at], at

        def finish(batches, block=block):
            for batch in batches:
                for row in batch.to_pylist():
                    b = block(row)
                    found = b.factors(b.candidates(_repeated(b.phrases, row["phrases"], buckets)), row["windows"], buckets)
                    yield b.rows(found)
                    yield b.requests(found)

        phrases = store(_exchange(blocks, phrase_hashes, buckets, "phrases"), "phrases")
        known = blocks.join(phrases, "block", "left")
        windows = store(_exchange(known, window_hashes, buckets, "windows"), "windows")
        made = store(known.join(windows, "block", "left").mapInArrow(finish, MADE), "factors")
        if not _differing(blocks, made.where("words is not null").select("block", "place", "length", "words")):
            return blocks, made.where("words is null").drop("block", "place", "length", "words")
    raise RuntimeError("windows with different words and one hash under every seed")


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (start, end, ... of removed words), factors, kept_sha256."""
    return parse(docs, window, phrase)[1]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated passages cut out of text (words joined by one space); all columns and rows stay."""
    rows, row = numbered(docs)
    spans = repeated_spans(rows.select(F.col(row).alias("doc_id"), "text"), window).where("n_removed > 0").select(F.col("doc_id").alias(row), F.col("spans").alias(f"{row}spans"))
    cut = rows.join(spans, row, "left")
    spans, words = F.col(f"{row}spans"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    flat = F.concat(F.array(F.lit(0)), spans, F.array(F.size(words)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int")), lambda i: F.slice(words, F.get(flat, 2 * i) + 1, F.get(flat, 2 * i + 1) - F.get(flat, 2 * i))))
    return cut.withColumn("text", F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(kept, " "))).select(*docs.columns)
