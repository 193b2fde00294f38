"""Alignment of two tokenizers' ids over the same bytes, by interval coalescing.

Each text with a leading space is tokenized twice (A: byte-level BPE, B: sentencepiece). Both sequences cover the same bytes,
so tokens are intervals: all of them are sorted by start, the running maximum of their ends is taken, and a group breaks where
a start reaches it; inside, every A token expands to the B tokens that it overlaps (links).

How often an id pair is linked in the whole corpus is counted by Spark: tasks pass on blocks of documents (BLOCK bytes of
text), each with its different pairs and their counts, however often the block holds them; totals join back to the blocks by
pair, and each block's documents look theirs up. A frequent pair is one row a block.

Null and empty texts, and texts that either tokenizer doesn't give back byte by byte (such as those with U+2581), have no
tokens: their counts are zero and `groups` is ''. Repeated rows count each time; null doc_ids are rows like others; an empty
table gives an empty result; other columns are not read. A long text is coalesced window by window, each ending where a group
ends; its `groups` must stay below 2 GB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import store, text_buffer, texts_of
from dnslens.llm.piece_models import PieceModel, _Bytes, byte_characters
from dnslens.llm.tokens import _spread, default_path, encoder, remembered

#: Bytes of text in a block, in one pass of numpy, and A tokens in a window of a longer text.
BLOCK, UNIT, WINDOW = 4 << 20, 1 << 19, 1 << 20
#: What the first pass writes: rows of documents, and at the end of each block a row with its pairs.
PARTS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, held binary, pairs array<long>, counts array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


def a_bytes(path: str) -> _Bytes:
    """The bytes of each id of a byte-level tokenizer file."""
    model = encoder(path, drop_space=False, plain=True).model
    back = {c: b for b, c in enumerate(byte_characters())}
    names = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
    return _Bytes([bytes(back[c] for c in p) if all(c in back for c in p) else p.encode() for p in names])


def windows(size_a: np.ndarray, size_b: np.ndarray, window: int = WINDOW) -> Iterator[tuple[slice, slice]]:
    """Runs of A and B tokens that end at the same byte, about `window` A tokens each."""
    if len(size_a) <= window:
        yield slice(0, len(size_a)), slice(0, len(size_b))
        return
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    a = b = 0
    while a < len(size_a):
        width = window
        while True:
            upto = end_a[a : a + width]
            common = np.intersect1d(upto, end_b[b : np.searchsorted(end_b, upto[-1], "right")], assume_unique=True)
            if len(common):
                break
            width *= 2
        next_a, next_b = (int(np.searchsorted(e, common[-1], "right")) for e in (end_a, end_b))
        yield slice(a, next_a), slice(b, next_b)
        a, b = next_a, next_b


def coalesce(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token: tokens sorted by start, groups broken where a start reaches the greatest end so far."""
    size, n_a = np.concatenate([size_a, size_b]), len(size_a)
    end = np.concatenate([np.cumsum(size_a), np.cumsum(size_b)])
    start = end - size
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:n_a], group[n_a:]


def links(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlaps: places of A tokens, and of the B token that each meets."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    first = np.searchsorted(end_b, end_a - size_a, "right")
    n = np.searchsorted(end_b - size_b, end_a, "left") - first
    return np.repeat(np.arange(len(size_a)), n), _spread(first, n)


class _Digits:
    """Decimal numbers with a place for a separator after each."""

    def __init__(self, n: int):
        self.bytes = _Bytes([b"%d," % i for i in range(n)])

    def render(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;` for each group in order, and where each group's text ends."""
        key = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([a, b])[order]
        text, end = self.bytes.join(ids), np.cumsum(self.bytes.size[ids])
        last = np.append(key[1:] != key[:-1], True)
        text[end[last] - 1] = np.where(key[last] % 2, ord(";"), ord("|"))
        return text, end[last & (key % 2 == 1)]


class Aligner:
    """The process's two tokenizers, their ids' bytes, and the decimal numbers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, drop_space=False, plain=True), remembered(PieceModel, path_b)
        self.bytes_a, self.bytes_b = a_bytes(path_a), self.b.bytes
        self.digits = _Digits(max(len(self.bytes_a.size), len(self.bytes_b.size)))

    def tokens(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Ids of A and B of each text and its bytes; none where the text is empty or isn't given back whole."""
        column = column.cast(pa.large_string())
        spaced = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        data, offsets = text_buffer(spaced)
        none = np.zeros(0, np.uint32)
        for k, (a, b) in enumerate(zip(self.a.encode_column(spaced), self.b.encode_column(spaced), strict=True)):
            text = data[offsets[k] : offsets[k + 1]]
            if self._same(self.bytes_a, a, text) and self._same(self.bytes_b, b, text):
                yield a, b, len(text)
            else:
                yield none, none, len(text)

    @staticmethod
    def _same(table: _Bytes, ids: np.ndarray, text: np.ndarray) -> bool:
        return int(table.size[ids].sum()) == len(text) and bool((table.join(ids) == text).all())

    def align(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
        """For each document: groups, links, the groups' text, its different pairs in order, and how often it has each."""
        n = len(a)
        until = np.cumsum([len(x) for x in a])
        ids_a, ids_b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        size_a, size_b = self.bytes_a.size[ids_a], self.bytes_b.size[ids_b]
        n_groups, n_links, texts = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in a]
        pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in a]
        for at, bt in windows(size_a, size_b):
            wa, wb, sa, sb = ids_a[at], ids_b[bt], size_a[at], size_b[bt]
            if not len(wa):
                continue
            group_a, group_b = coalesce(sa, sb)
            text, ends = self.digits.render(wa, wb, group_a, group_b)
            doc_of = np.searchsorted(until, np.arange(at.start, at.stop), "right")
            first = np.flatnonzero(np.diff(group_a, prepend=-1))  # every group has A tokens: its first one
            group_doc = doc_of[first]
            of_a, of_b = links(sa, sb)
            code, link_doc = wa[of_a] << 32 | wb[of_b], doc_of[of_a]
            for d in np.unique(group_doc).tolist():
                lo, hi = np.searchsorted(group_doc, [d, d + 1])
                texts[d].append(text[ends[lo - 1] if lo else 0 : ends[hi - 1]].tobytes())
                n_groups[d] += hi - lo
                lo, hi = np.searchsorted(link_doc, [d, d + 1])
                n_links[d] += hi - lo
                pairs[d].append(np.unique(code[lo:hi], return_counts=True))
        return [(int(n_groups[d]), int(n_links[d]), b"".join(texts[d])[:-1], *_merged(pairs[d])) for d in range(n)]


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)


def _shut(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts in few bytes."""
    rows = np.concatenate([np.diff(places, prepend=0), counts]).astype("<u4")
    return zstandard.ZstdCompressor(1).compress(rows.view(np.uint8).reshape(-1, 4).T.tobytes())


def _open(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8)
    rows = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
    n = len(rows) // 2
    return np.cumsum(rows[:n]), rows[n:]


class _Block:
    """Documents of a task whose pairs are numbered together."""

    def __init__(self, number: int):
        self.number, self.rows, self.keys, self.counts, self.size = number, [], [], [], 0

    def add(self, row: tuple, keys: np.ndarray, counts: np.ndarray, size: int) -> None:
        self.rows.append(row)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += size

    def batch(self) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum([len(k) for k in self.keys])])
        held = [_shut(at[lo:hi], c) if len(c) else None for lo, hi, c in zip(cut[:-1].tolist(), cut[1:].tolist(), self.counts, strict=True)]
        columns = [*zip(*self.rows, strict=True)]
        n = len(self.rows)
        types = [pa.int64()] * 5 + [pa.string()]
        return pa.record_batch(
            [pa.array([self.number] * (n + 1), pa.int64()), *(pa.array([*c, None], t) for c, t in zip(columns, types, strict=True)), pa.array([*held, None], pa.binary()), pa.array([None] * n + [keys], pa.list_(pa.int64())), pa.array([None] * n + [total], pa.list_(pa.int64()))],
            names=[x.split()[0] for x in PARTS.split(", ")],
        )


def parts(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """Documents with their own alignment, and the pairs of each block, as in PARTS."""

    def run(batches):
        aligner = remembered(Aligner, path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        open_block, unit, size = _Block(number), [], 0

        def flush():
            for (doc_id, a, b, n), (groups, n_links, text, keys, counts) in zip(unit, aligner.align([u[1] for u in unit], [u[2] for u in unit]), strict=True):
                open_block.add((doc_id, len(a), len(b), groups, n_links, text.decode()), keys, counts, n)
            unit.clear()

        for batch in batches:
            for doc_id, (a, b, n) in zip(batch.column("doc_id").to_pylist(), aligner.tokens(batch.column("text")), strict=True):
                unit.append((doc_id, a, b, n))
                size += n
                if size >= UNIT:
                    flush()
                    size = 0
                    if open_block.size >= block:
                        yield open_block.batch()
                        number += 1
                        open_block = _Block(number)
        if unit:
            flush()
        if open_block.rows:
            yield open_block.batch()

    return texts_of(docs).mapInArrow(run, PARTS)


def pair_totals(found: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), total over the corpus, and best: whether it is the highest of the pair's B id."""
    totals = found.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total"))
    totals = store(totals, "pairs").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    # one row an id of tokenizer B: as many as its vocabulary has
    best = totals.groupBy("b").agg(F.max("total").alias("highest"))
    return totals.join(F.broadcast(best), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: Callable[[Column], Column] = lambda c: c, block: int = BLOCK) -> DataFrame:
    """As in ALIGNED. groups: what is kept of the groups' text, such as a digest, before it is written between the passes."""
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    found = parts(docs, path_a, path_b, block)
    found = store(found.withColumn("groups", F.when(F.col("n_a") > 0, groups(F.col("groups"))).otherwise("")), "aligned")
    pairs = found.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select(F.col("block").alias("of_block"), "place", F.col("p.pairs").alias("pair"))
    answers = pairs.join(pair_totals(found), "pair").select("of_block", "place", "total", "best")
    rows = found.where("pairs IS NULL").drop("pairs", "counts")

    def look_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        place = np.asarray(answers.column("place"))
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        total[place], best[place] = np.asarray(answers.column("total")), np.asarray(answers.column("best").combine_chunks().cast(pa.uint8())) > 0
        n_best, count_sum = [], []
        for held in rows.column("held").to_pylist():
            at, n = _open(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            n_best.append(int((n * best[at]).sum()))
            count_sum.append(int((n * total[at]).sum()))
        return rows.drop_columns(["block", "held"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(look_up, ALIGNED)
