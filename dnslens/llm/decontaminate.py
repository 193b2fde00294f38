"""Benchmark decontamination by spaced-seed hashing.

Words (lower case, split at white space and punctuation) are hashed; a mask of ones and zeros slides over them, and the
words under its ones make a hash. Benchmark items are indexed by these hashes, in blocks of bounded size; every document
looks up all of its own against each block. As masks ignore some places, a passage with words replaced still meets the
item under some mask. Around each hit the two word rows are compared along the diagonal: a region of at least
`least_words` words (or the whole item, if shorter) of which at least `similarity` agree, is a leak.

What is found is told without pairing all documents and items that share a passage: leaks are grouped by the item's words that
matched (`passage`, their hash); each document of a passage is one row, with one of the items, and each item of it is one
row, with one of the documents. A document and an item are linked just if they have a passage in common.

Items shorter than the masks' span are met by all of their words, or all but one where the
similarity lets one differ. Items and documents without words never match. Null
texts count as empty; a null id is kept as is; repeated rows are reported each, repeated items once; of equally long regions the first
counts; an empty table gives no rows; a very long text is looked up in bounded steps; other columns are not read by `leaks`,
and stay in `drop_leaks`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import mix, slices, text_buffer, texts_of, without_marks, word_hashes, word_spans

#: Masks of weight 6 of which one fits any 12 to 23 words of which a fifth differ, wherever these are, and any 10 or 11 of
#: which two inner ones differ. A longer region splits into parts of 12 to 23, one of which is as similar as the whole.
MASKS = ("1101111", "1100010111", "11111001", "1110001011", "1010011101", "10110111")
LEAST_WORDS, SIMILARITY = 12, 0.8
#: Items and bytes of a block of the benchmark, and hits that are looked at in one step.
BLOCK_ITEMS, BLOCK_BYTES, STEP = 20_000, 32 << 20, 1 << 18

_INDEXES: dict[tuple, ItemIndex] = {}


def _index_of(key: tuple, items: list[tuple]) -> ItemIndex:
    """A worker's index of a block, made once for all of its tasks. key: the call and block, least words and similarity."""
    if key not in _INDEXES:
        if len(_INDEXES) >= 2:
            _INDEXES.clear()
        _INDEXES[key] = ItemIndex(items, *key[2:])
    return _INDEXES[key]


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-case texts and each text's first. ASCII punctuation separates like white space."""
    soft = without_marks(data)
    starts, ends, first = word_spans(soft, offsets)
    return word_hashes(soft, starts, ends), first


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at each place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(h)


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks for items of n words: all of them, or all but one if the similarity lets one differ."""
    if n - 1 < similarity * n:
        return ["1" * n]
    return ["1" * k + "0" + "1" * (n - k - 1) for k in range(n)]


class ItemIndex:
    """The seeds of a block of items: for each mask sorted hashes with item and place."""

    def __init__(self, items: list[tuple], least_words: int = LEAST_WORDS, similarity: float = SIMILARITY):
        self.least, self.similarity = least_words, similarity
        self.ids = [i for i, _ in items]
        words, first = plain_words(*text_buffer(pa.array([t for _, t in items], pa.string()), lower=True))
        self.words = [words[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True)]
        span = max(map(len, MASKS))
        short = sorted({len(w) for w in self.words if 0 < len(w) < span})
        self.seeds = []
        for mask, fits in [*((m, lambda n: n >= span) for m in MASKS), *((m, lambda n, k=k: n == k) for k in short for m in short_masks(k, similarity))]:
            h, item, place = [], [], []
            for i, w in enumerate(self.words):
                if fits(len(w)):
                    x = seed_hashes(w, mask)
                    h.append(x)
                    item.append(np.full(len(x), i))
                    place.append(np.arange(len(x)))
            if h:
                h, item, place = map(np.concatenate, (h, item, place))
                by = np.argsort(h, kind="stable")
                self.seeds.append((mask, h[by], item[by], place[by]))

    def _candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (document, item, diagonal) of the places where a mask's words agree, some at a time."""
        for mask, hashes, item, place in self.seeds:
            h = seed_hashes(words, mask)
            lo = np.searchsorted(hashes, h)
            at = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h)
            if not len(at):
                continue
            n = np.searchsorted(hashes, h[at], "right") - lo[at]
            steps = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), STEP), "left")
            for p, q in zip(steps, [*steps[1:], len(at)], strict=True):
                some = at[p:q]
                where = np.repeat(some, n[p:q])
                k = np.repeat(lo[some], n[p:q]) + np.arange(len(where)) - np.repeat(np.cumsum(n[p:q]) - n[p:q], n[p:q])
                doc = np.searchsorted(first, where, "right") - 1
                inside = where + len(mask) <= first[doc + 1]
                yield np.unique(np.stack([doc, item[k], where - place[k]], axis=1)[inside], axis=0)

    def hits(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
        """(document, item, start, length, share of equal words, start in the item), the longest region of each document and item."""
        found = {tuple(r) for rows in self._candidates(words, first) for r in rows.tolist()}
        best: dict = {}
        for doc, i, diagonal in found:
            shift = diagonal - int(first[doc])
            if (r := self._region(words[first[doc] : first[doc + 1]], self.words[i], shift)) and r[1] > best.get((doc, i), (0, 0, 0))[1]:
                best[doc, i] = *r, r[0] - shift
        return [(doc, i, *r) for (doc, i), r in sorted(best.items())]

    def leaking(self, words: np.ndarray, first: np.ndarray) -> set[int]:
        """The documents that have a region; nothing more of a document is compared once it has one."""
        done: set[int] = set()
        for rows in self._candidates(words, first):
            for doc, i, diagonal in rows.tolist():
                if doc not in done and self._region(words[first[doc] : first[doc + 1]], self.words[i], diagonal - int(first[doc])):
                    done.add(doc)
        return done

    def passage(self, item: int, start: int, n: int) -> int:
        """The hash of n words of an item, signed."""
        h = xxhash.xxh64_intdigest(self.words[item][start : start + n].tobytes())
        return h - (1 << 64) if h >> 63 else h

    def _region(self, doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, float] | None:
        """Along a diagonal the longest region that is similar enough, from one equal word to another; None if too short."""
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        if hi <= lo:
            return None
        same = doc[lo + shift : hi + shift] == item[lo:hi]
        need = min(self.least, len(item))
        sums = np.concatenate([[0], np.cumsum(same - self.similarity)])
        ones = np.flatnonzero(same)
        # the longest region with sum >= 0 from an equal word to an equal word: against the running least of earlier sums
        low = np.minimum.accumulate(sums[ones])
        best = (0, 0)
        for j in ones[::-1].tolist():
            if j + 1 - ones[0] <= best[1]:
                break
            k = int(np.searchsorted(-low, -(sums[j + 1] + 1e-9)))
            if k < len(ones) and ones[k] <= j and j + 1 - ones[k] > best[1]:
                best = (int(ones[k]), int(j + 1 - ones[k]))
        if best[1] < need:
            return None
        return lo + shift + best[0], best[1], float(same[best[0] : best[0] + best[1]].mean())


LEAKS = "kind string, passage long, doc_id long, item_id long, start int, n_words int, similarity double"
_NAMES = [x.split()[0] for x in LEAKS.split(", ")]
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())


def _item_blocks(items: DataFrame, block_items: int) -> list[DataFrame]:
    """Items (item_id, text; null: empty) in blocks of about block_items and BLOCK_BYTES."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items for k in range(blocks)]


def _broadcast(part: DataFrame):
    return part.sparkSession.sparkContext.broadcast(sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def _by_slice(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row, words and first words of some documents at a time."""
    data, offsets = text_buffer(batch.column("text"), lower=True)
    for lo, hi in slices(offsets):
        yield lo, *plain_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def leaks(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Documents and benchmark items that share a passage, as in LEAKS: passage, doc_id, item_id, start (word), n_words, similarity.

    kind `document`: a document of the passage, with one of its items; kind `item`: an item of it, with one of its documents.
    Items go to the tasks in blocks, each against all documents, so what is broadcast is bounded.
    """
    out, call = None, uuid.uuid4().hex
    for k, part in enumerate(_item_blocks(items, block_items)):
        shared = _broadcast(part)

        def run(batches, shared=shared, key=(call, k, least_words, similarity)):
            index, members = _index_of(key, shared.value), {}
            for b in batches:
                ids, rows = b.column("doc_id"), []
                for lo, words, first in _by_slice(b):
                    told = set()
                    for d, i, start, size, share, item_start in index.hits(words, first):
                        row = (index.passage(i, item_start, size), ids[lo + d].as_py(), index.ids[i], start, size, share)
                        members.setdefault((row[0], index.ids[i]), row)
                        if (d, row[0]) not in told:
                            told.add((d, row[0]))
                            rows.append(("document", *row))
                yield _batch(rows)
            yield _batch([("item", *row) for row in members.values()])

        found = texts_of(docs).mapInArrow(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    first = F.min(F.struct("doc_id", "start", "n_words", "similarity")).alias("r")
    members = out.where("kind = 'item'").groupBy("passage", "item_id").agg(first).select(F.lit("item").alias("kind"), "passage", "r.doc_id", "item_id", "r.start", "r.n_words", "r.similarity")
    return out.where("kind = 'document'").unionByName(members)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def drop_leaks(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs without the rows that share a passage with the benchmark; all columns stay.

    Decided row by row, without a shuffle: each block of items is one pass over what the blocks before it left.
    """
    schema, call = docs.schema, uuid.uuid4().hex
    for k, part in enumerate(_item_blocks(items, block_items)):
        shared = _broadcast(part)

        def run(batches, shared=shared, key=(call, k, LEAST_WORDS, SIMILARITY)):
            index = _index_of(key, shared.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                texts = pa.record_batch([b.column(text).cast(pa.string())], names=["text"])
                for lo, words, first in _by_slice(texts):
                    keep[[lo + d for d in index.leaking(words, first)]] = False
                yield b.filter(pa.array(keep))

        text = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
        docs = docs.mapInArrow(run, schema)
    return docs
