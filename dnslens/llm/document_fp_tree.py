"""Ranked lexical search of all documents for each item of a query set, over document FP-trees.

A document is reduced to the terms that items use. Its terms, most frequent first in the corpus, are a path; the documents of
a block share the beginnings of their paths in a trie whose unary runs are one node (an FP-tree with a header table from each
term to its nodes). Each node has the greatest tf of its terms and the least m of its subtree. For an item, the tf maxima of
its terms below each node follow from the header table, and with the least m they bound every score below; a depth-first
branch-and-bound takes the most promising children first and enters no subtree whose bound is under the item's k-th best
score so far. Documents that it reaches are scored exactly. Each task returns its k best of each item, and Spark ranks those.

Terms are maximal runs of letters and digits of ASCII and of all characters above it, with A-Z lower-cased, of whole texts.
With N documents that have a term, L terms in all, n terms in a document, and df documents with a term: its weight is
w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m = 75 + (25 n N) div L, its score the sum over the item's terms,
repeats included, of w * ((10^9 tf) div (1000 tf + 12 m)).

Null and empty texts have no terms: such documents and items are in no row. Repeated items and documents are ranked row by
row; equal scores rank by ascending doc_id, null last. Empty tables give an empty result; other columns are not read. Items
are taken in blocks of about ITEM_BYTES of text, with one scan of the documents each, so that what tasks receive is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import numbered, store, text_buffer, texts_of, word_hashes, word_spans
from dnslens.llm.tokens import _spread

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text of the items of one block.
ITEM_BYTES = 32 << 20
#: Bytes of text in work at once; documents and entries of one tree; nodes entered together.
SLICE, TREE_DOCS, TREE_ENTRIES, TOGETHER = 1 << 18, 8192, 1 << 21, 512
VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"

#: Each byte of a term in lower case; a space for every other byte.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)


class Vocabulary:
    """The terms of a block of items, found in texts by a hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        size = np.array([len(r) for r in raw], np.int64)
        first = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = word_hashes(self.data, first, first + size) if raw else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.first, self.size = hashes[self.order], first[self.order], size[self.order]
        self.most = int(np.unique(hashes, return_counts=True)[1].max(initial=0))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(starts), -1, np.int64)
        hashes = word_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        for k in range(self.most):  # terms of equal hash stand side by side
            place = np.minimum(at + k, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[place] == hashes) & (self.size[place] == ends - starts) & (out < 0))
            place, size = place[hit], (ends - starts)[hit]
            differ = self.data[_spread(self.first[place], size)] != data[_spread(starts[hit], size)]
            same = np.ones(len(hit), bool)
            same[np.searchsorted(np.cumsum(size), np.flatnonzero(differ), "right")] = False
            out[hit[same]] = self.order[place[same]]
        return out


def _parts(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Folded bytes of about `limit` at a time, their parts' offsets, and the document of the first part; longer documents are
    cut where no term stands, and their parts are numbered as documents of a slice of their own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        if offsets[hi] - offsets[lo] <= 2 * limit:
            yield _FOLD[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], lo
        else:
            a, end = int(offsets[lo]), int(offsets[hi])
            while a < end:
                b = min(a + limit, end)
                while b < end and _FOLD[data[b]] != 32:
                    b += 1
                yield _FOLD[data[a:b]], np.array([0, b - a]), lo
                a = b
        lo = hi


def _vectors(column: pa.Array, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n of each document, and the entries document, term, tf in order of document and term."""
    data, offsets = text_buffer(column)
    n, v = np.zeros(len(column), np.int64), max(1, len(words.hashes))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, offs, doc in _parts(data, offsets):
        starts, ends, first = word_spans(part, offs)
        n[doc : doc + len(offs) - 1] += np.diff(first)
        found = words.find(part, starts, ends)
        hit = np.flatnonzero(found >= 0)
        got, times = np.unique((doc + np.searchsorted(first, hit, "right") - 1) * v + found[hit], return_counts=True)
        keys.append(got)
        counts.append(times)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return n, key // v, key % v, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def restricted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """As in VECTORS: each document's number of terms, and those of `terms` that it has (their numbers) with their tf."""

    def run(batches):
        words = Vocabulary(terms)
        for b in batches:
            n, doc, term, tf = _vectors(b.column("text"), words)
            cut = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.record_batch([b.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    return texts_of(docs).mapInArrow(run, VECTORS)


class Tree:
    """The FP-tree of a block of documents: nodes level by level, so that the children of a node are side by side.

    rank: of each entry's term, 0 the most frequent; entries in order of document and rank.
    """

    def __init__(self, doc: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray):
        n, cut = len(m), np.searchsorted(doc, np.arange(len(m) + 1))
        raw = rank.astype(">u4").tobytes()
        order = np.array(sorted(range(n), key=lambda d: raw[4 * cut[d] : 4 * cut[d + 1]]), np.int64)  # by their paths
        size = np.diff(cut)[order]
        at = _spread(cut[:-1][order], size)
        self.rows, self.m, self.rank, self.tf = order, m[order], rank[at], tf[at]
        self.first = np.concatenate([[0], np.cumsum(size)])  # of each document's entries
        self._grow(n, size)

    def _grow(self, n: int, size: np.ndarray) -> None:
        doc = np.repeat(np.arange(n), size)
        depth = np.arange(len(self.rank)) - self.first[doc]
        before = self.first[np.maximum(doc - 1, 0)] + depth
        same = (doc > 0) & (before < self.first[doc])
        same[same] = self.rank[before[same]] == self.rank[np.flatnonzero(same)]
        shared = np.zeros(n + 1, np.int64)  # how many entries a document's path has in common with the one before
        shared[:n] = size
        stop = np.flatnonzero(~same)
        np.minimum.at(shared, doc[stop], depth[stop])
        shared[0] = shared[n] = 0
        # a node is a run of depths over a range of documents: its runs end where paths part or where a path ends
        self.top: list[tuple[int, int, int, int]] = []  # lo, hi (documents), from, to (depths)
        parents, level, levels = [], [(0, n, 0, -1)] if n else [], [0]
        while level:
            below = []
            for lo, hi, start, parent in level:
                inner = shared[lo + 1 : hi]
                end = int(min(inner.min(initial=size[lo]), size[lo]))  # the first path of a range is its shortest where it is a prefix
                me = len(self.top)
                self.top.append((lo, hi, start, end))
                parents.append(parent)
                a = lo
                while a < hi and size[a] == end:
                    a += 1  # documents that end here
                if a < hi:
                    cuts = [a, *(np.flatnonzero(shared[a + 1 : hi] == end) + a + 1).tolist(), hi]
                    below += [(x, y, end, me) for x, y in zip(cuts, cuts[1:], strict=False)]
            levels.append(len(self.top))
            level = below
        lo, hi, start, end = np.array(self.top, np.int64).reshape(-1, 4).T
        self.lo, self.levels, self.parent = lo, levels, np.array(parents, np.int64)
        self.ending = lo + np.array([np.searchsorted(size[a:b], e, "right") if size[a] == e else 0 for a, b, e in zip(lo.tolist(), hi.tolist(), end.tolist(), strict=True)], np.int64) if n else lo
        children = np.bincount(self.parent[1:], minlength=len(lo)) if n else lo
        self.n_children, self.first_child = children, 1 + np.cumsum(children) - children
        self.m_min = np.minimum.reduceat(np.append(self.m, np.iinfo(np.int64).max), np.stack([lo, hi], 1).ravel())[::2] if n else lo
        self._header(doc, depth, start, end, lo, hi, n)

    def _header(self, doc, depth, start, end, lo, hi, n) -> None:
        """From each term (rank) to the nodes that have it, and the greatest tf of it there."""
        node = np.repeat(np.arange(len(lo)), end - start)
        place = self.first[lo[node]] + _spread(start, end - start)  # the entry of the node's first document
        term = self.rank[place]
        greatest = self.tf[place].copy()
        shared = np.flatnonzero((hi - lo)[node] > 1)
        if len(shared):
            step, width = place[shared] - self.first[lo[node[shared]]], (hi - lo)[node[shared]]
            places = self.first[_spread(lo[node[shared]], width)] + np.repeat(step, width)  # the same depth of every document of a node
            greatest[shared] = np.maximum.reduceat(self.tf[places], np.cumsum(width) - width)
        order = np.argsort(term, kind="stable")
        self.link_term, self.link_node, self.link_tf = term[order], node[order], greatest[order]
        self.key = doc * (1 << 32) + self.rank  # to look a document's term up

    def search(self, rank: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offers to `best` every document that may be among its k best for an item: its different terms (ranks, ascending) and weights."""
        lo, hi = np.searchsorted(self.link_term, rank), np.searchsorted(self.link_term, rank, "right")
        here = hi > lo
        if not here.any():
            return
        rank, weight, lo, hi = rank[here], weight[here], lo[here], hi[here]
        at, column = _spread(lo, hi - lo), np.repeat(np.arange(len(rank)), hi - lo)
        own = np.zeros((len(self.lo), len(rank)), np.int64)
        own[self.link_node[at], column] = self.link_tf[at]
        below = own.copy()  # the greatest tf of each term in a node's subtree
        for a, b, c in zip(self.levels[-3::-1], self.levels[-2::-1], self.levels[::-1], strict=False):
            inner = np.flatnonzero(self.n_children[a:b]) + a
            if len(inner):
                below[inner] = np.maximum(own[inner], np.maximum.reduceat(below[b:c], self.first_child[inner] - b, axis=0))
        stack = [(np.zeros(1, np.int64), np.zeros((1, len(rank)), np.int64), _scores(below[:1], self.m_min[:1], weight))]
        while stack:
            nodes, path, bound = stack.pop()
            keep = (bound >= best.least) & (bound > 0)
            nodes, path = nodes[keep], np.maximum(path[keep], own[nodes[keep]])
            ends = self.ending[nodes] - self.lo[nodes]
            if ends.any():
                docs = _spread(self.lo[nodes], ends)
                best.offer(self.rows[docs], _scores(self._tf(docs, rank), self.m[docs], weight))
            n = self.n_children[nodes]
            if not n.any():
                continue
            children, path = _spread(self.first_child[nodes], n), np.repeat(path, n, axis=0)
            bound = _scores(np.maximum(path, below[children]), self.m_min[children], weight)
            keep = np.flatnonzero((bound >= best.least) & (bound > 0))
            keep = keep[np.argsort(bound[keep], kind="stable")]  # the most promising are on top
            for a in range(0, len(keep), TOGETHER):
                some = keep[a : a + TOGETHER]
                stack.append((children[some], path[some], bound[some]))

    def _tf(self, docs: np.ndarray, rank: np.ndarray) -> np.ndarray:
        want = (docs[:, None] * (1 << 32) + rank[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.tf[at], 0).reshape(len(docs), len(rank))


def _scores(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return (weight * (1_000_000_000 * tf // (1000 * tf + 12 * m[:, None]))).sum(axis=1)


class Best:
    """The k best documents of an item so far: highest score, then least doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = self.nulls = None

    def within(self, ids: np.ndarray, nulls: np.ndarray) -> Best:
        """From now on, documents are offered by their place in ids."""
        self.ids, self.nulls = ids, nulls
        return self

    def offer(self, places: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        self.score = np.concatenate([self.score, scores[good]])
        self.doc, self.null = np.concatenate([self.doc, self.ids[places[good]]]), np.concatenate([self.null, self.nulls[places[good]]])
        top = np.lexsort((self.doc, self.null, -self.score))[: self.k]
        self.score, self.doc, self.null = self.score[top], self.doc[top], self.null[top]
        if len(top) == self.k:
            self.least = max(1, int(self.score[-1]))


def lengths(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """m of documents of n terms, in whole numbers of any size."""
    some, at = np.unique(n, return_inverse=True)
    return np.array([75 + 25 * x * total_docs // max(1, total_terms) for x in some.tolist()], np.int64)[at]


def _item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term, times: the different terms of each row of items."""
    rows, name = numbered(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))
    folded = F.translate(F.col("text"), UPPER, LOWER)
    terms = rows.select(F.col(name).alias("item"), "item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents above 0 of each row of items (item_id, text)."""
    terms = store(_item_terms(items), "items")
    blocks = -(-int(terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // item_bytes)
    found = None
    for block in range(max(1, blocks)):
        some = terms.where(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))) == block)
        part = _search_block(docs, some, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """item, item_id, doc_id, score: the k best of each item in each task."""
    rows = terms.orderBy("item", "term").toArrow()  # one block: about ITEM_BYTES
    words = sorted(set(rows.column("term").to_pylist()))
    number = {w: i for i, w in enumerate(words)}
    vectors = store(restricted(docs, words), "vectors")
    total_docs, total_terms = vectors.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(words), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row a term of the block
        df[r["term"]] = r["count"]
    frequent = np.argsort(-df, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[frequent] = np.arange(len(words))
    weight = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    item, term, times = np.asarray(rows.column("item")), np.array([number[t] for t in rows.column("term").to_pylist()], np.int64), np.asarray(rows.column("times"))
    item_ids = rows.column("item_id").to_pylist()
    order = np.lexsort((rank[term], item))
    item, its_rank, its_weight = item[order], rank[term[order]], (times * weight[term])[order]
    first = np.flatnonzero(np.diff(item, prepend=-1)) if len(item) else np.zeros(0, np.int64)
    cuts = [*first.tolist(), len(item)]
    names = [(int(item[a]), item_ids[int(order[a])]) for a in first.tolist()]
    shared = docs.sparkSession.sparkContext.broadcast((rank, its_rank, its_weight, cuts, names))

    def run(batches):
        rank, its_rank, its_weight, cuts, names = shared.value
        best = [Best(k) for _ in names]
        for ids, n, doc, term, tf in _blocks(batches):
            place = rank[term]
            by = np.lexsort((place, doc))
            tree = Tree(doc[by], place[by], tf[by], lengths(n, total_docs, total_terms))
            doc_ids, nulls = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
            for q, (a, b) in zip(best, zip(cuts, cuts[1:], strict=False), strict=True):
                tree.search(its_rank[a:b], its_weight[a:b], q.within(doc_ids, nulls))
        for (number, item_id), q in zip(names, best, strict=True):
            if len(q.score):
                size = len(q.score)
                doc_id = pa.array(q.doc, pa.int64(), mask=q.null)
                yield pa.record_batch([pa.array([number] * size, pa.int64()), pa.array([item_id] * size, pa.int64()), doc_id, pa.array(q.score)], names=["item", "item_id", "doc_id", "score"])

    return vectors.where(F.size("terms") > 0).mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, n, and the entries of documents for one tree at a time."""
    held, docs, entries = [], 0, 0

    def joined():
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column("terms").combine_chunks()
        size = np.asarray(lists.value_lengths()).astype(np.int64)
        return t.column("doc_id").combine_chunks(), np.asarray(t.column("n")), np.repeat(np.arange(len(t)), size), np.asarray(lists.flatten()).astype(np.int64), np.asarray(t.column("tfs").combine_chunks().flatten()).astype(np.int64)

    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            held.append(part)
            docs, entries = docs + part.num_rows, entries + len(part.column("terms").flatten())
            if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield joined()
                held, docs, entries = [], 0, 0
    if held:
        yield joined()
