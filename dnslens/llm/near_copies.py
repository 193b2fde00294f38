"""The near-dedup stage of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates meet in the covering tables of `simhash`, over a SimHash of the five-word shingles, which lose no pair within
RADIUS bits. Pairs at 0.8 differ in about ten bits of 64, for which covering masks would need thousands of tables; so the same
buckets also take MinHash keys: BANDS of ROWS least values, in none of which a pair at 0.8 exactly meets with a chance of
(1 - 0.8^4)^20 = 3 in 100,000, and a closer pair with less. Every candidate link is checked on the whole sets.

Documents with one set are one node. In each turn every node is compared with a head of each of its buckets that isn't yet in
its component and has a set of like size; heads change from turn to turn and by kinds of keys (HEADS, then four times as many a turn). A turn's work grows
with the entries of buckets, not with their square: a large group of near copies is a few stars, joined by later turns. When no
more than MANY pairs of different components an entry are left, or after TURNS, pairs of different components meet once more:
in buckets with up to MANY such pairs an entry directly, all nodes of larger buckets by `_prefix_pairs`, which loses none. So no
candidate pair stays unchecked unless its ends are linked. The texts of nodes that share a bucket are compressed and shuffled once,
and go to the pairs in that form.

Lower case, words split at white space; a text under five words is one shingle, null and empty texts are one set. Two sets
or shingles with one 64-bit hash would be taken as equal. Rows are told apart by number, so repeated and null doc_ids, and
repeated rows, are like any others; of a component the row with the smallest doc_id stays (null last, then as read). A very
long text is one set. An empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import gram_hashes, mix, numbered, slices, store, text_buffer, without_rows, word_hashes, word_spans
from dnslens.llm.simhash import components, covering_masks

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
TURNS, HEADS, MANY = 3, 4, 4
#: Which shingles of the nodes that _prefix_pairs takes are common is told by counts of all of them in so many cells; shingles
#: that share a cell count as one another. This decides an order and so the work, never a result.
CELLS = 1 << 20
#: Shingles of the sets that a task keeps for its next pairs.
RECENT = 1 << 19
_MASKS = np.array(covering_masks(), np.uint64)
KEYS = BANDS + len(_MASKS)
_FACTORS = np.random.default_rng(11).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE):
    """The sorted different shingle hashes of each text."""
    data, offsets = text_buffer(column, lower=True)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, at)
        words = word_hashes(part, starts, ends)
        grams = gram_hashes(words, shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - shingle + 1] if b - a >= shingle else gram_hashes(words[a:b], b - a) if b > a else grams[:0])


def simhash(hashes: np.ndarray) -> np.uint64:
    """Bit i is 1 if set in over half of a set's hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each MinHash band, equal where two sets have the same ROWS least values, and for each covering table."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(hashes), 4096):
        np.minimum(least, np.multiply.outer(_FACTORS, hashes[lo : lo + 4096]).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return np.concatenate([key, mix(np.arange(BANDS, KEYS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (simhash(hashes) & _MASKS))])


def prints(rows: DataFrame, row: str) -> DataFrame:
    """doc_id, row_id, node (hash of the set), size of the set, keys of its buckets."""

    def run(batches):
        for b in batches:
            nodes, sizes, keys = [], [], []
            for h in shingle_sets(b.column("text")):
                nodes.append(mix(np.array([h.sum(dtype=np.uint64) + np.uint64(len(h))])))
                sizes.append(len(h))
                keys.append(bucket_keys(h))
            join = lambda x: (np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, KEYS * len(keys) + 1, KEYS, dtype=np.int32)), pa.array(join(keys)))
            yield pa.record_batch([b.column("doc_id"), b.column("row_id"), pa.array(join(nodes)), pa.array(sizes, pa.int64()), lists], names=["doc_id", "row_id", "node", "size", "keys"])

    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, row_id long, node long, size long, keys array<long>")


def _bodies(rows: DataFrame, row: str, chosen: DataFrame) -> DataFrame:
    """chosen (node, row_id, size) without row_id and with body: the text, compressed before it is sent."""

    def run(batches):
        packer = zstandard.ZstdCompressor(1)
        for b in batches:
            bodies = [packer.compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column("text")]
            yield pa.record_batch([b.column("row_id"), pa.array(bodies, pa.binary())], names=["row_id", "body"])

    texts = rows.select(F.col(row).alias("row_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "row_id long, body binary").join(chosen, "row_id").select("node", "size", "body")


def _unpacked(bodies: pa.Array):
    """The shingle set of each compressed text."""
    opener = zstandard.ZstdDecompressor()
    for body in bodies:
        yield next(shingle_sets(pa.array([opener.decompress(body.as_buffer().to_pybytes()).decode("utf-8", "replace")], pa.string())))


def _alike(n: str, m: str, similarity: float) -> Column:
    """Whether sets of n and m shingles could be similar by their sizes."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _of_like_size(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs of any origin whose sets could be similar by their sizes."""
    x, y = (bodies.select(F.col("node").alias(n), F.col("size").alias(m)) for n, m in (("a", "n"), ("b", "m")))
    return pairs.join(x, "a").join(y, "b").where(_alike("n", "m", similarity)).select("a", "b")


def _met(known: DataFrame, turn: int, similarity: float) -> DataFrame:
    """a, b: each node (node, size, key, root) with a head of each of its buckets that isn't in its component and is of like size."""
    heads = known.groupBy("key").agg(F.min_by(F.struct("node", "root", "size"), F.xxhash64("node", F.pmod("key", F.lit(HEADS << 2 * min(turn, 2))), F.lit(turn))).alias("h"))
    met = known.join(heads, "key").where("root <> h.root").where(_alike("size", "h.size", similarity))
    return met.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()


def _checked(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs that are similar enough. Texts go to the pairs, not their sets, which are several times as large."""

    def run(batches):
        recent: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            good = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                for node, body in ((a, x), (b, y)):
                    if node not in recent:
                        if held > RECENT:
                            recent = {k: v for k, v in recent.items() if k in (a, b)}
                            held = sum(map(len, recent.values()))
                        recent[node] = next(_unpacked([body]))
                        held += len(recent[node])
                n, both = len(recent[a]) + len(recent[b]), len(np.intersect1d(recent[a], recent[b], assume_unique=True))
                good.append(both >= similarity * (n - both) - 1e-9)
            mask = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    x, y = (bodies.select(F.col("node").alias(n), F.col("body").alias(h)) for n, h in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _cell_counts(bodies: DataFrame) -> np.ndarray:
    """How many shingles of all these sets fall in each of CELLS cells: at most CELLS numbers, whatever the input."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            for h in _unpacked(b.column("body")):
                np.add.at(counts, (h % np.uint64(CELLS)).astype(np.int64), 1)
        cells = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], names=["cell", "n"])

    found = bodies.select("body").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def _prefix_pairs(large: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of different components among the large nodes (node, root), all that are similar among them.

    Sets are put in one order, common shingles last. Similar sets of n and m shingles share similarity / (1 + similarity) of
    n + m, so the first one that they share leaves at least as many from there on in both: only leading shingles can be it, and
    nodes that have nothing but common shingles in common never meet.
    """
    mine = store(large.join(bodies, "node"), "large")
    table = large.sparkSession.sparkContext.broadcast(_cell_counts(mine))

    def run(batches):
        for b in batches:
            leading = []
            for h in _unpacked(b.column("body")):
                order = np.argsort(table.value[(h % np.uint64(CELLS)).astype(np.int64)], kind="stable")
                leading.append(h[order[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]])
            ends = np.cumsum([0, *map(len, leading)]).astype(np.int32)
            values = np.concatenate(leading) if leading else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
            yield pa.record_batch([*(b.column(c) for c in ("node", "root", "size")), lists], names=["node", "root", "size", "leading"])

    heads = mine.select("node", "root", "size", "body").mapInArrow(run, "node long, root long, size long, leading array<long>")
    heads = store(heads.select("node", "root", "size", F.posexplode("leading").alias("at", "shingle")), "leading")
    shared = heads.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle")
    heads = heads.join(shared, "shingle", "left_semi").withColumn("rest", F.col("size") - F.col("at"))
    one, other = (heads.select("shingle", F.col("node").alias(x), F.col("root").alias(r), F.col("size").alias(n), F.col("rest").alias(k)) for x, r, n, k in (("a", "p", "n", "i"), ("b", "q", "m", "j")))
    enough = F.least("i", "j") >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
    return one.join(other, "shingle").where("a < b and p <> q").where(enough & _alike("n", "m", similarity)).select("a", "b")


def near_groups(rows: DataFrame, row: str, similarity: float = SIMILARITY) -> DataFrame:
    """One row per numbered row: doc_id, row_id, component (a node)."""
    found = store(prints(rows, row), "shingles")
    nodes = store(found.groupBy("node").agg(F.min_by(F.struct("row_id", "size", "keys"), "row_id").alias("r")).select("node", "r.*"), "nodes")
    entries = nodes.select("node", "size", F.explode("keys").alias("key"))
    entries = store(entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi"), "entries")
    bodies = store(_bodies(rows, row, nodes.select("node", "row_id", "size").join(entries.select("node").distinct(), "node", "left_semi")), "bodies")
    links = roots = None
    last = False
    for turn in range(TURNS + 1):
        known = entries.withColumn("root", F.col("node")) if roots is None else entries.join(roots, "node", "left").select("node", "size", "key", F.coalesce("root", "node").alias("root"))
        if turn:
            kinds = known.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
            left, n = kinds.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.sum("n")).first()
            last = turn == TURNS or (left or 0) <= MANY * (n or 0)
        if last:
            apart = (F.col("n") * F.col("n") - F.col("own")) / 2
            mixed = known.join(kinds.where(apart > 0).select("key", (apart > MANY * F.col("n")).alias("large")), "key")
            one, other = (mixed.where("not large").select("key", F.col("node").alias(x), F.col("root").alias(r), F.col("size").alias(n)) for x, r, n in (("a", "p", "n"), ("b", "q", "m")))
            pairs = one.join(other, "key").where("a < b and p <> q").where(_alike("n", "m", similarity)).select("a", "b")
            pairs = pairs.unionByName(_prefix_pairs(mixed.where("large").select("node", "root").distinct(), bodies, similarity)).distinct()
        else:
            pairs = _met(known, turn, similarity)
        pairs = store(pairs, "pairs")
        good = store(_checked(pairs, bodies, similarity), "links")
        if good.take(1):
            links = good if links is None else links.unionByName(good)
            roots = components(links)
        if last:
            break
    found = found.drop("keys", "size")
    if roots is None:
        return found.withColumnRenamed("node", "component")
    return found.join(roots, "node", "left").select("doc_id", "row_id", F.coalesce("root", "node").alias("component"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but the first of each component; all columns stay."""
    rows, row = numbered(docs)
    groups = store(near_groups(rows, row, similarity), "components")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("r")).select(F.col("r.row_id").alias("row_id"))
    return without_rows(rows, row, groups.join(first, "row_id", "left_anti").select("row_id"))
