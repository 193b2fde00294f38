"""SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 bits gets a random vector of GF(2)^(r+1); table v (any of the 2^(r+1) - 1 non-zero vectors) keeps the bits
whose vector isn't orthogonal to v. For up to r differing bits some v is orthogonal to all of them, so every pair within
the radius has equal masked values in some table: nothing is missed.

Copies of one fingerprint are one node. A bucket links its fingerprints by a local forest (never all pairs); links then
become components by rounds of large-star and small-star. Empty and null texts have fingerprint zero and link like any
other. A null doc_id never names a component unless all of its rows have none; repeated rows and ties share a fingerprint and
so a component. A text of any length has one fingerprint. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import store, texts_of

RADIUS, BITS, SHINGLE, SEED = 3, 64, 3, 42


def simhash_arrays(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of whole texts: bit i is 1 if set in over half of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    for i, raw in enumerate(texts):
        words = raw.lower().split()
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        hashes = np.fromiter((digest(b" ".join(words[j : j + shingle]), SEED) for j in range(n)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for lo in range(0, n, 1 << 16):
            ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = weights[2 * ones > n].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long, the 64 bits)."""

    def run(batches):
        for b in batches:
            fp = simhash_arrays([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text")])
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 bit masks; for any set of at most `radius` bits one mask has none of them."""
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % (1 << (radius + 1)))
    return [sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _near_pairs(fps: np.ndarray, free: list[int], radius: int, unite) -> None:
    """Calls unite(i, j) until all pairs of fps within the radius are connected. free: bits in which they may differ.

    Up to 512 are compared directly. More are split by the value of each of radius + 1 parts of the free bits: a pair
    within the radius agrees on some part.
    """
    order = [(np.arange(len(fps)), free)]
    while order:
        at, free = order.pop()
        if len(at) <= 512 or len(free) <= radius:
            for lo in range(0, len(at), 512):
                one = at[lo : lo + 512]
                for hi in range(lo, len(at), 4096):
                    other = at[hi : hi + 4096]
                    i, j = np.nonzero(np.bitwise_count(fps[one][:, None] ^ fps[other][None, :]) <= radius)
                    for a, b in zip(one[i].tolist(), other[j].tolist(), strict=True):
                        if a < b:
                            unite(a, b)
            continue
        for part in np.array_split(np.array(free), radius + 1):
            mask = np.uint64(sum(1 << int(k) for k in part))
            value = fps[at] & mask
            by = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[by])) + 1
            rest = [k for k in free if k not in set(part.tolist())]
            order += [(x, rest) for x in np.split(at[by], cuts) if len(x) > 1]


def _link(fps: np.ndarray, mask: int, radius: int) -> tuple[list[int], list[int]]:
    """Links (root, member) of a forest that connects what one bucket connects."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(a: int, b: int) -> None:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    _near_pairs(fps, [i for i in range(BITS) if not mask >> i & 1], radius, unite)
    pairs = [(find(i), i) for i in range(len(fps))]
    pairs = [p for p in pairs if p[0] != p[1]]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between different fingerprints that connect all pairs within the radius."""
    masks = covering_masks(radius)

    def run(batches):
        # rows come in (v, part) order; a bucket may run over batches
        held: list[tuple] = []

        def flush(v, fps):
            a, b = _link(fps, masks[v], radius)
            return fps[a].view(np.int64), fps[b].view(np.int64)

        def ready(v, part, fp, last):
            cut = np.flatnonzero((np.diff(v) != 0) | (np.diff(part) != 0)) + 1
            cut = [0, *cut.tolist(), len(v)]
            out_a, out_b = [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi == len(v) and not last:
                    held.append((v[lo:], part[lo:], fp[lo:]))
                elif hi - lo > 1:
                    a, b = flush(int(v[lo]), np.unique(fp[lo:hi]))
                    out_a.append(a)
                    out_b.append(b)
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return pa.record_batch([pa.array(join(out_a)), pa.array(join(out_b))], names=["a", "b"])

        def take(more):
            parts = [*held, *more]
            held.clear()
            return [np.concatenate([p[i] for p in parts]) for i in range(3)] if parts else None

        for b in batches:
            if b.num_rows:
                new = (b.column("v").to_numpy(), b.column("part").to_numpy(), b.column("fp").to_numpy().view(np.uint64))
                if held and (new[0][-1], new[1][-1]) == (held[-1][0][-1], held[-1][1][-1]):
                    held.append(new)
                else:
                    yield ready(*take([new]), last=False)
        if held:
            yield ready(*take([]), last=True)

    table = F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")) for v, m in enumerate(masks)))
    rows = nodes.select("fp", F.inline(table))
    return rows.repartition("v", "part").sortWithinPartitions("v", "part").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of the links a, b; alternating large-star and small-star until stable.

    These settle in O(log^2 n) rounds at worst and about log n in practice, so most_rounds is enough for 2^50 nodes.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        # each star is dealt out once, for its least node and for its links: three shuffles a round, and no broadcast through the driver
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        edges = store(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id, n_links (links of its fingerprint in the forest)."""
    prints = store(fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("head"))
    edges = store(links(nodes), "links")
    roots = components(edges)
    ends = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("head").alias("component_id"))
    classes = store(named.join(least, "root").join(ends, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "n_links")
