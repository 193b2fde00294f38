"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Each shard has `vnodes` places on a ring of 2^32. A document hashes to an arc, which belongs to the next virtual node
clockwise. A shard takes at most its capacity: the documents of an arc (in hash order) for which its shard has no room
go on clockwise to the next virtual node whose shard has. Capacities add up to the number of documents and differ by at
most one, so counts do too. The plan is made from the row count of each arc (shards x vnodes numbers, whatever the data).

Null text has size 8 and crc32 0; a null doc_id hashes by its text; repeated rows are separate rows. Documents of one hash
rank by doc_id, digest and size; rows that are equal in all of these are one another's like. Texts are read whole but once,
for their size and digest, however long; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) in ring order. A shard's places don't depend on how many shards there are."""
    return sorted((zlib.crc32(f"shard-{s}-node-{v}".encode()) * 2654435761 % RING, s) for s in range(shards) for v in range(vnodes))


def plan(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, lo, hi, shard, slot): ranks lo to hi - 1 of an arc go to shard, the first of them at slot."""
    room, out, over = list(capacity), [], []
    used = [0] * len(capacity)

    def give(arc: int, lo: int, shard: int, n: int) -> None:
        out.append((arc, lo, lo + n, shard, used[shard]))
        used[shard], room[shard] = used[shard] + n, room[shard] - n

    for arc, n in enumerate(counts):
        if take := min(n, room[owners[arc]]):
            give(arc, 0, owners[arc], take)
        if n > take:
            over.append((arc, take, n))
    for arc, lo, n in over:
        at = arc
        while lo < n:
            at = (at + 1) % len(owners)
            if take := min(n - lo, room[owners[at]]):
                give(arc, lo, owners[at], take)
                lo += take
    return out


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 128) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard (where its arc points)."""
    nodes = ring(shards, vnodes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col("doc_id").cast("long"))).alias("h"))
    place = F.shiftrightunsigned("h", 32)
    rows = rows.withColumn("arc", _lookup(place, _grid(nodes)))
    counts = [0] * len(nodes)
    for r in rows.groupBy("arc").count().collect():
        counts[r[0]] = r[1]
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    made = json.dumps([dict(zip(("arc", "lo", "hi", "shard", "slot0", "home_shard"), (*x, nodes[x[0]][1]), strict=True)) for x in plan(counts, [s for _, s in nodes], capacity)])
    spark = docs.sparkSession
    steps = spark.range(1).select(F.inline(F.from_json(F.lit(made), "array<struct<arc int, lo long, hi long, shard int, slot0 long, home_shard int>>")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("h", "doc_id", "text_crc32", "size")).cast("long") - 1)
    placed = ranked.join(F.broadcast(steps), "arc").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def _grid(nodes: list[tuple[int, int]], bits: int = 14) -> list[list[tuple[int, int]]]:
    """For each cell of 2^(32-bits) places: (first place, arc) of the arcs that meet it."""
    places = [p for p, _ in nodes]
    cells = []
    for c in range(1 << bits):
        lo, hi = c << (32 - bits), (c + 1) << (32 - bits)
        i = bisect.bisect_left(places, lo)
        cell = [(lo, i % len(nodes))]
        while i < len(places) and places[i] < hi - 1:
            cell.append((places[i] + 1, (i + 1) % len(nodes)))
            i += 1
        cells.append(cell)
    return cells


def _lookup(place, grid: list[list[tuple[int, int]]]):
    """The arc of a place: the last entry of its cell that starts at or before it."""
    bits = len(grid).bit_length() - 1
    starts = F.from_json(F.lit(json.dumps([[p for p, _ in c] for c in grid])), "array<array<long>>")
    arcs = F.from_json(F.lit(json.dumps([[a for _, a in c] for c in grid])), "array<array<int>>")
    cell = F.shiftright(place, 32 - bits).cast("int")
    return F.get(F.get(arcs, cell), F.size(F.filter(F.get(starts, cell), lambda s: s <= place)) - 1)
