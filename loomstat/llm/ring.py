"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**bits cells. Each shard owns `vnodes` cells; a document's key
is its text, which hashes to a cell and belongs to the arc that ends in the
next virtual node clockwise: equal texts have one home shard. A shard takes
the keys of its own arcs up to its bound; what overflows goes on clockwise to
the next virtual nodes whose shards have room. With load_factor 1 the bounds
add up to the number of rows, so shards' counts differ by one at most (law
`rows`); rows of a group of equal texts that its home shard has no room for
move on like any others, and a group larger than a shard must be split. With
a load_factor above 1 (law `bounded`) only what is above that share of the
mean moves, and adding a shard moves few rows beside those it takes.

Arcs, not keys, pass through the driver: vnodes x shards x `split` counts, a
number fixed by the parameters. A hot text's arc is cut in `split` parts, so
no task ranks more than its share. Null text hashes as the empty one and
counts no bytes; equal rows get slots of their own; null ids are kept. Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_longs, materialize


def ring_cells(shards: int, vnodes: int, bits: int, seed: int) -> tuple[list[int], list[int]]:
    """(owner of each arc in ring order, arc of each cell)."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            c = int(hashlib.md5(f"{seed}:{s}:{v}".encode()).hexdigest()[:8], 16) % (1 << bits)
            while c in taken:
                c = (c + 1) % (1 << bits)
            taken[c] = s
    at = sorted(taken)
    arcs, k = [], 0
    for cell in range(1 << bits):
        arcs.append(k % len(at))
        if k < len(at) and at[k] == cell:
            k += 1
    return [taken[c] for c in at], arcs


def bounded_flows(counts: list[int], owners: list[int], bounds: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc the (shard, rows) it gives, in order: first to its own shard, then clockwise to shards with room."""
    room, flows, rest = list(bounds), [[] for _ in counts], list(counts)
    for a, n in enumerate(counts):
        take = min(n, room[owners[a]])
        if take:
            flows[a].append((owners[a], take))
            room[owners[a]] -= take
            rest[a] -= take
    for a in range(len(counts)):
        k = a
        while rest[a]:
            k = (k + 1) % len(counts)
            take = min(rest[a], room[owners[k]])
            if take:
                flows[a].append((owners[k], take))
                room[owners[k]] -= take
                rest[a] -= take
    return flows


def shard_documents(docs: DataFrame, *, text_col: str = "text", shards: int = 24, vnodes: int = 64, bits: int = 14, split: int = 32, load_factor: float = 1.0, seed: int = 11) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot (gapless in each shard), grown_shard (null), arc, home_shard."""
    spark = docs.sparkSession
    owners, arcs = ring_cells(shards, vnodes, bits, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cell = F.shiftrightunsigned(F.xxhash64(F.lit(seed), text), 64 - bits).cast("int")
    narrow = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.element_at(literal_longs(arcs), cell + 1).cast("int").alias("arc"),
            F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(split)).cast("int").alias("__part"),
        ), "ring-rows")
    found = {(r["arc"], r["__part"]): r["n"] for r in narrow.groupBy("arc", "__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # fixed by the parameters
    counts = [sum(found.get((a, p), 0) for p in range(split)) for a in range(len(owners))]
    total = sum(counts)
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    if load_factor > 1:
        bounds = [-(-int(total * load_factor) // shards)] * shards
    rows, used = [], [0] * shards
    for a, flow in enumerate(bounded_flows(counts, owners, bounds)):
        todo = list(flow)
        for p in range(split):
            lo, left = 0, found.get((a, p), 0)
            while left:
                s, have = todo[0]
                take = min(left, have)
                rows.append((a, p, lo, lo + take, s, used[s], owners[a]))
                used[s] += take
                lo, left = lo + take, left - take
                todo[0] = (s, have - take)
                if have == take:
                    todo.pop(0)
    runs = F.broadcast(spark.createDataFrame(rows, "arc int, __part int, __lo long, __hi long, shard int, __slot long, home_shard int"))  # at most vnodes * shards * (split + 1) rows
    rank = F.row_number().over(Window.partitionBy("arc", "__part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = narrow.withColumn("__rank", rank.cast("long")).join(runs, ["arc", "__part"]).where("__rank >= __lo and __rank < __hi")
    law = "rows" if load_factor <= 1 else "bounded"
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("__slot") + F.col("__rank") - F.col("__lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "arc", "home_shard")
