"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall, by a hash of their id and text, into blocks of
about `block_words` words; the blocks have a permuted order. What a source
owes to the mix is a number of block instances: whole epochs of all its
blocks, and a last partial epoch that ends inside one block. These exact
quotas are split down a binary tree over the output shards: each node draws,
without replacement, how many of its instances of each source go to its left
half (multivariate hypergeometric). A shard then takes its own, disjoint run
of each source's permuted instances and is shuffled locally. The mix is these
draws, one row for each copy of a document with its shard and place; the
report sums them up again by document.

Shards hold about `shard_words` words, so their number grows with the mix, up
to `MOST_CELLS` cells of shards x sources. Only per-source figures (one row a
source) and that quota table pass through the driver. Nulls: a null text has
size 0, a null source is a source of its own, ordered last; a null doc_id is
hashed as the word null, beside its text. Sources without words get the target
0 and nothing is taken. Equal rows are drawn one by one. Other columns are
kept by `mix`, in which only `mix_copy`, `mix_shard` and `mix_position` are
replaced; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialize

#: Tables up to so many rows or cells are joined by broadcast; larger ones by a shuffle.
SMALL = 1 << 18
MOST_CELLS = 1 << 20


def fill_targets(sizes: list[int], weights: list[int], cap: int) -> list[tuple[int, int]]:
    """Each source's target as (numerator, denominator): shares of the sum of sizes by weight, none above cap times its size."""
    out: list[tuple[int, int] | None] = [None] * len(sizes)
    rest, active = sum(sizes), list(range(len(sizes)))
    while active:
        w = sum(weights[i] for i in active)
        full = [i for i in active if cap * sizes[i] * w < weights[i] * rest]
        if not full:
            for i in active:
                out[i] = (weights[i] * rest, w)
            break
        for i in full:
            out[i] = (cap * sizes[i], 1)
            rest -= cap * sizes[i]
        active = [i for i in active if out[i] is None]
    return [x or (0, 1) for x in out]


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """shards x sources: how many instances of each source each shard takes."""
    out: list[list[int]] = [[] for _ in range(shards)]
    todo = [(0, shards, [int(q) for q in quotas])]
    while todo:
        lo, hi, own = todo.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = sum(own)
        need, left = total * (mid - lo) // (hi - lo), []
        for q in own:
            total -= q
            k = int(rng.hypergeometric(q, total, need)) if q and total and need else min(q, need)
            left.append(k)
            need -= k
        todo += [(lo, mid, left), (mid, hi, [q - k for q, k in zip(own, left, strict=True)])]
    return out


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def plan_mix(sized: DataFrame, *, weights=(1, 2, 3), cap: int = 3, shards: int | None = None, shard_words: int = 1 << 20, block_words: int = 1 << 16, seed: int = 7) -> DataFrame:
    """sized has doc_id, source, __size (words) and __th (hash of the text). Adds __source_size, __target and __draws: the shard of each copy taken."""
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("__size").alias("n")).collect()  # one row a source
    found = sorted(((r["source"], int(r["n"] or 0)) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    w = [weights[i % len(weights)] for i in range(len(found))]
    total = sum(n for _, n in found)
    per_block = max(block_words, total >> 20)
    if shards is None:
        shards = max(1, min(total // shard_words, MOST_CELLS // max(len(found), 1)))
    rows, owed = [], []
    for i, ((source, n), (num, den)) in enumerate(zip(found, fill_targets([n for _, n in found], w, cap), strict=True)):
        epochs = num // (den * n) if n else 0
        rest = num / den - epochs * n if n else 0.0
        rows.append((i, source, n, num / den, epochs, rest, max(1, -(-n // per_block))))
        owed.append(epochs)
    sources = spark.createDataFrame(rows, "__src int, __source string, __source_size long, __target double, __epochs int, __rest double, __blocks int")
    keyed = sized.join(_small(sources, len(rows)), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keyed = keyed.withColumn("__md", _digest(F.lit(seed), F.col("doc_id"), F.col("__th")))
    keyed = keyed.withColumn("__block", (F.conv(F.substring("__md", 1, 8), 16, 10).cast("long") % F.col("__blocks")).cast("int"))

    order = Window.partitionBy("__src").orderBy("__bh", "__block")
    blocks = keyed.groupBy("__src", "__block", "__epochs", "__rest").agg(F.sum("__size").alias("__bsize")).withColumn("__bh", _digest(F.lit(seed), F.col("__src"), F.col("__block")))
    blocks = blocks.select(
        "__src", "__block", "__epochs", "__rest",
        (F.row_number().over(order) - 1).cast("long").alias("__rank"),
        F.coalesce(F.sum("__bsize").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__at"),
        F.count(F.lit(1)).over(Window.partitionBy("__src")).alias("__count"),
    ).withColumn("__some", F.col("__at") < F.col("__rest"))
    blocks = materialize(blocks, "mix-blocks")
    quota = {r["__src"]: (int(r["c"]), int(r["s"])) for r in blocks.groupBy("__src").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("__some").cast("int")).alias("s")).collect()}
    quotas = [owed[i] * quota.get(i, (0, 0))[0] + quota.get(i, (0, 0))[1] for i in range(len(rows))]
    tree = splitting_tree(quotas, shards, seed)
    before = np.vstack([np.zeros((1, len(rows)), np.int64), np.cumsum(np.array(tree, np.int64).reshape(shards, len(rows)), axis=0)[:-1]])
    starts = [(i, before[:, i].tolist()) for i in range(len(rows))]
    starts = _small(spark.createDataFrame(starts, "__src int, __starts array<bigint>"), len(rows) * shards)
    n = F.col("__epochs") + F.col("__some").cast("int")
    at = lambda e: F.size(F.filter(F.col("__starts"), lambda s: s <= e.cast("long") * F.col("__count") + F.col("__rank"))) - 1  # noqa: E731  the last shard that starts at or before the instance
    blocks = blocks.join(starts, "__src").select("__src", "__block", "__at", "__some", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<int>")).alias("__shards"))

    within = Window.partitionBy("__src", "__block").orderBy("__md", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__before", F.coalesce(F.sum("__size").over(within), F.lit(0))).join(blocks, ["__src", "__block"])
    extra = F.col("__some") & (F.col("__at") + F.col("__before") + F.col("__size") / 2 <= F.col("__rest"))
    copies = F.col("__epochs") + extra.cast("int")
    return placed.withColumn("__draws", F.slice("__shards", F.lit(1), copies)).drop("__src", "__block", "__epochs", "__rest", "__blocks", "__md", "__before", "__at", "__some", "__shards")


def draw(plan: DataFrame, own: list[str], seed: int, outer: bool = False) -> DataFrame:
    """The mix: a row for each copy taken, with mix_copy, mix_shard and mix_position; with outer also rows of which none is, where those are null."""
    some = F.posexplode_outer if outer else F.posexplode
    out = plan.select(*own, "__th", some("__draws").alias("mix_copy", "mix_shard"))
    # by the shard and a hash, so that those of which no copy is taken don't meet in one task
    local = Window.partitionBy("mix_shard", F.when(F.col("mix_shard").isNull(), F.xxhash64("doc_id", "__th"))).orderBy(_digest(F.lit(seed), F.col("mix_shard"), F.col("doc_id"), F.col("__th"), F.col("mix_copy")), "doc_id", "mix_copy")
    return out.withColumn("mix_position", F.when(F.col("mix_shard").isNotNull(), F.row_number().over(local) - 1)).drop("__th")


def mix(docs: DataFrame, text_col: str = "text", seed: int = 7, **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy taken, with `mix_copy`, `mix_shard` and `mix_position` (the local shuffle)."""
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_shard", "mix_position")]
    plan = plan_mix(docs.select(*own, count_words(F.col(text_col)).alias("__size"), F.xxhash64(text_col).alias("__th")), seed=seed, **options)
    return draw(plan, own, seed)


def mix_report(docs: DataFrame, text_col: str = "text", seed: int = 7, **options) -> DataFrame:
    """One row a document: size, source_size, target, taken (words of the copies drawn), n_copies, and shards and positions of the copies."""
    sized = docs.select("doc_id", "source", count_words(F.col(text_col)).alias("__size"), F.xxhash64(text_col).alias("__th"), F.monotonically_increasing_id().alias("__row"))
    plan = plan_mix(materialize(sized, "mix-sizes"), seed=seed, **options)
    drawn = draw(plan, ["__row", "doc_id", "__size", "__source_size", "__target"], seed, outer=True)
    copies = F.array_sort(F.collect_list(F.when(F.col("mix_shard").isNotNull(), F.struct("mix_copy", "mix_shard", "mix_position"))))
    taken = F.sum(F.when(F.col("mix_shard").isNotNull(), F.col("__size")).otherwise(0))
    one = drawn.groupBy("__row", "doc_id", "__size", "__source_size", "__target").agg(taken.alias("taken"), copies.alias("c"))
    return one.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "taken",
        F.size("c").alias("n_copies"), F.col("c.mix_shard").alias("shards"), F.col("c.mix_position").alias("positions"),
    )
