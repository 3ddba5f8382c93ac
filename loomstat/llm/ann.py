"""Approximate nearest neighbours: one HNSW graph per shard, merged results.

Distinct vectors (with the ids of their copies) fall by hash into shards of
about `shard_size`. Each shard is built alone into a hierarchical navigable
small-world graph, stored as flat neighbour arrays: a row of the index table
holds the shard's vectors, its levels, and for each level an int32 matrix of
neighbours, -1 where there is none. Queries, distinct vectors too, go in
blocks to every shard; each shard gives its nearest, which are merged by
exact distances in double precision on the original vectors.

Copies cost nothing: of each distinct vector the k + 1 smallest ids are kept,
which is all that k results can use (ties go to smaller ids, and a query
leaves out itself). Vectors that are null, empty, zero or hold null or
non-finite components take no part; only vectors of one length are compared.
Rows with null vec_id take no part.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


class Hnsw:
    """A graph over the rows of x. links: node `links` on each upper level, twice as many on level 0."""

    def __init__(self, x: np.ndarray, links: int = 12, breadth: int = 64, seed: int = 1, graph=None):
        self.x = np.ascontiguousarray(x, np.float32)
        self.links, self.breadth = links, breadth
        if graph is not None:
            self.levels, self.near, self.entry = graph
            return
        n = len(x)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(links)).astype(np.int32), 8)
        self.near = [np.full((n, 2 * links if lv == 0 else links), -1, np.int32) for lv in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = 0
        for i in range(1, n):
            self._insert(i)

    def _dist(self, q: np.ndarray, ids) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        near, seen = self.near[level], {i for _, i in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= breadth:
                break
            new = [j for j in near[i].tolist() if j >= 0 and j not in seen]
            if not new:
                continue
            seen.update(new)
            worst = -best[0][0]
            for e, j in zip(self._dist(q, new).tolist(), new, strict=True):
                if len(best) < breadth or e < worst:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > breadth:
                        heapq.heappop(best)
                    worst = -best[0][0]
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that lie in different directions first, then the nearest of the rest."""
        ids = [i for _, i in found]
        v = self.x[ids]
        sq = (v * v).sum(1)
        between = sq[:, None] + sq[None] - 2 * (v @ v.T)
        kept, rest = [], []
        for k, (d, _) in enumerate(found):
            if len(kept) < most and (not kept or d < between[k, kept].min()):
                kept.append(k)
            else:
                rest.append(k)
        return [ids[k] for k in (kept + rest)[:most]]

    def _insert(self, i: int) -> None:
        q, top = self.x[i], int(self.levels[self.entry])
        at = [(float(self._dist(q, [self.entry])[0]), self.entry)]
        for level in range(top, int(self.levels[i]), -1):
            at = self._search(q, at, 1, level)
        for level in range(min(top, int(self.levels[i])), -1, -1):
            at = self._search(q, at, self.breadth, level)
            near, most = self.near[level], self.near[level].shape[1]
            own = self._choose(at, self.links)
            near[i, : len(own)] = own
            for j in own:
                row = near[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    ids = [*row.tolist(), i]
                    d = self._dist(self.x[j], ids)
                    row[:] = self._choose(sorted(zip(d.tolist(), ids, strict=True)), most)
        if self.levels[i] > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, breadth: int) -> list[int]:
        q = np.asarray(q, np.float32)
        at = [(float(self._dist(q, [self.entry])[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self._search(q, at, 1, level)
        return [i for _, i in self._search(q, at, max(k, breadth), 0)[:k]]


INDEX = "shard long, dim int, n int, vectors binary, keys array<bigint>, levels binary, near array<binary>, entry int"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (double array) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v")).where((F.size("v") > 0) & F.coalesce(ok, F.lit(False)))


def distinct_vectors(rows: DataFrame, ids: int, split: int = 32) -> DataFrame:
    """key, v, ids: each distinct vector with its `ids` smallest vec_ids. Hot vectors are cut in `split` parts first."""
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.xxhash64("v"))  # -0.0 is 0.0
    one = Window.partitionBy("key", "v", "part").orderBy("vec_id")
    some = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(split))).withColumn("r", F.row_number().over(one)).where(F.col("r") <= ids)
    return some.groupBy("key", "v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, ids).alias("ids"))


def build_index(distinct: DataFrame, *, shard_size: int = 8192, links: int = 12, breadth: int = 64) -> DataFrame:
    n = distinct.count()
    shards = max(1, round(n / shard_size))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x = np.array(pdf["v"].tolist(), np.float64)
        g = Hnsw(x, links, breadth)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "dim": [x.shape[1]], "n": [len(x)], "vectors": [x.tobytes()], "keys": [pdf["key"].to_numpy()], "levels": [g.levels.tobytes()], "near": [[a.tobytes() for a in g.near]], "entry": [g.entry]})

    rows = distinct.select("key", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard", "dim").applyInPandas(build, INDEX)


def search_index(index: DataFrame, queries: DataFrame, *, k: int, breadth: int, block: int = 512) -> DataFrame:
    """qkey, key, score: for each query (key, v) the k nearest keys of each shard, with exact distances."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.vectors, np.float64).reshape(r.n, r.dim)
                lv = np.frombuffer(r.levels, np.int32)
                near = [np.frombuffer(a, np.int32).reshape(r.n, -1) for a in r.near]
                g = Hnsw(x, graph=(lv, near, r.entry))
                q = np.array([list(v) for v in r.qv], np.float64)
                out = []
                for key, v in zip(r.qkeys, q, strict=True):
                    ids = g.search(v, k, breadth)
                    d = np.sqrt(((x[ids] - v) ** 2).sum(1))
                    out.append(pd.DataFrame({"qkey": key, "key": np.asarray(r.keys)[ids], "score": d}))
                yield pd.concat(out)

    blocks = queries.select("key", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(max(1, -(-queries.count() // block)))).alias("b"))
    blocks = blocks.groupBy("b", "dim").agg(F.collect_list("key").alias("qkeys"), F.collect_list("v").alias("qv"))  # about `block` queries
    shards = index.select("dim", "shard")
    sent = blocks.join(shards, "dim").select("shard", "dim", "qkeys", "qv")  # each query block to each shard
    return sent.join(index, ["shard", "dim"]).mapInPandas(run, "qkey long, key long, score double")


def nearest(vectors: DataFrame, *, every: int = 100, k: int = 10, shard_size: int = 8192, links: int = 12, breadth: int = 64, search_breadth: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`."""
    rows = usable(vectors)
    distinct = materialize(distinct_vectors(rows, k + 1), "vectors")
    index = materialize(build_index(distinct, shard_size=shard_size, links=links, breadth=breadth), "hnsw")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.xxhash64("v"))
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "key", "v").distinct(), "queries")
    queries = asked.groupBy("key").agg(F.first("v").alias("v"))
    found = search_index(index, queries, k=k + 1, breadth=search_breadth)
    top = Window.partitionBy("qkey").orderBy("score", "lead")
    best = found.join(distinct.select("key", "ids", F.element_at("ids", 1).alias("lead")), "key").withColumn("r", F.dense_rank().over(top)).where(F.col("r") <= k + 1)
    best = best.select("qkey", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("qkey").orderBy("score", "vec_id")
    best = best.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))
    out = asked.join(best, asked["key"] == best["qkey"]).select("query_id", F.filter("all", lambda x: x["vec_id"] != F.col("query_id")).alias("all"))
    return out.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
