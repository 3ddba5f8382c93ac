"""Neighbour models on training tables of any size, exact: all rows are compared, in blocks.

Equal rows are one vector with a weight, so a hot value costs one row. Query
and training vectors are dealt to blocks by hash; a task compares one block of
queries with one of training vectors and gives each query its nearest in that
block, and these lists are merged. Ties go to the smaller vector. The
comparisons are queries x training vectors; a task holds 2 * BLOCK vectors.
Rows with a null take no part and have no score.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detector_kernels as N

#: Vectors of each side in a task, and queries compared at once.
BLOCK, AT_ONCE = 8192, 256


def vector(features: list[str]) -> Column:
    """The features as one array of doubles; null where one of them is null or NaN."""
    x = [F.col(c).cast("double") for c in features]
    return F.when(reduce(and_, [c.isNotNull() & ~F.isnan(c) for c in x]), F.array(*x))


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """x, w: each distinct vector and its rows."""
    return df.select(vector(features).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("w"))


def by_blocks(queries: DataFrame, train: DataFrame, compare, schema: str) -> DataFrame:
    """compare(queries, vectors, weights) -> columns beside x; one row a query and block of train (x, w)."""
    i, j = (max(1, math.ceil(t.count() / BLOCK)) for t in (queries, train))
    own = lambda n: F.pmod(F.xxhash64("x"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.select("x", F.lit(0).cast("long").alias("w"), own(i).alias("i"), every(j).alias("j"))
    held = train.select("x", "w", every(i).alias("i"), own(j).alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(list(pdf["x"])), pdf["w"].to_numpy()
        a, b, w = x[w == 0], x[w > 0], w[w > 0]
        if not len(a) or not len(b):
            return pd.DataFrame()
        order = np.lexsort(b.T[::-1])
        b, w = b[order], w[order]
        parts = [pd.DataFrame({"x": list(a[s : s + AT_ONCE])} | compare(a[s : s + AT_ONCE], b, w)) for s in range(0, len(a), AT_ONCE)]
        return pd.concat(parts)

    return asks.union(held).groupBy("i", "j").applyInPandas(run, f"x array<double>, {schema}")


def nearest(queries: DataFrame, train: DataFrame, k: int, metric: str = "euclidean", skip_self: bool = False) -> DataFrame:
    """x, near: the k nearest training rows as (d, v, m), distance, vector and how many of its rows, nearest first."""
    most = k + skip_self

    def compare(a, b, w):
        d = N.distances(a, b, metric)
        n = min(most, len(b))
        last = np.partition(d, n - 1, axis=1)[:, n - 1]
        at = []
        for row, edge in zip(d, last, strict=True):
            c = np.flatnonzero(row <= edge)
            at.append(c[np.argsort(row[c], kind="stable")][:n])
        return {"d": [row[c] for row, c in zip(d, at, strict=True)], "v": [b[c].tolist() for c in at], "m": [w[c] for c in at]}

    parts = by_blocks(queries, train, compare, "d array<double>, v array<array<double>>, m array<bigint>")
    near = parts.groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "v", "m")))), 1, most).alias("near"))
    if skip_self:
        left = F.transform("near", lambda e: F.struct(e["d"].alias("d"), e["v"].alias("v"), (e["m"] - (e["v"] == F.col("x")).cast("long")).alias("m")))
        near = near.select("x", F.filter(left, lambda e: e["m"] > 0).alias("near"))
    before = lambda i: F.aggregate(F.slice("near", F.lit(1), i), F.lit(0).cast("long"), lambda t, e: t + e["m"])
    cut = F.transform("near", lambda e, i: F.struct(e["d"].alias("d"), e["v"].alias("v"), F.least(e["m"], F.lit(k) - before(i)).alias("m")))
    return near.select("x", F.filter(cut, lambda e: e["m"] > 0).alias("near"))


def _mean(near: DataFrame, stats: DataFrame, value: Column, name: str) -> DataFrame:
    """x, name: the mean of value over the neighbours (d, and what stats holds of each vector)."""
    flat = near.select("x", F.explode("near").alias("e")).select("x", "e.d", F.col("e.v").alias("v"), "e.m")
    return flat.join(stats.withColumnRenamed("x", "v"), "v").groupBy("x").agg((F.sum(value * F.col("m")) / F.sum("m")).alias(name))


def _by_row(near: DataFrame, score, name: str) -> DataFrame:
    """x, name: score(vector, its neighbours' vectors, each as often as it counts)."""
    rows = near.select("x", F.transform("near", lambda e: e["v"]).alias("v"), F.transform("near", lambda e: e["m"]).alias("m"))

    def run(batches):
        for p in batches:
            p[name] = [score(x, np.repeat(np.stack(list(v)), m, axis=0)) for x, v, m in zip(p["x"], p["v"], p["m"], strict=True)]
            yield p[["x", name]]

    return rows.mapInPandas(run, f"x array<double>, {name} double")


def _keep(train, c):
    return {}


def knn_score(state, queries, train, c):
    near = nearest(queries, train, c["n_neighbors"], c["distance_metric"])
    d = F.flatten(F.transform("near", lambda e: F.array_repeat(e["d"], e["m"].cast("int"))))
    half = F.size(d) / 2
    out = {
        "maximum": F.array_max(d),
        "mean": F.aggregate(d, F.lit(0.0), lambda t, x: t + x) / F.size(d),
        "median": (F.element_at(d, F.ceil(half).cast("int")) + F.element_at(d, (F.floor(half) + 1).cast("int"))) / 2,
    }[c["score_method"]]
    return near.select("x", out.alias("score"))


def _reach(near: DataFrame, kd: DataFrame) -> DataFrame:
    return _mean(near, kd, F.greatest("d", "kd"), "r").select("x", (1 / (F.col("r") + 1e-10)).alias("lrd"))


def lof_fit(train, c):
    near = nearest(train.select("x"), train, c["n_neighbors"], skip_self=True).cache()
    kd = near.select("x", F.array_max(F.transform("near", lambda e: e["d"])).alias("kd"))
    return {"kd": kd, "lrd": _reach(near, kd).cache()}


def lof_score(state, queries, train, c):
    near = nearest(queries, train, c["n_neighbors"]).cache()
    around = _mean(near, state["lrd"], F.col("lrd"), "around")
    return _reach(near, state["kd"]).join(around, "x").select("x", (F.col("around") / F.col("lrd")).alias("score"))


def abod_score(state, queries, train, c):
    k = c["n_neighbors"]
    return _by_row(nearest(queries, train, k + 1), lambda x, near: N.angle_spread(near - x, k), "score")


def _chains(near: DataFrame, name: str) -> DataFrame:
    return _by_row(near, lambda x, v: N.chain(np.vstack([x, v])), name)


def cof_fit(train, c):
    return {"ac": _chains(nearest(train.select("x"), train, c["n_neighbors"], skip_self=True), "ac").cache()}


def cof_score(state, queries, train, c):
    near = nearest(queries, train, c["n_neighbors"]).cache()
    around = _mean(near, state["ac"], F.col("ac"), "around")
    return _chains(near, "own").join(around, "x").select("x", (F.col("own") / F.greatest("around", F.lit(1e-10))).alias("score"))


def kde_score(state, queries, train, c):
    h = c["bandwidth"]
    n = train.agg(F.sum("w")).first()[0]

    def compare(a, b, w):
        e = -0.5 * (N.distances(a, b) / h) ** 2
        top = e.max(1)
        return {"top": top, "s": (np.exp(e - top[:, None]) * w).sum(1)}

    parts = by_blocks(queries, train, compare, "top double, s double").groupBy("x").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "s")).alias("p"))
    total = F.aggregate(F.transform("p", lambda e: e["s"] * F.exp(e["top"] - F.col("top"))), F.lit(0.0), lambda t, v: t + v)
    d = F.size("x")
    return parts.select("x", (-(F.col("top") + F.log(total) - math.log(n) - d * math.log(h) - d / 2 * math.log(2 * math.pi))).alias("score"))


def sod_fit(train, c):
    k = max(1, min(c["n_neighbors"], (train.agg(F.sum("w")).first()[0] or 0) - 1))
    near = nearest(train.select("x"), train, k, skip_self=True)
    return {"k": k, "lists": near.select(F.col("x").alias("v"), F.transform("near", lambda e: F.xxhash64(e["v"])).alias("ids"), F.transform("near", lambda e: e["m"]).alias("ms")).cache()}


def _shared(own: dict, mine: int, m: int, ids, ms) -> list[int]:
    """How many of a row's neighbours (own: rows of each vector) each of m equal rows of vector `mine` has among its own."""
    t = s = 0
    for u, n in zip(ids, ms, strict=True):
        if u == mine:
            t = n
        else:
            s += min(own.get(u, 0), n)
    # of its own vector a row has the first t other rows
    return [s + (t if r >= t else min(m, t + 1) - 1) for r in range(m)]


def sod_score(state, queries, train, c):
    flat = nearest(queries, train, state["k"]).select("x", F.posexplode("near").alias("pos", "e")).select("x", "pos", F.col("e.v").alias("v"), "e.m")
    parts = ["v", "m", "id", "ids", "ms"]
    full = flat.join(state["lists"], "v").withColumn("id", F.xxhash64("v")).groupBy("x").agg(F.array_sort(F.collect_list(F.struct("pos", *parts))).alias("near"))
    most, alpha = min(c["ref_set"], state["k"]), c["alpha"]

    def one(x, v, m, i, ids, ms):
        own = dict(zip(i, m, strict=True))
        shared = np.concatenate([_shared(own, *z) for z in zip(i, m, ids, ms, strict=True)])
        ref = np.repeat(np.stack(list(v)), m, axis=0)[np.argsort(-shared, kind="stable")[:most]]
        return N.subspace_deviation(x, ref, alpha)

    def run(batches):
        for p in batches:
            p["score"] = [one(*z) for z in zip(p["x"], *[p[n] for n in parts], strict=True)]
            yield p[["x", "score"]]

    return full.select("x", *[F.col("near")[n].alias(n) for n in parts]).mapInPandas(run, "x array<double>, score double")


def sos_score(train, c):
    """x, score of all vectors of train against each other: a task has its share of the rows and all distinct vectors."""
    spark, d = train.sparkSession, len((train.first() or [[]])[0])
    finite = F.forall("x", lambda v: F.abs(v) < math.inf)
    held = train.where(finite).select(*[F.col("x")[j].alias(f"x{j}") for j in range(d)], "w").toPandas().to_numpy(float)
    held = held[np.lexsort(held.T[::-1])]
    x, w = held[:, :d], held[:, d]
    if w.sum() < 2:
        return train.where(finite).select("x", F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast((x, w))

    def run(batches):
        x, w = sent.value
        out = np.zeros(len(x))
        for p in batches:
            i = p["id"].to_numpy()
            out += N.sos_logs(x[i], i, x, w, c["perplexity"], c["eps"])
        some = np.flatnonzero(out)
        for s in range(0, len(some), 1 << 14):
            at = some[s : s + (1 << 14)]
            yield pd.DataFrame({"x": list(x[at]), "t": out[at]})

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(len(x) / BLOCK))
    logs = spark.range(0, len(x), 1, tasks).mapInPandas(run, "x array<double>, t double").groupBy("x").agg(F.sum("t").alias("t"))
    return train.where(finite).select("x").join(logs, "x", "left").select("x", F.exp(F.coalesce("t", F.lit(0.0))).alias("score"))


#: name: (fit(train, config) -> state, score(state, queries, train, config) -> x, score)
MODELS = {"knn": (_keep, knn_score), "lof": (lof_fit, lof_score), "abod": (_keep, abod_score), "cof": (cof_fit, cof_score), "kde": (_keep, kde_score), "sod": (sod_fit, sod_score)}
#: name: score(train, config) -> x, score of each vector among all
TRANSDUCTIVE = {"sos": sos_score}
