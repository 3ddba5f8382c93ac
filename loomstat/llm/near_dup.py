"""MinHash near-dedup by chosen-path set similarity join.

Documents are sets of 5-word shingles. Equal sets form a class, told by two
64-bit sums over the set's shingle hashes and its size; classes are what is
joined. Each independent tree branches the classes by selected minwise
tokens: a node selects `BRANCH` of the `sketch` minhash coordinates and sends
a class to the child of its value in each. A pair of similarity J stays
together in some child with probability 1-(1-J)**BRANCH, so the number of
trees follows from the target recall. A node of at most `small` classes is
compared exhaustively. A larger one is compared with `pivots` of its classes,
chosen by hash, and branches on; nodes whose classes are linked already,
directly or not, end. Pairs are tested on size and sketch where they meet, so
only likely ones leave a node; they are then confirmed on full shingle sets.
A true link fails the sketch test with a probability under 3e-6.

In nodes that are still large at `max_depth`, every class outside the pivots'
main component is compared with the whole node on full sets, in blocks of a
bounded size on both sides; a block gives no pairs but the links that join
components, so what leaves it doesn't grow with the square of the node. The
comparisons do: a node of n classes that aren't linked takes n * n / 2 of them.

Links are merged to components in DataFrames; nothing of the documents is
collected. Empty and null texts have no shingles and link with nothing. A null
doc_id takes no part: its component is null and it is kept. Rows with one
doc_id and different texts each link by their own text, and a component is
named by the smallest doc_id in it. Other columns are ignored, whatever their
names; `keep_one` keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

BRANCH = 2


def _sums(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of each set's hashes, modulo 2**64."""
    out = []
    for x in (flat, K.mix64(flat)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _class() -> Column:
    return F.xxhash64("s1", "s2", "n")


def sketches(docs: DataFrame, text_col: str, shingle: int, sketch: int, seed: int) -> DataFrame:
    """doc_id, n (set size), mh (minhashes), rep (class; null for empty sets)."""

    @K.frugal
    def run(batches):
        for b in batches:
            for i, j, data, offs in K.slices(b.column(1)):
                flat, at = K.shingle_sets(*K.word_hashes(data, offs), shingle)
                values = pa.array(K.minhashes(flat, at, sketch, seed).view(np.int32).ravel())
                s1, s2 = _sums(flat, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * sketch), values)], names=["doc_id", "n", "s1", "s2", "mh"])

    out = docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, mh array<int>")
    return out.select("doc_id", "n", "mh", F.when(F.col("n") > 0, _class()).alias("rep"))


def full_sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """rep (class) and s, the sorted set, for each row of docs."""

    @K.frugal
    def run(batches):
        for b in batches:
            for _, _, data, offs in K.slices(b.column(0)):
                flat, at = K.shingle_sets(*K.word_hashes(data, offs), shingle)
                s1, s2 = _sums(flat, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))], names=["n", "s1", "s2", "s"])

    return docs.select(text_col).mapInArrow(run, "n long, s1 long, s2 long, s array<bigint>").select(_class().alias("rep"), "s")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over edges (a, b), for ids that are in edges.

    Each round hooks every vertex to its smallest neighbour, flattens the trees by pointer jumping and contracts them.
    """
    rest = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("id"), F.col("b").alias("to")).union(rest.select(F.col("b").alias("id"), F.col("a").alias("to")))
        tree = materialize(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")), "hooks")
        while True:
            up = tree.select(F.col("id").alias("label"), F.col("label").alias("__up"))
            tree = materialize(tree.join(up, "label").select("id", F.col("__up").alias("label"), (F.col("__up") != F.col("label")).alias("moved")), "jump")
            if tree.where("moved").isEmpty():
                break
        tree = tree.select("id", "label")
        found = tree if found is None else materialize(found.select("id", F.col("label").alias("m")).join(tree.select(F.col("id").alias("m"), F.col("label").alias("up")), "m", "left").select("id", F.coalesce("up", "m").alias("label")).union(tree.join(found.select("id"), "id", "left_anti")), "labels")
        t = tree.select(F.col("id").alias("a"), F.col("label").alias("la"))
        rest = rest.join(t, "a").join(t.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b")
        rest = materialize(rest.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("id"), F.col("a").alias("label")).limit(0)


def likely(x: str, y: str, percent: int, least: int) -> Column:
    """Whether two documents aren't linked yet, are near enough in size for a link, and agree in enough of the sketch."""
    sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent
    same = F.aggregate(F.zip_with(f"{x}.mh", f"{y}.mh", lambda u, v: (u == v).cast("int")), F.lit(0), lambda t, u: t + u)
    return (F.col(f"{x}.label") != F.col(f"{y}.label")) & sizes & (same >= least)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.rep", f"{y}.rep").alias("a"), F.greatest(f"{x}.rep", f"{y}.rep").alias("b")]


def by_class(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """nodes (rep, label, key and others) and what reps holds of each class; a class in many nodes is looked up once."""
    others = [c for c in nodes.columns if c not in ("rep", "label")]
    held = nodes.groupBy("rep").agg(F.first("label").alias("label"), F.collect_list(F.struct(*others)).alias("__nodes"))
    return held.join(reps, "rep").withColumn("__e", F.explode("__nodes")).select("rep", "label", *[c for c in reps.columns if c != "rep"], "__e.*")


def small_pairs(nodes: DataFrame, percent: int, least: int) -> DataFrame:
    """Likely pairs within nodes of bounded size."""
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & likely("x", "y", percent, least)
    return nodes.alias("x").join(nodes.alias("y"), on).select(*_ordered("x", "y"))


def pivot_pairs(nodes: DataFrame, pivots: DataFrame, percent: int, least: int) -> DataFrame:
    """Likely pairs of a node's documents with its pivots."""
    on = (F.col("x.key") == F.col("p.key")) & likely("x", "p", percent, least)
    return nodes.alias("x").join(pivots.alias("p"), on).select(*_ordered("x", "p"))


def sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, *, text_col: str, shingle: int, broadcast_ids: int) -> DataFrame:
    """rep and s of the classes in ids (rep)."""
    wanted = materialize(reps.join(ids, "rep", "left_semi").select(F.col("doc").alias("doc_id")), "wanted")
    few = wanted.count() <= broadcast_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col).join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return materialize(full_sets(texts, text_col, shingle), "sets").join(ids, "rep", "left_semi").dropDuplicates(["rep"])


def link_block(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that join components, between a block's classes outside the main component (side 1) and a block of the node (side 0).

    Sets are numbered once; a class is then compared with the whole block by one look-up of each of the block's shingles.
    A pair that several nodes hold is left to the one with the smallest key.
    """
    pdf = pdf.sort_values(["side", "rep"], kind="stable")
    side, rep, n = pdf["side"].to_numpy(), pdf["rep"].to_numpy(), np.array([len(s) for s in pdf["s"]])
    w, o = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(w) or not len(o):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    flat, number = np.unique(np.concatenate([np.asarray(s, np.int64) for s in pdf["s"]]), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(n)))
    whole = number[: at[len(w)]]
    # nodes with a smaller key that hold both
    key, lists = pdf["key"].iloc[0], [[k for k in x if k < pdf["key"].iloc[0]] for x in pdf["keys"]]
    names = {k: i for i, k in enumerate(sorted({k for x in lists for k in x}))}
    member = np.zeros((len(pdf), len(names)), np.float32)
    for i, x in enumerate(lists):
        member[i, [names[k] for k in x]] = 1
    elsewhere = member[o] @ member[w].T > 0
    free = ~elsewhere & ((pdf["main"].to_numpy()[w] == 1)[None] | (rep[w][None] > rep[o][:, None]))
    low, high = np.minimum(n[o][:, None], n[w][None]), np.maximum(n[o][:, None], n[w][None])
    free &= 100 * low >= percent * high
    top: dict = {}

    def root(x):
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    labels, out, mask = pdf["label"].tolist(), [], np.zeros(len(flat), bool)
    for r, i in enumerate(o.tolist()):
        if not free[r].any():
            continue
        own = number[at[i] : at[i + 1]]
        mask[own] = True
        both = np.add.reduceat(mask[whole].astype(np.int32), at[: len(w)])
        mask[own] = False
        for k in np.flatnonzero(free[r] & (100 * both >= percent * (n[i] + n[w] - both))).tolist():
            x, y = root(labels[i]), root(labels[w[k]])
            if x != y:
                top[x] = y
                out.append((min(rep[i], rep[w[k]]), max(rep[i], rep[w[k]])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def block_links(live: DataFrame, reps: DataFrame, docs: DataFrame, *, percent: int, block: int, block_shingles: int, **options) -> DataFrame:
    """Links within nodes of any size, in blocks: what is outside the main component of a node meets the whole node."""
    sized = by_class(live.select("key", "rep", "label", "main"), reps.select("rep", "n"))
    parts = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("wp"), F.greatest(F.ceil(F.sum((F.col("label") != F.col("main")).cast("int")) / block), F.ceil(F.sum(F.when(F.col("label") != F.col("main"), F.col("n"))) / block_shingles), F.lit(1)).cast("int").alias("op"))
    sets = sets_of(live.select("rep").distinct(), reps, docs, **options)
    # a class in many nodes is one row, joined once with its set
    held = live.select("key", "rep", "label", (F.col("label") == F.col("main")).cast("int").alias("main")).join(parts, "key").groupBy("rep").agg(F.first("label").alias("label"), F.collect_list(F.struct("key", "main", "op", "wp")).alias("nodes"))
    rows = materialize(held, "blocks").join(sets, "rep").select("rep", "label", "s", F.col("nodes")["key"].alias("keys"), F.explode("nodes").alias("e")).select("rep", "label", "s", "keys", "e.*")
    own = lambda p: F.pmod(F.xxhash64("rep"), F.col(p)).cast("int")
    every = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    cols = ["key", "i", "j", "side", "rep", "label", "main", "keys", "s"]
    whole = rows.withColumn("j", own("wp")).withColumn("i", every("op")).withColumn("side", F.lit(0)).select(*cols)
    others = rows.where("main = 0").withColumn("i", own("op")).withColumn("j", every("wp")).withColumn("side", F.lit(1)).select(*cols)
    return whole.union(others).groupBy("key", "i", "j").applyInPandas(lambda pdf: link_block(pdf, percent), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, text_col: str = "text", shingle: int = 5, percent: int = 85, recall: float = 0.99999, sketch: int = 64, small: int = 64, block: int = 1024, block_shingles: int = 1 << 19, pivots: int = 5, max_depth: int = 2, seed: int = 3, broadcast_ids: int = 500_000
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    s = percent / 100
    lost = (1 - s) ** BRANCH
    for _ in range(max_depth):  # that a pair parts somewhere on the way down
        lost = (1 - s + s * lost) ** BRANCH
    trees = max(1, math.ceil(math.log(1 - recall) / math.log(lost)))
    if trees * BRANCH > sketch:
        raise ValueError("the sketch has too few coordinates for this recall")
    least = max(0, math.floor(sketch * s - 5 * math.sqrt(sketch * s * (1 - s))))
    nulls = docs.where("doc_id is null").select("doc_id", F.col(text_col))
    known = docs.where("doc_id is not null")
    options = {"text_col": text_col, "shingle": shingle, "broadcast_ids": broadcast_ids}

    sets = materialize(sketches(known, text_col, shingle, sketch, seed), "sketches")
    reps = materialize(sets.where("rep is not null").groupBy("rep").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("mh").alias("mh")), "representatives")

    rng = np.random.default_rng([seed, 1])
    roots = rng.permutation(sketch)[: trees * BRANCH]
    keys = F.array(*[F.xxhash64(F.lit(t // BRANCH), F.lit(int(c)), F.get("mh", F.lit(int(c)))) for t, c in enumerate(roots)])
    nodes = reps.select("rep", F.explode(keys).alias("key"))
    labels, links = None, None
    for depth in range(1, max_depth + 2):
        if labels is not None:
            nodes = nodes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        else:
            nodes = nodes.withColumn("label", F.col("rep"))
        nodes = nodes.distinct()
        stats = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64(F.lit(depth), F.lit(j), "rep").alias("h"), "rep", "label")) for j in range(pivots)])).alias("pivots")).where("size > 1 and lo <> hi").drop("lo", "hi")
        own = F.transform("pivots", lambda p: p["label"])
        stats = stats.withColumn("main", F.array_max(F.transform(own, lambda x: F.struct(F.size(F.filter(own, lambda y: y == x)).alias("c"), x.alias("l"))))["l"])
        live = materialize(nodes.join(stats, "key"), "nodes")
        if live.isEmpty():
            break
        last = depth > max_depth
        if last:
            edges = materialize(block_links(live.drop("pivots"), reps, known, percent=percent, block=block, block_shingles=block_shingles, **options), "links")
            edges = None if edges.isEmpty() else edges
        else:
            large = live.where(F.col("size") > small)
            lead = large.select("key", "pivots").dropDuplicates(["key"]).select("key", F.explode("pivots").alias("p")).select("key", "p.rep", "p.label")
            full = [by_class(x.select("key", "rep", "label"), reps.drop("doc")) for x in (live.where(F.col("size") <= small), large, lead)]
            pairs = small_pairs(full[0], percent, least).union(pivot_pairs(full[1], full[2], percent, least)).distinct()
            edges = confirm(pairs, reps, known, percent=percent, **options)
        if edges is not None:
            links = edges if links is None else materialize(links.union(edges), "links")
            labels = components(links).withColumnRenamed("id", "rep")
        if last:
            break
        nodes = large.select("key", "rep")
        if depth < max_depth:
            child = [F.pmod(F.xxhash64("key", F.lit(j)), F.lit(sketch)).cast("int") for j in range(BRANCH)]
            nodes = by_class(large.select("key", "rep", "label"), reps.drop("doc")).select("rep", F.explode(F.array(*[F.xxhash64("key", c, F.get("mh", c)) for c in child])).alias("key"))
    # a class' component is named by the smallest doc_id of its classes
    named = reps.select("rep", F.col("doc").alias("component_id"))
    if labels is not None:
        smallest = labels.join(reps.select("rep", "doc"), "rep").groupBy("label").agg(F.min("doc").alias("lead"))
        linked = labels.join(smallest, "label").select("rep", "lead")
        named = named.join(linked, "rep", "left").select("rep", F.coalesce("lead", "component_id").alias("component_id"))
    out = sets.select("doc_id", "n", "rep").join(named, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if nulls.isEmpty():
        return out
    loose = sketches(nulls, text_col, shingle, 1, seed).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(loose)


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, *, percent: int, **options) -> DataFrame | None:
    """The pairs (a, b) of classes whose full sets are similar enough; None if there are none."""
    pairs = materialize(pairs, "likely")
    if pairs.isEmpty():
        return None
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = sets_of(ids, reps, docs, **options)
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    links = materialize(both.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b"), "links")
    return None if links.isEmpty() else links


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near copies: of each component the documents with the smallest doc_id stay; columns as they are."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
