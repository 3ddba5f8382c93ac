"""Language-model scoring with a hidden Markov model trained by Baum-Welch.

A token is emitted in two steps: a latent state emits one of `symbols` hash
classes (or the unknown class, or the end), and the class emits the word with
its share of the class's smoothed unigram probability. So the parameters of
the chain have a fixed size, the word counts cover all training documents,
and the distribution over known words, end and unknown sums to 1:

    P(text) = sum over state paths of prod A[z,z'] B[z',class] * p(w) / p(class)

Training: each partition runs the scaled forward-backward recursion over its
documents, each from end to end, and adds up expected counts; these are summed
over partitions, and the new parameters go out for the next iteration. The
start values come from all training documents too: the main axes of their
places in a random projection part them into one group a state.
Scoring: the scaled forward recursion over the whole text, exact.

Word counts are looked up in a sorted table of at most `table_words` words
(12 bytes each), the most frequent ones; any rarer words' counts are joined
by a shuffle. Null and empty texts are one end token. Words are 64-bit hashes.
Each row is scored by itself, equal ids and texts too; columns named like the
results are replaced, others kept. Without training tokens all words are
unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

END = K.mix64(np.array([0x454E44], np.uint64))[0]


def with_ends(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word hashes, each text followed by END; offsets."""
    at = first + np.arange(len(first))
    out = np.full(at[-1], END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = words
    return out, at


def symbols_of(words: np.ndarray, symbols: int) -> np.ndarray:
    """Hash class of each word; `symbols` is the unknown class, `symbols` + 1 the end."""
    out = (words & np.uint64(symbols - 1)).astype(np.int32)
    out[words == END] = symbols + 1
    return out


def forward(sym: np.ndarray, at: np.ndarray, pi: np.ndarray, A: np.ndarray, B: np.ndarray, keep: bool = False):
    """Log10 likelihood of each sequence (none is empty); with keep also the scaled alphas and scales of each token."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, size = at[:-1][order], size[order]
    ll = np.zeros(len(size))
    alphas, scales = (np.empty((len(sym), len(pi)), np.float32), np.empty(len(sym))) if keep else (None, None)
    n = len(size)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if n else 0), "left")
    alpha = None
    for t, n in enumerate(alive):
        pos = start[:n] + t
        alpha = (pi if alpha is None else alpha[:n] @ A) * B[sym[pos]]
        c = alpha.sum(1)
        alpha /= c[:, None]
        ll[:n] += np.log10(c)
        if keep:
            alphas[pos], scales[pos] = alpha, c
    out = np.empty(len(size))
    out[order] = ll
    return (out, alphas, scales) if keep else out


def expected_counts(sym: np.ndarray, at: np.ndarray, pi: np.ndarray, A: np.ndarray, B: np.ndarray):
    """Baum-Welch counts: (of classes x states, of transitions, of first states, log10 likelihood)."""
    ll, alphas, scales = forward(sym, at, pi, A, B, keep=True)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    last, size = at[1:][order] - 1, size[order]
    betas = np.empty_like(alphas)
    beta = None
    # from the ends: sequences are aligned at their last token
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for t, n in enumerate(alive):
        pos = last[:n] - t
        if beta is None:
            beta = np.ones((n, len(pi)))
        else:
            nxt = pos + 1
            beta = (beta[:n] * B[sym[nxt]] / scales[nxt][:, None]) @ A.T
        betas[pos] = beta
    gamma = alphas * betas
    emit = np.stack([np.bincount(sym, gamma[:, k], len(B)) for k in range(len(pi))], 1)
    inner = np.ones(len(sym), bool)
    inner[at[1:] - 1] = False
    flow = np.zeros_like(A)
    for lo in range(0, len(sym), 1 << 16):
        here = lo + np.flatnonzero(inner[lo : lo + (1 << 16)])
        flow += alphas[here].T.astype(float) @ (betas[here + 1] * B[sym[here + 1]] / scales[here + 1][:, None])
    return emit, A * flow, gamma[at[:-1]].sum(0, dtype=float), ll.sum()


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(hash, c): how often each token, ends included, occurs in docs."""

    @K.frugal
    def run(batches):
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)].astype(np.int64))], names=["hash", "c"])

        for b in batches:
            for _, _, data, offs in K.slices(b.column(0)):
                w, _ = with_ends(*K.word_hashes(data, offs))
                held.append(w)
                size += len(w)
                if size > 1_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(text_col).mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


def _summed(docs: DataFrame, text_col: str, add, shape: tuple[int, int], symbols: int) -> np.ndarray:
    """The sum over all docs of add(classes of the tokens, offsets), arrays of `shape`."""

    @K.frugal
    def run(batches):
        out = np.zeros(shape)
        for b in batches:
            for _, _, data, offs in K.slices(b.column(0)):
                w, at = with_ends(*K.word_hashes(data, offs))
                out += add(symbols_of(w, symbols), at)
        some = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(out[some, k]) for k in range(shape[1])]], names=["i", *cols])

    cols = [f"v{k}" for k in range(shape[1])]
    sums = docs.select(text_col).mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in cols)).groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect()  # shape[0] rows at most
    out = np.zeros(shape)
    for r in sums:
        out[r["i"]] = [r[c] for c in cols]
    return out


def start_values(docs: DataFrame, text_col: str, prior: np.ndarray, states: int, symbols: int):
    """Start values from all docs, each from end to end: a document belongs to the state of the main axis, and side of it, where its classes lie farthest out."""
    spark, dim = docs.sparkSession.sparkContext, max(16, states)
    signs = np.random.default_rng(5).choice([-1.0, 1.0], (symbols + 2, dim))
    sent = spark.broadcast((signs * (np.maximum(prior, 1e-12) ** -0.25)[:, None]).astype(np.float32))

    def places(sym, at):  # mean place of each text's tokens
        x = np.empty((len(at) - 1, dim))
        step = 1 << 18
        total = np.zeros((1, dim))
        run = [total]
        for lo in range(0, len(sym), step):
            run.append(run[-1][-1] + np.cumsum(sent.value[sym[lo : lo + step]], axis=0, dtype=float))
            cut = at[1:][(at[1:] > lo) & (at[1:] <= lo + step)]
            x[np.searchsorted(at[1:], cut)] = run[-1][cut - lo - 1]
            run = [run[-1][-1:]]
        return np.diff(x, axis=0, prepend=0.0) / np.diff(at)[:, None]

    def moments(sym, at):
        x, n = places(sym, at), np.diff(at).astype(float)
        return np.concatenate([(x * n[:, None]).T @ x, (n @ x)[None], np.full((1, dim), n.sum())])

    sums = _summed(docs, text_col, moments, (dim + 2, dim), symbols)
    n = max(sums[dim + 1, 0], 1.0)
    mean = sums[dim] / n
    size, axes = np.linalg.eigh(sums[:dim] / n - np.outer(mean, mean))
    main = axes[:, ::-1][:, : (states + 1) // 2] / np.sqrt(np.maximum(size[::-1][: (states + 1) // 2], 1e-12))

    def groups(sym, at):
        y = (places(sym, at) - mean) @ main
        group = np.stack([y, -y], 2).reshape(len(y), -1)[:, :states].argmax(1)
        return np.bincount(sym * states + np.repeat(group, np.diff(at)), minlength=(symbols + 2) * states).reshape(-1, states)

    own = _summed(docs, text_col, groups, (symbols + 2, states), symbols)
    B = (own + 500 * prior[:, None]) / (own.sum(0) + 500)
    A = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(A, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), A, B


def baum_welch_step(docs: DataFrame, text_col: str, params, symbols: int, most: int = 500_000):
    """Expected counts over all docs, in batches of about `most` tokens."""
    pi, A, B = params
    states = len(pi)
    sent = docs.sparkSession.sparkContext.broadcast(params)  # (symbols + 2 + states + 1) x states floats

    @K.frugal
    def run(batches):
        pi, A, B = sent.value
        emit, flow, first, ll = np.zeros_like(B), np.zeros_like(A), np.zeros_like(pi), 0.0
        held: list = []

        def add():
            nonlocal emit, flow, first, ll
            sym = np.concatenate([s for s, _ in held])
            base = np.cumsum([0] + [len(s) for s, _ in held])
            at = np.concatenate([a[:-1] + o for (_, a), o in zip(held, base, strict=False)] + [[base[-1]]])
            e, f, p, x = expected_counts(sym, at, pi, A, B)
            emit, flow, first, ll = emit + e, flow + f, first + p, ll + x

        for b in batches:
            for _, _, data, offs in K.slices(b.column(0)):
                w, at = with_ends(*K.word_hashes(data, offs))
                held.append((symbols_of(w, symbols), at))
                if sum(len(s) for s, _ in held) > most:
                    add()
                    held = []
        if held:
            add()
        out = np.concatenate([emit, flow, first[None], np.full((1, states), ll / states)])
        some = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(out[some, k]) for k in range(states)]], names=["i", *[f"v{k}" for k in range(states)]])

    cols = [f"v{k}" for k in range(states)]
    sums = docs.select(text_col).mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in cols)).groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect()  # a fixed number of rows
    out = np.zeros((symbols + 2 + states + 2, states))
    for r in sums:
        out[r["i"]] = [r[c] for c in cols]
    n = symbols + 2
    return out[:n], out[n : n + states], out[n + states], out[n + states + 1].sum()


class HmmModel:
    """pi, A, B (classes x states), prior (of classes), and the counts: table (hash, c) as a DataFrame, tokens, words."""

    def __init__(self, params, prior, counts, tokens, words, symbols, log=()):
        self.params, self.prior, self.counts, self.tokens, self.words, self.symbols, self.log = params, prior, counts, tokens, words, symbols, list(log)


def fit(docs: DataFrame, *, text_col: str = "text", states: int = 6, symbols: int = 1 << 14, iterations: int = 2, strength: float = 5000.0) -> HmmModel:
    """Train on all of docs. strength: pseudo-counts of the class prior in each state."""
    docs = docs.select("doc_id", text_col)
    counts = materialize(word_counts(docs, text_col), "word-counts")
    total = counts.agg(F.sum("c"), F.count("c")).first()
    tokens, words = int(total[0] or 0), int(total[1])
    scale = tokens + words + 1
    mask = F.col("hash").bitwiseAND(F.lit(symbols - 1))
    kind = F.when(F.col("hash") == int(END.view(np.int64)), symbols + 1).otherwise(mask)
    prior = np.zeros(symbols + 2)
    for r in counts.groupBy(kind.alias("k")).agg(F.sum(F.col("c") + 1).alias("s")).collect():  # `symbols` rows at most
        prior[r["k"]] = r["s"] / scale
    prior[symbols] = 1 / scale
    prior = np.maximum(prior, 1e-300)
    params, log = start_values(docs, text_col, prior, states, symbols), []
    for _ in range(iterations if tokens else 0):
        emit, flow, first, ll = baum_welch_step(docs, text_col, params, symbols)
        log.append(float(ll))
        B = (emit + strength * prior[:, None]) / (emit.sum(0) + strength * prior.sum())
        A = (flow + 1.0) / (flow + 1.0).sum(1, keepdims=True)
        params = ((first + 1.0) / (first + 1.0).sum(), A, B)
    return HmmModel(params, prior, counts, tokens, words, symbols, log)


def score(model: HmmModel, docs: DataFrame, *, text_col: str = "text", table_words: int = 1 << 23) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs; other columns of docs but the text are carried."""
    spark, symbols, scale = docs.sparkSession, model.symbols, model.tokens + model.words + 1
    counts = model.counts
    if model.words > table_words:
        # of the most frequent words, whole levels of the count that fit; levels are powers of 2 ** 0.25
        level = F.floor(4 * F.log2("c"))
        sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        have, least = 0, math.inf
        for lv, n in sizes:
            if have + n > table_words:
                break
            have, least = have + n, lv
        often = (level >= (least if have else 1e9)) | (F.col("hash") == int(END.view(np.int64)))
        top, rare = counts.where(often), counts.where(~often)
    else:
        top, rare = counts, None
    found = top.toArrow()  # at most table_words rows of 16 bytes
    h, c = found["hash"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(h)
    table = spark.sparkContext.broadcast((h[order], np.log10((c[order] + 1) / scale)))
    sent = spark.sparkContext.broadcast((model.params, np.log10(model.prior)))
    del found, h, c, order
    others = [x for x in docs.columns if x not in (text_col, "n_tokens", "n_known", "base_score", "score")]
    partial = rare is not None

    def look_up(words):
        keys, logs = table.value
        if not len(keys):
            return np.zeros(len(words), bool), np.zeros(len(words))
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        known = keys[at] == words
        return known, np.where(known, logs[at], 0.0)

    @K.frugal
    def run(batches):
        (pi, A, B), prior = sent.value
        B10 = B
        unknown = -math.log10(scale)
        for b in batches:
            held = []

            def done():
                sym, ends = np.concatenate([x[0] for x in held]), np.cumsum([0] + [len(x[0]) for x in held])
                at = np.concatenate([x[1][:-1] + o for x, o in zip(held, ends, strict=False)] + [[ends[-1]]])
                ll = forward(sym, at, pi, A, B10)
                known, base, more = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
                i = held[0][5]
                own = [b.column(k).slice(i, len(ll)) for k in range(len(others))]
                return pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(ll + more)], names=[*others, "n_tokens", "n_known", "base_score", "score"])

            for i, j, data, offs in K.slices(b.column(len(others))):
                w, at = with_ends(*K.word_hashes(data, offs))
                known, base = look_up(w)
                sym = symbols_of(w, symbols)
                if partial:
                    wrong = b.column(len(others) + 1).slice(i, j - i)  # the rare words of each text that training lacks: the rest is known
                    lost, part = wrong.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(j - i), pa.compute.fill_null(pa.compute.list_value_length(wrong), 0).to_numpy(zero_copy_only=False))
                    doc = np.repeat(np.arange(j - i), np.diff(at))
                    miss = np.isin(K.mix64(w ^ doc.astype(np.uint64)), K.mix64(lost ^ part.astype(np.uint64))) & ~known
                else:
                    miss = ~known
                sym[miss] = symbols
                base[miss] = unknown
                n_known = np.add.reduceat((~miss).astype(np.int64), at[:-1])
                base_sum = np.add.reduceat(base, at[:-1])
                held.append((sym, at, n_known, base_sum, base_sum - np.add.reduceat(prior[sym], at[:-1]), i))
                if sum(len(x[0]) for x in held) > 600_000:
                    yield done()
                    held = []
            if held:
                yield done()

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{x}` {types[x]}" for x in others], "n_tokens long, n_known long, base_score double, score double"])
    if rare is None:
        return docs.select(*others, text_col).mapInArrow(run, schema)
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    extra = _rare_words(keyed.select("__key", text_col).where(F.col(text_col).isNotNull()).dropDuplicates(["__key"]), text_col, look_up, rare, scale)
    keyed = keyed.join(extra, "__key", "left")
    others = [*others, "__base"]
    types["__base"] = "double"
    schema = ", ".join([*[f"`{x}` {types[x]}" for x in others], "n_tokens long, n_known long, base_score double, score double"])
    out = keyed.select(*others, F.coalesce(text_col, F.lit("")).alias(text_col), F.coalesce("__lost", F.array().cast("array<bigint>")).alias("__lost")).mapInArrow(run, schema)
    add = F.coalesce("__base", F.lit(0.0))
    return out.withColumn("base_score", F.col("base_score") + add).withColumn("score", F.col("score") + add).drop("__base")


def _rare_words(texts: DataFrame, text_col: str, look_up, rare: DataFrame, scale: int) -> DataFrame:
    """For each text key: __base, the log10 probabilities of its words outside the table that training has, and __lost, the words it lacks."""

    @K.frugal
    def run(batches):
        for b in batches:
            for i, j, data, offs in K.slices(b.column(1)):
                w, at = K.word_hashes(data, offs)
                doc = np.repeat(np.arange(j - i), np.diff(at))
                other = ~look_up(w)[0]
                pair, n = np.unique(np.stack([doc[other].astype(np.uint64), w[other]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64) if pair[1].flags.c_contiguous else np.ascontiguousarray(pair[1]).view(np.int64)), pa.array(n.astype(np.int64))], names=["__key", "hash", "n"])

    words = texts.select("__key", text_col).mapInArrow(run, "__key long, hash long, n long")
    joined = words.join(rare, "hash", "left")
    return joined.groupBy("__key").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(scale))))).alias("__base"), F.collect_list(F.when(F.col("c").isNull(), F.col("hash"))).alias("__lost"))
