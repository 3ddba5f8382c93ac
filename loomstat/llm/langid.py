"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of variable order (0 to `order` bytes) is
trained on a bounded, documented sample of labelled texts: the first
`max_chars` characters of at most `per_lang` texts a language, chosen by a
hash, and in all at most about `sample_chars` characters, shared equally by
the languages. Every labelled language has a tree, whatever their number and
whatever their alphabets. Statistics are then frozen: in a context that has
seen n bytes, d of them distinct, byte x costs -log2(count / (n+d)) if seen,
else the escape d / (n+d) times its probability in the next shorter context,
with what the longer one has seen excluded; below order 0 all 256 bytes are
equal. Before a text stand newlines. A tree is sorted arrays: the cost of each
(context, byte) that was seen and the escape cost of each context, so its size
goes with its sample. In scoring, the distinct (context, byte) pairs of a run
of texts are looked up once for each language; a text's code lengths are sums,
exact for the whole text.

The predicted language has the shortest code, of equal ones the first by name;
`score` is its share of 2**-length over all languages. Texts that are null or
have no letter are `und`, score 0. ASCII letters are lower-cased. With no
labelled text at all every document is `und`. Repeated rows count once in the
sample. Columns named like the results are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import _LOWER, find_sorted, frugal, slices

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def windows(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """For each byte the `order` bytes before it and itself as one number, the byte lowest; before a text there are newlines."""
    out = data.astype(np.uint64)
    for j in range(1, order + 1):
        x = np.full(len(data), 10, np.uint64)
        x[j:] = data[:-j] if len(data) > j else 0
        for d in range(j):
            at = offs[:-1] + d
            x[at[at < offs[1:]]] = 10
        out |= x << np.uint64(8 * j)
    return out


class Tree:
    """One language's contexts. keys[k], costs[k]: the pairs seen at order k; contexts[k], escapes[k]: escape costs."""

    def __init__(self, texts: list[bytes], order: int):
        data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        codes = windows(data, offs, order)
        n = np.bincount(data, minlength=256).astype(float)
        d = (n > 0).sum()
        unseen = d / max(n.sum() + d, 1) / max(256 - d, 1) if d else 1 / 256
        zero = np.where(n > 0, n / (n.sum() + (d if d < 256 else 0)) if d else 0, unseen)
        self.zero = -np.log2(zero)
        self.keys, self.costs, self.contexts, self.escapes, lower = [None], [None], [None], [None], zero
        for k in range(1, order + 1):
            keys, count = np.unique(codes & np.uint64((1 << (8 * k + 8)) - 1), return_counts=True)
            below = keys & np.uint64((1 << (8 * k)) - 1)  # the same pair one order down, which has been seen
            p = lower[below.astype(np.int64)] if k == 1 else lower[np.searchsorted(self.keys[k - 1], below)]
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            distinct = np.diff(np.append(first, len(keys)))
            left = 1 - (np.add.reduceat(p, first) if len(first) else np.zeros(0))
            whole = left <= 1e-12  # nothing is left for an escape
            size = total + np.where(whole, 0, distinct)
            lower = count / np.repeat(size, distinct)
            self.keys.append(keys)
            self.costs.append(-np.log2(lower))
            self.contexts.append(contexts)
            self.escapes.append(np.where(whole, 0.0, -np.log2(np.maximum(distinct / size, 1e-300) / np.maximum(left, 1e-300))))

    def cost(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Bits of each pair in codes."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(order, 0, -1):
            own = codes[todo] & np.uint64((1 << (8 * k + 8)) - 1)
            at, seen = find_sorted(self.keys[k], own)
            out[todo[seen]] += self.costs[k][at[seen]]
            todo, own = todo[~seen], own[~seen]
            at, known = find_sorted(self.contexts[k], own >> np.uint64(8))
            out[todo[known]] += self.escapes[k][at[known]]
        out[todo] += self.zero[(codes[todo] & np.uint64(255)).astype(np.int64)]
        return out


class PpmModel:
    def __init__(self, texts: dict[str, list[bytes]], order: int = 3):
        if not 1 <= order <= 6:
            raise ValueError("order is from 1 to 6")
        self.langs, self.order = sorted(texts), order
        self.trees = [Tree(texts[k], order) for k in self.langs]

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, languages): bits."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offs))
        if not len(full):
            return out
        codes, where = np.unique(windows(_LOWER[data], offs, self.order), return_inverse=True)
        for k, tree in enumerate(self.trees):
            out[full, k] = np.add.reduceat(tree.cost(codes, self.order)[where], offs[:-1][full])
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, bits per byte under it) of each text."""
        langs, scores, rate = [], [], []
        for i, j, data, offs in slices(col):
            bits = self.code_lengths(data, offs) if self.langs else np.zeros((j - i, 1))
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            has = np.zeros(j - i, bool)
            full = np.flatnonzero(np.diff(offs))
            if len(full):
                has[full] = np.logical_or.reduceat(_LETTER[_LOWER[data]], offs[full])
            for x in np.flatnonzero(~has & (np.diff(offs) > 0)):
                has[x] = any(ch.isalpha() for ch in bytes(data[offs[x] : offs[x + 1]]).decode())
            has &= bool(self.langs)
            langs += [self.langs[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
            scores.append(np.where(has, share, 0.0))
            rate.append(bits.min(1) / np.maximum(np.diff(offs), 1))
        return langs, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rate) if rate else np.zeros(0)


def fit(docs: DataFrame, *, text_col: str = "text", per_lang: int = 400, max_chars: int = 8000, sample_chars: int = 32_000_000, order: int = 3) -> PpmModel:
    """Train on the rows of docs that have a lang: a bounded sample, long texts by their beginnings."""
    usable = docs.where(F.col("lang").isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id", text_col), F.lit(1 << 30))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    langs = counts.count()
    most = max(1, min(per_lang, sample_chars // (max_chars * max(langs, 1))))
    # a share of the rows that holds `most` of a language for sure, if it has them; the first by place are taken
    rows = usable.select("lang", F.substring(text_col, 1, max_chars).alias("t"), place.alias("p"), F.xxhash64(F.lit(18), text_col).alias("__h"))
    rows = rows.join(F.broadcast(counts) if langs <= 100_000 else counts, "lang").where(F.col("p") * F.col("__n") < F.lit((1 << 30) * (4 * most + 40))).drop("__n")
    first = Window.partitionBy("lang").orderBy("p", "__h")
    rows = rows.dropDuplicates(["lang", "p", "__h"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    texts: dict[str, list[bytes]] = {}
    for r in rows.select("lang", "t", "p", "__h").orderBy("lang", "p", "__h").toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["t"].encode())
    return PpmModel(texts, order)


def predict(model: PpmModel, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs' columns and lang_pred, score, bits_per_byte (instead of any of those names)."""
    new = ("lang_pred", "score", "bits_per_byte")
    own = [c for c in docs.columns if c not in new]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size goes with the sample, which sample_chars bounds
    at = own.index(text_col)
    types = dict(docs.dtypes)

    @frugal
    def run(batches):
        for b in batches:
            langs, score, rate = sent.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], names=[*own, *new])

    return docs.select(*own).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in own], "lang_pred string, score double, bits_per_byte double"]))


def predict_narrow(model: PpmModel, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """As predict, but the text is read and not carried."""
    new = ("lang_pred", "score", "bits_per_byte")
    own = [c for c in docs.columns if c not in (*new, text_col)]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    @frugal
    def run(batches):
        for b in batches:
            langs, score, rate = sent.value.predict(b.column(len(own)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], names=[*own, *new])

    return docs.select(*own, text_col).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in own], "lang_pred string, score double, bits_per_byte double"]))
