"""Anomaly detection: predictors, scorers, deciders, detectors and their composites.

All work on DataFrames with explicit feature columns: `fit(df)` learns a
small state, `transform(df)` adds `score`, `label` or predicted columns and
keeps every other column. Statistics that aggregates can express cover all
rows. Neighbour models and densities (k-NN, LOF, ABOD, COF, KDE) are exact at
any size, SOD too: up to `max_train` training rows are broadcast, more are compared in
blocks, with the same scores. The other models that need rows in memory fit on
at most `max_train` training rows, chosen by a hash of whole rows, and score in
Arrow batches against the broadcast state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detector_kernels as N
from . import neighbours as B
from . import ordered as O
from .linear import moments


class Operator:
    """config checked against `defaults`; run before fit raises, a second fit raises."""

    defaults: dict = {}
    learns = True

    def __init__(self, features: list[str], **config):
        unknown = set(config) - set(self.defaults)
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        self.features, self.config, self.state = list(features), self.defaults | config, None

    def fit(self, df: DataFrame) -> Operator:
        if self.state is not None:
            raise RuntimeError("fitted already")
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        self.state = self._fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.learns and self.state is None:
            raise RuntimeError("fit first")
        return self._transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return (self.fit(df) if self.learns else self).transform(df)

    def _fit(self, df):
        return {}


def _num(c: str) -> Column:
    return F.col(c).cast("double")


# ---- predictors


class MeanPredictor(Operator):
    """Each feature's mean, corrected by the mean of what is left, since a long sum of doubles loses digits."""

    def _fit(self, df):
        first = df.agg(*[F.avg(_num(c)).alias(c) for c in self.features]).first()
        known = [c for c in self.features if first[c] is not None]
        rest = df.agg(F.lit(0), *[F.avg(_num(c) - F.lit(first[c])).alias(c) for c in known]).first()
        return {c: first[c] + rest[c] if c in known else None for c in self.features}

    def _transform(self, df):
        return df.withColumns({c: F.lit(self.state[c]).cast("double") for c in self.features})


class PcaPredictor(Operator):
    """Reconstruction from the first components; state: means, axes, explained variance ratio."""

    defaults = {"n_components": 2}

    def _fit(self, df):
        k = self.config["n_components"]
        if k > len(self.features):
            raise ValueError("more components than features")
        _, mean, cov = moments(df, self.features)
        w, v = np.linalg.eigh(cov)
        order = np.argsort(-w)
        return {"mean": mean, "axes": v[:, order[:k]], "explained": w[order[:k]] / max(w.sum(), 1e-300)}

    def predicted(self) -> dict[str, Column]:
        m, back = self.state["mean"], self.state["axes"] @ self.state["axes"].T
        return {c: sum(((_num(f) - float(m[j])) * float(back[j, i]) for j, f in enumerate(self.features)), F.lit(float(m[i]))) for i, c in enumerate(self.features)}

    def _transform(self, df):
        return df.withColumns(self.predicted())


class PluginPredictor(Operator):
    """A reconstruction model from outside: model(matrix) -> matrix of the same shape, in Arrow batches or a series at a time.

    Stands in for the pretrained and deep reconstruction models, whose code is not part of this library.
    """

    defaults = {"model": None, "series": (), "order": None, "win_size": 1}

    def _fit(self, df):
        if self.config["model"] is None:
            raise ImportError("no model given: pass model=callable")
        return {"model": self.config["model"]}

    def _transform(self, df):
        cols, model, order, least = self.features, self.state["model"], self.config["order"], self.config["win_size"]

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable") if order else pdf
            if len(pdf) < least:
                raise ValueError(f"a series has {len(pdf)} rows; the model needs {least}")
            pdf[cols] = np.asarray(model(pdf[cols].to_numpy(float)), float)
            return pdf

        df = df.withColumns({c: _num(c) for c in cols})
        if self.config["series"]:
            return df.groupBy(*self.config["series"]).applyInPandas(one, df.schema)
        return df.mapInPandas(lambda it: (one(p) for p in it), df.schema)


# ---- residuals and merges


def residual_score(df: DataFrame, real: list[str], pred: list[str], metric: str = "mse", output: str = "score") -> DataFrame:
    each = residual_columns(real, pred, metric)
    return df.withColumn(output, sum(each, F.lit(0.0)) / len(each))


def residual_columns(real, pred, metric="mse") -> list[Column]:
    d = [_num(a) - _num(b) for a, b in zip(real, pred, strict=True)]
    return [x * x if metric == "mse" else F.abs(x) for x in d]


def residual_map(df: DataFrame, real: list[str], pred: list[str], metric: str = "mse") -> DataFrame:
    return df.withColumns({f"{c}_residual": r for c, r in zip(real, residual_columns(real, pred, metric), strict=True)})


def _weights(n: int, weights) -> list[float]:
    w = [1.0] * n if weights is None else [float(x) for x in weights]
    return [x / sum(w) for x in w]


def mean_merge(df: DataFrame, scores: list[str], method: str = "arithmetic", weights=None, posterior: bool = False) -> DataFrame:
    """Weighted mean of score columns; posterior adds each column's share of it."""
    w = [1.0] * len(scores) if weights is None else [float(x) for x in weights]
    part = {"arithmetic": lambda x, a: a * x, "geometric": lambda x, a: a * F.log(x), "harmonic": lambda x, a: a / x, "quadratic": lambda x, a: a * x * x}[method]
    parts = [part(_num(c), F.lit(a)) for c, a in zip(scores, w, strict=True)]
    total = sum(parts[1:], parts[0]) / sum(w)
    out = {"arithmetic": total, "geometric": F.exp(total), "harmonic": 1 / total, "quadratic": F.sqrt(total)}[method]
    new = {"score": out}
    if posterior:
        new |= {f"{c}_weight": F.when(total == 0, 0.0).otherwise(p / sum(w) / total) for c, p in zip(scores, parts, strict=True)}
    return df.withColumns(new)


class DistMergeScorer(Operator):
    """z-scores under a normal or log-normal fit of each score column, merged by Stouffer's rule."""

    defaults = {"dist": "normal", "weights": None, "mus": None, "sigmas": None}

    def _x(self, c):
        return F.log(_num(c)) if self.config["dist"] == "log_normal" else _num(c)

    def _fit(self, df):
        r = df.agg(*[f(self._x(c)).alias(f"{n}{i}") for i, c in enumerate(self.features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return {"mus": [r[f"m{i}"] for i in range(len(self.features))], "sigmas": [r[f"s{i}"] or 1.0 for i in range(len(self.features))]}

    def _transform(self, df):
        z = [(self._x(c) - float(m)) / float(s or 1.0) for c, m, s in zip(self.features, self.state["mus"], self.state["sigmas"], strict=True)]
        if self.config["weights"] is None:
            out = sum(z, F.lit(0.0)) / len(z) ** 0.5
        else:
            w = _weights(len(z), self.config["weights"])
            out = sum((x * a for x, a in zip(z, w, strict=True)), F.lit(0.0)) / sum(a * a for a in w) ** 0.5
        return df.withColumn("score", F.exp(out) if self.config["dist"] == "log_normal" else out)


class DistDirectMergeScorer(DistMergeScorer):
    """Preset mus and sigmas, or those of the data at hand."""

    learns = False

    def _transform(self, df):
        c = self.config
        self.state = {"mus": c["mus"], "sigmas": c["sigmas"]} if c["mus"] is not None and c["sigmas"] is not None else self._fit(df)
        return super()._transform(df)


def overlap_merge(df: DataFrame, values: str, start: str, series=(), method: str = "heuristic") -> DataFrame:
    """Window outputs (an array that begins at row `start`) to one value a row.

    mean: NaN-free mean. heuristic: with more than 5 windows the highest and lowest tenth (rounded up) go, then mean plus population deviation.
    """
    rows = df.select(*series, F.col(start).alias("__s"), F.posexplode(values).alias("__k", "v")).select(*series, (F.col("__s") + F.col("__k")).alias("i"), F.col("v").cast("double").alias("v")).where("not isnan(v)")
    if method == "mean":
        return rows.groupBy(*series, "i").agg(F.avg("v").alias("score"))
    lists = rows.groupBy(*series, "i").agg(F.array_sort(F.collect_list("v")).alias("a"))  # as many as windows overlap
    cut = F.when(F.size("a") > 5, F.ceil(F.size("a") * 0.1)).otherwise(0).cast("int")
    lists = lists.withColumn("a", F.slice("a", cut + 1, F.size("a") - 2 * cut))
    m = F.aggregate("a", F.lit(0.0), lambda t, x: t + x) / F.size("a")
    lists = lists.withColumn("m", m)
    d = F.sqrt(F.aggregate("a", F.lit(0.0), lambda t, x: t + (x - F.col("m")) * (x - F.col("m"))) / F.size("a"))
    return lists.select(*series, "i", (F.col("m") + d).alias("score"))


class WindowedPluginScorer(Operator):
    """A pretrained window model: model(windows x length x features) -> windows x length scores, merged where windows overlap."""

    defaults = {"model": None, "length": 64, "step": 1, "score_merge": "heuristic", "order": None, "series": (), "scale": False}

    def _fit(self, df):
        if self.config["model"] is None:
            raise ImportError("no model given: pass model=callable")
        return {"model": self.config["model"]}

    def _transform(self, df):
        c, cols, model = self.config, self.features, self.state["model"]
        series = list(c["series"])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__order", kind="stable")
            x = pdf[cols].to_numpy(float)
            if c["scale"]:
                x = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
            if len(x) < c["length"]:
                return pd.DataFrame(columns=[*series, "start", "values"])
            starts = range(0, len(x) - c["length"] + 1, c["step"])
            got = np.asarray(model(np.stack([x[s : s + c["length"]] for s in starts])), float)
            return pd.DataFrame({**{s: [pdf[s].iloc[0]] * len(got) for s in series}, "start": list(starts), "values": got.tolist()})

        kinds = dict(df.dtypes)
        rows = df.select(*series, F.col(c["order"]).alias("__order"), *cols)
        rows = rows if series else rows.withColumn("__all", F.lit(0))
        schema = ", ".join([*[f"{s} {kinds[s]}" for s in series], "start long, values array<double>"])
        return overlap_merge(rows.groupBy(*(series or ["__all"])).applyInPandas(run, schema), "values", "start", series, c["score_merge"])


# ---- deciders


class ThresholdDecider(Operator):
    defaults = {"threshold": 3.0}
    learns = False

    def __init__(self, features=("score",), **config):
        super().__init__(list(features), **config)

    def _transform(self, df):
        return df.withColumn("label", (F.col(self.features[0]) > self.config["threshold"]).cast("int"))


class PercentileDecider(Operator):
    """Exact percentile (linear interpolation) of the training scores; strictly above is 1."""

    defaults = {"percentile": 95.0}

    def __init__(self, features=("score",), **config):
        super().__init__(list(features), **config)

    def _fit(self, df):
        return {"threshold": O.exact_percentile(df, self.features[0], self.config["percentile"] / 100)}

    def _transform(self, df):
        return df.withColumn("label", (F.col(self.features[0]) > F.lit(self.state["threshold"])).cast("int"))


# ---- scorers by aggregates


class ZScoreScorer(Operator):
    defaults = {"threshold": 3.0}

    def _fit(self, df):
        r = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(self.features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return {c: (r[f"m{i}"], r[f"s{i}"] or 1.0) for i, c in enumerate(self.features)}

    def _transform(self, df):
        z = [F.abs((_num(c) - self.state[c][0]) / self.state[c][1]) for c in self.features]
        return df.withColumn("score", F.greatest(*z) if len(z) > 1 else z[0])


class PcaScorer(PcaPredictor):
    defaults = {"n_components": 3, "metric": "mse"}

    def _transform(self, df):
        d = [_num(c) - p for c, p in self.predicted().items()]
        return df.withColumn("score", sum((x * x if self.config["metric"] == "mse" else F.abs(x) for x in d), F.lit(0.0)) / len(d))


class PluginScorer(PluginPredictor):
    """Residual of a plug-in reconstruction."""

    defaults = PluginPredictor.defaults | {"metric": "mse"}

    def _transform(self, df):
        kept = df.withColumns({f"__real_{c}": _num(c) for c in self.features})
        out = super()._transform(kept)
        out = residual_score(out, [f"__real_{c}" for c in self.features], self.features, self.config["metric"])
        return out.withColumns({c: F.col(f"__real_{c}") for c in self.features}).drop(*[f"__real_{c}" for c in self.features])


class _TailScorer(Operator):
    """Empirical tail probabilities of each feature, over all training rows; at least one row's share. A null has no tails and no score."""

    defaults = {"contamination": 0.1, "n_jobs": 1}

    def _fit(self, df):
        r = df.agg(F.count(F.lit(1)).alias("n"), *[F.skewness(c).alias(f"k{i}") for i, c in enumerate(self.features)]).first()
        counts = {c: df.select(_num(c).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c")) for c in self.features}
        return {"n": r["n"], "tails": {c: (counts[c], r[f"k{i}"] or 0.0) for i, c in enumerate(self.features)}}

    def _parts(self, df):
        """df with the tails of every feature; ranks are computed for distinct values and joined by value."""
        n, out = self.state["n"], df
        for c, (counts, _) in self.state["tails"].items():
            at = O.ranks(counts, df.select(_num(c).alias("v")), "v")
            tail = lambda x: -F.log(F.greatest(x / n, F.lit(1.0 / max(n, 1))))
            at = at.select(F.col("v").alias("__v"), tail(F.col("le")).alias(f"__left_{c}"), tail(n - F.col("lt")).alias(f"__right_{c}"))
            out = out.withColumn("__v", _num(c)).join(at, "__v", "left").drop("__v")
        left, right = ([F.col(f"__{s}_{c}") for c in self.features] for s in ("left", "right"))
        skew = [l if self.state["tails"][c][1] < 0 else r for c, l, r in zip(self.features, left, right, strict=True)]  # noqa: E741
        return out, left, right, skew


class EcodScorer(_TailScorer):
    def _transform(self, df):
        df, left, right, skew = self._parts(df)
        sums = [sum(x, F.lit(0.0)) for x in (left, right, skew)]
        return df.withColumn("score", F.greatest(*sums)).drop(*[f"__{s}_{c}" for s in ("left", "right") for c in self.features])


class CopodScorer(_TailScorer):
    def _transform(self, df):
        df, left, right, skew = self._parts(df)
        each = [F.greatest(s, (a + b) / 2) for s, a, b in zip(skew, left, right, strict=True)]
        return df.withColumn("score", sum(each, F.lit(0.0))).drop(*[f"__{s}_{c}" for s in ("left", "right") for c in self.features])


class HbosScorer(Operator):
    """Sum over features of -log2(density + alpha) in equal-width bins; outside by more than tol bins counts as empty."""

    defaults = {"n_bins": 10, "alpha": 0.1, "tol": 0.5, "contamination": 0.1}

    def _fit(self, df):
        k = self.config["n_bins"]
        r = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(self.features) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        aggs = []
        for i, c in enumerate(self.features):
            width = ((r[f"hi{i}"] - r[f"lo{i}"]) / k) or 1.0
            b = F.least(F.floor((_num(c) - r[f"lo{i}"]) / width), F.lit(k - 1))
            aggs += [F.sum((b == j).cast("long")).alias(f"c{i}_{j}") for j in range(k)]
        counts = df.agg(*aggs).first()
        return {"bins": [(r[f"lo{i}"], r[f"hi{i}"], [counts[f"c{i}_{j}"] / r["n"] / ((((r[f"hi{i}"] - r[f"lo{i}"]) / k) or 1.0)) for j in range(k)]) for i in range(len(self.features))]}

    def _transform(self, df):
        k, alpha, tol, total = self.config["n_bins"], self.config["alpha"], self.config["tol"], F.lit(0.0)
        for c, (lo, hi, density) in zip(self.features, self.state["bins"], strict=True):
            width = ((hi - lo) / k) or 1.0
            b = F.floor((_num(c) - lo) / width)
            cost = F.element_at(F.array(*[F.lit(float(-np.log2(d + alpha))) for d in density]), (F.greatest(F.least(b, F.lit(k - 1)), F.lit(0)) + 1).cast("int"))
            far = (_num(c) < lo - tol * width) | (_num(c) > hi + tol * width)
            total = total + F.when(far, float(-np.log2(alpha))).otherwise(cost)
        return df.withColumn("score", total)


# ---- scorers by NumPy models


class ModelScorer(Operator):
    """fit_rows(matrix, rng, **config) -> state; score_rows(state, matrix) -> scores; in_blocks: the same for larger tables."""

    fit_rows: Callable = None
    score_rows: Callable = None
    in_blocks: tuple[Callable, Callable] | None = None
    max_train = 20_000

    def _fit(self, df):
        rows = df
        many = df.count() > self.max_train
        if many and self.in_blocks:
            train = B.vectors(df, self.features).cache()
            return {"train": train, "blocks": self.in_blocks[0](train, self.config)}
        if many:  # by whole rows, so that rows that share their features aren't taken or left together
            rows = df.orderBy(F.xxhash64(F.lit(3), *df.columns)).limit(self.max_train)
        rows = rows.select(*[_num(c).alias(c) for c in self.features])
        x = rows.toPandas().to_numpy(float)
        x = x[np.lexsort(x.T[::-1])]
        return type(self).fit_rows(x, np.random.default_rng(self.config.get("random_state") or 0), **{k: v for k, v in self.config.items() if k != "random_state"})

    def _transform(self, df):
        cols, state, score = self.features, self.state, type(self).score_rows
        if self.in_blocks and "blocks" in state:
            asks = B.vectors(df, cols).select("x")
            scores = self.in_blocks[1](state["blocks"], asks, state["train"], self.config).select(F.col("x").alias("__x"), "score")
            return df.drop("score").withColumn("__x", B.vector(cols)).join(scores, "__x", "left").drop("__x")
        out = df.withColumn("score", F.lit(0.0))
        kept = out.columns
        sent = df.sparkSession.sparkContext.broadcast(state)  # bounded by max_train

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in it:
                x = p[cols].to_numpy(float)
                p["score"] = np.concatenate([score(sent.value, x[i : i + 1024]) for i in range(0, len(x), 1024)]) if len(x) else 0.0
                yield p[kept]

        return out.mapInPandas(run, out.schema)


class TransductiveScorer(Operator):
    """Scores a batch against itself; with `series`, each series is a batch."""

    defaults = {"series": ()}
    learns = False
    score_rows: Callable = None
    in_blocks: Callable | None = None

    def _transform(self, df):
        cols, score = self.features, type(self).score_rows
        config = {k: v for k, v in self.config.items() if k != "series"}
        if type(self).in_blocks and not self.config["series"]:
            scores = type(self).in_blocks(B.vectors(df, cols).cache(), config).select(F.col("x").alias("__x"), "score")
            return df.drop("score").withColumn("__x", B.vector(cols)).join(scores, "__x", "left").drop("__x")
        out = df.withColumn("score", F.lit(0.0))

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.copy()
            p["score"] = score(p[cols].to_numpy(float), **config)
            return p

        if self.config["series"]:
            return out.groupBy(*self.config["series"]).applyInPandas(run, out.schema)
        return out.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda p: run(p.drop(columns="__all")), out.schema)


SCORERS: dict[str, type[Operator]] = {"zscore": ZScoreScorer, "pca": PcaScorer, "ecod": EcodScorer, "copod": CopodScorer, "hbos": HbosScorer}
for _name, (_fit, _score, _defaults) in N.MODELS.items():
    SCORERS[_name] = type(f"{_name.title()}Scorer", (ModelScorer,), {"fit_rows": staticmethod(_fit), "score_rows": staticmethod(_score), "defaults": _defaults, "in_blocks": B.MODELS.get(_name)})
for _name, (_score, _defaults) in N.TRANSDUCTIVE.items():
    SCORERS[_name] = type(f"{_name.title()}Scorer", (TransductiveScorer,), {"score_rows": staticmethod(_score), "defaults": _defaults | {"series": ()}, "in_blocks": staticmethod(B.TRANSDUCTIVE[_name]) if _name in B.TRANSDUCTIVE else None})


# ---- composites


class CompositeScorer:
    """Steps in order. A predictor may come first only and needs a residual step after it; a decider is not allowed."""

    decider_needed = False

    def __init__(self, *steps):
        roles = ["decider" if isinstance(s, (ThresholdDecider, PercentileDecider)) else "predictor" if isinstance(s, (MeanPredictor, PluginPredictor)) or type(s) is PcaPredictor else "residual" if s in ("mse", "mae") else "scorer" for s in steps]
        if len(steps) < 2:
            raise ValueError("a composite has two steps at least")
        if "predictor" in roles[1:] or (roles[0] == "predictor") != ("residual" in roles) or ("residual" in roles and roles[1] != "residual"):
            raise ValueError("a predictor comes first, and only a residual step ('mse', 'mae') follows it")
        if roles.count("decider") != self.decider_needed or (self.decider_needed and roles[-1] != "decider"):
            raise ValueError("a detector ends in its one decider; a scorer has none")
        self.steps = steps

    def _run(self, df, fit):
        for s in self.steps:
            if s == "mse" or s == "mae":
                df = residual_score(df, [f"__real_{c}" for c in real], real, s)
                df = df.withColumns({c: F.col(f"__real_{c}") for c in real}).drop(*[f"__real_{c}" for c in real])
                continue
            if isinstance(s, (MeanPredictor, PluginPredictor)) or type(s) is PcaPredictor:
                real = s.features
                start = df
                df = df.withColumns({f"__real_{c}": _num(c) for c in real})
                if fit and s.learns:
                    s.fit(start)
            elif fit and s.learns:
                s.fit(df)
            df = s.transform(df)
        return df

    def fit(self, df):
        self._run(df, True)
        return self

    def transform(self, df):
        return self._run(df, False)

    def fit_transform(self, df):
        return self.fit(df).transform(df)


class CompositeDetector(CompositeScorer):
    decider_needed = True


def detector(name: str, features: list[str], percentile: float = 95.0, **config) -> CompositeDetector:
    """`{name}_detector`: the scorer, then the percentile of its training scores (z-score: its threshold)."""
    scorer = SCORERS[name](features, **config)
    return CompositeDetector(scorer, ThresholdDecider(threshold=scorer.config["threshold"]) if name == "zscore" else PercentileDecider(percentile=percentile))
