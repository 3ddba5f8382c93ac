"""Forecasting from sliding windows: ridge with chosen strength, boosted trees (direct, or one model for all steps), plug-ins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import temporal_split, window_arrays


class RidgeForecaster:
    """Predicts the increment over `horizon` steps from the last `seq_len` increments and standardised inputs.

    The Gram matrix of the window features is summed over rows in Arrow batches (d x d numbers a batch), so any
    number of windows trains one model; the strength with the least validation error is refitted on train + val.
    """

    def __init__(self, target: str, inputs: list[str] = (), seq_len: int = 16, horizon: int = 5, alphas=(0.1, 1.0, 10.0, 100.0), train_ratio=0.7, val_ratio=0.15):
        self.target, self.inputs, self.seq_len, self.horizon, self.alphas, self.ratios, self.w = target, list(inputs), seq_len, horizon, alphas, (train_ratio, val_ratio), None

    def _features(self, df, order, series, future):
        w = Window.partitionBy(*series).orderBy(order)
        x = df.withColumn("__dy", F.col(self.target) - F.coalesce(F.lag(self.target).over(w), F.col(self.target)))
        cols = ["__dy"]
        for c in self.inputs:
            x = x.withColumn(f"__x_{c}", (F.col(c) - self.stats[c][0]) / (self.stats[c][1] or 1.0))
            cols.append(f"__x_{c}")
        if future:
            x = x.withColumn("__goal", F.lead(self.target, self.horizon).over(w) - F.col(self.target))
        x = window_arrays(x, cols, order, self.seq_len, series)
        x = x.withColumn("__f", F.concat(*[f"{c}_window" for c in cols])).drop(*cols, *[f"{c}_window" for c in cols])
        return x.where(F.col("__goal").isNotNull()) if future else x

    def fit(self, df: DataFrame, order: str, series=()) -> RidgeForecaster:
        r = df.agg(F.lit(0).alias("__"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(self.inputs) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.stats = {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(self.inputs)}
        rows = temporal_split(self._features(df, order, series, True), order, self.ratios, series)
        d = self.seq_len * (1 + len(self.inputs)) + 1

        def gram(it):
            sums = {}
            for p in it:
                if not len(p):
                    continue
                x = np.hstack([np.array(p["__f"].tolist()), np.ones((len(p), 1)), p[["__goal"]].to_numpy(float)])
                for s in p["split"].unique():
                    own = x[(p["split"] == s).to_numpy()]
                    sums[s] = sums.get(s, 0) + own.T @ own
            for s, g in sums.items():
                yield pd.DataFrame({"split": [s] * len(g), "i": range(len(g)), "row": g.tolist()})

        total = {s: np.zeros((d + 1, d + 1)) for s in ("train", "val", "test")}
        parts = rows.select("__f", "__goal", "split").mapInPandas(gram, "split string, i int, row array<double>").groupBy("split", "i").agg(*[F.sum(F.get("row", F.lit(j))).alias(f"g{j}") for j in range(d + 1)])
        for r in parts.collect():
            total[r["split"]][r["i"]] = [r[f"g{j}"] for j in range(d + 1)]

        def solve(g, a):
            pen = a * np.eye(d)
            pen[-1, -1] = 0
            return np.linalg.lstsq(g[:d, :d] + pen, g[:d, d], rcond=None)[0]

        def error(w):
            g, v = total["val"], np.append(-w, 1)
            return v @ g @ v

        self.alpha = min(self.alphas, key=lambda a: error(solve(total["train"], a)))
        self.w = solve(total["train"] + total["val"], self.alpha)
        return self

    def transform(self, df: DataFrame, order: str, series=()) -> DataFrame:
        """df's full windows with `forecast_0`: the target `horizon` steps on."""
        if self.w is None:
            raise RuntimeError("fit first")
        w = F.array(*[F.lit(float(x)) for x in self.w[:-1]])
        dot = F.aggregate(F.zip_with("__f", w, lambda a, b: a * b), F.lit(float(self.w[-1])), lambda t, x: t + x)
        return self._features(df, order, series, False).withColumn("forecast_0", F.col(self.target) + dot).drop("__f")


class BoostedForecaster:
    """Gradient-boosted trees on windows. direct: a model for each step; MIMO: the step is a feature of one model."""

    def __init__(self, target: str, inputs: list[str] = (), seq_len: int = 96, pred_len: int = 24, strategy: str = "direct", max_depth: int = 4, learning_rate: float = 0.05, n_estimators: int = 200, min_child: int = 20, train_ratio: float = 0.8, seed: int = 42):
        self.target, self.columns, self.seq_len, self.pred_len, self.strategy = target, list(dict.fromkeys([target, *inputs])), seq_len, pred_len, strategy
        self.options, self.train_ratio, self.models = {"maxDepth": max_depth, "stepSize": learning_rate, "maxIter": n_estimators, "minInstancesPerNode": min_child, "seed": seed}, train_ratio, None

    def _vectors(self, df, order, series, horizon):
        from pyspark.ml.functions import array_to_vector

        x = window_arrays(df, self.columns, order, self.seq_len, series, horizon, self.target)
        return x.withColumn("__a", F.concat(*[f"{c}_window" for c in self.columns])).withColumn("features", array_to_vector("__a"))

    def fit(self, df, order, series=()):
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.regression import GBTRegressor

        rows = temporal_split(self._vectors(df, order, series, self.pred_len), order, (self.train_ratio, 0.0), series).where("split = 'train'")
        one = lambda d: GBTRegressor(labelCol="__y", **self.options).fit(d)
        if self.strategy == "MIMO":
            steps = rows.select("__a", F.posexplode(f"{self.target}_future").alias("__k", "__y"))
            self.models = [one(steps.withColumn("features", array_to_vector(F.concat("__a", F.array(F.col("__k").cast("double"))))))]
        else:
            self.models = [one(rows.withColumn("__y", F.get(f"{self.target}_future", F.lit(k)))) for k in range(self.pred_len)]
        return self

    def transform(self, df, order, series=()):
        from pyspark.ml.functions import array_to_vector

        if self.models is None:
            raise RuntimeError("fit first")
        out = self._vectors(df, order, series, 0)
        for k in range(self.pred_len):
            if self.strategy == "MIMO":
                out = out.withColumn("features", array_to_vector(F.concat("__a", F.array(F.lit(float(k))))))
            out = self.models[0 if self.strategy == "MIMO" else k].transform(out).withColumnRenamed("prediction", f"forecast_{k}")
        return out.drop("features", "__a", *[f"{c}_window" for c in self.columns])


class PluginForecaster:
    """A sequence model from outside: model(windows x length x features) -> windows x steps of scaled residuals.

    Ships the window builder, the z-scaling and the return to the target's scale and last value.
    """

    def __init__(self, target: str, inputs: list[str] = (), seq_len: int = 160, pred_len: int = 30, model=None):
        self.target, self.columns, self.seq_len, self.pred_len, self.model, self.stats = target, list(dict.fromkeys([*inputs, target])), seq_len, pred_len, model, None

    def fit(self, df, order=None, series=()):
        if self.model is None:
            raise ImportError("no model given: pass model=callable")
        r = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(self.columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.stats = [(r[f"m{i}"], r[f"s{i}"] or 1.0) for i in range(len(self.columns))]
        return self

    def transform(self, df, order, series=()):
        wins, stats, model, n, m = [f"{c}_window" for c in self.columns], self.stats, self.model, self.seq_len, self.pred_len
        rows = window_arrays(df, self.columns, order, n, series).select(*series, order, *wins)
        kinds = dict(rows.dtypes)
        keys = [*series, order]

        def run(it):
            for p in it:
                x = np.stack([np.array(p[w].tolist()).reshape(len(p), n) for w in wins], 2)
                got = np.asarray(model((x - [a for a, _ in stats]) / [b for _, b in stats]), float).reshape(len(p), m)
                out = p[keys].copy()
                for k in range(m):
                    out[f"forecast_{k}"] = x[:, -1, -1] + got[:, k] * stats[-1][1]
                yield out

        return rows.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"forecast_{k} double" for k in range(m)]]))


FORECASTERS = {
    "ridge_forecaster": RidgeForecaster,
    "lightgbm_forecaster": BoostedForecaster,
    "lightgbm_mimo_forecaster": lambda *a, **k: BoostedForecaster(*a, **{"strategy": "MIMO", "max_depth": 6} | k),
    "xgboost_forecaster": BoostedForecaster,
    "xgboost_mimo_forecaster": lambda *a, **k: BoostedForecaster(*a, **{"strategy": "MIMO", "max_depth": 6} | k),
    "itransformer_forecaster": PluginForecaster,
}
