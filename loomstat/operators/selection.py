"""Feature selection: static, by variance, and a supervised chain (screening, greedy selection, permutation ranking)."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import moments
from .ordered import running_sums


def column_selector(df: DataFrame, columns: list[str | int] | None = None) -> tuple[DataFrame, list[int]]:
    """(the columns, their positions in df); names or positions."""
    at = list(range(len(df.columns))) if columns is None else [df.columns.index(c) if isinstance(c, str) else c for c in columns]
    return df.select(*[df.columns[i] for i in at]), at


def variance_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, variance (population): one aggregate, unpivoted."""
    one = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])).alias("x")).select("x.*")


def variance_threshold_selector(df: DataFrame, columns: list[str], threshold: float = 0.0) -> tuple[DataFrame, list[int]]:
    keep = {r["feature"] for r in variance_table(df, columns).collect() if r["variance"] is not None and r["variance"] > threshold}
    return column_selector(df, [c for c in columns if c in keep])


def ks_table(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, ks: the largest gap between the two classes' distribution functions."""
    long = df.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("y", "x.feature", "x.v")
    at = long.groupBy("feature", "v").agg(F.sum("y").alias("p"), F.count("y").alias("n"))
    part = Window.partitionBy("feature")
    run = part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("p").over(run) / F.sum("p").over(part) - F.sum(F.col("n") - F.col("p")).over(run) / F.sum(F.col("n") - F.col("p")).over(part))
    return at.withColumn("g", gap).groupBy("feature").agg(F.max("g").alias("ks"))


def screening_table(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, ks, mv (mean-variance index), dcor (distance correlation) against a label of two values, over all rows.

    All three follow from running counts and sums by class: with two classes the distance of labels is 0 or 1, and the sum of
    distances from a value is a difference of prefix sums. Nulls of a feature or the label are left out.
    """
    top = df.agg(F.max(label), *[F.avg(F.col(c).cast("double")) for c in columns]).first()
    pairs = [F.struct(F.lit(c).alias("feature"), (F.col(c).cast("double") - F.lit(m)).alias("v")) for c, m in zip(columns, top[1:], strict=True)]
    long = df.where(F.col(label).isNotNull()).select((F.col(label) == F.lit(top[0])).cast("long").alias("y"), F.explode(F.array(*pairs)).alias("x")).select("y", "x.*").where("v is not null")
    at = long.groupBy("feature", "v").agg(F.sum("y").alias("p"), F.count("y").alias("n")).withColumns({"ps": F.col("p") * F.col("v"), "ns": F.col("n") * F.col("v")})
    at = running_sums(at, "v", ["p", "n", "ps", "ns"], ["feature"])
    away = {c: F.col("v") * (2 * F.col(f"{c}_upto") - F.col(f"{c}_all")) - (2 * F.col(f"{c}s_upto") - F.col(f"{c}s_all")) for c in "pn"}
    rows, ones = F.col("n_all").cast("double"), F.col("p_all").cast("double")
    zeros = rows - ones
    f1, f0, f = F.col("p_upto") / ones, (F.col("n_upto") - F.col("p_upto")) / zeros, F.col("n_upto") / rows
    sums = {
        "mv": F.col("n") * (ones / rows * F.pow(f1 - f, 2) + zeros / rows * F.pow(f0 - f, 2)) / rows,
        "across": 2 * F.col("p") * (away["n"] - away["p"]) / rows / rows,
        "dist": F.col("n") * away["n"] / rows / rows,
        "both": away["n"] / rows * (F.col("p") * zeros + (F.col("n") - F.col("p")) * ones) / rows / rows,
        "square": F.col("n") * F.pow(away["n"] / rows, 2) / rows,
        "second": F.col("n") * F.pow("v", F.lit(2)) / rows,
        "first": F.col("ns") / rows,
    }
    one = at.groupBy("feature").agg(F.max(F.abs(f1 - f0)).alias("ks"), *[F.sum(x).alias(c) for c, x in sums.items()], F.first(2 * ones * zeros / rows / rows).alias("label"))
    cov = F.col("across") + F.col("dist") * F.col("label") - 2 * F.col("both")
    var = 2 * (F.col("second") - F.pow("first", F.lit(2))) + F.pow("dist", F.lit(2)) - 2 * F.col("square")
    dcor = F.when((var > 1e-12 * F.col("second")) & (F.col("label") > 0), F.sqrt(F.greatest(cov, F.lit(0.0)) / (F.sqrt(var) * F.col("label")))).otherwise(0.0)
    return one.select("feature", "ks", "mv", dcor.alias("dcor"))


def sis_filter(df: DataFrame, columns: list[str], label: str, threshold: float = 0.05) -> list[str]:
    """Columns with max(distance correlation, MV index, KS) above threshold, over all rows; not binary: all."""
    if df.select(label).distinct().limit(3).count() != 2:
        return list(columns)
    best = {r["feature"]: max(r["ks"] or 0.0, r["mv"] or 0.0, r["dcor"]) for r in screening_table(df, columns, label).collect()}
    return [c for c in columns if best.get(c, 0.0) > threshold]


def greedy_order(cov: np.ndarray, target: np.ndarray, k: int) -> list[int]:
    """Forward selection by the gain in explained variance, with an incremental Cholesky factor."""
    d = len(target)
    left, chosen, basis, rest = set(range(d)), [], [], target.astype(float).copy()
    spread = np.diag(cov).astype(float).copy()
    for _ in range(min(k, d)):
        gain = {j: rest[j] ** 2 / spread[j] for j in left if spread[j] > 1e-10}
        if not gain:
            break
        j = max(gain, key=lambda i: (gain[i], -i))
        row = (cov[j] - sum((b[j] * b for b in basis), np.zeros(d))) / np.sqrt(spread[j])
        rest = rest - row * rest[j] / np.sqrt(spread[j])
        spread = spread - row**2
        basis.append(row)
        chosen.append(j)
        left.discard(j)
    return chosen


def cwdm_selector(df: DataFrame, columns: list[str], label: str, final_k: int = 10, n_iterations: int = 100, random_state: int = 0) -> list[str]:
    """How often each column is chosen over shuffled halves of the columns; one Gram matrix serves all of them."""
    _, _, cov = moments(df, [*columns, label])
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = cov / sd[:, None] / sd[None]
    rng, picks = np.random.default_rng(random_state), Counter()
    for _ in range(n_iterations):
        some = rng.permutation(len(columns))[: max(1, (len(columns) + 1) // 2)]
        for j in greedy_order(corr[np.ix_(some, some)], corr[some, -1], final_k):
            picks[int(some[j])] += 1
    order = sorted(range(len(columns)), key=lambda i: (-picks[i], -abs(corr[i, -1])))
    return [columns[i] for i in order[:final_k]]


def train_proxy(df: DataFrame, columns: list[str], label: str, model: str = "GBT", task: str = "classification", seed: int = 42):
    """A Spark ML proxy (LR, RF, GBT, SVC, NB; regression: GBT, RF, LR) on the named columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import VectorAssembler

    kinds = {"LR": lambda: C.LogisticRegression(labelCol=label), "RF": lambda: C.RandomForestClassifier(labelCol=label, seed=seed), "GBT": lambda: C.GBTClassifier(labelCol=label, seed=seed, maxIter=20), "SVC": lambda: C.LinearSVC(labelCol=label), "NB": lambda: C.NaiveBayes(labelCol=label, modelType="gaussian")}
    if task == "regression":
        kinds = {"GBT": lambda: R.GBTRegressor(labelCol=label, seed=seed, maxIter=20), "RF": lambda: R.RandomForestRegressor(labelCol=label, seed=seed), "LR": lambda: R.LinearRegression(labelCol=label)}
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip"), kinds[model]()]).fit(df)


def _loss(df: DataFrame, label: str, task: str) -> float:
    miss = (F.col("prediction") != F.col(label)).cast("double") if task == "classification" else F.pow(F.col("prediction") - F.col(label), 2)
    return df.agg(F.avg(miss)).first()[0] or 0.0


def sage_ranking(df: DataFrame, columns: list[str], label: str, model, task: str = "classification", rounds: int = 4, seed: int = 0) -> list[tuple[str, float]]:
    """Permutation Shapley values of the loss: absent columns take values of other rows (a marginal imputer by a shifted join)."""
    rng = np.random.default_rng(seed)
    n = df.count()
    order = Window.orderBy(F.xxhash64(*columns, label))
    rows = df.select(*columns, label).withColumn("__i", F.row_number().over(order) - 1).cache()
    donor = rows.select(((F.col("__i") + n // 2 + 1) % n).alias("__i"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = rows.join(donor, "__i").cache()
    total = dict.fromkeys(columns, 0.0)
    for _ in range(rounds):
        absent = list(columns)
        last = _loss(model.transform(both.withColumns({c: F.col(f"__{c}") for c in absent})), label, task)
        for j in rng.permutation(len(columns)):
            absent.remove(columns[j])
            now = _loss(model.transform(both.withColumns({c: F.col(f"__{c}") for c in absent}) if absent else both), label, task)
            total[columns[j]] += (last - now) / rounds
            last = now
    rows.unpersist()
    both.unpersist()
    return sorted(total.items(), key=lambda x: -x[1])


def convergence_finder(df: DataFrame, ranked: list[str], label: str, step: int = 5, window: int = 5, stability: float = 1e-3, accuracy: float = 0.75, model: str = "LR") -> int:
    """The smallest number of ranked columns from which accuracy stays put and high; else the best one."""
    train, test = df.randomSplit([0.8, 0.2], 7)
    seen: list[tuple[int, float]] = []
    for k in range(min(step, len(ranked)), len(ranked) + 1, step):
        seen.append((k, 1 - _loss(train_proxy(train, ranked[:k], label, model).transform(test), label, "classification")))
        last = [a for _, a in seen[-window:]]
        if len(last) == window and np.std(last) < stability and min(last) >= accuracy:
            return k
    return max(seen, key=lambda x: (x[1], -x[0]))[0] if seen else len(ranked)


def cwdw_sage(df: DataFrame, columns: list[str], label: str, final_k: int = 10, task: str = "classification", model: str = "RF", random_state: int = 42) -> list[tuple[str, float]]:
    """Screening, greedy selection, proxy model and permutation ranking: (column, value), best first."""
    kept = sis_filter(df, columns, label) or list(columns)
    kept = cwdm_selector(df, kept, label, min(final_k, len(kept)), random_state=random_state)
    kept = kept[: convergence_finder(df, kept, label)] if task == "classification" else kept
    return sage_ranking(df, kept, label, train_proxy(df, kept, label, model, task, random_state), task, seed=random_state)


def load_labelled(df: DataFrame, label: str = "label", time_columns=("time", "timestamp", "date")) -> DataFrame:
    """Numeric columns only, without times, all-null and constant columns; rows with a null are dropped."""
    numeric = [c for c, t in df.dtypes if c == label or (c.lower() not in time_columns and (t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")))]
    r = df.agg(*[F.count(c).alias(c) for c in numeric]).first()
    some = [c for c in numeric if r[c]]
    df = df.select(*some).dropna()
    s = df.agg(*[F.stddev_pop(c).alias(c) for c in some]).first()
    return df.select(*[c for c in some if c == label or s[c]])
