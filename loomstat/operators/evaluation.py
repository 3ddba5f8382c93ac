"""Evaluation metrics: (df, truth, pred, ...) -> DataFrame with one row, or one row a series.

Counting and moment metrics are single aggregates; ranking metrics count each
distinct score first and accumulate over those; event metrics find islands
with window functions. What is sequential by definition (greedy matching,
NAB, DTW, affiliation integrals, VUS) runs in NumPy per series (`series`
columns): series are the unit of parallelism, as in the data model.
Ties in a ranking are broken by `key` columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import event_kernels as E
from . import ordered as O

METRICS: dict[str, Callable[..., DataFrame]] = {}


def metric(f):
    METRICS[f.__name__] = f
    return f


def _by(df: DataFrame, series, *aggs: Column) -> DataFrame:
    return df.groupBy(*series).agg(*aggs)


def _safe(a: Column, b: Column, zero=0.0) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(a / b)


# ---- regression: aggregate expressions, so that any number of them share one scan

Y, P = "__y", "__p"
EPS = 1e-10


def _err() -> Column:
    return F.col(Y) - F.col(P)


def _r2() -> Column:
    n, s, q = F.count(Y), F.sum(Y), F.sum(F.col(Y) * F.col(Y))
    tot = q - s * s / n
    return F.when(tot <= 0, 0.0).otherwise(1 - F.sum(_err() * _err()) / tot)


REGRESSION: dict[str, Callable[..., Column]] = {
    "mae_metric": lambda: F.avg(F.abs(_err())),
    "mse_metric": lambda: F.avg(_err() * _err()),
    "rmse_metric": lambda: F.sqrt(F.avg(_err() * _err())),
    "mape_metric": lambda epsilon=EPS: 100 * F.avg(F.abs(_err() / (F.col(Y) + epsilon))),
    "smape_metric": lambda epsilon=EPS: 100 * F.avg(F.abs(_err()) / ((F.abs(Y) + F.abs(P)) / 2 + epsilon)),
    "r2_metric": _r2,
}


def regression_metrics(df: DataFrame, truth: str, pred: str, names=tuple(REGRESSION), series=(), **config) -> DataFrame:
    """All named metrics in one pass."""
    rows = df.select(*series, F.col(truth).cast("double").alias(Y), F.col(pred).cast("double").alias(P))
    return _by(rows, series, *[REGRESSION[n](**config.get(n, {})).alias(n.removesuffix("_metric")) for n in names])


for _name in REGRESSION:
    METRICS[_name] = (lambda n: lambda df, truth, pred, series=(), **config: regression_metrics(df, truth, pred, (n,), series, **{n: config}))(_name)


def _lagged(df: DataFrame, truth: str, pred: str, order: str, series, lag: int) -> DataFrame:
    w = Window.partitionBy(*series).orderBy(order) if series else Window.orderBy(order)
    return df.select(*series, F.col(truth).cast("double").alias(Y), F.col(pred).cast("double").alias(P), F.lag(truth, lag).over(w).cast("double").alias("__lag"))


@metric
def mase_metric(df, truth, pred, order, series=(), seasonality=1):
    """Mean absolute error over that of the seasonal naive forecast; without a naive error, over 1."""
    naive = F.avg(F.abs(F.col(Y) - F.col("__lag")))
    mae = F.avg(F.abs(_err()))
    return _by(_lagged(df, truth, pred, order, series, seasonality), series, F.when(F.coalesce(naive, F.lit(0.0)) == 0, mae).otherwise(mae / naive).alias("mase"))


@metric
def theils_u_metric(df, truth, pred, order, series=()):
    naive = F.sqrt(F.avg(F.pow(F.col(Y) - F.coalesce("__lag", Y), 2)))
    rmse = F.sqrt(F.avg(_err() * _err()))
    u = F.when(F.count(Y) <= 1, 1.0).when(naive == 0, F.when(rmse == 0, 1.0).otherwise(float("inf"))).otherwise(rmse / naive)
    return _by(_lagged(df, truth, pred, order, series, 1), series, u.alias("theils_u"))


@metric
def forecasting_metrics(df, truth, pred, order, series=(), epsilon=1e-8, max_dtw_len=2000, naive_error=None):
    rows = _lagged(df, truth, pred, order, series, 1).withColumn("__o", F.col(Y))
    mae = F.avg(F.abs(_err()))
    naive = F.lit(float(naive_error)) if naive_error is not None else F.avg(F.abs(F.col(Y) - F.col("__lag")))
    out = _by(rows, series, F.avg(_err() * _err()).alias("mse"), F.sqrt(F.avg(_err() * _err())).alias("rmse"), mae.alias("mae"), (100 * F.avg(F.abs(_err()) / (F.abs(Y) + epsilon))).alias("mape"), REGRESSION["smape_metric"](epsilon).alias("smape"), (mae / (naive + epsilon)).alias("mase"), _r2().alias("r2"))
    dtw = per_series(df, [truth, pred], lambda y, p: [E.dtw(y[:: -(-len(y) // max_dtw_len)], p[:: -(-len(p) // max_dtw_len)])[0]], "dtw double", order, series)
    return out.join(dtw, list(series)) if series else out.crossJoin(dtw)  # one row each


# ---- labels


def _counts(df, truth, pred, positive=1, series=()):
    t, p = F.col(truth) == positive, F.col(pred) == positive
    c = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")
    return _by(df, series, c(t & p).alias("tp"), c(~t & p).alias("fp"), c(~t & ~p).alias("tn"), c(t & ~p).alias("fn"))


def _scores(zero=0.0, decimals=6) -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, precision = _safe(tp, tp + fn, zero), _safe(tp, tp + fp, zero)
    fpr = _safe(fp, fp + tn, zero)
    out = {"accuracy": _safe(tp + tn, tp + fp + tn + fn, zero), "precision": precision, "recall": recall, "f1": _safe(2 * tp, 2 * tp + fp + fn, zero), "specificity": _safe(tn, tn + fp, zero), "fpr": fpr, "fnr": _safe(fn, fn + tp, zero), "npv": _safe(tn, tn + fn, zero), "far": fpr, "fdr": recall, "mar": 1 - recall}
    return {k: F.round(v, decimals).alias(k) for k, v in out.items()}


@metric
def binary_classification(df, truth, pred, positive_label=1, series=(), default_for_zero=0.0, decimals=6):
    """Counts and eleven ratios; fdr is the fault detection rate (recall), mar the missed alarms."""
    return _counts(df, truth, pred, positive_label, series).select("*", *_scores(default_for_zero, decimals).values())


@metric
def multi_classification(df, truth, pred, labels=None, default_for_zero=0.0, decimals=6):
    """One against the rest for each label of the truth, and the mean of each ratio."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).count()
    names = df.sparkSession.createDataFrame([(x,) for x in labels], pairs.select("t").schema) if labels else pairs.select("t").distinct()
    names = names.select(F.col("t").alias("label"))
    s = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)).cast("long")
    t, p = F.col("t") == F.col("label"), F.col("p") == F.col("label")
    each = pairs.crossJoin(F.broadcast(names)).groupBy("label").agg(s(t & p).alias("tp"), s(~t & p).alias("fp"), s(~t & ~p).alias("tn"), s(t & ~p).alias("fn"))  # labels x labels, not rows
    each = each.select("*", *[v for v in _scores(default_for_zero, 15).values()])
    return each.agg(F.count(F.lit(1)).alias("n_labels"), *[F.round(F.avg(k), decimals).alias(f"macro_{k}") for k in _scores()])


@metric
def fbeta_metric(df, truth, pred, beta=1.0, pos_label=1, series=()):
    b = beta * beta
    return _counts(df, truth, pred, pos_label, series).select(*series, _safe((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp")).alias("fbeta"))


def _label_f1(df, truth, pred):
    t = df.groupBy(F.col(truth).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n_true"), F.sum((F.col(truth) == F.col(pred)).cast("long")).alias("tp"))
    p = df.groupBy(F.col(pred).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return t.join(p, "label", "full").select(z("n_true").alias("n_true"), z("n_pred").alias("n_pred"), z("tp").alias("tp")).withColumn("f1", _safe(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")))


@metric
def macro_f1_metric(df, truth, pred):
    return _label_f1(df, truth, pred).agg(F.avg("f1").alias("macro_f1"))


@metric
def micro_f1_metric(df, truth, pred):
    return _label_f1(df, truth, pred).agg((2 * F.sum("tp") / (F.sum("n_true") + F.sum("n_pred"))).alias("micro_f1"))


@metric
def weighted_f1_metric(df, truth, pred):
    return _label_f1(df, truth, pred).agg((F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("weighted_f1"))


def _contingency(df, truth, pred):
    c = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return c.select("c", F.sum("c").over(Window.partitionBy("t")).alias("a"), F.sum("c").over(Window.partitionBy("p")).alias("b"), "t", "p")


@metric
def cohen_kappa_metric(df, truth, pred):
    c = _contingency(df, truth, pred)
    n = F.sum("c")
    po = F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0.0)) / n
    # each label's marginals: from the cells, a label's row total once and its column total once
    rows = c.select("t", "a").distinct().join(c.select(F.col("p").alias("t"), "b").distinct(), "t", "left").agg(F.sum(F.col("a") * F.coalesce("b", F.lit(0.0))).alias("e"))
    one = c.agg(po.alias("po"), n.alias("n")).crossJoin(rows)  # one row each
    pe = F.coalesce("e", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return one.select(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("cohen_kappa"))


@metric
def entropy_metric(df, truth, pred=None):
    c = df.groupBy(truth).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return c.agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("entropy"))


def _information(df, truth, pred):
    c = _contingency(df, truth, pred)
    n = df.agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = c.crossJoin(F.broadcast(n))  # one row
    r = F.col("c") / F.col("n")
    return c.agg(F.sum(r * F.log(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"), (-F.sum(r * F.log(F.col("a") / F.col("n")))).alias("ht"), (-F.sum(r * F.log(F.col("b") / F.col("n")))).alias("hp"))


@metric
def mi_metric(df, truth, pred):
    return _information(df, truth, pred).select(F.greatest("mi", F.lit(0.0)).alias("mi"))


@metric
def nmi_metric(df, truth, pred):
    h = F.sqrt(F.col("ht") * F.col("hp"))
    return _information(df, truth, pred).select(F.when((F.col("ht") == 0) & (F.col("hp") == 0), 1.0).when(h == 0, 0.0).otherwise(F.col("mi") / h).alias("nmi"))


@metric
def ari_metric(df, truth, pred):
    c = _contingency(df, truth, pred)
    two = lambda x: x * (x - 1) / 2
    cells = c.agg(F.sum(two(F.col("c"))).alias("i"), F.sum("c").alias("n"))
    rows, cols = (c.select(k, v).distinct().agg(F.sum(two(F.col(v))).alias(n)) for k, v, n in (("t", "a", "x"), ("p", "b", "y")))
    one = cells.crossJoin(rows).crossJoin(cols)  # one row each
    expected, most = F.col("x") * F.col("y") / two(F.col("n")), (F.col("x") + F.col("y")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("i") - expected) / (most - expected)).alias("ari"))


def _multi(df, truth, pred):
    return [(F.col(a), F.col(b)) for a, b in zip(truth, pred, strict=True)]


@metric
def hamming_loss_metric(df, truth, pred):
    return df.agg(F.avg(sum(((a != b).cast("double") for a, b in _multi(df, truth, pred)), F.lit(0.0)) / len(truth)).alias("hamming_loss"))


@metric
def exact_match_ratio_metric(df, truth, pred):
    same = F.lit(True)
    for a, b in _multi(df, truth, pred):
        same = same & a.eqNullSafe(b)
    return df.agg(F.avg(same.cast("double")).alias("exact_match_ratio"))


@metric
def multi_label_accuracy_metric(df, truth, pred):
    both = sum((((a == 1) & (b == 1)).cast("int") for a, b in _multi(df, truth, pred)), F.lit(0))
    any_ = sum((((a == 1) | (b == 1)).cast("int") for a, b in _multi(df, truth, pred)), F.lit(0))
    return df.agg(F.avg(_safe(both, any_, 1.0)).alias("multi_label_accuracy"))


@metric
def self_evaluation(df, truth, pred=None, series=()):
    """sigmoid(population deviation / mean of absolute values); 0 for no rows or a mean under 1e-10."""
    m = F.coalesce(F.avg(F.abs(truth)), F.lit(0.0))
    return _by(df, series, F.when(m < 1e-10, 0.0).otherwise(1 / (1 + F.exp(-F.stddev_pop(truth) / m))).alias("self_evaluation"))


# ---- rankings: counts at each distinct score, then running sums


def _curve(df, truth, score, pos_label=1, series=()):
    """For each distinct score: positives and rows at it (dp, dn), at or above it (tp, rows), in all, and its place from the top."""
    pos = (F.col(truth) == pos_label).cast("long")
    at = df.groupBy(*series, F.col(score).alias("s")).agg(F.sum(pos).alias("dp"), F.count(F.lit(1)).alias("dn"), F.lit(1).cast("long").alias("d"))
    at = O.running_sums(at, "s", ["dp", "dn", "d"], series, O.boundaries(df, score))
    down = lambda c: F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)
    return at.select(*series, "s", "dp", "dn", down("dp").alias("tp"), down("dn").alias("rows"), F.col("dp_all").alias("all_pos"), F.col("dn_all").alias("all_rows"), down("d").cast("int").alias("i"))


@metric
def roc_auc_metric(df, truth, score, pos_label=1, series=()):
    c = _curve(df, truth, score, pos_label, series)
    dneg = F.col("dn") - F.col("dp")
    area = F.sum(dneg * (F.col("tp") - F.col("dp") / 2))
    neg = F.first("all_rows") - F.first("all_pos")
    return _by(c, series, _safe(area, F.first("all_pos") * neg).alias("roc_auc"))


@metric
def pr_auc_metric(df, truth, score, pos_label=1, series=()):
    """Trapezoids over recall, from precision 1 at recall 0."""
    c = _curve(df, truth, score, pos_label, series)
    higher = F.col("rows") - F.col("dn")
    before = F.when(higher == 0, 1.0).otherwise((F.col("tp") - F.col("dp")) / higher)  # the precision at the next higher score
    return _by(c, series, F.coalesce(F.sum(F.col("dp") / F.col("all_pos") * (F.col("tp") / F.col("rows") + before) / 2), F.lit(0.0)).alias("pr_auc"))


def _ranked(df, truth, score, key, pos_label, series):
    """y, r (place from the top) and tp (positives so far). Equal scores go by key; one numeric key is cut in ranges, so that a hot score is, too."""
    rows = df.select(*series, F.col(score).alias("s"), *key, (F.col(truth) == pos_label).cast("long").alias("y"))
    at = _curve(rows.withColumn("__one", F.col("y")), "__one", "s", 1, series).select(*series, "s", (F.col("tp") - F.col("dp")).alias("tp_above"), (F.col("rows") - F.col("dn")).alias("above"))
    tie = [*series, "s"]
    if len(key) == 1 and dict(df.dtypes)[key[0]] in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        one = rows.groupBy(*tie, *key).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("c"))
        rows = O.running_sums(one, key[0], ["y", "c"], tie, O.boundaries(df, key[0])).select(*tie, "y", F.col("c_upto").alias("r"), F.col("y_upto").alias("tp"))
    else:
        w = Window.partitionBy(*tie).orderBy(*key) if key else Window.partitionBy(*tie).orderBy("y")
        rows = rows.select(*tie, "y", F.row_number().over(w).alias("r"), F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in tie]
    return rows.alias("a").join(at.alias("b"), on).select(*[F.col(f"a.{c}") for c in series], "y", (F.col("above") + F.col("r")).alias("r"), (F.col("tp_above") + F.col("tp")).alias("tp"))


@metric
def average_precision_metric(df, truth, score, key=(), pos_label=1, series=()):
    return _by(_ranked(df, truth, score, list(key), pos_label, series), series, F.coalesce(F.avg(F.when(F.col("y") == 1, F.col("tp") / F.col("r"))), F.lit(0.0)).alias("average_precision"))


def _top(df, truth, score, key, k, pos_label):
    return df.select((F.col(truth) == pos_label).cast("long").alias("y"), F.col(score).alias("s"), *key).orderBy(F.desc("s"), *key).limit(k)


@metric
def precision_at_k_metric(df, truth, score, key=(), k=10, pos_label=1):
    """k above the number of rows gives null."""
    return _top(df, truth, score, key, k, pos_label).agg(F.when(F.count("y") == k, F.sum("y") / k).alias("precision_at_k"))


@metric
def recall_at_k_metric(df, truth, score, key=(), k=10, pos_label=1):
    top = _top(df, truth, score, key, k, pos_label).agg(F.sum("y").alias("h"))
    all_ = df.agg(F.sum((F.col(truth) == pos_label).cast("long")).alias("P"))
    return top.crossJoin(all_).select(_safe(F.col("h"), F.col("P")).alias("recall_at_k"))  # one row each


@metric
def binary_classification_curve(df, truth, score, positive_label=1, series=(), decimals=6, inf_threshold=True):
    """One row a threshold (distinct scores, from high to low, +inf last): counts for score > threshold and the ratios."""
    c = _curve(df, truth, score, positive_label, series)
    c = c.withColumn("tp", F.col("tp") - F.col("dp")).withColumn("pred", F.col("rows") - F.col("dn"))
    c = c.select(*series, "i", F.col("s").cast("double").alias("threshold"), "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("all_rows") - F.col("all_pos") - F.col("pred") + F.col("tp")).alias("tn"), (F.col("all_pos") - F.col("tp")).alias("fn"))
    if inf_threshold:
        last = c.groupBy(*series).agg((F.max("i") + 1).alias("i"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.max(F.col("tn") + F.col("fp")).alias("tn"), F.max(F.col("fn") + F.col("tp")).alias("fn"))
        c = c.unionByName(last)
    return c.select("*", *_scores(decimals=decimals).values())


# ---- events: islands of the positive label


def islands(df: DataFrame, label: str, order: str, series=(), pos_label=1) -> DataFrame:
    """Closed intervals of row positions: series..., event, start, end, n (rows of the series)."""
    w = Window.partitionBy(*series).orderBy(order)
    rows = df.select(*series, (F.row_number().over(w) - 1).alias("i"), F.row_number().over(w).alias("__"), (F.col(label) == pos_label).cast("int").alias("y"), F.count(F.lit(1)).over(Window.partitionBy(*series)).alias("n"))
    rows = rows.withColumn("g", F.col("i") - F.sum("y").over(Window.partitionBy(*series).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("y = 1").groupBy(*series, "g").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.first("n").alias("n")).drop("g")


@metric
def point_adjust(df, truth, pred, order, positive_label=1, series=()):
    """tp and fn count true segments (hit or not), fp predicted points outside them."""
    w = Window.partitionBy(*series).orderBy(order)
    rows = df.select(*series, (F.col(truth) == positive_label).cast("int").alias("t"), (F.col(pred) == positive_label).cast("int").alias("p"), F.row_number().over(w).alias("i"))
    rows = rows.withColumn("g", F.when(F.col("t") == 1, F.col("i") - F.sum("t").over(Window.partitionBy(*series).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))))
    seg = rows.groupBy(*series, "g").agg(F.max("p").alias("hit"), F.sum("p").alias("points"))
    c = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    real = F.col("g").isNotNull()
    out = _by(seg, series, c((real & (F.col("hit") == 1)).cast("int")).alias("tp"), c((real & (F.col("hit") == 0)).cast("int")).alias("fn"), c(F.when(~real, F.col("points"))).alias("fp"), c(real.cast("int")).alias("segments"))
    return out.select("*", _safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


@metric
def detection_delay_metric(df, truth, score, order, threshold, pos_label=1, series=(), check_before_event=False, return_all=False):
    """For each true event the rows from its start to the first score >= threshold; its length if there is none."""
    w = Window.partitionBy(*series).orderBy(order)
    hits = df.select(*series, (F.row_number().over(w) - 1).alias("i"), F.col(score).alias("s")).where(F.col("s") >= threshold).select(*series, "i")
    ev = islands(df, truth, order, series, pos_label)
    on = (F.col("i") <= F.col("end")) & (F.lit(True) if check_before_event else F.col("i") >= F.col("start"))
    for c in series:
        on = on & (F.col(f"e.{c}") == F.col(f"h.{c}"))
    each = ev.alias("e").join(hits.alias("h"), on, "left").groupBy(*[F.col(f"e.{c}").alias(c) for c in series], "start", "end").agg(F.min("i").alias("i"))
    each = each.select(*series, "start", F.when(F.col("i").isNull(), F.col("end") - F.col("start") + 1).otherwise(F.greatest(F.col("i") - F.col("start"), F.lit(0))).cast("double").alias("delay"))
    return each if return_all else _by(each, series, F.avg("delay").alias("detection_delay"))


def per_series(df: DataFrame, columns: list[str], kernel: Callable, out: str, order: str, series=()) -> DataFrame:
    """kernel(*arrays in order) -> the values of `out`, for each series."""
    names = [f"__c{i}" for i in range(len(columns))]
    rows = df.select(*series, F.col(order).alias("__order"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in series], out])
    cols = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__order", kind="stable")
        return pd.DataFrame([[*(key if series else ()), *kernel(*[pdf[n].to_numpy(float) for n in names])]], columns=cols)

    keyed = rows if series else rows.withColumn("__all", F.lit(0))
    return keyed.groupBy(*(series or ["__all"])).applyInPandas(run, schema)


def _register(name: str, kernel: Callable, out: str) -> None:
    def run(df, truth, pred, order, series=(), pos_label=1, **config):
        y = F.when(F.col(truth) == pos_label, 1.0).otherwise(0.0)
        return per_series(df.withColumn("__truth", y), ["__truth", pred], partial(kernel, **config), out, order, series)

    METRICS[name] = run


_register("event_based_f1_metric", lambda y, p, overlap_threshold=0: E.event_f1(y, p, overlap_threshold), "tp long, fp long, fn long, f1 double")
_register("soft_event_based_f1_metric", lambda y, p: E.soft_f1(y, p), "precision double, recall double, f1 double")
_register("affiliation_metric", lambda y, p: E.affiliation(y, p), "affiliation_precision double, affiliation_recall double, affiliation_f1 double")
_register("range_auc_roc_metric", lambda y, s, sliding_window, num_thresholds=250: [E.range_auc(y, s, sliding_window, num_thresholds)[0]], "range_auc_roc double")
_register("range_auc_pr_metric", lambda y, s, sliding_window, num_thresholds=250: [E.range_auc(y, s, sliding_window, num_thresholds)[1]], "range_auc_pr double")
_register("vus_roc_metric", lambda y, s, sliding_window=100, num_thresholds=250: [E.vus(y, s, sliding_window, num_thresholds)[0]], "vus_roc double")
_register("vus_pr_metric", lambda y, s, sliding_window=100, num_thresholds=250: [E.vus(y, s, sliding_window, num_thresholds)[1]], "vus_pr double")
_register("nab_score_metric", lambda y, s, threshold=None, **k: E.nab(y, s, threshold, **k), "nab_score double, threshold double")
_register("nab_best_threshold_metric", lambda y, s, **k: [E.nab_best(y, s, **k)], "nab_best_score double")


@metric
def dtw_distance_metric(df, truth, pred, order, series=(), window=None):
    return per_series(df, [truth, pred], lambda a, b: [E.dtw(a, b, window)[0]], "dtw_distance double", order, series)


@metric
def dtw_path_metric(df, truth, pred, order, series=(), window=None):
    """Distance and path as an array of (i, j) pairs; ties go up, left, diagonal."""

    def kernel(a, b):
        d, path = E.dtw(a, b, window, path=True)
        return [d, [list(x) for x in path]]

    return per_series(df, [truth, pred], kernel, "dtw_distance double, path array<array<int>>", order, series)


@metric
def confidence_metric(train, test, score, threshold, contamination=0.1):
    """test with `confidence` of its label: a binomial tail at the smoothed rank among the training scores.

    Ranks come from running sums over ranges of values; test rows look theirs up by value. A null score has a null confidence.
    """
    counts = train.select(F.col(score).cast("double").alias("__t")).where("__t is not null").groupBy("__t").agg(F.count(F.lit(1)).alias("c"))
    n = train.count()
    if not n:
        raise ValueError("no training scores")
    k = n - math.floor(n * contamination)

    @F.pandas_udf("double")
    def tail(p: pd.Series) -> pd.Series:
        return pd.Series(E.binomial_tail(k, n, p.to_numpy(float)))

    own = test.withColumn("__t", F.col(score).cast("double"))
    at = O.ranks(counts, own.select("__t"), "__t").withColumn("__c", tail((1 + F.col("le")) / F.lit(2.0 + n))).select("__t", "__c")
    c = F.col("__c")
    return own.join(at, "__t", "left").withColumn("confidence", F.when(F.col(score) > threshold, 1 - c).otherwise(c)).select(*test.columns, "confidence")


@metric
def normalize_score_metric(train, test, score, method="linear"):
    """test with `normalized`: min-max by the training scores, clipped, or the normal distribution's error function."""
    s = train.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("m"), F.stddev_pop(score).alias("d")).first()
    x = F.col(score)
    if method == "linear":
        out = F.lit(0.0) if s["hi"] == s["lo"] else (x - s["lo"]) / (s["hi"] - s["lo"])
    elif not s["d"]:
        return test.withColumn("normalized", F.lit(0.5))
    else:
        erf = F.pandas_udf(lambda v: v.map(math.erf), "double")
        out = erf((x - s["m"]) / (s["d"] * math.sqrt(2)))
    return test.withColumn("normalized", F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)))


__all__ = ["METRICS", "islands", "np", "per_series", "regression_metrics"]
