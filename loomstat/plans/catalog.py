"""Named queries over the driver's tables and their DuckDB SQL, one for each operator.

Matrix: lineitem's or part's numbers; series: events by ts, one for each
user; signal cells: embeddings; labels: labels and events' error flag.
Values are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection as D
from ..operators import evaluation as E
from ..operators import features as X
from ..operators import forecasting as C
from ..operators import selection as S
from ..operators import series as T
from ..operators import tuning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _half_away(x, places: int):
    """The double nearest to x's multiple of 10**-places; halves of the scaled double go away from zero, as DuckDB's round has it."""
    t = F.abs(x) * 10.0**places
    return F.signum(x) * F.when(t < 2.0**52, F.floor(t + 0.5).cast("double")).otherwise(t) / 10.0**places


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[_half_away(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _add(name: str, base: Callable[[SparkSession, str], DataFrame], f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: _round(f(base(spark, d)))
    if sql:
        ORACLE[name] = " ".join(sql.split())


# ---- bases
MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(s, d):
    return _read(s, d, "lineitem").select((F.col("l_quantity") / 10).alias("y"), (F.col("l_extendedprice") / 5000).alias("p"))


P_SQL = "WITH b AS (SELECT l_quantity / 10 AS y, l_extendedprice / 5000 AS p FROM lineitem)"


def _labels(s, d):
    return _read(s, d, "labels").select("doc_id", F.col("toxic").alias("t"), (1 - F.col("quality")).alias("p"))


L_SQL = "WITH b AS (SELECT doc_id, toxic AS t, 1 - quality AS p FROM labels)"


def _events(s, d):
    return _read(s, d, "events").select("event_id", "user_id", "ts", "value", (F.col("event_type") == "error").cast("int").alias("t"), (F.col("value") > 100).cast("int").alias("p"))


E_SQL = "WITH b AS (SELECT event_id, user_id, ts, value, CAST(event_type = 'error' AS INTEGER) AS t, CAST(value > 100 AS INTEGER) AS p FROM events)"


def _next(s, d):
    return _events(s, d).withColumn("guess", F.col("value") * 0.9 + 5)


def _cells(s, d):
    return _read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


V_SQL = "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::BIGINT - 1 AS i FROM embeddings), m AS (SELECT *, avg(v) OVER (PARTITION BY vec_id) AS a FROM e)"


def _items(s, d):
    return _read(s, d, "lineitem").select(*MATRIX)


def _parts(s, d):
    return _read(s, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 100.0).alias("nat"))


S_SQL = "WITH b AS (SELECT s_suppkey, s_acctbal, s_nationkey * 100.0::DOUBLE AS nat FROM supplier)"

# ---- evaluation
for n, q in {
    "mae": "avg(abs(y - p))", "mse": "avg((y - p) * (y - p))", "rmse": "sqrt(avg((y - p) * (y - p)))", "mape": "100 * avg(abs((y - p) / (y + 1e-10::DOUBLE)))",
    "smape": "100 * avg(abs(y - p) / ((abs(y) + abs(p)) / 2 + 1e-10::DOUBLE))", "r2": "1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))",
}.items():
    _add(f"eval_{n}_metric", _pairs, lambda df, n=n: E.METRICS[f"{n}_metric"](df, "y", "p"), f"{P_SQL} SELECT round({q}, 6) AS {n} FROM b")
_lag = "(SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS z, value * 0.9::DOUBLE + 5 AS g FROM b)"
_add("eval_mase_metric", _next, lambda df: E.mase_metric(df, "value", "guess", "ts", ["user_id"]), f"{E_SQL} SELECT user_id, round(CASE WHEN coalesce(avg(abs(value - z)), 0) = 0 THEN avg(abs(value - g)) ELSE avg(abs(value - g)) / avg(abs(value - z)) END, 6) AS mase FROM {_lag} GROUP BY 1")
_add("eval_theils_u_metric", _next, lambda df: E.theils_u_metric(df, "value", "guess", "ts", ["user_id"]), f"{E_SQL} SELECT user_id, round(CASE WHEN count(*) <= 1 THEN 1.0::DOUBLE ELSE sqrt(avg((value - g) * (value - g))) / sqrt(avg((value - coalesce(z, value)) * (value - coalesce(z, value)))) END, 6) AS theils_u FROM {_lag} GROUP BY 1")
_add("eval_forecasting_metrics", _next, lambda df: E.forecasting_metrics(df, "value", "guess", "ts", ["user_id"]))
_cnt = "SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t <> 1 AND p = 1) AS fp, count(*) FILTER (t <> 1 AND p <> 1) AS tn, count(*) FILTER (t = 1 AND p <> 1) AS fn FROM b"


def _sdiv(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


_RATIOS = {"accuracy": _sdiv("tp + tn", "tp + fp + tn + fn"), "precision": _sdiv("tp", "tp + fp"), "recall": _sdiv("tp", "tp + fn"), "f1": _sdiv("2 * tp", "2 * tp + fp + fn"), "specificity": _sdiv("tn", "tn + fp"), "fpr": _sdiv("fp", "fp + tn"), "fnr": _sdiv("fn", "fn + tp"), "npv": _sdiv("tn", "tn + fn"), "far": _sdiv("fp", "fp + tn"), "fdr": _sdiv("tp", "tp + fn"), "mar": f"1 - ({_sdiv('tp', 'tp + fn')})"}
_sel = ", ".join(f'round({v}, 6) AS "{k}"' for k, v in _RATIOS.items())
_add("eval_binary_classification", _labels, lambda df: E.binary_classification(df, "t", "p"), f"{L_SQL}, c AS ({_cnt}) SELECT tp, fp, tn, fn, {_sel} FROM c")
_each = "SELECT l, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t <> l AND p = l) AS fp, count(*) FILTER (t <> l AND p <> l) AS tn, count(*) FILTER (t = l AND p <> l) AS fn FROM b, (SELECT DISTINCT t AS l FROM b) GROUP BY l"
_add("eval_multi_classification", _labels, lambda df: E.multi_classification(df, "t", "p"), f"{L_SQL}, c AS ({_each}) SELECT count(*) AS n_labels, " + ", ".join(f"round(avg({v}), 6) AS macro_{k}" for k, v in _RATIOS.items()) + " FROM c")
_add("eval_fbeta_metric", _labels, lambda df: E.fbeta_metric(df, "t", "p", 2.0), f"{L_SQL}, c AS ({_cnt}) SELECT round({_sdiv('5 * tp', '5 * tp + 4 * fn + fp')}, 6) AS fbeta FROM c")
_f1 = f"{L_SQL}, l AS (SELECT t AS l FROM b UNION SELECT p FROM b), f AS (SELECT l, count(*) FILTER (t = l) AS nt, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (p = l) AS np FROM b, l GROUP BY l)"
_add("eval_macro_f1_metric", _labels, lambda df: E.macro_f1_metric(df, "t", "p"), f"{_f1} SELECT round(avg({_sdiv('2 * tp', 'nt + np')}), 6) AS macro_f1 FROM f")
_add("eval_micro_f1_metric", _labels, lambda df: E.micro_f1_metric(df, "t", "p"), f"{L_SQL} SELECT round(avg(CAST(t = p AS INTEGER)), 6) AS micro_f1 FROM b")
_add("eval_weighted_f1_metric", _labels, lambda df: E.weighted_f1_metric(df, "t", "p"), f"{_f1} SELECT round(sum(nt * ({_sdiv('2 * tp', 'nt + np')})) / sum(nt), 6) AS weighted_f1 FROM f")
_ct = f"{L_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM b), c AS (SELECT t, p, count(*)::DOUBLE AS c FROM b GROUP BY 1, 2), r AS (SELECT t, count(*)::DOUBLE AS a FROM b GROUP BY 1), k AS (SELECT p, count(*)::DOUBLE AS b FROM b GROUP BY 1)"
_add("eval_cohen_kappa_metric", _labels, lambda df: E.cohen_kappa_metric(df, "t", "p"), f"{_ct}, o AS (SELECT (SELECT sum(c) FROM c WHERE t = p) / n AS po, (SELECT sum(a * b) FROM r JOIN k ON t = p) / (n * n) AS pe FROM n) SELECT round((po - pe) / (1 - pe), 6) AS cohen_kappa FROM o")
_add("eval_entropy_metric", _labels, lambda df: E.entropy_metric(df, "t"), f"{_ct} SELECT round(-sum(a / n * ln(a / n)), 6) AS entropy FROM r, n")
_mi = "sum(c / n * ln(c * n / (a * b)))"
_add("eval_mi_metric", _labels, lambda df: E.mi_metric(df, "t", "p"), f"{_ct} SELECT round(greatest({_mi}, 0), 6) AS mi FROM c JOIN r USING (t) JOIN k USING (p), n")
_add("eval_nmi_metric", _labels, lambda df: E.nmi_metric(df, "t", "p"), f"{_ct} SELECT round({_mi} / sqrt((SELECT -sum(a / n * ln(a / n)) FROM r, n) * (SELECT -sum(b / n * ln(b / n)) FROM k, n)), 6) AS nmi FROM c JOIN r USING (t) JOIN k USING (p), n")
_add("eval_ari_metric", _labels, lambda df: E.ari_metric(df, "t", "p"), f"{_ct}, s AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM c) AS i, (SELECT sum(a * (a - 1) / 2) FROM r) AS x, (SELECT sum(b * (b - 1) / 2) FROM k) AS y, n * (n - 1) / 2 AS m FROM n) SELECT round((i - x * y / m) / ((x + y) / 2 - x * y / m), 6) AS ari FROM s")
_ml = lambda f: lambda df: f(df.withColumns({"a": 1 - F.col("t"), "b": 1 - F.col("p")}), ["t", "a"], ["p", "b"])
_add("eval_hamming_loss_metric", _labels, _ml(E.hamming_loss_metric), f"{L_SQL} SELECT round(avg((CAST(t <> p AS INTEGER) + CAST(1 - t <> 1 - p AS INTEGER)) / 2), 6) AS hamming_loss FROM b")
_add("eval_exact_match_ratio_metric", _labels, _ml(E.exact_match_ratio_metric), f"{L_SQL} SELECT round(avg(CAST(t = p AS INTEGER)), 6) AS exact_match_ratio FROM b")
_add("eval_multi_label_accuracy_metric", _labels, _ml(E.multi_label_accuracy_metric), f"{L_SQL} SELECT round(avg(CASE WHEN t = p THEN 1 ELSE 0 END), 6) AS multi_label_accuracy FROM b")
_add("eval_self_evaluation", _events, lambda df: E.self_evaluation(df, "value"), f"{E_SQL} SELECT round(1 / (1 + exp(-stddev_pop(value) / avg(abs(value)))), 6) AS self_evaluation FROM b")
_cv = f"{E_SQL}, g AS (SELECT value AS s, sum(t) AS dp, count(*) AS dn FROM b GROUP BY 1), u AS (SELECT *, sum(dp) OVER (ORDER BY s DESC) AS tp, sum(dn) OVER (ORDER BY s DESC) AS n, sum(dp) OVER () AS pp, sum(dn) OVER () AS nn FROM g)"
_add("eval_roc_auc_metric", _events, lambda df: E.roc_auc_metric(df, "t", "value"), f"{_cv} SELECT round(sum((dn - dp) * (tp - dp / 2)) / (any_value(pp)::DOUBLE * (any_value(nn) - any_value(pp))), 6) AS roc_auc FROM u")
_add("eval_pr_auc_metric", _events, lambda df: E.pr_auc_metric(df, "t", "value"), f"{_cv}, w AS (SELECT dp, pp, tp::DOUBLE / n AS q, lag(tp::DOUBLE / n, 1, 1.0::DOUBLE) OVER (ORDER BY s DESC) AS z FROM u) SELECT round(sum(dp::DOUBLE / pp * (q + z) / 2), 6) AS pr_auc FROM w")
_rk = f"{E_SQL}, r AS (SELECT t, row_number() OVER (ORDER BY value DESC, event_id) AS r, sum(t) OVER (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS tp FROM b)"
_add("eval_average_precision_metric", _events, lambda df: E.average_precision_metric(df, "t", "value", ["event_id"]), f"{_rk} SELECT round(avg(tp::DOUBLE / r) FILTER (t = 1), 6) AS average_precision FROM r")
_add("eval_precision_at_k_metric", _events, lambda df: E.precision_at_k_metric(df, "t", "value", ["event_id"], 50), f"{_rk} SELECT round(sum(t) / 50, 6) AS precision_at_k FROM r WHERE r <= 50")
_add("eval_recall_at_k_metric", _events, lambda df: E.recall_at_k_metric(df, "t", "value", ["event_id"], 50), f"{_rk} SELECT round(sum(t) FILTER (r <= 50)::DOUBLE / sum(t), 6) AS recall_at_k FROM r")
_add("eval_binary_classification_curve", _events, lambda df: E.binary_classification_curve(df, "t", "value").where("not isnan(threshold) and threshold < 1e300"), f"{_cv}, c AS (SELECT row_number() OVER (ORDER BY s DESC)::INTEGER AS i, s AS threshold, (tp - dp)::BIGINT AS tp, (n - dn - tp + dp)::BIGINT AS fp, (nn - pp - n + dn + tp - dp)::BIGINT AS tn, (pp - tp + dp)::BIGINT AS fn FROM u) SELECT i, threshold, tp, fp, tn, fn, {_sel} FROM c")
_is = f"{E_SQL}, o AS (SELECT *, row_number() OVER w - 1 AS i, row_number() OVER w - sum(t) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g, count(*) OVER (PARTITION BY user_id) AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts))"
_add("eval_event_islands", _events, lambda df: E.islands(df, "t", "ts", ["user_id"]), f'{_is} SELECT user_id, min(i)::INTEGER AS start, max(i)::INTEGER AS "end", any_value(n) AS n FROM o WHERE t = 1 GROUP BY user_id, g')
_add("eval_point_adjust", _events, lambda df: E.point_adjust(df, "t", "p", "ts", series=["user_id"]), f"{_is}, s AS (SELECT user_id, CASE WHEN t = 1 THEN g END AS g, max(p) AS hit, sum(p) AS pts FROM o GROUP BY 1, 2), c AS (SELECT user_id, count(*) FILTER (g IS NOT NULL AND hit = 1) AS tp, count(*) FILTER (g IS NOT NULL AND hit = 0) AS fn, coalesce(sum(pts) FILTER (g IS NULL), 0)::BIGINT AS fp, count(g) AS segments FROM s GROUP BY 1) SELECT *, round({_RATIOS['precision']}, 6) AS precision, round({_RATIOS['recall']}, 6) AS recall, round({_RATIOS['f1']}, 6) AS f1 FROM c")
_add("eval_detection_delay_metric", _events, lambda df: E.detection_delay_metric(df, "t", "value", "ts", 150.0, series=["user_id"]), f"{_is}, v AS (SELECT user_id, min(i) AS a, max(i) AS z FROM o WHERE t = 1 GROUP BY user_id, g), d AS (SELECT v.user_id, a, z, min(o.i) AS h FROM v LEFT JOIN o ON o.user_id = v.user_id AND o.value >= 150 AND o.i BETWEEN a AND z GROUP BY 1, 2, 3) SELECT user_id, round(avg(CASE WHEN h IS NULL THEN z - a + 1 ELSE h - a END), 6) AS detection_delay FROM d GROUP BY 1")
_soft = f"{_is}, v AS (SELECT user_id, min(i) AS a, max(i) AS z FROM o WHERE t = 1 GROUP BY user_id, g), o2 AS (SELECT *, row_number() OVER w - sum(p) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g2 FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts)), q0 AS (SELECT o.user_id, o.i, o2.g2 FROM o JOIN o2 USING (event_id) WHERE o.p = 1), q AS (SELECT user_id, min(i) AS a, max(i) AS z FROM q0 GROUP BY user_id, g2), x AS (SELECT v.user_id, v.a AS va, q.a AS qa, greatest(least(v.z, q.z) - greatest(v.a, q.a) + 1, 0)::DOUBLE / (v.z - v.a + 1 + q.z - q.a + 1 - greatest(least(v.z, q.z) - greatest(v.a, q.a) + 1, 0)) AS iou FROM v JOIN q USING (user_id)), pr AS (SELECT user_id, avg(m) AS precision FROM (SELECT user_id, qa, max(iou) AS m FROM x GROUP BY 1, 2) GROUP BY 1), rc AS (SELECT user_id, avg(m) AS recall FROM (SELECT user_id, va, max(iou) AS m FROM x GROUP BY 1, 2) GROUP BY 1), ids AS (SELECT user_id, bool_or(t = 1) AS ht, bool_or(p = 1) AS hp FROM b GROUP BY 1)"
_add("eval_soft_event_based_f1_metric", _events, lambda df: E.METRICS["soft_event_based_f1_metric"](df, "t", "p", "ts", ["user_id"]), f"{_soft} SELECT user_id, round(CASE WHEN NOT ht AND NOT hp THEN 1 ELSE coalesce(precision, 0) END, 6) AS precision, round(CASE WHEN NOT ht AND NOT hp THEN 1 ELSE coalesce(recall, 0) END, 6) AS recall, round(CASE WHEN NOT ht AND NOT hp THEN 1 WHEN coalesce(precision + recall, 0) = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM ids LEFT JOIN pr USING (user_id) LEFT JOIN rc USING (user_id)")
for n, pred, cfg in (("event_based_f1_metric", "p", {}), ("affiliation_metric", "p", {}), ("range_auc_roc_metric", "value", {"sliding_window": 10}), ("range_auc_pr_metric", "value", {"sliding_window": 10}), ("vus_roc_metric", "value", {"sliding_window": 10}), ("vus_pr_metric", "value", {"sliding_window": 10}), ("nab_score_metric", "value", {}), ("nab_best_threshold_metric", "value", {})):
    _add(f"eval_{n}", _events, lambda df, n=n, pred=pred, cfg=cfg: E.METRICS[n](df, "t", pred, "ts", ["user_id"], **cfg))
_add("eval_dtw_distance_metric", _next, lambda df: E.dtw_distance_metric(df, "value", "guess", "ts", ["user_id"], 10))
_add("eval_dtw_path_metric", _next, lambda df: E.dtw_path_metric(df, "value", "guess", "ts", ["user_id"], 10).select("user_id", "dtw_distance", F.size("path").alias("steps")))
_add("eval_confidence_metric", _events, lambda df: E.confidence_metric(df.where("t = 0"), df.where("t = 1").select("event_id", "value"), "value", 150.0))
_add("eval_normalize_score_metric", _events, lambda df: E.normalize_score_metric(df.where("t = 0"), df.where("t = 1").select("event_id", "value"), "value"), f"{E_SQL}, s AS (SELECT min(value) AS lo, max(value) AS hi FROM b WHERE t = 0) SELECT event_id, round(value, 6) AS value, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS normalized FROM b, s WHERE t = 1")

# ---- features: scalars
_add("feat_square_feature", _items, lambda df: X.add_features(df, MATRIX[:2], "square_feature", keep=[]), "SELECT round(l_quantity * l_quantity, 6) AS l_quantity_square, round(l_extendedprice * l_extendedprice, 6) AS l_extendedprice_square FROM lineitem")
_add("feat_polynomial_feature", _items, lambda df: X.add_features(df, ["l_quantity", "l_tax"], "polynomial_feature", keep=[]), "SELECT " + ", ".join(f"round(pow({c}, {k}), 6) AS {c}_poly_{k}" for c in ("l_quantity", "l_tax") for k in (2, 3)) + " FROM lineitem")
_add("feat_column_median_feature", _items, lambda df: X.add_features(df, MATRIX, ("column_median_feature", {"output_column": "med"}), keep=[]), "SELECT round(list_median([l_quantity, l_extendedprice, l_discount, l_tax]), 6) AS med FROM lineitem")
for pad, sql in (("none", "SELECT event_id, round(r, 6) AS value_rolling_mean FROM w WHERE k >= 4"), ("edge", "SELECT event_id, round((s + (4 - n) * f) / 4, 6) AS value_rolling_mean FROM w"), ("constant", "SELECT event_id, round(s / 4, 6) AS value_rolling_mean FROM w")):
    _add(f"feat_rolling_mean_feature_{pad}", _events, lambda df, pad=pad: X.rolling_mean(df, "value", 4, order="ts", series=("user_id",), padding={"none": None, "constant": 0.0}.get(pad, pad)).select("event_id", "value_rolling_mean"), f"{E_SQL}, w AS (SELECT event_id, row_number() OVER o AS k, avg(value) OVER z AS r, sum(value) OVER z AS s, count(*) OVER z AS n, first_value(value) OVER (PARTITION BY user_id ORDER BY ts) AS f FROM b WINDOW o AS (PARTITION BY user_id ORDER BY ts), z AS (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING)) {sql}")
for pad in ("reflect", "ring"):
    src = "2 - k" if pad == "reflect" else "k - m"
    cond = "k BETWEEN 2 AND 4" if pad == "reflect" else "k > m - 3"
    _add(f"feat_rolling_mean_feature_{pad}", _events, lambda df, pad=pad: X.rolling_mean(df, "value", 4, order="ts", series=("user_id",), padding=pad).select("event_id", "value_rolling_mean"), f"{E_SQL}, o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM b), u AS (SELECT event_id, user_id, value, k FROM o UNION ALL SELECT NULL, user_id, value, {src} FROM o WHERE {cond}), w AS (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY k ROWS 3 PRECEDING) AS r FROM u) SELECT event_id, round(r, 6) AS value_rolling_mean FROM w WHERE event_id IS NOT NULL")
_add("feat_pca_feature", _items, lambda df: X.PcaFeature(MATRIX, 2).fit(df).transform(df).select("pca_0", "pca_1"))

# ---- features: cells
_rms = "sqrt(avg(v * v))"
for n, q in {
    "max": "max(v)", "min": "min(v)", "mean": "avg(v)", "std": "stddev_samp(v)", "sum": "sum(v)", "slope": "regr_slope(v, i)", "mean_square": "avg(v * v)", "variance": "var_samp(v)", "rms": _rms, "peak_peak": "max(v) - min(v)",
    "shape_factor": f"{_rms} / avg(abs(v))", "crest": f"max(abs(v)) / {_rms}", "impulse": "max(abs(v)) / avg(abs(v))", "clearance": "max(abs(v)) / pow(avg(sqrt(abs(v))), 2)", "skewness": "avg(pow(v - a, 3)) / pow(stddev_samp(v), 3)", "kurtosis": "avg(pow(v - a, 4)) / pow(stddev_samp(v), 4) - 3",
}.items():
    _add(f"feat_{n}_feature", _cells, lambda df, n=n: X.add_features(df, ["x"], f"{n}_feature", keep=["vec_id"]), f"{V_SQL} SELECT vec_id, round({q}, 6) AS x_{n} FROM m GROUP BY vec_id")
_add("feat_gini_index_feature", _cells, lambda df: X.add_features(df, ["x"], "gini_index_feature", keep=["vec_id"]), f"{V_SQL}, r AS (SELECT vec_id, abs(v) AS v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v)) AS k FROM e) SELECT vec_id, round(2 * sum(k * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS x_gini_index FROM r GROUP BY vec_id")
_add("feat_average_kurtosis_feature", _cells, lambda df: X.add_features(df, ["x"], ("average_kurtosis_feature", {"n_segments": 4}), keep=["vec_id"]), f"{V_SQL}, g AS (SELECT vec_id, i // 16 AS s, v, avg(v) OVER (PARTITION BY vec_id, i // 16) AS a FROM e), k AS (SELECT vec_id, s, avg(pow(v - a, 4)) / pow(stddev_samp(v), 4) - 3 AS k FROM g GROUP BY 1, 2) SELECT vec_id, round(avg(k), 6) AS x_average_kurtosis FROM k GROUP BY vec_id")


def _long(name: str, config: dict | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: X.add_features(df, ["x"], (f"{name}_feature", config or {}), keep=["vec_id"]).select("vec_id", F.posexplode(f"x_{name}").alias("i", "v"))


_as = "SELECT vec_id, i::INTEGER AS i, round({}, 6) AS v FROM {}"
_add("feat_abs_feature", _cells, _long("abs"), f"{V_SQL} {_as.format('abs(v)', 'e')}")
_add("feat_sqrt_feature", lambda s, d: _cells(s, d).withColumn("x", F.transform("x", F.abs)), _long("sqrt"), f"{V_SQL} {_as.format('sqrt(abs(v))', 'e')}")
_add("feat_diff_feature", _cells, _long("diff"), f"{V_SQL} {_as.format('v - lag(v, 1, v) OVER (PARTITION BY vec_id ORDER BY i)', 'e')}")
_add("feat_uni_feature", _cells, _long("uni"), f"{V_SQL} {_as.format('v / count(*) OVER (PARTITION BY vec_id)', 'e')}")
_add("feat_rfftfreq_feature", _cells, _long("rfftfreq", {"sample_rate": 100.0}), f"{V_SQL} {_as.format('i * 100.0::DOUBLE / 64', 'e')} WHERE i <= 32")
_add("feat_fftfreq_feature", _cells, _long("fftfreq", {"sample_rate": 100.0}), f"{V_SQL} {_as.format('CASE WHEN i < 32 THEN i ELSE i - 64 END * 100.0::DOUBLE / 64', 'e')}")
_cw = f"{V_SQL}, w AS (SELECT a.vec_id, a.i, k.k, b.v FROM e a, (SELECT unnest(range(0, 5)) AS k) k JOIN e b ON true WHERE b.vec_id = a.vec_id AND b.i = (a.i + k.k - 4 + 64) % 64), c AS (SELECT vec_id, i, avg(v) AS mean, min(v) AS min, max(v) AS max, stddev_samp(v) AS std, regr_slope(v, k) AS slope, (5 * sum(v * v) + pow(sum(v), 2)) / 2 AS fft_energy FROM w GROUP BY 1, 2)"
for n in ("mean", "min", "max", "std", "slope", "fft_energy"):
    _add(f"feat_smooth_{n}_feature", _cells, _long(f"smooth_{n}", {"win": 5}), f"{_cw} {_as.format(n, 'c')}")
_gr = "(coalesce(lead({0}) OVER o, {0}) - coalesce(lag({0}) OVER o, {0})) / CASE WHEN i IN (0, 63) THEN 1 ELSE 2 END"
for n in ("mean", "std"):
    _add(f"feat_smooth_grad_{n}_feature", _cells, _long(f"smooth_grad_{n}", {"win": 5}), f"{_cw} {_as.format(_gr.format(n), 'c')} WINDOW o AS (PARTITION BY vec_id ORDER BY i)")
_add("feat_smooth_grad2_mean_feature", _cells, _long("smooth_grad2_mean", {"win": 5}), f"{_cw} {_as.format('coalesce(lag(mean) OVER o, lead(mean) OVER o) - 2 * mean + coalesce(lead(mean) OVER o, lag(mean) OVER o)', 'c')} WINDOW o AS (PARTITION BY vec_id ORDER BY i)")
_add("feat_specific_loudness_feature", lambda s, d: _cells(s, d).withColumn("x", F.transform(F.slice("x", 1, 24), F.abs)), _long("specific_loudness"), f"{V_SQL}, q AS (SELECT unnest([44,32,25,19,14,11,8,6,5,5,5,5,5,5,5,5,5,5,5,5,5,5,5,5]) AS q, unnest(range(0, 24)) AS i), l AS (SELECT vec_id, e.i, 10 * log10(greatest(abs(v), 1e-20::DOUBLE) / 1e-12::DOUBLE) - q AS d FROM e JOIN q USING (i)) {_as.format('CASE WHEN d > 0 THEN 0.08 * pow(pow(10, d / 10), 0.23) ELSE 0 END', 'l')}")
# spectra: scalars against discrete Fourier sums where SQL is short, else rows only
_pw = f"{V_SQL}, k AS (SELECT unnest(range(0, 33)) AS k), s AS (SELECT vec_id, k, pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2) AS p, k * 100.0::DOUBLE / 64 AS f FROM e, k GROUP BY 1, 2)"
_add("feat_rfft_feature", _cells, _long("rfft"), f"{_pw} SELECT vec_id, k::INTEGER AS i, round(sqrt(p), 6) AS v FROM s")
_add("feat_fft_feature", _cells, _long("fft"), f"{_pw} SELECT vec_id, k::INTEGER AS i, round(sqrt(p), 6) AS v FROM s UNION ALL SELECT vec_id, (64 - k)::INTEGER, round(sqrt(p), 6) FROM s WHERE k BETWEEN 1 AND 31")
_fs = {"sample_rate": 100.0}
_cen = "sum(f * p) / sum(p)"
_var = "sum(f * f * p) / sum(p) - pow(sum(f * p) / sum(p), 2)"
for n, q in {"spectral_centroid": _cen, "mean_square_frequency": "sum(f * f * p) / sum(p)", "rms_frequency": "sqrt(sum(f * f * p) / sum(p))", "frequency_variance": _var, "frequency_std": f"sqrt({_var})"}.items():
    _add(f"feat_{n}_feature", _cells, lambda df, n=n: X.add_features(df, ["x"], (f"{n}_feature", _fs), keep=["vec_id"]), f"{_pw} SELECT vec_id, round({q}, 6) AS x_{n} FROM s GROUP BY vec_id")
for n, cfg in {"ehr": {}, "spectral_entropy": {}, "roughness": _fs, "sharpness": _fs, "envelope_rms": {}, "hnr": {}, "band_kurtosis": _fs | {"high": 20.0}, "band_rms": _fs | {"high": 20.0}, "band_hnr": _fs | {"high": 20.0}, "speed_rpm": _fs | {"speed_min": 60.0, "speed_max": 1200.0}}.items():
    _add(f"feat_{n}_feature", _cells, lambda df, n=n, cfg=cfg: X.add_features(df, ["x"], (f"{n}_feature", cfg), keep=["vec_id"]))
for n, cfg in {"envelope": {}, "hps": {}, "bark_spectrum": _fs}.items():
    _add(f"feat_{n}_feature", _cells, _long(n, cfg))

# ---- detection
_st = "s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(MATRIX)) + " FROM lineitem)"
_z = "greatest(" + ", ".join(f"abs(({c} - m{i}) / d{i})" for i, c in enumerate(MATRIX)) + ")"
_add("det_mean_predictor", _items, lambda df: D.MeanPredictor(MATRIX).fit(df).transform(df), "SELECT " + ", ".join(f"round(avg({c}) OVER (), 6) AS {c}" for c in MATRIX) + " FROM lineitem")
_add("det_zscore_scorer", _items, lambda df: D.ZScoreScorer(MATRIX).fit(df).transform(df).select("score"), f"WITH {_st} SELECT round({_z}, 6) AS score FROM lineitem, s")
_add("det_zscore_detector", _events, lambda df: D.detector("zscore", ["value"]).fit_transform(df).select("event_id", "score", "label"), "SELECT event_id, round(abs((value - m) / d), 6) AS score, CAST(abs((value - m) / d) > 3 AS INTEGER) AS label FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events)")
_add("det_residual_scorer", _pairs, lambda df: D.residual_score(df, ["y"], ["p"]).select("score"), f"{P_SQL} SELECT round((y - p) * (y - p), 6) AS score FROM b")
_add("det_residual_map_scorer", _pairs, lambda df: D.residual_map(df, ["y", "p"], ["p", "y"], "mae").select("y_residual", "p_residual"), f"{P_SQL} SELECT round(abs(y - p), 6) AS y_residual, round(abs(p - y), 6) AS p_residual FROM b")
for m, q in {"arithmetic": "(y + 3 * p) / 4", "geometric": "exp((ln(y) + 3 * ln(p)) / 4)", "harmonic": "1 / ((1 / y + 3 / p) / 4)", "quadratic": "sqrt((y * y + 3 * p * p) / 4)"}.items():
    _add(f"det_mean_merge_scorer_{m}", _pairs, lambda df, m=m: D.mean_merge(df, ["y", "p"], m, [1, 3]).select("score"), f"{P_SQL} SELECT round({q}, 6) AS score FROM b")
_zz = "s AS (SELECT avg(y) AS my, stddev_pop(y) AS dy, avg(p) AS mp, stddev_pop(p) AS dp FROM b)"
_add("det_dist_merge_scorer", _pairs, lambda df: D.DistMergeScorer(["y", "p"], weights=[1, 3]).fit(df).transform(df).select("score"), f"{P_SQL}, {_zz} SELECT round((0.25 * (y - my) / dy + 0.75 * (p - mp) / dp) / sqrt(0.0625 + 0.5625), 6) AS score FROM b, s")
_add("det_dist_direct_merge_scorer", _pairs, lambda df: D.DistDirectMergeScorer(["y", "p"]).transform(df).select("score"), f"{P_SQL}, {_zz} SELECT round(((y - my) / dy + (p - mp) / dp) / sqrt(2), 6) AS score FROM b, s")
_add("det_threshold_decider", _events, lambda df: D.ThresholdDecider(["value"], threshold=100.0).transform(df).select("event_id", "label"), "SELECT event_id, CAST(value > 100 AS INTEGER) AS label FROM events")
_add("det_percentile_decider", _events, lambda df: D.PercentileDecider(["value"]).fit(df).transform(df).select("event_id", "label"), "SELECT event_id, CAST(value > (SELECT quantile_cont(value, 0.95) FROM events) AS INTEGER) AS label FROM events")
_knn = f"{S_SQL}, d AS (SELECT a.s_suppkey, sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + (a.nat - b.nat) * (a.nat - b.nat)) AS d FROM b a, b b), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d) AS r FROM d), k AS (SELECT s_suppkey, max(d) AS score FROM r WHERE r <= 5 GROUP BY 1)"
_F2 = ["s_acctbal", "nat"]
_add("det_knn_scorer", _parts, lambda df: D.SCORERS["knn"](_F2).fit(df).transform(df).select("s_suppkey", "score"), f"{_knn} SELECT s_suppkey, round(score, 6) AS score FROM k")
_add("det_knn_detector", _parts, lambda df: D.detector("knn", _F2).fit_transform(df).select("s_suppkey", "score", "label"), f"{_knn} SELECT s_suppkey, round(score, 6) AS score, CAST(score > (SELECT quantile_cont(score, 0.95) FROM k) AS INTEGER) AS label FROM k")
_kde = f"{S_SQL}, n AS (SELECT count(*) AS n FROM b), k AS (SELECT a.s_suppkey, -ln(sum(exp(-0.5 * ((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + (a.nat - b.nat) * (a.nat - b.nat)) / 250000)) / any_value(n) / (250000 * 2 * pi())) AS score FROM b a, b b, n GROUP BY 1)"
_add("det_kde_scorer", _parts, lambda df: D.SCORERS["kde"](_F2, bandwidth=500.0).fit(df).transform(df).select("s_suppkey", "score"), f"{_kde} SELECT s_suppkey, round(score, 6) AS score FROM k")
_add("det_kde_detector", _parts, lambda df: D.detector("kde", _F2, bandwidth=500.0).fit_transform(df).select("s_suppkey", "score", "label"), f"{_kde} SELECT s_suppkey, round(score, 6) AS score, CAST(score > (SELECT quantile_cont(score, 0.95) FROM k) AS INTEGER) AS label FROM k")
_tails = "{}, t AS (SELECT *, " + ", ".join(f"-ln(cume_dist() OVER (ORDER BY {c})) AS l{i}, -ln(cume_dist() OVER (ORDER BY {c} DESC)) AS r{i}" for i, c in enumerate(_F2)) + " FROM b), k AS (SELECT " + ", ".join(f"avg(pow({c} - (SELECT avg({c}) FROM b), 3)) AS k{i}" for i, c in enumerate(_F2)) + " FROM b), x AS (SELECT s_suppkey, {} AS score FROM t, k)"
_sk = [f"CASE WHEN k{i} < 0 THEN l{i} ELSE r{i} END" for i in range(2)]
_ecod = _tails.format(S_SQL, f"greatest(l0 + l1, r0 + r1, {' + '.join(_sk)})")
_copod = _tails.format(S_SQL, " + ".join(f"greatest({s}, (l{i} + r{i}) / 2)" for i, s in enumerate(_sk)))
_hbos = f"{S_SQL}, s AS (SELECT " + ", ".join(f"min({c}) AS lo{i}, (max({c}) - min({c})) / 10 AS w{i}" for i, c in enumerate(_F2)) + ", count(*) AS n FROM b), g AS (SELECT s_suppkey, " + ", ".join(f"least(floor(({c} - lo{i}) / w{i}), 9) AS b{i}, w{i}" for i, c in enumerate(_F2)) + ", n FROM b, s), x AS (SELECT s_suppkey, " + " + ".join(f"-log2(count(*) OVER (PARTITION BY b{i}) / n / w{i} + 0.1)" for i in range(2)) + " AS score FROM g)"
for n, sql in (("ecod", _ecod), ("copod", _copod), ("hbos", _hbos)):
    _add(f"det_{n}_scorer", _parts, lambda df, n=n: D.SCORERS[n](_F2).fit(df).transform(df).select("s_suppkey", "score"), f"{sql} SELECT s_suppkey, round(score, 6) AS score FROM x")
    _add(f"det_{n}_detector", _parts, lambda df, n=n: D.detector(n, _F2).fit_transform(df).select("s_suppkey", "label"), f"{sql} SELECT s_suppkey, CAST(score > (SELECT quantile_cont(score, 0.95) FROM x) AS INTEGER) AS label FROM x")
for n in ("lof", "abod", "cof", "sod", "cblof", "inne", "loda", "iforest", "eif", "ocsvm", "gmm", "mcd", "sos", "rod", "pca"):
    cfg = {"pca": {"n_components": 1}}.get(n, {})
    _add(f"det_{n}_scorer", _parts, lambda df, n=n, cfg=cfg: (lambda s: s.fit_transform(df))(D.SCORERS[n](_F2, **cfg)).select("s_suppkey", "score"))
    _add(f"det_{n}_detector", _parts, lambda df, n=n, cfg=cfg: D.detector(n, _F2, **cfg).fit_transform(df).select("s_suppkey", "score", "label"))
_add("det_pca_predictor", _items, lambda df: D.PcaPredictor(MATRIX, n_components=2).fit(df).transform(df))
_echo = lambda x: x * 0.5
_add("det_plugin_reconstruction_predictor", _events, lambda df: D.PluginPredictor(["value"], model=_echo).fit(df).transform(df).select("event_id", "value"), "SELECT event_id, round(value * 0.5, 6) AS value FROM events")
_add("det_plugin_reconstruction_scorer", _events, lambda df: D.PluginScorer(["value"], model=_echo).fit(df).transform(df).select("event_id", "score"), "SELECT event_id, round(value * value * 0.25, 6) AS score FROM events")
_add("det_zero_shot_predictor", _events, lambda df: D.PluginPredictor(["value"], model=_echo, series=("user_id",), order="ts", win_size=1).fit(df).transform(df).select("event_id", "value"), "SELECT event_id, round(value * 0.5, 6) AS value FROM events")
_add("det_zero_shot_scorer", _events, lambda df: D.PluginScorer(["value"], model=_echo, series=("user_id",), order="ts").fit(df).transform(df).select("event_id", "score"), "SELECT event_id, round(value * value * 0.25, 6) AS score FROM events")
_add("det_windowed_overlap_merge_scorer", _events, lambda df: D.WindowedPluginScorer(["value"], model=lambda w: w[:, :, 0], length=8, order="ts", series=("user_id",), score_merge="mean").fit(df).transform(df).withColumn("i", F.col("i").cast("long")), f"{E_SQL}, o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM b) SELECT user_id, i, round(value, 6) AS score FROM o WHERE n >= 8")
_add("det_composite_scorer", _items, lambda df: D.CompositeScorer(D.MeanPredictor(MATRIX[2:]), "mse").fit_transform(df).select("score"), f"WITH {_st} SELECT round((" + " + ".join(f"({c} - m{i}) * ({c} - m{i})" for i, c in enumerate(MATRIX) if i >= 2) + ") / 2, 6) AS score FROM lineitem, s")
_add("det_composite_detector", _items, lambda df: D.CompositeDetector(D.ZScoreScorer(MATRIX), D.PercentileDecider()).fit_transform(df).groupBy("label").count(), f"WITH {_st}, z AS (SELECT {_z} AS score FROM lineitem, s) SELECT CAST(score > (SELECT quantile_cont(score, 0.95) FROM z) AS INTEGER) AS label, count(*) AS count FROM z GROUP BY 1")

# ---- selection
_add("sel_column_selector", _items, lambda df: S.column_selector(df, ["l_tax", 0])[0], "SELECT round(l_tax, 6) AS l_tax, round(l_quantity, 6) AS l_quantity FROM lineitem")
_add("sel_variance_threshold_selector", _items, lambda df: S.variance_threshold_selector(df, MATRIX, 0.01)[0], "SELECT round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem")


def _flagged(s, d):
    return _read(s, d, "lineitem").select(*MATRIX, (F.col("l_quantity") > 25).cast("int").alias("label"))


_ks = "WITH b AS (SELECT *, CAST(l_quantity > 25 AS INTEGER) AS y FROM lineitem), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, y FROM b" for c in MATRIX) + "), a AS (SELECT feature, v, sum(y) AS p, count(*) AS n FROM v GROUP BY 1, 2), g AS (SELECT feature, abs(sum(p) OVER (PARTITION BY feature ORDER BY v) / sum(p) OVER (PARTITION BY feature) - sum(n - p) OVER (PARTITION BY feature ORDER BY v) / sum(n - p) OVER (PARTITION BY feature)) AS g FROM a) SELECT feature, round(max(g), 6) AS ks FROM g GROUP BY 1"
_add("sel_sis_filter_ks", _flagged, lambda df: S.ks_table(df, MATRIX, "label"), _ks)
_names = lambda df, xs: df.sparkSession.createDataFrame([(i, *((x,) if isinstance(x, str) else x)) for i, x in enumerate(xs)], "rank int, feature string" + (", value double" if xs and not isinstance(xs[0], str) else ""))
_add("sel_sis_filter", _flagged, lambda df: _names(df, S.sis_filter(df, MATRIX, "label")))
_add("sel_cwdm_selector", _flagged, lambda df: _names(df, S.cwdm_selector(df, MATRIX, "label", 3)))
_add("sel_data_loader", _flagged, lambda df: S.load_labelled(df), "SELECT round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, CAST(l_quantity > 25 AS INTEGER) AS label FROM lineitem")


def _small_flagged(s, d):
    return _read(s, d, "part").select("p_size", F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 7).cast("double").alias("k"), (F.col("p_size") > 25).cast("int").alias("label"))


_F3 = ["p_size", "price", "k"]
_add("sel_cwdw_sage", _small_flagged, lambda df: _names(df, S.cwdw_sage(df, _F3, "label", 2, model="LR")))
_add("sel_sage_evaluator", _small_flagged, lambda df: _names(df, S.sage_ranking(df, _F3, "label", S.train_proxy(df, _F3, "label", "LR"), rounds=2)))
_add("sel_convergence_finder", _small_flagged, lambda df: _names(df, _F3[: S.convergence_finder(df, _F3, "label", step=1, window=2)]))
_add("sel_classification_trainer", _small_flagged, lambda df: S.train_proxy(df, _F3, "label", "RF").transform(df).groupBy("label", "prediction").count())
_add("sel_regression_trainer", _small_flagged, lambda df: S.train_proxy(df, ["p_size", "k"], "price", "GBT", "regression").transform(df).agg(F.count("prediction").alias("n")))

# ---- forecasting
_by = ("ts", ("user_id",))
_add("fc_ridge_forecaster", _events, lambda df: C.RidgeForecaster("value", seq_len=8, horizon=2).fit(df, *_by).transform(df, *_by).select("event_id", "forecast_0"))
for n, f in C.FORECASTERS.items():
    if "boost" in n or "gbm" in n:
        _add(f"fc_{n}", _events, lambda df, f=f: f("value", seq_len=6, pred_len=2, n_estimators=3).fit(df, *_by).transform(df, *_by).select("event_id", "forecast_0", "forecast_1"))
_add("fc_plugin_forecaster", _events, lambda df: C.PluginForecaster("value", seq_len=8, pred_len=1, model=lambda x: x[:, :1, 0] * 0).fit(df, *_by).transform(df, *_by).select("user_id", "forecast_0"), f"{E_SQL}, o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b) SELECT user_id, round(value, 6) AS forecast_0 FROM o WHERE k >= 8")
_add("fc_window_builder", _events, lambda df: T.window_arrays(df, ["value"], "ts", 4, ["user_id"], 2, "value").select("event_id", F.aggregate("value_window", F.lit(0.0), lambda a, b: a + b).alias("w"), F.aggregate("value_future", F.lit(0.0), lambda a, b: a + b).alias("f")), f"{E_SQL}, o AS (SELECT event_id, row_number() OVER z AS k, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING) AS w, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS f, lead(value, 2) OVER z AS l FROM b WINDOW z AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(w, 6) AS w, round(f, 6) AS f FROM o WHERE k >= 4 AND l IS NOT NULL")

# ---- series and tuning
_add("prep_gap_chunks", _events, lambda df: T.gap_chunks(df, "ts", 86400.0, ["user_id"]).select("event_id", "chunk_id"), f"{E_SQL}, g AS (SELECT event_id, user_id, ts, CAST(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400000000, false) AS INTEGER) AS g FROM b) SELECT event_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS chunk_id FROM g")
_holes = lambda s, d: _events(s, d).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
_add("prep_impute_linear", _holes, lambda df: T.impute_linear(df, ["value"], "ts", ["user_id"], zero_is_missing=False).select("event_id", "value"), f"{E_SQL}, h AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM b), n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i DESC) AS z FROM h) SELECT n.event_id, round(coalesce(p.v + (q.v - p.v) * (n.i - n.a) / nullif(n.z - n.a, 0), p.v, q.v, 0), 6) AS value FROM n LEFT JOIN h p ON p.user_id = n.user_id AND p.i = n.a LEFT JOIN h q ON q.user_id = n.user_id AND q.i = n.z")
_add("prep_double_ema", _events, lambda df: T.double_ema(df, ["value"], "ts", ["user_id"]).select("event_id", "value"))
_add("prep_window_starts", _events, lambda df: T.window_starts(df, "ts", 10, ["user_id"]).select("event_id"), f"{E_SQL} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM b) WHERE k >= 10")
_add("prep_temporal_split", _events, lambda df: T.temporal_split(df, "ts", (0.7, 0.15), ["user_id"]).select("event_id", "split"), f"{E_SQL}, o AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM b) SELECT event_id, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o")
_add("prep_minmax_scale", _items, lambda df: T.scale(df, MATRIX[:1], "minmax").select("l_quantity"), "SELECT round((l_quantity - lo) / (hi - lo), 6) AS l_quantity FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)")
_add("prep_zscore_scale", _items, lambda df: T.scale(df, MATRIX[:1]).select("l_quantity"), "SELECT round((l_quantity - m) / d, 6) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem)")


def _tuned(df: DataFrame) -> DataFrame:
    out = tuning.search(lambda c: D.CompositeDetector(D.ZScoreScorer(["value"]), D.PercentileDecider(**c)), lambda o: E.fbeta_metric(o, "t", "label").first()[0], df, {"percentile": (50.0, 99.0)}, key=["event_id"], n_trials=3, k=2)
    return df.sparkSession.createDataFrame([(float(out.best_params["percentile"]), float(out.best_score))], "percentile double, score double")


_add("tune_search", _events, _tuned)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores of lineitem's numbers, cut at their 95th percentile, by return flag."""
    df = _read(spark, sf_dir, "lineitem").select("l_returnflag", *MATRIX)
    out = D.CompositeDetector(D.ZScoreScorer(MATRIX), D.PercentileDecider()).fit_transform(df)
    return out.groupBy("l_returnflag").agg(F.sum("label").alias("n_outliers"), F.round(F.max("score"), 6).alias("max_score"))


QUERIES["flagship_zscore_outliers"] = flagship
ORACLE["flagship_zscore_outliers"] = f"WITH {_st}, z AS (SELECT l_returnflag, {_z} AS score FROM lineitem, s) SELECT l_returnflag, count(*) FILTER (score > (SELECT quantile_cont(score, 0.95) FROM z)) AS n_outliers, round(max(score), 6) AS max_score FROM z GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
