"""Running sums, ranks and percentiles over ranges against NumPy, with many ranges on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import evaluation as E
from loomstat.operators import ordered as O


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 50)
    monkeypatch.setattr(O, "DIRECT", 40)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(1500) < 0.33, 2.5, rng.normal(0, 3, 1500).round(2))  # a third of the rows share one value
    return spark.createDataFrame([(i, i % 3, float(v), int(rng.random() < 0.3)) for i, v in enumerate(x)], "id long, s int, x double, y int")


def test_running_sums(many_ranges, table):
    at = table.groupBy("s", "x").agg(F.count("x").alias("c"))
    assert len(O.boundaries(table, "x")) > 5
    out = O.running_sums(at, "x", ["c"], ["s"]).toPandas()
    for s, g in table.toPandas().groupby("s"):
        own = out[out["s"] == s]
        assert all(r.c_upto == (g["x"] <= r.x).sum() and r.c_all == len(g) for r in own.itertuples()) and len(own) == g["x"].nunique()
    whole = O.running_sums(table.groupBy("x").agg(F.count("x").alias("c")), "x", ["c"]).toPandas()
    x = table.toPandas()["x"]
    assert all(r.c_upto == (x <= r.x).sum() for r in whole.itertuples())


def test_ranks(many_ranges, spark, table):
    x = table.toPandas()["x"].to_numpy()
    ask = spark.createDataFrame([(v,) for v in (-100.0, 2.5, 2.51, 100.0, 0.0, None)], "x double")
    got = {r["x"]: (r["le"], r["lt"]) for r in O.ranks(table.groupBy("x").agg(F.count("x").alias("c")), ask, "x").collect()}
    assert all(got[v] == ((x <= v).sum(), (x < v).sum()) for v in (-100.0, 2.5, 2.51, 100.0, 0.0)) and None not in got


@pytest.mark.parametrize("q", [0.0, 0.013, 0.5, 0.6, 0.95, 1.0])
def test_percentile(many_ranges, table, q):
    assert O.exact_percentile(table, "x", q) == pytest.approx(np.percentile(table.toPandas()["x"], 100 * q), abs=1e-12)


def test_percentile_edges(many_ranges, spark):
    empty = spark.createDataFrame([], "x double")
    assert O.exact_percentile(empty, "x", 0.5) is None
    same = spark.createDataFrame([(1.5,)] * 200 + [(None,)], "x double")
    assert O.exact_percentile(same, "x", 0.5) == 1.5


def test_rankings(many_ranges, table):
    p = table.toPandas().sort_values(["x", "id"], ascending=[False, True])
    y = p["y"].to_numpy()
    prec = np.cumsum(y) / np.arange(1, len(y) + 1)
    assert E.average_precision_metric(table, "y", "x", ["id"]).first()[0] == pytest.approx(prec[y == 1].mean())
    two = table.withColumn("k", F.col("id").cast("string"))
    q = table.toPandas().assign(k=lambda d: d["id"].astype(str)).sort_values(["x", "k"], ascending=[False, True])["y"].to_numpy()
    assert E.average_precision_metric(two, "y", "x", ["k"]).first()[0] == pytest.approx((np.cumsum(q) / np.arange(1, len(q) + 1))[q == 1].mean())
    x = table.toPandas()
    pos, neg = x[x["y"] == 1]["x"].to_numpy(), x[x["y"] == 0]["x"].to_numpy()
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert E.roc_auc_metric(table, "y", "x").first()[0] == pytest.approx(auc)
    curve = E.binary_classification_curve(table, "y", "x").toPandas().sort_values("i")
    assert curve["i"].tolist() == list(range(1, x["x"].nunique() + 2)) and all(r.tp == (pos > r.threshold).sum() and r.fp == (neg > r.threshold).sum() for r in curve.itertuples())


def test_confidence(many_ranges, table):
    from math import comb

    train, test = table.where("id < 60"), table.where("id >= 1400")
    t = np.array([r["x"] for r in train.collect()])
    n, k = 60, 54
    out = E.confidence_metric(train, test, "x", 2.0).collect()
    assert len(out) == 100
    for r in out:
        p = (1 + (t <= r["x"]).sum()) / (n + 2)
        c = 1 - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert r["confidence"] == pytest.approx(1 - c if r["x"] > 2 else c, abs=1e-9)
