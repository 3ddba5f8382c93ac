"""Queries with SQL against DuckDB on the smallest tables, and hand-checked cases."""

import math
import os

import duckdb
import numpy as np
import pytest

from loomstat.operators import detection as D
from loomstat.operators import evaluation as E
from loomstat.operators import event_kernels as K
from loomstat.operators import features as X
from loomstat.operators import series as T
from loomstat.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{data}/{t}'")
    return c


def _norm(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, data, con, name):
    df = catalog.QUERIES[name](spark, data)
    r = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    got = sorted((tuple(_norm(x[c]) for c in cols) for x in df.collect()), key=str)
    want = sorted((tuple(_norm(dict(zip(names, x, strict=True))[c]) for c in cols) for x in r.fetchall()), key=str)
    assert got == want


def test_hand_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "a double, b double, c double")
    assert [r["score"] for r in D.mean_merge(df, ["a", "b", "c"]).collect()] == pytest.approx([2.0, 5.0])
    assert [r["a_square"] for r in X.add_features(df, ["a"], "square_feature").collect()] == [1.0, 16.0]
    with pytest.raises(RuntimeError):
        D.ZScoreScorer(["a"]).transform(df)
    with pytest.raises(ValueError):
        D.CompositeScorer(D.MeanPredictor(["a"]))
    rows = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip([0, 1, 1, 1, 0, 0, 0], [0, 0, 1, 0, 0, 0, 0], strict=True))], "i int, t int, p int")
    r = E.point_adjust(rows, "t", "p", "i").first()
    assert (r["tp"], r["fn"], r["segments"]) == (1, 0, 1)


def test_impute(spark):
    nan = float("nan")
    rows = [(0, "a", 0.0), (1, "a", 2.0), (2, "a", None), (3, "a", 0.0), (4, "a", 8.0), (5, "a", nan), (0, "b", None), (1, "b", 0.0)]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    got = lambda **k: [r["x"] for r in T.impute_linear(df, ["x"], "i", ["s"], **k).orderBy("s", "i").collect()]
    assert got() == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0, 0.0, 0.0]
    assert got(zero_is_missing=False) == [0.0, 2.0, 1.0, 0.0, 8.0, 8.0, 0.0, 0.0]


def test_event_kernels():
    y = np.array([0, 1, 1, 1, 0, 0, 0])
    assert K.affiliation(y, y) == pytest.approx((1, 1, 1))
    assert K.affiliation(np.zeros(3), np.array([0, 1, 0])) == (0.0, 0.0, 0.0)
    assert K.event_f1(np.array([0, 0, 1, 1, 1, 0, 0]), np.array([0, 1, 0, 0, 0, 1, 1]))[:3] == (0, 2, 1)
    assert K.dtw(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3]), path=True)[0] == 0
    assert K.nab(np.array([]), np.array([])) == (0.0, 0.0)
    for n, k in ((1, 0), (10, 3), (60, 54), (400, 360)):
        p = np.concatenate((np.arange(1, n + 2) / (n + 2), [0.0, 1.0, 1e-9]))
        want = [sum(math.comb(n, i) * x**i * (1 - x) ** (n - i) for i in range(k + 1, n + 1)) for x in p]
        assert np.allclose(K.binomial_tail(k, n, p), want, rtol=1e-9, atol=1e-13)
    assert K.binomial_tail(10, 10, np.array([0.3])).tolist() == [0.0]
    big = K.binomial_tail(9_000_000, 10_000_000, np.array([0.8, 0.9, 0.95]))
    assert big[0] == 0 and abs(big[1] - 0.5) < 1e-3 and big[2] == 1
