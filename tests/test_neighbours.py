"""Neighbour models in blocks against the same models in memory; screening statistics against NumPy."""

import math

import numpy as np
import pytest

from loomstat.operators import detection as D
from loomstat.operators import detector_kernels as N
from loomstat.operators import neighbours as B
from loomstat.operators import selection as S


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, (240, 2)).round(1)  # ties
    x[::3] = (0.5, -0.5)  # a third of the rows share one vector
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").cache()


CASES = [("knn", {}), ("knn", {"score_method": "median", "n_neighbors": 4, "distance_metric": "manhattan"}), ("knn", {"score_method": "mean"}), ("kde", {"bandwidth": 0.7}), ("lof", {"n_neighbors": 7}), ("abod", {}), ("cof", {"n_neighbors": 6})]


@pytest.mark.parametrize("name, config", CASES, ids=[f"{n}{i}" for i, (n, _) in enumerate(CASES)])
def test_blocks(monkeypatch, points, name, config):
    new = points.where("id >= 200").unionByName(points.where("id < 4").selectExpr("id + 1000 AS id", "a + 0.25 AS a", "b"))
    train = points.where("id < 200")
    want = {r["id"]: r["score"] for r in D.SCORERS[name](["a", "b"], **config).fit(train).transform(new).collect()}
    monkeypatch.setattr(D.ModelScorer, "max_train", 50)
    monkeypatch.setattr(B, "BLOCK", 40)
    monkeypatch.setattr(B, "AT_ONCE", 16)
    out = D.SCORERS[name](["a", "b"], **config).fit(train).transform(new)
    assert out.columns == ["id", "a", "b", "score"]
    got = {r["id"]: r["score"] for r in out.collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-12) for i in want)


@pytest.mark.parametrize("config", [{}, {"n_neighbors": 9, "ref_set": 4, "alpha": 0.95}, {"n_neighbors": 90, "ref_set": 60}])
def test_blocks_sod(monkeypatch, points, config):
    test_blocks(monkeypatch, points, "sod", config)
    model = D.SCORERS["sod"](["a", "b"], **config).fit(points)
    assert "x" not in model.state  # no training rows on the driver


def test_nearest_in_parts(monkeypatch):
    x = np.random.default_rng(3).normal(size=(70, 2)).round(1)
    want = N.nearest(x, x, 9, skip_self=True)
    seen, whole = [], N.distances
    monkeypatch.setattr(N, "AT_ONCE", 700)
    monkeypatch.setattr(N, "distances", lambda a, b, metric="euclidean": seen.append(len(a) * len(b)) or whole(a, b, metric))
    got = N.nearest(x, x, 9, skip_self=True)
    assert max(seen) <= 700 and all((a == b).all() for a, b in zip(got, want, strict=True))


def _sos(x, perplexity=4.5, eps=1e-5):
    """Row by row with the whole matrix."""
    n, d = len(x), N.distances(x, x)
    b = np.zeros((n, n))
    for i in range(n):
        e = np.delete(d[i], i)
        e, lo, hi, beta = e - e.min(), 0.0, math.inf, 1.0
        for _ in range(900):
            a = np.exp(-e * beta)
            entropy = math.log(a.sum()) + beta * (e * a).sum() / a.sum()
            if abs(entropy - math.log(perplexity)) <= eps:
                break
            lo, hi = (beta, hi) if entropy > math.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == math.inf else (lo + hi) / 2
        b[i, np.arange(n) != i] = a / a.sum()
    return np.prod(1 - b, axis=0)


def test_sos(spark, points, monkeypatch):
    x = np.array([(r["a"], r["b"]) for r in points.orderBy("id").collect()])
    want = _sos(x)
    assert np.isfinite(want).all() and N.sos_score(x) == pytest.approx(want, rel=1e-9, abs=1e-12)
    monkeypatch.setattr(B, "BLOCK", 40)
    out = D.SCORERS["sos"](["a", "b"]).fit_transform(points.unionByName(spark.createDataFrame([(500, None, 1.0), (501, math.inf, 1.0)], points.schema)))
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got.pop(500) is None and got.pop(501) is None
    assert [got[i] for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-12)
    for n in (0, 1, 3):
        few = D.SCORERS["sos"](["a", "b"]).fit_transform(points.where(f"id between 1 and {n}"))
        assert [r["score"] for r in few.collect()] == pytest.approx(_sos(x[1 : n + 1]).tolist() if n > 1 else [0.0] * n, abs=1e-6)


def test_blocks_nulls(monkeypatch, spark, points):
    monkeypatch.setattr(D.ModelScorer, "max_train", 50)
    model = D.SCORERS["knn"](["a", "b"]).fit(points.unionByName(spark.createDataFrame([(500, None, 1.0)], points.schema)))
    odd = spark.createDataFrame([(1, None, 1.0), (2, 0.5, -0.5)], points.schema)
    assert {r["id"]: r["score"] for r in model.transform(odd).collect()} == {1: None, 2: 0.0}
    assert model.transform(odd.limit(0)).count() == 0


def _distance_correlation(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    v = np.sqrt((a * a).mean() * (b * b).mean())
    return np.sqrt(max((a * b).mean(), 0) / v) if v > 0 else 0.0


def _mean_variance(x, y):
    f = lambda s: np.searchsorted(np.sort(s), x, "right") / len(s)
    return sum((y == c).mean() * ((f(x[y == c]) - f(x)) ** 2).mean() for c in np.unique(y))


@pytest.mark.parametrize("labels", [(0, 1), (1, 2)])
def test_screening(spark, labels):
    rng = np.random.default_rng(6)
    y = rng.random(400) < 0.3
    x = np.stack([rng.normal(size=400).round(1) + y, 1000 + rng.normal(size=400), np.where(rng.random(400) < 0.5, 3.0, rng.normal(size=400)), np.full(400, 2.0)], 1)
    df = spark.createDataFrame([(*map(float, r), labels[int(k)]) for r, k in zip(x, y, strict=True)], "a double, b double, c double, d double, y int")
    got = {r["feature"]: r for r in S.screening_table(df, ["a", "b", "c", "d"], "y").collect()}
    for i, c in enumerate("abcd"):
        assert got[c]["dcor"] == pytest.approx(_distance_correlation(x[:, i], y.astype(float)), abs=1e-6)
        assert got[c]["mv"] == pytest.approx(_mean_variance(x[:, i], y), abs=1e-9)
        assert got[c]["ks"] == pytest.approx(max(abs((x[y][:, i] <= v).mean() - (x[~y][:, i] <= v).mean()) for v in x[:, i]), abs=1e-9)
    assert S.sis_filter(df, ["a", "b", "c", "d"], "y", 0.3) == ["a"]
