"""NumPy models of the detectors: MODELS {name: (fit, score, defaults)}, TRANSDUCTIVE {name: (score, defaults)}.

Written from the published descriptions of the methods; parameters keep their usual names and defaults.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "manhattan":
        return np.abs(a[:, None] - b[None]).sum(2)
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) if a.shape[1] <= 8 else np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


#: Distances held at once.
AT_ONCE = 1 << 22


def nearest(a, b, k, metric="euclidean", skip_self=False):
    """(distances, indices) of the k nearest rows of b; with skip_self row i of b is left out for row i of a."""
    k = min(k, len(b) - skip_self)
    near, at = np.empty((len(a), k)), np.empty((len(a), k), int)
    step = max(1, AT_ONCE // max(1, len(b)))
    for s in range(0, len(a), step):
        d = distances(a[s : s + step], b, metric)
        if skip_self:
            d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
        at[s : s + step] = np.argsort(d, axis=1, kind="stable")[:, :k]
        near[s : s + step] = np.take_along_axis(d, at[s : s + step], 1)
    return near, at


def _keep(x, rng, **config):
    return {"x": x, **config}


def knn_score(s, x):
    d, _ = nearest(x, s["x"], s["n_neighbors"], s["distance_metric"])
    return {"maximum": d.max, "mean": d.mean, "median": lambda axis: np.median(d, axis=axis)}[s["score_method"]](axis=1)


def lof_fit(x, rng, n_neighbors=20, **_):
    k = max(1, min(n_neighbors, len(x) - 1))
    d, at = nearest(x, x, k, skip_self=True)
    kd = d[:, -1]
    lrd = 1 / (np.maximum(d, kd[at]).mean(1) + 1e-10)
    return {"x": x, "k": k, "kd": kd, "lrd": lrd}


def lof_score(s, x):
    d, at = nearest(x, s["x"], s["k"])
    lrd = 1 / (np.maximum(d, s["kd"][at]).mean(1) + 1e-10)
    return s["lrd"][at].mean(1) / lrd


def angle_spread(v, k):
    """Negative variance of the angles between the first k vectors that aren't 0, weighted by their lengths."""
    v = v[(v * v).sum(1) > 0][:k]
    if len(v) < 2:
        return 0.0
    sq = (v * v).sum(1)
    a, b = np.triu_indices(len(v), 1)
    return -np.var((v[a] * v[b]).sum(1) / (sq[a] * sq[b]))


def abod_score(s, x):
    """The angle spread of each row's neighbours."""
    k = s["n_neighbors"]
    _, at = nearest(x, s["x"], k + 1)
    return np.array([angle_spread(s["x"][i] - row, k) for i, row in zip(at, x, strict=True)])


def chain(p):
    """Average chaining distance from row 0 of p."""
    n = len(p)
    if n < 2:
        return 0.0
    d = distances(p, p)
    left, near, total = list(range(1, n)), d[0].copy(), 0.0
    for i in range(1, n):
        k = min(left, key=near.__getitem__)
        total += 2 * (n - i) / (n * (n - 1)) * near[k]
        left.remove(k)
        near = np.minimum(near, d[k])
    return total


def cof_fit(x, rng, n_neighbors=20, **_):
    k = max(1, min(n_neighbors, len(x) - 1))
    _, at = nearest(x, x, k, skip_self=True)
    return {"x": x, "k": k, "ac": np.array([chain(np.vstack([x[i], x[at[i]]])) for i in range(len(x))])}


def cof_score(s, x):
    _, at = nearest(x, s["x"], s["k"])
    own = np.array([chain(np.vstack([x[i], s["x"][at[i]]])) for i in range(len(x))])
    return own / np.maximum(s["ac"][at].mean(1), 1e-10)


def sod_fit(x, rng, n_neighbors=20, ref_set=10, alpha=0.8, **_):
    k = max(1, min(n_neighbors, len(x) - 1))
    return {"x": x, "k": k, "ref": min(ref_set, k), "alpha": alpha, "near": nearest(x, x, k, skip_self=True)[1]}


def subspace_deviation(x, ref, alpha):
    mean, var = ref.mean(0), ref.var(0)
    low = var < alpha * var.mean()
    return np.sqrt(((x - mean)[low] ** 2).sum() / low.sum()) if low.any() else 0.0


def sod_score(s, x):
    """Deviation from the reference set (most shared neighbours) in the features where that set varies little."""
    _, at = nearest(x, s["x"], s["k"])
    out = np.zeros(len(x))
    for i in range(len(x)):
        own = set(at[i].tolist())
        shared = [len(own & set(s["near"][j].tolist())) for j in at[i]]
        out[i] = subspace_deviation(x[i], s["x"][at[i][np.argsort(-np.array(shared), kind="stable")[: s["ref"]]]], s["alpha"])
    return out


def kmeans(x, k, rng, steps=50):
    k = min(k, len(x))
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < k:
        d = (distances(x, c) ** 2).min(1)
        c = np.vstack([c, x[int(rng.choice(len(x), p=d / d.sum())) if d.sum() else int(rng.integers(len(x)))]])
    for _ in range(steps):
        g = distances(x, c).argmin(1)
        new = np.stack([x[g == j].mean(0) if (g == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c, distances(x, c).argmin(1)


def cblof_fit(x, rng, n_clusters=8, alpha=0.9, beta=5, use_weights=False, **_):
    c, g = kmeans(x, n_clusters, rng)
    size = np.bincount(g, minlength=len(c))
    order = np.argsort(-size, kind="stable")
    n, cut = 0, len(c)
    for i, j in enumerate(order):
        n += size[j]
        if n >= alpha * len(x) or (i + 1 < len(order) and size[j] >= beta * max(size[order[i + 1]], 1)):
            cut = i + 1
            break
    return {"c": c, "size": size, "large": order[:cut], "weights": use_weights}


def cblof_score(s, x):
    d = distances(x, s["c"])
    g = d.argmin(1)
    out = np.where(np.isin(g, s["large"]), d[np.arange(len(x)), g], d[:, s["large"]].min(1))
    return out * s["size"][g] if s["weights"] else out


def inne_fit(x, rng, n_estimators=200, max_samples="auto", **_):
    m = min(8, len(x)) if max_samples == "auto" else min(int(max_samples), len(x))
    sets = []
    for _ in range(n_estimators):
        p = x[rng.choice(len(x), m, replace=False)]
        d = distances(p, p)
        np.fill_diagonal(d, np.inf)
        near, r = d.argmin(1), np.where(np.isfinite(d.min(1)), d.min(1), 0)
        sets.append((p, r, 1 - (r[near] + 1e-12) / (r + 1e-12)))
    return {"sets": sets}


def inne_score(s, x):
    total = np.zeros(len(x))
    for p, r, ratio in s["sets"]:
        d = distances(x, p)
        inside = np.where(d <= r, r, np.inf)
        at = inside.argmin(1)
        total += np.where(np.isfinite(inside.min(1)), ratio[at], 1.0)
    return total / len(s["sets"])


def loda_fit(x, rng, n_bins=10, n_random_cuts=100, **_):
    d = x.shape[1]
    w = np.zeros((n_random_cuts, d))
    for i in range(n_random_cuts):
        on = rng.choice(d, max(1, round(math.sqrt(d))), replace=False)
        w[i, on] = rng.normal(size=len(on))
    hist = [np.histogram(x @ v, n_bins) for v in w]
    return {"w": w, "edges": [e for _, e in hist], "p": [(h / h.sum() + 1e-12) / (h / h.sum() + 1e-12).sum() for h, _ in hist]}


def loda_score(s, x):
    return -np.mean([np.log(p[np.searchsorted(e[1:-1], x @ v, "left")]) for v, e, p in zip(s["w"], s["edges"], s["p"], strict=True)], axis=0)


def _c(n):
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _grow(x, depth, rng, split):
    if depth == 0 or len(x) <= 1 or (x == x[0]).all():
        return len(x)
    w, b = split(x, rng)
    go = x @ w < b
    if go.all() or not go.any():
        return len(x)
    return (w, b, _grow(x[go], depth - 1, rng, split), _grow(x[~go], depth - 1, rng, split))


def _depth(node, x, at, level, out):
    if not isinstance(node, tuple):
        out[at] = level + _c(node)
        return
    go = x[at] @ node[0] < node[1]
    _depth(node[2], x, at[go], level + 1, out)
    _depth(node[3], x, at[~go], level + 1, out)


def _forest(x, rng, trees, size, split):
    psi = max(1, min(size, len(x)))
    depth = math.ceil(math.log2(psi)) if psi > 1 else 0
    return {"trees": [_grow(x[rng.choice(len(x), psi, replace=False)], depth, rng, split) for _ in range(trees)], "c": _c(psi)}


def _axis(x, rng):
    spread = np.flatnonzero(x.max(0) > x.min(0))
    w = np.zeros(x.shape[1])
    j = int(rng.choice(spread))
    w[j] = 1
    return w, rng.uniform(x[:, j].min(), x[:, j].max())


def iforest_fit(x, rng, n_estimators=100, max_samples="auto", **_):
    return _forest(x, rng, n_estimators, 256 if max_samples == "auto" else int(max_samples if max_samples > 1 else max_samples * len(x)), _axis)


def eif_fit(x, rng, n_estimators=100, max_samples=None, extension_level=None, **_):
    d = x.shape[1]
    level = d - 1 if extension_level is None else min(extension_level, d - 1)

    def plane(x, rng):
        w = rng.normal(size=d)
        w[rng.choice(d, d - level - 1, replace=False)] = 0
        return w, float(rng.uniform(x.min(0), x.max(0)) @ w)

    return _forest(x, rng, n_estimators, max_samples or 256, plane)


def forest_score(s, x):
    total = np.zeros(len(x))
    for t in s["trees"]:
        h = np.zeros(len(x))
        _depth(t, x, np.arange(len(x)), 0, h)
        total += h
    return 2 ** (-(total / len(s["trees"])) / s["c"]) if s["c"] else np.zeros(len(x))


def _gram(s, a, b):
    g, kind = s["gamma"], s["kernel"]
    if kind == "linear":
        return a @ b.T
    if kind == "poly":
        return (g * a @ b.T + s["coef0"]) ** s["degree"]
    if kind == "sigmoid":
        return np.tanh(g * a @ b.T + s["coef0"])
    return np.exp(-g * distances(a, b) ** 2)


def ocsvm_fit(x, rng, kernel="rbf", degree=3, gamma="scale", coef0=0.0, nu=0.5, tol=1e-3, max_iter=-1, **_):
    """The one-class dual by pairwise updates on at most 2,000 rows."""
    x = x[np.sort(rng.choice(len(x), min(len(x), 2000), replace=False))]
    g = 1 / (x.shape[1] * (x.var() or 1.0)) if gamma == "scale" else 1 / x.shape[1] if gamma == "auto" else float(gamma)
    s = {"kernel": kernel, "gamma": g, "coef0": coef0, "degree": degree}
    n = len(x)
    k, top = _gram(s, x, x), 1 / (nu * n)
    a = np.full(n, 1 / n)
    grad = k @ a
    for _ in range(max_iter if max_iter > 0 else 50 * n):
        up, down = np.where(a < top - 1e-12, grad, np.inf).argmin(), np.where(a > 1e-12, grad, -np.inf).argmax()
        if grad[down] - grad[up] < tol * max(abs(grad[down]), 1e-12):
            break
        step = min((grad[down] - grad[up]) / max(k[up, up] + k[down, down] - 2 * k[up, down], 1e-12), top - a[up], a[down])
        a[up] += step
        a[down] -= step
        grad += step * (k[:, up] - k[:, down])
    on = a > 1e-12
    return s | {"x": x[on], "a": a[on]}


def ocsvm_score(s, x):
    return -(_gram(s, x, s["x"]) @ s["a"])


def kde_score(s, x):
    h, d = s["bandwidth"], s["x"].shape[1]
    e = -0.5 * (distances(x, s["x"]) / h) ** 2
    m = e.max(1)
    return -(m + np.log(np.exp(e - m[:, None]).sum(1)) - math.log(len(s["x"])) - d * math.log(h) - d / 2 * math.log(2 * math.pi))


def gmm_fit(x, rng, n_components=1, reg_covar=1e-6, max_iter=100, tol=1e-3, **_):
    n, d = x.shape
    _, g = kmeans(x, n_components, rng)
    r = np.eye(n_components)[g]
    last = -math.inf
    for _ in range(max_iter):
        w = r.sum(0) + 1e-10
        mu = r.T @ x / w[:, None]
        cov = [((x - m) * r[:, [j]]).T @ (x - m) / w[j] + reg_covar * np.eye(d) for j, m in enumerate(mu)]
        s = {"w": w / n, "mu": mu, "cov": cov}
        lp = _gmm_logs(s, x)
        top = lp.max(1, keepdims=True)
        ll = top[:, 0] + np.log(np.exp(lp - top).sum(1))
        r = np.exp(lp - ll[:, None])
        if abs(ll.mean() - last) < tol:
            break
        last = ll.mean()
    return s


def _gmm_logs(s, x):
    out = []
    for w, m, c in zip(s["w"], s["mu"], s["cov"], strict=True):
        z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
        out.append(math.log(w) - 0.5 * (z * z).sum(0) - 0.5 * np.linalg.slogdet(c)[1] - len(m) / 2 * math.log(2 * math.pi))
    return np.stack(out, 1)


def gmm_score(s, x):
    lp = _gmm_logs(s, x)
    top = lp.max(1)
    return -(top + np.log(np.exp(lp - top[:, None]).sum(1)))


def mcd_fit(x, rng, support_fraction=None, assume_centered=False, **_):
    """FAST-MCD: concentration steps from random starts; the best determinant wins."""
    n, d = x.shape
    h = min(n, math.ceil((n + d + 1) / 2) if support_fraction is None else math.ceil(support_fraction * n))
    best = None
    for _ in range(30):
        at = rng.choice(n, min(d + 1, n), replace=False)
        for _ in range(20):
            m = np.zeros(d) if assume_centered else x[at].mean(0)
            c = np.cov(x[at].T, bias=True).reshape(d, d) + 1e-9 * np.eye(d)
            new = np.argsort(((x - m) @ np.linalg.inv(c) * (x - m)).sum(1), kind="stable")[:h]
            if set(new) == set(at):
                break
            at = new
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = (det, m, c)
    _, m, c = best
    dist = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
    c = c * np.median(dist) / max(d * (1 - 2 / (9 * d)) ** 3, 1e-9)  # to the median of a chi-squared
    return {"m": m, "inv": np.linalg.inv(c)}


def mcd_score(s, x):
    return ((x - s["m"]) @ s["inv"] * (x - s["m"])).sum(1)


def sos_logs(a, own, x, w, perplexity=4.5, eps=1e-5):
    """For each vector of x the sum, over the rows of a (own: the vectors they are, as indices of x), of log(1 - binding probability); w: rows of each vector.

    A row's own vector counts with its other rows. Terms under exp(-100) of a row's largest are below the last digit of its sum.
    """
    out, want = np.zeros(len(x)), math.log(perplexity)
    for row, i in zip(a, own, strict=True):
        others = w.astype(float)
        others[i] -= 1
        d = distances(row[None], x)[0]
        least = d[others > 0].min()
        d = d - least
        at = np.flatnonzero(others > 0)
        lo, hi, beta = 0.0, math.inf, 1.0
        for _ in range(5000):
            near = at[d[at] * beta <= 100]
            e = d[near]
            p = np.exp(-e * beta)
            t = (p * others[near]).sum()
            entropy = math.log(t) + beta * (e * p * others[near]).sum() / t
            if abs(entropy - want) <= eps or (hi - lo) < 1e-300 or beta in (lo, hi) or entropy > want and (beta > 1e300 or not e.any()):
                break  # the last: more nearest rows at one distance than the perplexity asks for share evenly
            if entropy > want:
                lo, at = beta, near
            else:
                hi = beta
            beta = beta * 2 if hi == math.inf else (lo + hi) / 2
        many = np.full(len(near), float(w[i]))
        many[near == i] -= 1
        near, p, many = near[many > 0], p[many > 0], many[many > 0]
        with np.errstate(divide="ignore"):
            out[near] += many * np.log1p(-np.minimum(p / t, 1.0))
    return out


def sos_score(x, perplexity=4.5, eps=1e-5, **_):
    """Rows with a missing or infinite value take no part and have no score."""
    known = np.isfinite(x).all(1)
    out = np.where(known, 0.0, np.nan)
    if known.sum() > 1:
        v, own, w = np.unique(x[known], axis=0, return_inverse=True, return_counts=True)
        out[known] = np.exp(sos_logs(v, np.arange(len(v)), v, w, perplexity, eps))[own.ravel()]
    return out


def _rod3(x):
    """Rotation-based scores of points in three dimensions, around the geometric median."""
    m = np.median(x, 0)
    for _ in range(100):
        w = 1 / np.maximum(np.linalg.norm(x - m, axis=1), 1e-12)
        new = (x * w[:, None]).sum(0) / w.sum()
        if np.linalg.norm(new - m) < 1e-8:
            break
        m = new
    v, norm = x - m, np.linalg.norm(m)
    length = np.linalg.norm(v, axis=1)
    axis = m / norm if norm > 0 else np.array([1.0, 0, 0])
    angle = np.arccos(np.clip(v @ axis / np.maximum(length, 1e-12), -1, 1))
    cost = length**3 * np.cos(angle) * np.sin(angle) ** 2
    mad = np.median(np.abs(cost - np.median(cost)))
    return 0.6745 * np.abs(cost - np.median(cost)) / (mad or 1.0)


def rod_score(x, **_):
    n, d = x.shape
    if d < 3:
        x, d = np.hstack([x, np.zeros((n, 3 - d))]), 3
    if d == 3:
        return _rod3(x)
    iqr = np.percentile(x, 75, 0) - np.percentile(x, 25, 0)
    x = (x - np.median(x, 0)) / np.where(iqr == 0, 1, iqr)
    return np.mean([1 / (1 + np.exp(-_rod3(x[:, list(c)]))) for c in combinations(range(d), 3)], axis=0)


_SK = {"algorithm": "auto", "leaf_size": 30, "metric": "minkowski", "p": 2}
_OUT = {"contamination": 0.1}
MODELS = {
    "knn": (_keep, knn_score, {"n_neighbors": 5, "distance_metric": "euclidean", "score_method": "maximum"}),
    "lof": (lof_fit, lof_score, {"n_neighbors": 20, "n_jobs": 1, "metric_params": None} | _SK | _OUT),
    "abod": (_keep, abod_score, {"n_neighbors": 5, "method": "fast", "metric": "minkowski", "p": 2} | _OUT),
    "cof": (cof_fit, cof_score, {"n_neighbors": 20, "method": "fast"} | _OUT),
    "sod": (sod_fit, sod_score, {"n_neighbors": 20, "ref_set": 10, "alpha": 0.8, "n_jobs": 1, "metric_params": None} | _SK | _OUT),
    "cblof": (cblof_fit, cblof_score, {"n_clusters": 8, "alpha": 0.9, "beta": 5, "use_weights": False, "check_estimator": False, "random_state": None, "n_jobs": 1} | _OUT),
    "inne": (inne_fit, inne_score, {"n_estimators": 200, "max_samples": "auto", "random_state": None} | _OUT),
    "loda": (loda_fit, loda_score, {"n_bins": 10, "n_random_cuts": 100, "random_state": None}),
    "iforest": (iforest_fit, forest_score, {"n_estimators": 100, "max_samples": "auto", "max_features": 1.0, "bootstrap": False, "n_jobs": 1, "random_state": None} | _OUT),
    "eif": (eif_fit, forest_score, {"n_estimators": 100, "max_samples": None, "extension_level": None, "random_state": None}),
    "ocsvm": (ocsvm_fit, ocsvm_score, {"kernel": "rbf", "degree": 3, "gamma": "scale", "coef0": 0.0, "tol": 0.001, "nu": 0.5, "shrinking": True, "cache_size": 200.0, "max_iter": -1, "random_state": None}),
    "kde": (_keep, kde_score, {"bandwidth": 1.0, "kernel": "gaussian", "algorithm": "auto", "metric": "euclidean", "atol": 0.0, "rtol": 0.0, "breadth_first": True, "leaf_size": 40}),
    "gmm": (gmm_fit, gmm_score, {"n_components": 1, "covariance_type": "full", "tol": 0.001, "reg_covar": 1e-6, "max_iter": 100, "n_init": 1, "init_params": "kmeans", "random_state": None, "warm_start": False}),
    "mcd": (mcd_fit, mcd_score, {"store_precision": True, "assume_centered": False, "support_fraction": None, "random_state": None}),
}
TRANSDUCTIVE = {"sos": (sos_score, {"perplexity": 4.5, "metric": "euclidean", "eps": 1e-5}), "rod": (rod_score, {})}
