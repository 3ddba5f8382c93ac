"""NumPy kernels over one ordered series: events, affiliation, range curves, NAB, DTW."""

from __future__ import annotations

import math

import numpy as np


def events(y: np.ndarray) -> list[tuple[int, int]]:
    """Closed intervals where y is 1."""
    edge = np.diff(np.concatenate(([0], (np.asarray(y) == 1).astype(int), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def event_f1(y, p, least=0):
    """Greedy one-to-one matching in order: a predicted event takes the first free true event that it overlaps enough."""
    truth, found = events(y), events(p)
    free, tp = list(truth), 0
    for a, b in found:
        for k, (s, e) in enumerate(free):
            n = min(b, e) - max(a, s) + 1
            if n > 0 and n >= least:
                tp += 1
                del free[k]
                break
    fp, fn = len(found) - tp, len(truth) - tp
    return tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def soft_f1(y, p):
    truth, found = events(y), events(p)
    if not truth and not found:
        return 1.0, 1.0, 1.0
    if not truth or not found:
        return 0.0, 0.0, 0.0

    def best(one, others):
        a, b = np.array(one), np.array(others)
        n = np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0]) + 1
        n = np.maximum(n, 0)
        size = (a[:, 1] - a[:, 0] + 1)[:, None] + (b[:, 1] - b[:, 0] + 1)[None] - n
        return float((n / size).max(1).mean())

    precision, recall = best(found, truth), best(truth, found)
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def _area(f, a: float, b: float, breaks) -> float:
    """Integral of a piecewise linear f over [a, b], given where it can bend."""
    x = np.unique(np.clip([a, b, *breaks], a, b))
    v = np.array([f(t) for t in x])
    return float(((v[1:] + v[:-1]) / 2 * np.diff(x)).sum()) if len(x) > 1 else 0.0


def _zones(parts, lo, hi):
    """Each interval's share of [lo, hi]: up to half way to its neighbours; mirrored at the ends."""
    ends = [2 * lo - parts[0][0], *[b for _, b in parts]]
    starts = [*[a for a, _ in parts], 2 * hi - parts[-1][1]]
    cut = [(e + s) / 2 for e, s in zip(ends, starts, strict=True)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def affiliation(y, p):
    """Mean probabilities that a random point of the zone is farther off than the prediction (precision) and the truth (recall)."""
    truth, found = events(y), events(p)
    if not truth or not found:
        return 0.0, 0.0, 0.0
    precisions, recalls = [], []
    for (s, e), (lo, hi) in zip(truth, _zones(truth, 0, len(y)), strict=True):
        cuts = [(max(a, lo), min(b, hi)) for a, b in found if b >= lo and a <= hi]
        cuts = [(a, b) for a, b in cuts if a < b]
        if not cuts:
            recalls.append(0.0)
            continue
        width = hi - lo

        def farther(x, s=s, e=e, lo=lo, hi=hi, width=width):
            d = max(s - x, x - e, 0.0)
            return 1.0 if d == 0 else 1 - (min(d, s - lo) + min(d, hi - e) + (e - s)) / width

        total = 0.0
        for a, b in cuts:
            bends = [s, e, 2 * s - lo - (s - lo), lo, hi, s - (hi - e), e + (s - lo)]
            inside = max(0.0, min(b, e) - max(a, s))
            left, right = (a, min(b, s)), (max(a, e), b)
            total += inside + sum(_open(farther, u, v, bends) for u, v in (left, right) if u < v)
        precisions.append(total / sum(b - a for a, b in cuts))
        if s == e:
            recalls.append(0.0)
            continue
        got = 0.0
        for (a, b), (u, v) in zip(cuts, _zones(cuts, lo, hi), strict=True):
            u, v = max(u, s), min(v, e)
            if u >= v:
                continue

            def nearer(x, a=a, b=b, lo=lo, hi=hi, width=width):
                d = max(a - x, x - b, 0.0)
                return 1.0 if d == 0 else 1 - (min(hi, x + d) - max(lo, x - d)) / width

            inside = max(0.0, min(v, b) - max(u, a))
            bends = [a, b, (lo + a) / 2, (hi + a) / 2, (lo + b) / 2, (hi + b) / 2]
            got += inside + sum(_open(nearer, x, z, bends) for x, z in ((u, min(v, a)), (max(u, b), v)) if x < z)
        recalls.append(got / (e - s))
    precision = float(np.mean(precisions)) if precisions else 0.0
    recall = float(np.mean(recalls))
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def _open(f, a, b, bends):
    """Integral over the open interval: f may jump at a or b, so it is taken from inside."""
    x = np.unique(np.clip([a, b, *bends], a, b))
    out = 0.0
    for u, v in zip(x[:-1], x[1:], strict=True):
        out += (v - u) * f((u + v) / 2)  # linear between bends: the middle is the mean
    return out


def range_auc(y, s, window, thresholds=250):
    """(ROC area, PR area) with labels that decay over half a window around each event."""
    y, s = np.asarray(y, int), np.asarray(s, float)
    n, pos = len(y), int(y.sum())
    if not pos:
        return 0.0, 0.0
    ev, half = events(y), window // 2
    soft = y.astype(float)
    if window > 0:
        at = np.arange(n)
        for a, b in ev:
            d = np.maximum(a - at, at - b)
            near = (d > 0) & (d <= half)
            soft[near] = np.maximum(soft[near], np.sqrt(1 - d[near] / window))
        merged = []
        for a, b in [(max(0, a - half), min(n - 1, b + half)) for a, b in ev]:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        ev = merged
    p_new = (pos + soft.sum()) / 2
    n_new = n - p_new
    if n_new <= 0:
        return 0.0, 0.0
    down = np.sort(s)[::-1]
    cut = down[np.unique(np.round(np.linspace(0, n - 1, thresholds)).astype(int))]
    order = np.argsort(-s, kind="stable")
    upto = np.searchsorted(-down, -cut, "right")
    tp = np.concatenate(([0.0], np.cumsum(soft[order])))[upto]
    best = np.array([s[a : b + 1][soft[a : b + 1] > 0].max(initial=-np.inf) for a, b in ev])
    exist = (best[None] >= cut[:, None]).mean(1)
    tpr = np.minimum(tp / p_new, 1) * exist
    fpr, prec = (upto - tp) / n_new, tp / upto
    x, t = np.concatenate(([0.0], fpr, [1.0])), np.concatenate(([0.0], tpr, [1.0]))
    roc = float((np.diff(x) * (t[1:] + t[:-1]) / 2).sum())
    pr = np.concatenate(([1.0], prec))
    return roc, float((np.diff(t[:-1]) * (pr[1:] + pr[:-1]) / 2).sum())


def vus(y, s, window=100, thresholds=250):
    got = np.array([range_auc(y, s, w, thresholds) for w in range(window + 1)])
    return tuple(got.mean(0).tolist())


#: Weights of true positives, false positives and misses.
PROFILES = {"standard": (1.0, 0.11, 1.0), "reward_low_FP_rate": (1.0, 0.22, 1.0), "reward_low_FN_rate": (1.0, 0.11, 2.0)}


def _nab_curve(y, s, window_length=None, probation_percent=0.15, profile="standard"):
    """(thresholds from high to low, total score at each, score above all)."""
    w_tp, w_fp, w_fn = PROFILES[profile]
    n, ev = len(y), events(y)
    size = window_length or (max(1, int(0.1 * n / len(ev))) if ev else 1)
    half = max(size // 2, 1)
    wins = [(max((a + b) // 2 - half, 0), min((a + b) // 2 + half, n - 1)) for a, b in ev]
    scale = lambda x: 2 / (1 + np.exp(np.minimum(5 * x, 700))) - 1
    at = np.arange(n)
    own = np.full(n, -1)
    for k in range(len(wins) - 1, -1, -1):
        own[wins[k][0] : wins[k][1] + 1] = k
    value = np.full(n, -1.0 * w_fp)
    inside = own >= 0
    left, right = (np.array([w[i] for w in wins] or [0]) for i in (0, 1))
    k = own[inside]
    value[inside] = scale(-(right[k] - at[inside] + 1) / (right[k] - left[k] + 1)) * w_tp / scale(np.array(-1.0))
    last = np.maximum.accumulate(np.where(inside, at, -1))
    past = ~inside & (last >= 0)
    k = own[last[past]]
    value[past] = scale(np.abs(right[k] - at[past]) / np.maximum(right[k] - left[k], 1)) * w_fp
    start = min(math.floor(probation_percent * n), int(probation_percent * 5000))
    names = np.where(own >= 0, left[np.maximum(own, 0)], -1)
    parts = {int(x): -w_fn for x in names[start:] if x >= 0}
    total = first = sum(parts.values())
    order = np.argsort(-np.asarray(s), kind="stable")
    cuts, totals = [], []
    for j, i in enumerate(order):
        if i >= start:
            if names[i] < 0:
                total += value[i]
            elif value[i] > parts[int(names[i])]:
                total += value[i] - parts[int(names[i])]
                parts[int(names[i])] = value[i]
        if j + 1 == n or s[order[j + 1]] != s[i]:
            cuts.append(float(s[i]))
            totals.append(float(total))
    return cuts, totals, float(first)


def nab(y, s, threshold=None, **options):
    """(score at the threshold, threshold); no rows give (0, 0). Default threshold: half the largest score."""
    if not len(y):
        return 0.0, 0.0
    cuts, totals, first = _nab_curve(y, s, **options)
    threshold = float(np.max(s) / 2) if threshold is None else threshold
    got = first
    for c, t in zip(cuts, totals, strict=True):
        if c < threshold:
            break
        got = t
    return got, threshold


def nab_best(y, s, **options):
    return max(_nab_curve(y, s, **options)[1]) if len(y) else 0.0


def dtw(a, b, window=None, path=False):
    """(distance, path): absolute cost; window is the Sakoe-Chiba band, at least the difference of lengths."""
    n, m = len(a), len(b)
    if not n or not m:
        return (0.0 if n == m else math.inf), []
    w = max(n, m) if window is None else max(window, abs(n - m))
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        lo, hi = max(1, i - w), min(m, i + w)
        cost = np.abs(a[i - 1] - b[lo - 1 : hi])
        best = np.minimum(d[i - 1, lo : hi + 1], d[i - 1, lo - 1 : hi])
        left = d[i, lo - 1]
        for k in range(hi - lo + 1):
            left = cost[k] + min(best[k], left)
            d[i, lo + k] = left
    steps = []
    if path:
        i, j = n, m
        while i or j:
            steps.append((i - 1, j - 1))
            up, back, diag = (d[i - 1, j] if i else np.inf), (d[i, j - 1] if j else np.inf), (d[i - 1, j - 1] if i and j else np.inf)
            least = min(up, back, diag)
            i, j = (i - 1, j) if up == least and i > 1 else (i, j - 1) if back == least and j > 1 else (i - 1, j - 1)
        steps.reverse()
    return float(d[n, m]), steps


def binomial_tail(k: int, n: int, p: np.ndarray) -> np.ndarray:
    """P(X > k) of binomial (n, p) for an array of p: the regularised incomplete beta function I_p(k + 1, n - k).

    Its continued fraction is summed on the side of the mean where it converges, for all of p at once; values whose
    leading factor is under 1e-20 are 0 or 1 without it.
    """
    p = np.clip(np.asarray(p, float), 0.0, 1.0)
    if k < 0 or k >= n:
        return np.full(p.shape, float(k < 0))
    a, b = k + 1.0, float(n - k)
    with np.errstate(divide="ignore"):
        front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(p) + b * np.log1p(-p)
    low = p < (a + 1) / (a + b + 2)
    out = np.where(low, 0.0, 1.0)
    on = np.flatnonzero(front > -46)
    x = np.where(low, p, 1 - p)[on]
    u, v = np.where(low, a, b)[on], np.where(low, b, a)[on]
    tiny = 1e-300
    c, d = np.ones(len(on)), 1 - (u + v) * x / (u + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f, m, todo = d.copy(), 0, np.arange(len(on))
    while len(todo):
        m += 1
        xs, us, vs = x[todo], u[todo], v[todo]
        for coef in (m * (vs - m) * xs / ((us + 2 * m - 1) * (us + 2 * m)), -(us + m) * (us + vs + m) * xs / ((us + 2 * m) * (us + 2 * m + 1))):
            d[todo] = 1 + coef * d[todo]
            c[todo] = 1 + coef / c[todo]
            d[todo] = 1 / np.where(np.abs(d[todo]) < tiny, tiny, d[todo])
            c[todo] = np.where(np.abs(c[todo]) < tiny, tiny, c[todo])
            step = c[todo] * d[todo]
            f[todo] *= step
        todo = todo[np.abs(step - 1) > 1e-15] if m < 200_000 else todo[:0]
    part = np.exp(front[on]) * f / u
    out[on] = np.where(low[on], part, 1 - part)
    return np.clip(out, 0.0, 1.0)
