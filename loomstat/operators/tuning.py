"""Hyper-parameter search over operator configs: grid or seeded random trials, folds by a hash of the key."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class SearchResult:
    best_params: dict
    best_score: float
    top: list[tuple[dict, float]] = field(default_factory=list)


def grid(space: dict, points: int = 11) -> list[dict]:
    """Every combination; (low, high) of floats gives `points` values, of ints all of them, a list its entries."""

    def values(v):
        if isinstance(v, list):
            return v
        lo, hi = v
        return list(range(lo, hi + 1)) if isinstance(lo, int) and isinstance(hi, int) else [lo + (hi - lo) * k / (points - 1) for k in range(points)]

    return [dict(zip(space, c, strict=True)) for c in product(*map(values, space.values()))]


def draws(space: dict, n: int, seed: int = 0) -> list[dict]:
    rng = random.Random(seed)
    one = lambda v: rng.choice(v) if isinstance(v, list) else rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v)
    return [{k: one(v) for k, v in space.items()} for _ in range(n)]


def folds(df: DataFrame, k: int, key: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    """k (train, validation) pairs; labels are columns of df and so follow their rows."""
    at = F.pmod(F.xxhash64(*key), F.lit(k))
    return [(df.where(at != i), df.where(at == i)) for i in range(k)]


def search(build: Callable[[dict], object], objective: Callable[[DataFrame], float], df: DataFrame, space: dict, *, key: list[str], val: DataFrame | None = None, k: int = 3, sampler: str = "random", n_trials: int = 10, top_k: int = 3, maximize: bool = True, base: dict | None = None, parallel: int = 2, seed: int = 0) -> SearchResult:
    """Fit build(base | params) on each training part, score its output on the validation part; trials run as parallel Spark jobs."""
    trials = grid(space)[:n_trials] if sampler == "grid" else draws(space, n_trials, seed)
    parts = [(df, val)] if val is not None else folds(df, max(k, 2), key)

    def run(params):
        got = [objective(build((base or {}) | params).fit(a).transform(b)) for a, b in parts]
        return params, sum(got) / len(got)

    with ThreadPoolExecutor(parallel) as pool:
        done = sorted(pool.map(run, trials), key=lambda x: -x[1] if maximize else x[1])
    return SearchResult(*done[0], done[:top_k])
