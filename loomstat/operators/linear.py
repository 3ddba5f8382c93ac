"""First and second moments of feature columns in one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariance); the state is d + d * d numbers, whatever the rows."""
    d = len(columns)
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n, mean = first["n"], np.array([first[f"m{i}"] if first[f"m{i}"] is not None else 0.0 for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    second = df.agg(*[F.sum((F.col(columns[i]) - float(mean[i])) * (F.col(columns[j]) - float(mean[j]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (second[f"c{i}_{j}"] or 0.0) / max(n - 1, 1)
    return n, mean, cov
