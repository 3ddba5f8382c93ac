"""Ordered series: gaps, imputation, smoothing, windows, splits. `series` columns are the unit of parallelism."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(series, order) -> Window:
    return Window.partitionBy(*series).orderBy(order)


def gap_chunks(df: DataFrame, order: str, max_gap: float, series=(), output: str = "chunk_id") -> DataFrame:
    """Numbers the stretches of each series that are free of gaps above max_gap (seconds, for timestamps)."""
    t = F.col(order)
    kind = dict(df.dtypes)[order]
    if kind.startswith("timestamp"):
        t = F.unix_micros(t.cast("timestamp")) / 1e6
    gap = t - F.lag(t).over(_w(series, order)) > max_gap
    return df.withColumn("__g", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(output, F.sum("__g").over(_w(series, order).rowsBetween(Window.unboundedPreceding, 0))).drop("__g")


def impute_linear(df: DataFrame, columns: list[str], order: str, series=(), zero_is_missing: bool = True) -> DataFrame:
    """Missing values (null, NaN, 0) by linear interpolation on row positions, both ways at the ends; 0 where a series has none."""
    w = _w(series, order)
    df = df.withColumn("__i", F.row_number().over(w))
    for c in columns:
        x = F.col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | ((x == 0) if zero_is_missing else F.lit(False))
        v = F.when(~bad, F.struct(F.col("__i").alias("i"), x.alias("v")))
        a, b = F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(v, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        df = df.withColumns({"__a": a, "__b": b})
        line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__i") - F.col("__a.i")) / F.when(F.col("__b.i") == F.col("__a.i"), 1).otherwise(F.col("__b.i") - F.col("__a.i"))
        df = df.withColumn(c, F.coalesce(line, F.col("__a.v"), F.col("__b.v"), F.lit(0.0))).drop("__a", "__b")
    return df.drop("__i")


def double_ema(df: DataFrame, columns: list[str], order: str, series=(), alpha: float = 0.3) -> DataFrame:
    """Brown's double smoothing 2 s1 - s2, each started at the first value; one Arrow group per series."""
    kept = df.withColumns({c: F.col(c).cast("double") for c in columns})

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        for c in columns:
            s1 = p[c].ewm(alpha=alpha, adjust=False).mean()
            p[c] = 2 * s1 - s1.ewm(alpha=alpha, adjust=False).mean()
        return p

    if series:
        return kept.groupBy(*series).applyInPandas(run, kept.schema)
    return kept.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda p: run(p.drop(columns="__all")), kept.schema)


def window_starts(df: DataFrame, order: str, length: int, series=()) -> DataFrame:
    """The rows from which `length` rows follow inside the series."""
    w = _w(series, order)
    left = F.count(F.lit(1)).over(Window.partitionBy(*series)) - F.row_number().over(w) + 1
    return df.withColumn("__left", left).where(F.col("__left") >= length).drop("__left")


def window_arrays(df: DataFrame, columns: list[str], order: str, length: int, series=(), horizon: int = 0, target: str | None = None) -> DataFrame:
    """One row a full window (at its last row): `{c}_window`, and with a horizon `{target}_future`."""
    w = _w(series, order)
    out = df.withColumn("__n", F.row_number().over(w)).withColumns({f"{c}_window": F.collect_list(F.col(c).cast("double")).over(w.rowsBetween(1 - length, 0)) for c in columns})
    out = out.where(F.col("__n") >= length) if not horizon else out
    if horizon:
        out = out.withColumn(f"{target}_future", F.collect_list(F.col(target).cast("double")).over(w.rowsBetween(1, horizon))).where((F.col("__n") >= length) & (F.size(f"{target}_future") == horizon))
    return out.drop("__n")


def temporal_split(df: DataFrame, order: str, ratios=(0.7, 0.15), series=()) -> DataFrame:
    """`split` train, val or test: the first int(n * ratio) rows of each series, and so on."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*series))
    i = F.row_number().over(_w(series, order))
    a, b = F.floor(n * ratios[0]), F.floor(n * ratios[0]) + F.floor(n * ratios[1])
    return df.withColumn("split", F.when(i <= a, "train").when(i <= b, "val").otherwise("test"))


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    r = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if not r[c]]


def check_not_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = constant_columns(df, columns)
    if bad:
        raise ValueError(f"constant columns: {bad}")
    return df


def scale(df: DataFrame, columns: list[str], method: str = "zscore", stats: DataFrame | None = None) -> DataFrame:
    """z-score (population deviation) or min-max of columns by the statistics of `stats` (or of df)."""
    a, b = (F.avg, F.stddev_pop) if method == "zscore" else (F.min, F.max)
    r = (df if stats is None else stats).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", a), ("b", b))]).first()

    def one(i: int, c: str) -> Column:
        low, width = r[f"a{i}"], r[f"b{i}"] if method == "zscore" else r[f"b{i}"] - r[f"a{i}"]
        return (F.col(c) - low) / (width or 1.0)

    return df.withColumns({c: one(i, c) for i, c in enumerate(columns)})
