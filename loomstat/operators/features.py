"""Feature construction. FEATURES maps each name to a builder; `add_features` projects any number of them at once.

A builder takes (df, columns, config) and returns new columns {name: Column};
names are `{column}_{feature}`. Scalar kernels on cells are Column
expressions; spectra and envelopes go through Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import signals as S

Builder = Callable[[list[str], dict], dict[str, Column]]
FEATURES: dict[str, Builder] = {}
D = "array<double>"


def _each(name: str, f: Callable[..., Column], suffix: str | None = None) -> None:
    def build(columns, config):
        return {f"{c}_{suffix or name}": f(F.col(c), **config) for c in columns}

    FEATURES[f"{name}_feature"] = build


def _udf(name: str, kernel: Callable, out: str = "double") -> None:
    def make(c: Column, **config):
        @F.pandas_udf(out)
        def run(s: pd.Series) -> pd.Series:
            got = [kernel(np.asarray(x, float), **config) if x is not None else None for x in s]
            return pd.Series([g.tolist() if isinstance(g, np.ndarray) else g for g in got], dtype=object if out != "double" else float)

        return run(c.cast(D))

    _each(name, make)


# scalar columns
_each("square", lambda c: c * c)
FEATURES["polynomial_feature"] = lambda columns, config: {f"{c}_poly_{d}": F.pow(F.col(c), d) for c in columns for d in config.get("degrees", (2, 3))}  # names and values agree, column by column


def _median(columns, config):
    n = len(columns)
    s = F.array_sort(F.array(*[F.col(c).cast("double") for c in columns]))
    mid = A.let(s, lambda v: (F.get(v, F.lit((n - 1) // 2)) + F.get(v, F.lit(n // 2))) / 2)
    return {config.get("output_column") or "_".join(columns) + "_median": mid}


FEATURES["column_median_feature"] = _median

# one number of each cell
_each("max", F.array_max)
_each("min", F.array_min)
_each("mean", A.mean)
_each("std", A.std)
_each("sum", A.total)
_each("slope", A.slope)
_each("mean_square", lambda c: A.mean(c, lambda x: x * x))
_each("variance", A.variance)
_each("rms", A.rms)
_each("peak_peak", lambda c: F.array_max(c) - F.array_min(c))
_each("shape_factor", lambda c: A.ratio(A.rms(c), A.mean(c, F.abs)))
_each("crest", lambda c: A.ratio(A.peak(c), A.rms(c)))
_each("impulse", lambda c: A.ratio(A.peak(c), A.mean(c, F.abs)))
_each("clearance", lambda c: A.ratio(A.peak(c), F.pow(A.mean(c, lambda x: F.sqrt(F.abs(x))), 2)))
_each("skewness", A.skewness)
_each("kurtosis", A.kurtosis)
_each("gini_index", A.gini)
_each("average_kurtosis", lambda c, n_segments=10: A.segments_kurtosis(c, n_segments))

# cell to cell
_each("abs", lambda c: F.transform(c, F.abs))
_each("sqrt", lambda c: F.transform(c, F.sqrt))
_each("diff", lambda c: F.transform(c, lambda x, i: x - F.get(c, F.greatest(i - 1, F.lit(0)))))
_each("uni", lambda c: F.transform(c, lambda x: x / F.size(c)))
_each("rfftfreq", lambda c, sample_rate: F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 2).cast("int")), lambda k: k * F.lit(float(sample_rate)) / F.size(c)))
_each("fftfreq", lambda c, sample_rate: F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda k: F.when(k <= (F.size(c) - 1) / 2, k).otherwise(k - F.size(c)) * F.lit(float(sample_rate)) / F.size(c)))
_each("specific_loudness", lambda c, ref_power=1e-12: F.transform(F.arrays_zip(c.alias("p"), F.array(*map(F.lit, S.QUIET_DB)).alias("q")), lambda z: A.let(10 * F.log10(F.greatest(z["p"], F.lit(1e-20)) / ref_power), lambda level: F.when(level > z["q"], 0.08 * F.pow(F.pow(F.lit(10.0), (level - z["q"]) / 10), F.lit(0.23))).otherwise(0.0))))

# windows inside a cell (circular, stride 1, ending at each place)
_each("smooth_mean", lambda c, win=30: A.smooth(c, win, lambda w: A.mean(w)))
_each("smooth_min", lambda c, win=30: A.smooth(c, win, F.array_min))
_each("smooth_max", lambda c, win=30: A.smooth(c, win, F.array_max))
_each("smooth_std", lambda c, win=30: A.smooth(c, win, (lambda w: A.std(w)) if win > 1 else lambda w: F.lit(float("nan"))))
_each("smooth_slope", lambda c, win=30: A.smooth(c, win, lambda w: A.slope(w)))
_each("smooth_grad_mean", lambda c, win=30: A.gradient(A.smooth(c, win, lambda w: A.mean(w))))
_each("smooth_grad_std", lambda c, win=30: A.gradient(A.smooth(c, win, lambda w: A.std(w))))
_each("smooth_grad2_mean", lambda c, win=30: A.second_difference(A.smooth(c, win, lambda w: A.mean(w))))
_each("smooth_fft_energy", lambda c, win=30: A.smooth(c, win, lambda w: A.energy(w, win)))

# spectra and envelopes
_udf("ehr", S.envelope_harmonic_ratio)
_udf("rfft", lambda x, output="magnitude": np.abs(np.fft.rfft(x)) if output == "magnitude" else np.fft.rfft(x).view(float), D)  # complex: re, im in turn
_udf("fft", lambda x, output="magnitude": np.abs(np.fft.fft(x)) if output == "magnitude" else np.fft.fft(x).view(float), D)
_udf("envelope", S.envelope, D)
_udf("hps", lambda x, n_harmonics=5: S.hps(x, n_harmonics), D)
_udf("bark_spectrum", lambda x, sample_rate, n_barks=24: S.bark_power(x, sample_rate, n_barks), D)
_udf("spectral_entropy", lambda x, sample_rate=1.0: S.welch_entropy(x))
_udf("roughness", lambda x, sample_rate: S.roughness(x, sample_rate))
_udf("sharpness", lambda x, sample_rate: S.sharpness(x, sample_rate))
_udf("spectral_centroid", lambda x, sample_rate: S.spectral_moment(x, sample_rate))
_udf("mean_square_frequency", lambda x, sample_rate: S.spectral_moment(x, sample_rate, 2))
_udf("rms_frequency", lambda x, sample_rate: S.spectral_moment(x, sample_rate, 2) ** 0.5)
_udf("frequency_variance", lambda x, sample_rate: S.spectral_moment(x, sample_rate, 2, True))
_udf("frequency_std", lambda x, sample_rate: S.spectral_moment(x, sample_rate, 2, True) ** 0.5)
_udf("envelope_rms", lambda x: float(np.sqrt((S.envelope(x) ** 2).mean())) if len(x) else 0.0)
_udf("hnr", S.hnr)
_udf("band_kurtosis", lambda x, sample_rate, low=0.0, high=None: S.kurtosis(S.band_pass(x, sample_rate, low, high)))
_udf("band_rms", lambda x, sample_rate, low=0.0, high=None: float(np.sqrt((S.band_pass(x, sample_rate, low, high) ** 2).mean())))
_udf("band_hnr", lambda x, sample_rate, low=0.0, high=None: S.hnr(S.band_pass(x, sample_rate, low, high)))
_udf("speed_rpm", lambda x, sample_rate, speed_min, speed_max, n_harmonics=5, speed_delta=10.0, std_min=0.01: S.speed_rpm(x, sample_rate, speed_min, speed_max, n_harmonics, speed_delta, std_min))


def add_features(df: DataFrame, columns: list[str], *specs: str | tuple[str, dict], keep: list[str] | None = None) -> DataFrame:
    """df (or its `keep` columns) with the features of all specs in one projection."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    new: dict[str, Column] = {}
    for spec in specs:
        name, config = (spec, {}) if isinstance(spec, str) else spec
        new |= FEATURES[name](columns, config)
    return df.select(*(keep if keep is not None else df.columns), *[v.alias(k) for k, v in new.items()])


def rolling_mean(df: DataFrame, column: str, window_size: int, *, order: str, series: tuple[str, ...] = (), padding: str | float | None = None, alignment: str = "right") -> DataFrame:
    """`{column}_rolling_mean` over window_size rows of each series, stride 1.

    padding None drops rows whose window is not full; `edge`, `nan`, `reflect`, `ring` or a number fill the window's missing rows.
    """
    w, right = window_size, alignment == "right"
    part = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    ordered = part.orderBy(order if right else F.desc(order))
    v = F.col(column).cast("double")
    frame = ordered.rowsBetween(-(w - 1), 0)
    n, total = F.count(F.lit(1)).over(frame), F.sum(v).over(frame)
    name = f"{column}_rolling_mean"
    if padding is None:
        return df.withColumn("__n", n).withColumn(name, total / w).where(F.col("__n") == w).drop("__n")
    if padding == "edge":
        return df.withColumn(name, (total + (w - n) * F.first(v).over(ordered.rowsBetween(Window.unboundedPreceding, 0))) / w)
    if padding == "nan":
        return df.withColumn(name, F.when(n < w, F.lit(float("nan"))).otherwise(total / w))
    if padding in ("reflect", "ring"):
        size = F.count(F.lit(1)).over(part)
        at = F.row_number().over(ordered)
        rows = df.withColumn("__at", at).withColumn("__size", size)
        source = F.when(F.col("__at").between(2, w), 2 - F.col("__at")) if padding == "reflect" else F.when(F.col("__at") > F.col("__size") - (w - 1), F.col("__at") - F.col("__size"))
        pads = rows.withColumn("__pad", source).where("__pad is not null").withColumn("__at", F.col("__pad")).drop("__pad").withColumn("__own", F.lit(False))
        both = rows.withColumn("__own", F.lit(True)).unionByName(pads)
        return both.withColumn(name, F.sum(v).over(part.orderBy("__at").rowsBetween(-(w - 1), 0)) / w).where("__own").drop("__own", "__at", "__size")
    return df.withColumn(name, (total + (w - n) * F.lit(float(padding))) / w)


class PcaFeature:
    """Principal components: covariance (ddof 1) by one aggregate, eigenvectors of the d x d matrix on the driver."""

    def __init__(self, columns: list[str], n_components: int):
        self.columns, self.n_components, self.mean = columns, n_components, None

    def fit(self, df: DataFrame) -> PcaFeature:
        from .linear import moments

        n, mean, cov = moments(df, self.columns)
        w, v = np.linalg.eigh(cov)
        self.mean, self.axes = mean, v[:, np.argsort(-w)][:, : self.n_components]
        self.axes *= np.sign(self.axes[np.abs(self.axes).argmax(0), range(self.axes.shape[1])])  # the largest weight is positive
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.mean is None:
            raise RuntimeError("fit first")
        return df.select("*", *[sum(((F.col(c) - float(m)) * float(a) for c, m, a in zip(self.columns, self.mean, self.axes[:, k], strict=True)), F.lit(0.0)).alias(f"pca_{k}") for k in range(self.n_components)])


FEATURES["rolling_mean_feature"] = lambda columns, config: (_ for _ in ()).throw(ValueError("ordered: use rolling_mean(df, ...)"))
FEATURES["pca_feature"] = lambda columns, config: (_ for _ in ()).throw(ValueError("learned: use PcaFeature"))
