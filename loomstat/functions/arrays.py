"""Signal cells (array<double> columns) as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + f(x))


def mean(a: Column, f=lambda x: x) -> Column:
    return F.when(F.size(a) > 0, total(a, f) / F.size(a)).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _moments(a: Column, body) -> Column:
    """body(array, mean, sample standard deviation); 0 for fewer than 2 values or no spread."""
    n = F.size(a)
    return let(
        F.struct(a.alias("a"), (total(a) / n).alias("m")),
        lambda s: let(F.sqrt(total(s["a"], lambda x: (x - s["m"]) * (x - s["m"])) / (F.size(s["a"]) - 1)), lambda d: body(s["a"], s["m"], d)),
    )


def std(a: Column) -> Column:
    return F.when(F.size(a) > 1, _moments(a, lambda x, m, d: d)).otherwise(0.0)


def variance(a: Column) -> Column:
    return F.pow(std(a), 2)


def _central(a: Column, k: int, less: float) -> Column:
    return F.when(F.size(a) > 1, _moments(a, lambda x, m, d: F.when(d == 0, 0.0).otherwise(total(x, lambda v: F.pow(v - m, k)) / F.size(x) / F.pow(d, k) - less))).otherwise(0.0)


def skewness(a: Column) -> Column:
    return _central(a, 3, 0.0)


def kurtosis(a: Column) -> Column:
    return _central(a, 4, 3.0)


def rms(a: Column) -> Column:
    return F.sqrt(mean(a, lambda x: x * x))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def gini(a: Column) -> Column:
    def body(s):
        n = F.size(s)
        return let(F.struct(total(s).alias("t"), total(F.transform(s, lambda x, i: x * (i + 1))).alias("w")), lambda r: F.when(r["t"] == 0, 0.0).otherwise(2 * r["w"] / (n * r["t"]) - (n + 1) / n))

    return F.when(F.size(a) > 0, let(F.array_sort(F.transform(a, F.abs)), body)).otherwise(0.0)


def slope(a: Column) -> Column:
    """Least-squares slope against the index."""
    n = F.size(a).cast("double")
    t = total(F.transform(a, lambda x, i: x * (i - (n - 1) / 2)))
    return F.when(F.size(a) > 1, t / (n * (n * n - 1) / 12)).otherwise(0.0)


def segments_kurtosis(a: Column, k: int) -> Column:
    size = F.floor(F.size(a) / k).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: kurtosis(F.slice(a, i * size + 1, size)))
    return F.when(size < 2, kurtosis(a)).otherwise(mean(parts))


def windows(a: Column, win: int) -> Column:
    """For each place the `win` values that end there, the array taken as a circle."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1 - win), F.lit(0)), lambda k: F.get(a, F.pmod(i + k, n))))


def smooth(a: Column, win: int, each) -> Column:
    return F.when(F.size(a) > 0, F.transform(windows(a, win), each)).otherwise(F.array().cast("array<double>"))


def gradient(a: Column) -> Column:
    """Central differences, one-sided at the ends."""
    return let(a, lambda v: F.transform(v, lambda x, i: F.when(F.size(v) < 2, 0.0).when(i == 0, F.get(v, F.lit(1)) - x).when(i == F.size(v) - 1, x - F.get(v, i - 1)).otherwise((F.get(v, i + 1) - F.get(v, i - 1)) / 2)))


def second_difference(a: Column) -> Column:
    """x[i-1] - 2 x[i] + x[i+1], mirrored at the ends."""
    return let(a, lambda v: F.transform(v, lambda x, i: F.coalesce(F.get(v, F.when(i == 0, 1).otherwise(i - 1)), x) - 2 * x + F.coalesce(F.get(v, F.when(i == F.size(v) - 1, i - 1).otherwise(i + 1)), x)))


def energy(w: Column, win: int) -> Column:
    """Sum of |rfft(w)|**2 by Parseval's identity."""
    alt = total(F.transform(w, lambda x, i: x * F.when(i % 2 == 0, 1.0).otherwise(-1.0)))
    even = F.pow(alt, 2) if win % 2 == 0 else F.lit(0.0)
    return (win * total(w, lambda x: x * x) + F.pow(total(w), 2) + even) / 2
