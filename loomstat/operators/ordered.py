"""Running totals and order statistics over one global order, without a task that holds all rows.

Values are cut into ranges at sampled boundaries; a range's rows are sorted in
one task, and the totals of the ranges before it are added. The boundaries
only balance the ranges: results are the same wherever they lie.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows per range that are aimed at, and the most ranges.
RANGE_ROWS, MOST_RANGES = 250_000, 1 << 12
#: Up to so many rows an exact percentile is one aggregate.
DIRECT = 1 << 20


def boundaries(df: DataFrame, column: str, rows: int | None = None) -> list[float]:
    """Cut points of a numeric column, for ranges of about RANGE_ROWS rows; none for small tables."""
    n = df.count() if rows is None else rows
    parts = min(MOST_RANGES, n // RANGE_ROWS + 1)
    if parts < 2:
        return []
    at = [k / parts for k in range(1, parts)]
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), at, 10 * parts).alias("c")).first()["c"]
    return sorted({c for c in cuts or () if c is not None and not math.isnan(c)})


def range_of(value: Column, cuts: list[float]) -> Column:
    """The number of cut points below value, by halving; null is in range 0, NaN in the last."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= cuts[mid], within(lo, mid)).otherwise(within(mid + 1, hi))

    return F.when(value.isNull(), 0).otherwise(within(0, len(cuts))).cast("int") if cuts else F.lit(0)


def running_sums(at: DataFrame, value: str, sums: list[str], series=(), cuts: list[float] | None = None) -> DataFrame:
    """at (one row a series and value) with `{c}_upto`, the sum of c over values up to the row's own, and `{c}_all`."""
    cuts = boundaries(at, value) if cuts is None else cuts
    keys = [*series, "__range"]
    rows = at.withColumn("__range", range_of(F.col(value).cast("double"), cuts))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{c}_upto": F.sum(c).over(run) for c in sums})
    # a row a series and range: a series' ranges, MOST_RANGES + 1 at most, are added up in an array
    parts = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).groupBy(*series).agg(F.collect_list(F.struct("__range", *sums)).alias("__p"))
    total = lambda xs, c: F.aggregate(xs, F.lit(0).cast(dict(at.dtypes)[c]), lambda t, x: t + x[c])
    below = F.transform("__p", lambda p: F.struct(p["__range"].alias("__range"), *[total(F.filter("__p", lambda q: q["__range"] < p["__range"]), c).alias(f"__below_{c}") for c in sums], *[total(F.col("__p"), c).alias(f"{c}_all") for c in sums]))
    parts = parts.select(*series, F.inline(below))
    if series:
        cond = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
        out = rows.alias("r").join(parts.alias("p"), cond)
    else:
        out = rows.alias("r").join(F.broadcast(parts).alias("p"), F.col("r.__range") == F.col("p.__range"))  # MOST_RANGES + 1 rows at most
    add = {f"{c}_upto": (F.col(f"r.{c}_upto") + F.col(f"p.__below_{c}")).alias(f"{c}_upto") for c in sums}
    return out.select(*[F.col(f"r.{c}") for c in at.columns], *add.values(), *[F.col(f"p.{c}_all") for c in sums])


def exact_percentile(df: DataFrame, column: str, fraction: float) -> float | None:
    """The percentile with linear interpolation, of the values that are not null.

    Larger tables are bracketed by approximate percentiles until what is inside is small or one value.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = rows.count()
    if not n:
        return None
    if n <= DIRECT:
        return rows.agg(F.percentile("v", fraction)).first()[0]
    place = fraction * (n - 1)
    want = [math.floor(place), math.ceil(place)]
    lo = hi = None
    before, inside = 0, n
    while True:
        part = rows if lo is None else rows.where((F.col("v") >= lo) & (F.col("v") <= hi))
        if inside <= DIRECT or (lo is not None and lo == hi):
            break
        slack = 4 / 10_000
        ask = [max((want[0] - before) / inside - slack, 0.0), min((want[1] - before) / inside + slack, 1.0)]
        a, b = part.agg(F.percentile_approx("v", ask, 10_000).alias("c")).first()["c"]
        r = part.agg(F.sum((F.col("v") < a).cast("long")), F.sum(((F.col("v") >= a) & (F.col("v") <= b)).cast("long"))).first()
        if not (before + r[0] <= want[0] and want[1] < before + r[0] + r[1]) or r[1] == inside:
            break  # the bracket doesn't get smaller: the rest is counted by value
        lo, hi, before, inside = a, b, before + r[0], r[1]
    if lo is not None and lo == hi:
        return lo
    at = running_sums(part.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v", ["c"])
    found = [at.where(F.col("c_upto") > w - before).agg(F.min("v")).first()[0] for w in want]
    return found[0] if want[0] == want[1] else (want[1] - place) * found[0] + (place - want[0]) * found[1]


def ranks(train: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """value, le, lt: for each distinct value how many of train (value, c) are not above it, and below it."""
    both = train.select(value, "c").unionByName(values.select(value, F.lit(0).cast("long").alias("c"))).where(F.col(value).isNotNull())
    at = running_sums(both.groupBy(value).agg(F.sum("c").alias("c")), value, ["c"])
    return at.select(value, F.col("c_upto").alias("le"), (F.col("c_upto") - F.col("c")).alias("lt"))


__all__ = ["boundaries", "exact_percentile", "range_of", "ranks", "running_sums"]
