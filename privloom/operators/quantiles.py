"""Quantiles and bounds with noise of their smooth sensitivity, measured over distributed rows.

The mechanism needs the order statistics within ``4 sqrt(n + 1)`` ranks of a quantile: these are selected by ranks of distinct
values, and two of them at a time, equally far from the quantile, are weighed in Spark. One row comes back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privloom.functions import number
from privloom.operators.prefix import order_statistics
from privloom.operators.privacy import SecureNoise


def place_of(q: float) -> Column:
    """0-based rank of a quantile among ``n`` values: the first that leaves the share ``q`` at or below it."""
    return F.greatest(F.least(F.ceil(F.lit(float(q)) * F.col("n")).cast("long") - 1, F.col("n") - 1), F.lit(0).cast("long"))


def reach() -> Column:
    """How far from the quantile the mechanism looks among ``n`` values."""
    return F.least(F.ceil(4 * F.sqrt(F.col("n") + 1)).cast("long"), F.col("n") - 1)


def smooth_sensitivity(df: DataFrame, column: str, q: float, epsilon: float, delta: float) -> DataFrame:
    """One row (value, sensitivity, n): the quantile and the most that exp(-beta k) times the gap of the values k ranks to either side comes to, ranks
    that leave the table being its ends. Nulls, text and infinities are left out; without values the row is null, null, 0."""
    finite = df.select(number(F.col(column)).alias("x")).filter(F.abs("x") < float("inf"))
    beta = epsilon / (2 * math.log(1 / delta))
    place = place_of(q)
    band = order_statistics(finite, "x", place - reach(), place + reach())
    band = band.withColumns({"place": place, "reach": reach()})
    # k of a rank that is an end of the table stands for all larger k too
    k = F.abs(F.col("rank") - F.col("place"))
    low = F.when((F.col("rank") == 0) & (F.col("rank") <= F.col("place")), F.sequence(k, F.col("reach"))).when(F.col("rank") <= F.col("place"), F.array(k))
    high = F.when((F.col("rank") == F.col("n") - 1) & (F.col("rank") >= F.col("place")), F.sequence(k, F.col("reach"))).when(F.col("rank") >= F.col("place"), F.array(k))
    lows = band.filter(low.isNotNull()).select(F.explode(low).alias("k"), F.col("x").alias("l"), F.lit(None).cast("double").alias("h"), "n")
    highs = band.filter(high.isNotNull()).select(F.explode(high).alias("k"), F.lit(None).cast("double").alias("l"), F.col("x").alias("h"), "n")
    gaps = lows.unionByName(highs).groupBy("k").agg(F.max("l").alias("l"), F.max("h").alias("h"), F.max("n").alias("n"))
    return gaps.agg(
        F.max(F.when(F.col("k") == 0, F.col("l"))).alias("value"), F.max(F.exp(F.lit(-beta) * F.col("k")) * (F.col("h") - F.col("l"))).alias("sensitivity"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n")
    )


def smooth_quantile(df: DataFrame, column: str, q: float, epsilon: float, delta: float, noise: SecureNoise | None = None) -> float | None:
    """An (epsilon, delta) private quantile, without public limits; None without values."""
    one = smooth_sensitivity(df, column, q, epsilon, delta).first()
    return None if not one.n else one.value + float((noise or SecureNoise()).laplace(2 * one.sensitivity / epsilon))


def repaired(low: float, high: float, public: tuple[float, float] | None, span: float) -> tuple[float, float]:
    """Two noisy ends as bounds: within the public limits, and the upper one moved above the lower one where noise has crossed them, by a hundredth of
    the public distance (1 at least) or, without limits, of ``span`` and 1."""
    if public:
        low, high = (min(max(x, public[0]), public[1]) for x in (low, high))
    if not math.isfinite(high) or high <= low:
        high = low + (max((public[1] - public[0]) / 100, 1.0) if public else (span + 1) / 100)
    return low, high


def smooth_bounds(df: DataFrame, column: str, epsilon: float, delta: float, alpha: float = 0.05, public: tuple[float, float] | None = None, noise: SecureNoise | None = None) -> tuple[float, float]:
    """Bounds from the quantiles ``alpha`` and 1 - alpha with half of the budget each. Without values the public limits, or 0 and 1.

    The width that crossed ends get without public limits is read from the rows: give limits where that must be private too.
    """
    noise = noise or SecureNoise()
    ends = [smooth_quantile(df, column, q, epsilon / 2, delta / 2, noise) for q in (alpha, 1 - alpha)]
    if ends[0] is None:
        return public or (0.0, 1.0)
    span = 0.0
    if public is None and ends[1] <= ends[0]:
        x = number(F.col(column))
        one = df.filter(F.abs(x) < float("inf")).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        span = one.hi - one.lo
    return repaired(ends[0], ends[1], public, span)
