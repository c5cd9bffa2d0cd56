"""Aggregation of results over runs: seeds, intervals, best values, bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def student_quantile(p: float, df: int) -> float:
    """By bisection of the distribution function, a regularised incomplete beta function by its continued fraction."""

    def beta_fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
        out = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d or tiny), 1 + num / c or tiny
                out *= d * c
        return out

    def cdf(t: float) -> float:
        x, a, b = df / (df + t * t), df / 2, 0.5
        front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if 0 < x < 1 else 0.0
        tail = front * beta_fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(1 - x, b, a) / b
        return 1 - tail / 2 if t > 0 else tail / 2

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def over_seeds(runs: DataFrame, by: Sequence[str], metric: str, most: int = 1_000) -> DataFrame:
    """(by, n, mean, std, se, half): n counts the values that aren't null; half is half the 95 % t interval, null for a single value.

    Student's quantiles are a small table up to ``most`` degrees of freedom, and the normal one beyond.
    """
    spark = runs.sparkSession
    agg = runs.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    sizes = sorted({r.n for r in agg.select("n").distinct().filter(F.col("n").between(2, most + 1)).collect()})
    table = spark.createDataFrame([(int(n), student_quantile(0.975, n - 1)) for n in sizes], "n long, t double")
    agg = agg.join(F.broadcast(table), "n", "left").withColumn("se", F.col("std") / F.sqrt("n"))
    t = F.when(F.col("n") > most + 1, F.lit(1.959963984540054)).otherwise(F.col("t"))
    return agg.select(*by, "n", "mean", "std", "se", (t * F.col("se")).alias("half"))


def ablation_intervals(runs: DataFrame, by: Sequence[str], metric: str, most: int = 1_000) -> DataFrame:
    """(by, runs, n, mean, std, se, half) of an ablation's conditions: n counts the values that aren't null and gives the standard error, while Student's
    quantile goes by all runs of the condition. A single value has no spread (0), a condition without values has nulls; a single run has no interval."""
    spark = runs.sparkSession
    agg = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    agg = agg.withColumn("std", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std")))
    sizes = sorted({r.runs for r in agg.select("runs").distinct().filter(F.col("runs").between(2, most + 1)).collect()})
    table = spark.createDataFrame([(int(n), student_quantile(0.975, n - 1)) for n in sizes], "runs long, t double")
    agg = agg.join(F.broadcast(table), "runs", "left").withColumn("se", F.when(F.col("n") > 0, F.col("std") / F.sqrt("n")))
    t = F.when(F.col("runs") > most + 1, F.lit(1.959963984540054)).otherwise(F.col("t"))
    return agg.select(*by, "runs", "n", "mean", "std", "se", (t * F.col("se")).alias("half"))


def best(results: DataFrame, by: Sequence[str], name: str, metric: str, lower: bool, exclude: Sequence[str] = ()) -> DataFrame:
    """(by, best): the name with the best value in each group, ties to the first name, the excluded left out."""
    sign = 1 if lower else -1
    kept = results.filter(~F.col(name).isin(*exclude)) if exclude else results
    return kept.filter(F.col(metric).isNotNull()).groupBy(*by).agg(F.min_by(name, F.struct(F.col(metric) * sign, name)).alias("best"))


def band(curves: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, mean, lo, hi): pointwise mean and 2.5 and 97.5 percentiles."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return curves.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q")).select(*by, "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def invariant(results: DataFrame, by: Sequence[str], metrics: Sequence[str], within: float = 1e-9) -> DataFrame:
    """(by, metric, constant): whether a metric has hardly any spread over the runs of a group."""
    one = results.groupBy(*by).agg(*[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(m) for m in metrics])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) <= within).alias("constant")) for m in metrics]))
    return one.select(*by, pairs.alias("p")).select(*by, "p.*")
