"""Scans over many ranges against plain running sums; smooth quantiles against the formula over sorted values."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from privloom.metrics import survival, utility
from privloom.operators import counts, encode, prefix, quantiles, relational
from privloom.operators.privacy import SeededNoise


@pytest.fixture
def many_ranges(monkeypatch):
    for f in (prefix.scan, prefix.value_ranks, prefix.order_statistics, prefix.cuts):
        monkeypatch.setattr(f, "__defaults__", tuple(7 if d == prefix.RANGE_ROWS else d for d in f.__defaults__))


def test_scan_with_all_values_distinct(spark, many_ranges):
    random.seed(1)
    values = random.sample(range(-10_000, 10_000), 500)
    rows = [(v / 7, i % 3 or None, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "x double, g int, n int")
    assert len(prefix.cuts(df, "x")) > 20
    for by in ([], ["g"]):
        got = prefix.scan(df, "x", {"s": F.col("n")}, by, "next").collect()
        assert len(got) == 500
        for g in {r[1] for r in rows} if by else {0}:
            mine = sorted(r for r in rows if not by or r[1] == g)
            sums, ahead = np.cumsum([r[2] for r in mine]), [r[0] for r in mine[1:]] + [None]
            found = sorted((r.x, r.s, r.next, r.s_total) for r in got if not by or r.g == g)
            assert found == [(r[0], s, a, sums[-1]) for r, s, a in zip(mine, sums, ahead, strict=True)]


def test_scan_of_text_ties_and_nulls(spark, many_ranges):
    df = spark.createDataFrame([(f"k{i * 37 % 400:04}",) for i in range(400)] + [(None,)], "k string")
    got = {r.k: r.s for r in prefix.scan(df, "k", {"s": F.lit(1)}).collect()}
    assert got[None] == 1 and [got[f"k{i:04}"] for i in range(400)] == list(range(2, 402))
    assert len(prefix.cuts(df, "k")) > 20
    assert prefix.scan(df.limit(0), "k", {"s": F.lit(1)}).collect() == []
    codes = encode.label_encode(df, "k", "code").collect()
    assert sorted(r.code for r in codes if r.k) == list(range(400)) and [r.code for r in codes if r.k is None] == [None]


def test_what_rests_on_scans(spark, many_ranges):
    random.seed(3)
    rows = [(i % 2, random.random(), random.choice([0, 1]), round(random.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "side int, x double, y int, t double")
    x = [[r[1] for r in rows if r[0] == s] for s in (0, 1)]
    grid = sorted(r[1] for r in rows)
    want = sum(abs(np.searchsorted(np.sort(x[0]), a, "right") / 150 - np.searchsorted(np.sort(x[1]), a, "right") / 150) * (b - a) for a, b in zip(grid, grid[1:]))
    assert utility.wasserstein(df, "x").first()[0] == pytest.approx(want)
    wins = [(a[1] > b[1]) + (a[1] == b[1]) / 2 for a in rows for b in rows if a[2] > b[2]]
    assert utility.auc(df, "x", "y").first()[0] == pytest.approx(sum(wins) / len(wins))
    ranks = {r.x: r.average_rank for r in counts.with_average_rank(df, "x").collect()}
    assert ranks == {v: i + 1 for i, v in enumerate(grid)}
    tied = {r.t: r.average_rank for r in counts.with_average_rank(df, "t").collect()}
    ts = sorted(r[3] for r in rows)
    assert tied == {t: (ts.index(t) + 1 + 300 - ts[::-1].index(t)) / 2 for t in set(ts)}
    rx, rt = np.array([ranks[r[1]] for r in rows]), np.array([tied[r[3]] for r in rows])
    assert counts.spearman(df, "x", "t").first()[0] == pytest.approx(np.corrcoef(rx, rt)[0, 1])
    assert [(r.rank, r.x) for r in relational.around_rank(df, "x", 0.5, 9).orderBy("rank").collect()] == [(i, grid[i]) for i in range(140, 159)]
    assert survival.log_rank(df, "t", "y", "side", 1).first()[0] is not None


def test_no_window_over_all_values(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit(0).alias("side"), (F.col("id") % 2).cast("int").alias("y"))
    made = (utility.wasserstein(df, "x"), utility.auc(df, "x", "y"), counts.spearman(df, "x", "y"), counts.with_average_rank(df, "x"), relational.around_rank(df, "x", 0.5, 2), encode.label_encode(df, "x", "code"))
    for plan in (d._jdf.queryExecution().analyzed().toString() for d in made):
        windows = re.findall(r"windowspecdefinition\(([^()]*?), (?:x|s|value|code)#\d+ ASC", plan)
        assert windows and all("__range" in w for w in windows)


def smooth(x, q, epsilon, delta):
    x, n = np.sort(x), len(x)
    i, beta = max(math.ceil(q * n) - 1, 0), epsilon / (2 * math.log(1 / delta))
    return x[i], max(math.exp(-beta * k) * (x[min(i + k, n - 1)] - x[max(i - k, 0)]) for k in range(min(n - 1, math.ceil(4 * math.sqrt(n + 1))) + 1))


@pytest.mark.parametrize("n", [1, 2, 30, 700])
def test_smooth_sensitivity(spark, many_ranges, n):
    x = np.round(np.random.default_rng(n).normal(0, 100, n))
    df = spark.createDataFrame([(str(v),) for v in x] + [(None,), ("NaN",), ("Infinity",), ("word",)], "x string")
    for q in (0.0, 0.05, 0.5, 1.0):
        one = quantiles.smooth_sensitivity(df, "x", q, 0.7, 1e-5).first()
        assert (one.value, one.sensitivity, one.n) == (*map(pytest.approx, smooth(x, q, 0.7, 1e-5)), n)


def test_bounds_and_their_repair(spark):
    x = np.arange(1000.0)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    noise, same = SeededNoise(4), SeededNoise(4)
    want = []
    for q in (0.05, 0.95):
        value, s = smooth(x, q, 50.0, 5e-7)
        want.append(value + same.laplace(2 * s / 50.0))
    assert quantiles.smooth_bounds(df, "x", 100.0, 1e-6, noise=noise) == pytest.approx(tuple(want))
    lo, hi = quantiles.smooth_bounds(df, "x", 0.01, 1e-6, public=(10.0, 500.0), noise=SeededNoise(2))
    assert 10 <= lo < hi
    assert quantiles.repaired(7.0, 3.0, (0.0, 1000.0), 0.0) == (7.0, 17.0)
    assert quantiles.repaired(7.0, 3.0, None, 99.0) == (7.0, 8.0)
    assert quantiles.repaired(-5.0, 2000.0, (0.0, 1000.0), 0.0) == (0.0, 1000.0)
    assert quantiles.smooth_bounds(df.limit(0), "x", 1.0, 1e-6) == (0.0, 1.0)
    assert quantiles.smooth_bounds(df.limit(0), "x", 1.0, 1e-6, public=(2.0, 3.0)) == (2.0, 3.0)
