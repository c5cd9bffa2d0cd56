"""Exact quantiles from bracketed ranges, against Spark's own percentile, which gathers all distinct values in one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from privloom.operators import counts, prefix

AT = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy", [3, 10_000])
def test_as_percentile_gives_them(spark, accuracy, monkeypatch):
    random.seed(2)
    rows = [(i % 3 if i % 7 else None, random.choice([random.gauss(0, 1e6), 5.0, -0.0, None, float("inf")])) for i in range(3000)] + [(9, None), (8, float("nan")), (7, 1.5)]
    df = spark.createDataFrame(rows, "g int, x double")
    for groups in (prefix.FEW_GROUPS, 2):
        monkeypatch.setattr(prefix, "FEW_GROUPS", groups)
        for by in ([], ["g"]):
            want = {tuple(r[b] for b in by): (r.q, r.n) for r in df.groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, AT))).alias("q"), F.count("x").alias("n")).collect()}
            got = {tuple(r[b] for b in by): (r.q, r.n) for r in prefix.quantiles(df, F.col("x"), AT, by, accuracy).collect()}
            assert got.keys() == want.keys()
            for k, (q, n) in want.items():
                assert got[k][1] == n and (got[k][0] == q if q is None else got[k][0] == pytest.approx(q, nan_ok=True))


def test_no_row_and_few_values_in_the_last_step(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    assert counts.quantiles(df.limit(0), "x", [0.5]).collect() == [(None,)]
    assert counts.quantiles(df, "x", [0.5]).first()[0] == df.agg(F.percentile("x", F.array(F.lit(0.5)))).first()[0]
    one = prefix.quantiles(df, F.col("x"), [0.5])
    assert not re.search(r"\bpercentile\(", one._jdf.queryExecution().analyzed().toString())
