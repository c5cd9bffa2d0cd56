"""Rank correlations of many pairs: columns without nulls share their ranks."""

import itertools
import random

import numpy as np
import pytest

from privloom.operators import counts


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("gap", [False, True])
def test_pairs_of_groups(spark, monkeypatch, few, gap):
    monkeypatch.setattr(counts, "FEW_LEVELS", few)
    random.seed(4)
    rows = [(random.choice([0, 1, None]), random.randrange(5), random.random(), random.randrange(40) / 3, 1.0) for i in range(300)]
    if gap:
        rows.append((0, 3, None, 9.0, 1.0))
    df = spark.createDataFrame(rows, "side int, a int, b double, c double, k double")
    made = counts.spearman_pairs(df, ["b", "a", "c", "k"], ["side"])
    got = {(r.side, r.a, r.b): r.rho for r in made.collect()}
    assert len(got) == 18
    place = {"a": 1, "b": 2, "c": 3}
    rank = lambda x: np.array([np.mean([i + 1 for i, v in enumerate(sorted(x)) if v == y]) for y in x])
    for side, (x, y) in itertools.product([0, 1, None], itertools.combinations("bac", 2)):
        pairs = [(r[place[x]], r[place[y]]) for r in rows if r[0] == side and None not in (r[place[x]], r[place[y]])]
        assert got[side, x, y] == pytest.approx(np.corrcoef(rank([p[0] for p in pairs]), rank([p[1] for p in pairs]))[0, 1])
        assert got[side, x, "k"] is None
    # rows are copied for each pair only where nulls differ: the cells of all pairs hold no column "cell" otherwise
    assert ("AS cell#" in made._jdf.queryExecution().analyzed().toString()) == gap
