"""Nearest neighbours by balls, concordance by halving: against all pairs."""

import numpy as np
import pytest

from privloom.metrics.survival import concordance
from privloom.operators.neighbours import nearest_distances, visited_share


def points(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "k long, v array<double>")


@pytest.mark.parametrize("block", [64, 4096])
def test_all_distances_of_clustered_and_repeated_points(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (8, 3))
    x = np.concatenate([centres[rng.integers(0, 8, 260)] + rng.normal(0, 1, (260, 3)), np.tile(centres[:1], (40, 1))])
    q = centres[rng.integers(0, 8, 60)] + rng.normal(0, 1, (60, 3))
    far = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    got = {r.k: r.distances for r in nearest_distances(points(spark, q, 1000), points(spark, x), "k", "v", 3, block).collect()}
    assert len(got) == 60
    for i in range(60):
        assert got[1000 + i] == pytest.approx(np.sort(far[i])[:3].tolist())
    assert visited_share(points(spark, q, 1000), points(spark, x), "k", "v", 3, block) < 1 / 3


def test_own_keys_few_points_and_none(spark):
    x = points(spark, [[0, 0], [3, 4], [6, 8]])
    got = {r.k: r.distances for r in nearest_distances(x, x, "k", "v", 2).collect()}
    assert got == {0: [5.0, 10.0], 1: [5.0, 5.0], 2: [5.0, 10.0]}
    assert nearest_distances(x.limit(1), x.limit(1), "k", "v").collect() == [] == nearest_distances(x, x.limit(0), "k", "v").collect()
    assert nearest_distances(x.limit(0), x, "k", "v").collect() == []


@pytest.mark.parametrize("digits", [0, 1, 9])
def test_concordance(spark, digits):
    rng = np.random.default_rng(digits)
    rows = [(float(t), int(e), round(float(r), digits)) for t, e, r in zip(rng.integers(1, 40, 120), rng.integers(0, 2, 120), rng.random(120) * 5)]
    pairs = wins = 0.0
    for t, e, r in rows:
        for t2, _, r2 in rows:
            if e and t2 > t:
                pairs += 1
                wins += (r > r2) + (r == r2) / 2
    one = concordance(spark.createDataFrame(rows + [(None, 1, 1.0)], "t double, e int, r double"), "t", "e", "r").first()
    assert one.pairs == pairs and one.concordance == pytest.approx(wins / pairs)


def test_concordance_without_pairs(spark):
    df = spark.createDataFrame([(1.0, 1, 2.0), (1.0, 0, 3.0)], "t double, e int, r double")
    assert concordance(df, "t", "e", "r").first().pairs == 0 and concordance(df.limit(0), "t", "e", "r").first().concordance is None


def test_many_queries_far_apart_in_scale_copies_and_what_is_no_number(spark):
    """Work that goes by products has the distances of differences: of copies, of far offsets, of one point far from the others, of huge and missing numbers."""
    rng = np.random.default_rng(5)
    x = np.concatenate([1e6 + rng.normal(0, 1e-3, (150, 5)), np.tile(rng.normal(0, 1, (1, 5)), (150, 1)), rng.normal(0, 1, (40, 5)), [[1e8] * 5, [1e170] * 5]])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.nan)
    for block in (64, None):
        got = {r.k: r.distances for r in nearest_distances(points(spark, x), points(spark, x), "k", "v", 2, block).collect()}
        for i in range(len(x)):
            assert got[i] == pytest.approx(np.sort(far[i])[:2].tolist(), rel=1e-9, abs=1e-12)
    one = {r.k: r.distances for r in nearest_distances(points(spark, [[float("nan"), 0], [0, 0]]), points(spark, [[3, 4]], 9), "k", "v").collect()}
    assert np.isnan(one[0][0]) and one[1] == [5.0]


def test_pivots_of_copies_differ_and_tasks_are_bounded_by_blocks(spark):
    """Copies have equal hashes: pivots were once the same vector many times, and every ball was visited row by row."""
    from privloom.operators import neighbours as N

    x = np.repeat(np.arange(40.0)[:, None], 25, 0)
    df = points(spark, x).select("k", "v")
    pivots = N.pivots_of(df, 1000)
    assert len(pivots) == len(np.unique(pivots)) == 31
    plan = N._plan(df, df, "k", "v", 1, 100)
    balls = plan[4]
    assert plan[2].groupBy("cell").count().agg({"count": "max"}).first()[0] <= 200 and balls.sizes.sum() == 1000
    assert N._visits(plan[1], balls, "long", "array<double>").count() <= 1000 * (balls.cell + balls.slices).max()
