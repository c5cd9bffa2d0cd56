import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from privloom.operators import graphical as G
from privloom.operators import network as N
from privloom.operators import privacy as P


@pytest.fixture(scope="module")
def coded(spark):
    df = spark.range(4000).select("id", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("a"))
    df = df.withColumn("b", F.pmod(F.col("a") + F.when(F.col("id") % 5 == 0, 1).otherwise(0), F.lit(3)).cast("int"))
    return df.withColumn("c", (F.when(F.col("id") % 7 == 0, 1 - F.col("b") % 2).otherwise(F.col("b") % 2)).cast("int")).withColumn("d", (F.col("id") % 4).cast("int"))


DOMAIN = G.Domain({"a": 3, "b": 3, "c": 2, "d": 4})


def test_belief_propagation_against_enumeration():
    rng = np.random.default_rng(1)
    m = G.Model(DOMAIN, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], 100.0)
    m.potentials = [G.Factor(f.domain, rng.normal(size=f.values.shape)) for f in m.potentials]
    whole = G.Factor.constant(DOMAIN)
    for f in m.potentials:
        whole = whole + f
    p = np.exp(whole.values)
    whole = G.Factor(DOMAIN, 100 * p / p.sum())
    for names in itertools.chain.from_iterable(itertools.combinations(DOMAIN.names, k) for k in (1, 2, 3, 4)):
        assert np.allclose(m.marginal(names).values, whole.reduce(names).values)


def test_fit_reproduces_marginals_and_samples_them(coded):
    cliques = [("a", "b"), ("b", "c"), ("d",)]
    measured = G.measure(coded, DOMAIN, cliques, None)
    m = G.Model(DOMAIN, cliques, G.total_of(measured))
    m.fit(measured, steps=2000, tolerance=1e-12)
    for c, y, _ in measured:
        assert np.abs(m.marginal(c).values - y).max() < 0.02 * y.sum()
    out = m.sample(coded.select("id"), "id").persist()
    assert out.count() == 4000
    for c, y, _ in G.measure(out, DOMAIN, cliques, None):
        want = dict((k, v) for k, v, _ in measured)[c]
        assert np.abs(y - want).max() < 0.03 * 4000
    out.unpersist()


def test_noise_scales(coded):
    noisy = G.measure(coded, DOMAIN, [("a", "b")] * 1, 1.0, 1e-5, P.SeededNoise(3))
    exact = G.measure(coded, DOMAIN, [("a", "b")], None)
    assert 0 < np.abs(noisy[0][1] - exact[0][1]).mean() < 10 * noisy[0][2]
    big = P.SeededNoise(1).laplace(2.0, 200_000)
    assert abs(big.mean()) < 0.05 and np.abs(big).mean() == pytest.approx(2.0, rel=0.02)


def test_network_tables_and_sample(coded):
    sizes = {"a": 3, "b": 3, "c": 2, "d": 4}
    net = N.fit(coded, sizes, ["a", "b", "c", "d"], None, alpha=0.0)
    assert net.parents["b"] == ["a"] and net.parents["c"][0] == "b"
    assert all(np.allclose(t.sum(1), 1) for t in net.tables.values())
    out = net.sample(coded.select("id"), "id")
    got = {(r.a, r.b): r["count"] for r in out.groupBy("a", "b").count().collect()}
    want = {(r.a, r.b): r["count"] for r in coded.groupBy("a", "b").count().collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 150 for k in want)
    noisy = N.fit(coded, sizes, ["a", "b", "c", "d"], 1.0, noise=P.SeededNoise(4))
    assert sum(noisy.spent.values()) == pytest.approx(1.0)
    none = N.fit(coded, sizes, ["a", "b", "c", "d"], None, forbidden={"b": ["a"]})
    assert none.parents["b"] == []


def test_accounting():
    rho = P.rho_of(1.0, 1e-5)
    assert 0.01 < rho < 0.05 and P.epsilon_of(rho, 1e-5) == pytest.approx(1.0, abs=1e-6)
    assert P.delta_of(rho, 1.0) == pytest.approx(1e-5, rel=1e-3)
    assert P.rho_of(2.0, 1e-5) > rho
    assert P.exponential_probabilities([0, 0, 1], 2.0, 1.0).sum() == pytest.approx(1.0)
    parts = P.split_budget(1.0, 4)
    assert parts["n_records"] + parts["missing"] + parts["strategy"] + 4 * parts["bounds_each"] == pytest.approx(1.0)
    bins = P.tree_bins(np.array([1000] * 4 + [1] * 60), 5.0, 8, P.SeededNoise(2))
    assert bins[0][0] == 0 and bins[-1][1] == 64 and all(a[1] == b[0] for a, b in zip(bins, bins[1:]))
    band = np.sort(np.random.default_rng(0).normal(size=401))
    assert abs(P.smooth_quantile(band, 200, 50.0, 1e-6, -5, 5, P.SeededNoise(1))) < 0.5
    lo, hi = P.private_bounds(0, 1, 1.0, -10, 10, P.SeededNoise(1))
    assert -10 <= lo < hi <= 10


def test_trees():
    assert len(G.greedy_cliques({("a", "b"): 1.0, ("b", "c"): 2.0, ("a", "c"): 0.1}, ["a", "b", "c"])) == 2
    with pytest.raises(ValueError):
        G.Model(G.Domain({c: 100 for c in "abcdef"}), [tuple("abcdef")], 1.0)


def test_order_temperature_and_extensions(spark):
    import numpy as np

    from privloom.engines import NetworkEngine
    from privloom.operators.network import column_order, tempered
    from privloom.schema import Schema

    assert column_order(["a", "b", "c"], ["c", "z", "a", "c"]) == ["c", "a", "b"]
    p = np.array([[0.5, 0.3, 0.2], [1.0, 0.0, 0.0]])
    assert tempered(p, 0.5)[0] == pytest.approx(np.array([25, 9, 4]) / 38) and tempered(p, 0.5)[1].tolist() == [1, 0, 0] and tempered(p, 1.0) is p
    with pytest.raises(ValueError):
        tempered(p, 0)
    df = spark.createDataFrame([(i % 3, i % 3, i % 2) for i in range(600)], "a int, b int, c int").selectExpr("string(a) a", "string(b) b", "c")
    doc = {"column_types": {"a": "categorical", "b": "categorical", "c": "binary"}, "public_categories": {"a": ["0", "1", "2"], "b": ["0", "1", "2"]}, "dataset_info": {"n_records": 600}}
    ordered = NetworkEngine(epsilon=None).fit(df, Schema.parse({**doc, "extensions": {"partial_order": ["c", "b"], "forbidden_parents": {"a": ["b"]}, "max_parents": 1, "alpha": {"a": 5.0}}}))
    assert ordered.net.order == ["c", "b", "a"] and ordered.net.parents == {"c": [], "b": ["c"], "a": ["c"]}
    plain = NetworkEngine(epsilon=None, alpha=None).fit(df, Schema.parse(doc))
    assert plain.sample(spark, 500, temperature=0.05).filter("a <> b").count() == 0
