"""Third engine, larger cliques, compression, structural zeros, PrivTree over rows, results and reports."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from privloom.engines import ENGINES, ClusteredEngine, GraphicalEngine
from privloom.operators import clustered as K
from privloom.operators import encode as E
from privloom.operators import results
from privloom.operators.cliques import fitting, grow_cliques
from privloom.operators.compression import Compression
from privloom.operators.privacy import SeededNoise, tree_bins, tree_of_rows
from privloom.schema import Schema


def planted(spark, n=3000):
    """c follows a, d is the exclusive or of a's parity and b; e is alone."""
    rng = np.random.default_rng(0)
    a, b, e = rng.integers(0, 6, n), rng.integers(0, 2, n), rng.integers(0, 3, n)
    c, d = (a + (rng.random(n) < 0.05)) % 6, (a % 2) ^ b
    return spark.createDataFrame([tuple(map(int, x)) for x in zip(a, b, c, d, e)], "a int, b int, c int, d int, e int"), {"a": 6, "b": 2, "c": 6, "d": 2, "e": 3}


def test_search_finds_the_planted_network(spark):
    df, sizes = planted(spark)
    edges = dict(K.search(df, sizes, None, 2, root="a"))
    assert "a" in edges["c"] and edges["e"] == [] and (set(edges["d"]) >= {"b"} or set(edges["b"]) >= {"d"})
    noisy = K.search(df, sizes, 1.0, 2, noise=SeededNoise(1))
    assert sorted(c for c, _ in noisy) == sorted(sizes) and noisy[0][1] == []
    assert noisy == K.search(df, sizes, 1.0, 2, noise=SeededNoise(1))
    assert K.search(df, sizes, None, 0, root="b")[1:] == [(c, []) for c in "acde"]


@pytest.mark.parametrize("small", [0, 100_000])
def test_clusters_of_distinct_codes(spark, monkeypatch, small):
    monkeypatch.setattr(K, "SMALL", small)
    df = spark.createDataFrame([(x, y, 0) for x, y in [(0, 0), (0, 1), (9, 9), (9, 8)] * 5], "x int, y int, z int")
    cells = K.candidate_cells(df, [("x", "y")], ["z"])
    found = K.cluster(cells, 2)[0]
    assert sorted(found.tolist()) == [[0.0, 0.5], [9.0, 8.5]]
    wide, sizes = planted(spark, 800)
    both = K.candidate_cells(wide, [("a", "c"), ("a", "b")], list(sizes))
    monkeypatch.setattr(K, "SMALL", 100_000)
    here = K.cluster(both, 4)
    monkeypatch.setattr(K, "SMALL", small)
    there = K.cluster(both, 4)
    assert all(here[i] == pytest.approx(there[i]) for i in (0, 1))
    assert [(r["set"], r.child, r.score) for r in K.cluster_scores(cells, {0: found}).collect()] == [(0, "z", 0.0)]
    assert K.first_centroids(np.array([[1.0], [1.0], [5.0]]), np.array([1, 1, 1]), 3).tolist() == [[1.0], [5.0]]


def test_sparse_tables(spark):
    df, sizes = planted(spark)
    net = K.tables(df, K.SparseNetwork(sizes, [("a", []), ("c", ["a"]), ("b", []), ("d", ["a", "b"]), ("e", [])]), 2, None)
    counts = {(r.a, r.c): r["count"] for r in df.groupBy("a", "c").count().collect()}
    row = np.array([counts.get((2, k), 0) + 1 for k in range(6)], float)
    assert net.tables["c"][2] == pytest.approx(row / row.sum())
    noisy = K.tables(df, K.SparseNetwork(sizes, [("a", []), ("c", ["a"]), ("b", []), ("d", ["a", "b"]), ("e", [])]), 2, 0.5, SeededNoise(2))
    assert all(p.min() >= 0 and p.sum() == pytest.approx(1) for t in noisy.tables.values() for p in t.values())
    sample = net.sample(spark.range(4000), "id")
    assert sample.filter("d <> (a % 2) ^ b").count() / 4000 < 0.02
    assert K.fit(df, sizes, None, root="a").edges[0] == ("a", [])


def test_clustered_engine(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), "xyz"[k], float(k * 100 + rng.random() * 20), None if rng.random() < 0.1 else int(rng.integers(0, 4))) for k in rng.integers(0, 3, 1500)]
    df = spark.createDataFrame(rows, "k int, s string, v double, w int")
    engine = ClusteredEngine(epsilon=None, bins=30).fit(df)
    out = engine.sample(spark, 1500)
    assert out.dtypes == df.dtypes and out.collect() == engine.sample(spark, 1500).collect()
    assert out.filter("s <> element_at(array('x', 'y', 'z'), k + 1)").count() < 75
    assert 60 < out.filter("w is null").count() < 300 and out.filter("v < 0 or v > 220").count() == 0
    schema = Schema.parse({"column_types": {"k": "integer", "s": "categorical", "v": "continuous"}, "public_bounds": {"k": {"min": 0, "max": 2, "n_bins": 10}, "v": {"min": 0, "max": 200, "n_bins": 20}}, "public_categories": {"s": ["x", "y", "z"]}})
    private = ENGINES["clustered"](epsilon=5.0, noise=SeededNoise(1)).fit(df, schema)
    assert private.used_bins == 15 and private.source == "schema median"
    got = private.sample(spark, 400)
    assert got.columns == ["k", "s", "v"] and got.filter("v < 0 or v > 200 or s not in ('x', 'y', 'z')").count() == 0
    assert private.report()["epsilon_structure"] == 2.5


def test_cliques_of_three(spark):
    df, sizes = planted(spark)
    cliques = grow_cliques(df, sizes, 3)
    assert any({"a", "b", "d"} == set(c) for c in cliques) and max(map(len, cliques)) == 3
    assert all(len(c) <= 2 for c in grow_cliques(df, sizes, 2))
    assert fitting([("a", "c"), ("b", "d")], "e", sizes, 20) == [("b", "d")] and fitting([("a", "c")], "e", sizes, 20) == [("a", "c")]
    noisy = grow_cliques(df, sizes, 3, 2.0, most_candidates=2, most_cells=500, noise=SeededNoise(4))
    assert {x for c in noisy for x in c} == set(sizes)


SCHEMA = {"column_types": {"k": "categorical", "b": "binary"}, "public_categories": {"k": [f"v{i}" for i in range(12)]}, "dataset_info": {"n_records": 2000}}


def test_compression_round_trip(spark):
    n = np.array([900.0, 4.0, 6.0, 2.0, 1000.0, -3.0, 0.0])
    pools = Compression.learn({"x": 7}, {"x": (n, 10.0)}, {"x": [6]})
    assert pools.kept["x"].tolist() == [0, 4] and pools.pooled["x"].tolist() == [1, 2, 3, 5] and pools.new_sizes() == {"x": 3}
    assert pools.shares["x"].tolist() == pytest.approx([4 / 12, 6 / 12, 2 / 12, 0])
    _, y, sigma = pools.measurement("x", n, 10.0)
    assert y.tolist() == [900.0, 1000.0, 9.0] and sigma.tolist() == [10.0, 10.0, 20.0]
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("int").alias("x"))
    back = pools.decode(pools.encode(df), "id").select("id", F.col("x").alias("y")).join(df, "id")
    assert back.filter("x in (0, 4) and x <> y").count() == 0 and back.filter("x in (1, 2, 3, 5) and y not in (1, 2, 3)").count() == 0
    assert back.filter("x = 6 and y <> 4").count() == 0
    drawn = {r.y: r["count"] for r in back.filter("x in (1, 2, 3, 5)").groupBy("y").count().collect()}
    assert drawn[2] / sum(drawn.values()) == pytest.approx(0.5, abs=0.04)
    plain = Compression.learn({"x": 3}, {"x": (np.zeros(3), 0.0)})
    assert plain.kept["x"].tolist() == [0, 1, 2] and Compression.learn({"x": 2}, {"x": (np.array([1.0, 2.0]), 50.0)}).kept["x"].tolist() == [0, 1]
    with pytest.raises(ValueError):
        Compression.learn({"x": 1}, {}, {"x": [0]})


def test_engine_with_pools_and_zeros(spark):
    rows = [(f"v{i % 3}" if i % 50 else f"v{3 + i // 50 % 9}", i % 2) for i in range(2000)]
    df, schema = spark.createDataFrame(rows, "k string, b int"), Schema.parse(SCHEMA)
    engine = GraphicalEngine(epsilon=1.0, compress=True, zeros={"k": [11]}, steps=100, noise=SeededNoise(6)).fit(df, schema)
    assert 3 <= engine.pools.size("k") < 12
    out = engine.sample(spark, 2000)
    seen = {r.k: r["count"] for r in out.groupBy("k").count().collect()}
    assert "v11" not in seen and len(seen) > 4 and all(500 < seen[f"v{i}"] < 800 for i in range(3))


def test_three_column_cliques_in_the_engine(spark):
    df, sizes = planted(spark, 2000)
    schema = Schema.parse({"column_types": {c: "categorical" for c in sizes}, "public_categories": {c: [str(i) for i in range(n)] for c, n in sizes.items()}, "dataset_info": {"n_records": 2000}})
    engine = GraphicalEngine(epsilon=None, degree=3, steps=60).fit(df, schema)
    assert engine.sample(spark, 2000).filter("(cast(a as int) % 2) ^ cast(b as int) <> cast(d as int)").count() < 100


def test_structural_zeros(spark):
    assert E.merged_intervals([(5, 6), (1, 3), (3, 4), (2, 2.5)]) == [(1, 4), (5, 6)]
    assert E.complement(0, 10, [(-1, 1), (3, 4), (9, 12)]) == [(1, 3), (4, 9)] and E.complement(0, 1, [(0, 1)]) == []
    holed = E.Holed.of([0, 10, 20, 30], [(2, 4), (6, 7), (9, 12), (20, 35)])
    assert holed.zero_codes() == [2]
    out = spark.range(6000).select((F.col("id") % 3).cast("int").alias("c"), (F.col("id") / 6000).alias("u")).withColumn("x", holed.decode(F.col("c"), F.col("u")))
    assert out.filter("c = 2 and x is not null").count() == 0 and out.filter("c < 2 and x is null").count() == 0
    for a, b in holed.zeros:
        assert out.filter((F.col("x") > a) & (F.col("x") < b)).count() == 0
    assert out.filter("c = 0 and (x < 0 or x > 10)").count() == 0 and out.filter("c = 0 and x < 2").count() == pytest.approx(2000 * 2 / 6, abs=20)
    assert [r[0] for r in spark.createDataFrame([("3",), (None,), ("99",), ("-1",)], "x string").select(holed.encode(F.col("x"))).collect()] == [0, None, 2, 0]


def test_tree_of_rows(spark):
    x = np.random.default_rng(1).normal(50, 8, 3000).clip(0, 99.99)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    leaves = tree_of_rows(df, "x", 0.0, 100.0, 12, enforce=False, deepest=8)
    hist = np.bincount((x / 100 * 256).astype(int), minlength=256)
    class Silent(SeededNoise):
        def laplace(self, scale, shape=()):
            return np.zeros(shape)
    fine = tree_bins(hist, 1e9, 12, Silent(0))
    assert [(a * 100 / 256, b * 100 / 256) for a, b in fine] == [(lo, hi) for lo, hi, _ in leaves]
    assert sum(n for *_, n in leaves) == 3000 and leaves[0][0] == 0 and leaves[-1][1] == 100
    assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
    assert len(tree_of_rows(df, "x", 0.0, 100.0, 12, deepest=20)) <= 12
    assert len(tree_of_rows(df, "x", 0.0, 100.0, 12, epsilon=1.0, noise=SeededNoise(1))) <= 12
    same = spark.createDataFrame([(7.0,)] * 50, "x double")
    assert sum(n for *_, n in tree_of_rows(same, "x", 0.0, 100.0, 4, enforce=False, deepest=10)) == 50
    assert tree_of_rows(same.limit(0), "x", 0.0, 1.0, 4) == [(0.0, 1.0, 0)]


def test_documents_to_rows(spark, tmp_path):
    good = {"status": "ok", "survival": {"km_l1": 0.5, "rmst": {"mean": 2, "per_tau": {}}}, "utility": {"marginal": {"error": "bad", "value": math.nan}, "tvd": {"mean": None}}, "compliance": {"composition": {"gap_flag": True}}, "performance": {"fit_time_sec": "fast"}}
    bad = {"privacy": {"error": "no rows"}, "utility": None, "survival": {"km_l1": math.nan}}
    (tmp_path / "results_eps0.5_seed3.json").write_text(json.dumps({"crn": good, "other": bad}))
    (tmp_path / "results_eps2_seed10.json").write_text("{}")
    (tmp_path / "notes.json").write_text("[]")
    rows = {r.implementation: r for r in results.read_results(spark, str(tmp_path / "*.json")).collect()}
    assert set(rows) == {"crn", "other"}
    r = rows["crn"]
    assert (r.epsilon, r.seed, r.status, r.km_l1, r.rmst, r.composition_gap) == (0.5, 3, "ok", 0.5, 2.0, 1.0)
    assert (r.marginal_l1, r.tvd_mean, r.fit_time_sec, r.mia_auc) == (None,) * 4 and r.errors == ["utility.marginal: bad"]
    assert rows["other"].km_l1 is None and rows["other"].nndr_mean is None and rows["other"].errors == ["privacy: no rows"]
    broken = spark.createDataFrame([(1, "not json"), (2, None), (3, '{"a": 5}')], "i int, document string")
    assert results.flatten_results(broken).collect() == []


def test_report_survives_failed_families(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 2)), float(rng.integers(1, 60)), float(rng.random() * 50), float(rng.random()), "ab"[i % 2]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, event int, time double, age double, dose double, k string")
    schema = Schema.parse({"column_types": {"event": "binary", "time": "continuous", "age": "continuous", "dose": "continuous", "k": "categorical"}, "public_bounds": {"time": [0, 60], "age": [0, 50], "dose": [0, 1]}, "public_categories": {"k": ["a", "b"]}, "target_spec": {"kind": "survival_pair", "targets": ["event", "time"], "primary_target": "event", "tau": 40}})
    got = results.report(df.filter("id % 3 = 0"), df.filter("id % 3 = 1"), schema, "network", {"epsilon_total": 1.0}, df.filter("id % 3 = 2"), key="id")
    flat = results.flatten_results(spark.createDataFrame([(results.document({"network": got}),)], "document string")).first()
    known = ("km_l1", "km_ci_overlap", "logrank_p", "censoring_err", "joint_censoring", "rmst", "marginal_l1", "tvd_mean", "corr_spearman", "cat_coverage", "wasserstein_mean", "unk_rate", "mia_auc", "nndr_mean", "constraint_viol", "ledger_complete")
    assert [c for c in known if flat[c] is None] == [] and flat.errors == []
    assert flat.cat_coverage == 1 and flat.constraint_viol == 0 and 0 <= flat.logrank_p <= 1
    assert results.guarded(lambda: 1 / 0) == {"error": "division by zero", "value": None}
    broken = results.report(df, df.drop("age").withColumn("age", F.lit("x")), schema, "network")
    assert broken["status"] == "ok" and broken["utility"]["marginal"] is not None


def test_composition_and_inferred_schema(spark):
    from privloom.engines import NetworkEngine
    from privloom.metrics.risk import composition
    from privloom.metrics.utility import sampled_pairs

    df = spark.createDataFrame([("ab"[i % 2], i % 7, i * 0.37) for i in range(300)], "k string, n int, x double")
    engine = NetworkEngine(epsilon=2.0, noise=SeededNoise(1)).fit(df)
    assert engine.sample(spark, 50).columns == ["k", "n", "x"]
    told = composition(engine.report())
    assert told["gap_flag"] and told["n_gaps"] == 1 and told["composition_gap_ratio"] == 1.0 and told["declared_phases"] == ["epsilon_structure", "epsilon_cpt"]
    assert composition({"epsilon_total": 1.0, "epsilon_cpt": 1.5}) | {"gap_flag": False, "composition_gap_ratio": 1.5} == composition({"epsilon_total": 1.0, "epsilon_cpt": 1.5})
    assert composition({})["composition_gap_ratio"] is None
    assert len(sampled_pairs("abcdef", 4)) == 4 and sampled_pairs("abcdef", 4) == sampled_pairs("abcdef", 4) and len(sampled_pairs("abcd")) == 6
