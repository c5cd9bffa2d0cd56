import pytest
from pyspark.sql import functions as F

from privloom import engines, sources, streaming
from privloom.metrics import risk
from privloom.operators import privacy as P
from privloom.operators.analysis import student_quantile
from privloom.schema import Schema, check_numeric

DOC = {
    "dataset": {"n_records": 1500}, "column_types": {"c_acctbal": "continuous", "c_nationkey": "integer", "c_mktsegment": "categorical"},
    "public_bounds": {"c_acctbal": {"min": -1000, "max": 10000, "n_bins": 12}, "c_nationkey": [0, 24]},
    "public_categories": {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
}


@pytest.fixture(scope="module")
def customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/customer.parquet")


@pytest.mark.parametrize("name", ["network", "graphical"])
def test_engine(spark, customers, name):
    schema = Schema.parse(DOC)
    assert schema.problems() == [] and Schema.parse(schema.document()) == schema
    engine = engines.ENGINES[name](epsilon=5.0, noise=P.SeededNoise(2)).fit(customers, schema)
    out = engine.sample(spark, 1000)
    rows = out.collect()
    assert len(rows) == 1000 and out.columns == list(DOC["column_types"])
    assert all(-1000 <= r.c_acctbal <= 10000 and 0 <= r.c_nationkey <= 24 and r.c_mktsegment in DOC["public_categories"]["c_mktsegment"] for r in rows)
    real = {r.c_mktsegment: r["count"] / 1500 for r in customers.groupBy("c_mktsegment").count().collect()}
    synth = {r.c_mktsegment: r["count"] / 1000 for r in out.groupBy("c_mktsegment").count().collect()}
    assert sum(abs(real.get(k, 0) - synth.get(k, 0)) for k in real | synth) / 2 < 0.15
    assert sum(risk.ledger(engine.report())[k] for k in ("epsilon_structure", "epsilon_cpt")) == pytest.approx(5.0)
    assert risk.ledger(engine.report())["completeness"] == 1.0


def test_row_count_guard(customers):
    with pytest.raises(ValueError):
        engines.NetworkEngine().fit(customers.limit(100), Schema.parse(DOC))
    with pytest.raises(ValueError):
        Schema.parse({"column_types": {"x": "categoricl"}})


def test_attack_target():
    one = Schema.parse({"column_types": {"x": "binary"}, "sensitive_attributes": ["s"], "target_spec": {"primary_target": "t"}})
    assert one.attack_target() == "s"
    assert Schema.parse({"column_types": {"x": "binary"}, "target_spec": {"primary_target": "t"}}).attack_target() == "t"
    assert Schema.parse({"column_types": {"x": "binary"}}).attack_target() is None


@pytest.mark.parametrize("values,kind,bad", [(["1", "na", "3", "n/a"], "integer", None), (["1", "abc"], "integer", "1 not numbers"), (["0", "1", "2"], "binary", "1 not 0 or 1"), (["1", "1.5"], "integer", "1 not whole"), (["1", "inf"], "continuous", "1 infinite")])
def test_numeric_validation(spark, values, kind, bad):
    df = spark.createDataFrame([(v,) for v in values], "a string")
    if bad is None:
        check_numeric(df, "a", kind)
    else:
        with pytest.raises(ValueError, match=bad) as e:
            check_numeric(df, "a", kind)
        assert "abc" not in str(e.value)


def test_sources(spark, tmp_path):
    schema = Schema.parse({**DOC, "column_types": {**DOC["column_types"], "t": "integer", "e": "binary"}, "public_bounds": {**DOC["public_bounds"], "t": [1, 100]}, "target_spec": {"kind": "survival_pair", "targets": ["e", "t"], "tau": 50}})
    df = sources.dummy_rows(spark, schema, 500, missing={"c_acctbal": 0.3})
    assert df.count() == 500 and 100 < df.filter("c_acctbal is null").count() < 200
    assert df.filter("e = 1 and t > 50").count() == 0 and df.filter("t < 1 or t > 100").count() == 0
    assert df.repartition(7).orderBy("id").collect() == df.orderBy("id").collect()
    (tmp_path / "x.csv").write_text("a;b\n1;2\n3;4\n")
    assert sources.read_table(spark, str(tmp_path / "x.csv")).agg(F.sum("b")).first()[0] == 6
    (tmp_path / "network_eps0.5_seed3.csv").write_text("a\n1\n")
    assert sources.read_runs(spark, str(tmp_path / "*_eps*.csv"), "a int").first()[1:] == ("network", 0.5, 3)
    assert sources.uniform_rows(spark, {"a": 3}, 100).agg(F.max("a")).first()[0] == 2
    assert sources.dump({"x": float("nan"), "y": [float("inf"), 1]}, None) == '{"x": null, "y": [null, 1]}'
    assert r"a\_b" in sources.latex_table(spark.createDataFrame([(1.0,)], "a_b double"), ["a_b"])


def test_model_round_trip(spark, customers, tmp_path):
    engine = engines.NetworkEngine(epsilon=None).fit(customers, Schema.parse(DOC))
    sources.write_model(spark, engine.net, str(tmp_path / "m"))
    again = sources.read_model(spark, str(tmp_path / "m"))
    a, b = (net.sample(spark.range(50), "id").orderBy("id").collect() for net in (engine.net, again))
    assert a == b


def test_stream(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.select("ts", "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    levels = [r[0] for r in table.select("event_type").distinct().collect()]
    q = streaming.release(streaming.windowed_counts(stream, "ts", "event_type"), "event_type", levels, str(tmp_path / "out"), 1e6, str(tmp_path / "cp"), P.SeededNoise(1))
    q.awaitTermination(120)
    got = {(r.start, r.event_type): round(r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in streaming.windowed_counts(table, "ts", "event_type").collect()}
    closed = {k[0] for k in got}
    assert closed and all(got[k] == want.get(k, 0) for k in got) and {k for k in want if k[0] in closed} <= set(got)


def test_student():
    assert student_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    assert student_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)
