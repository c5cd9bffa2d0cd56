"""Schema documents: round trip, survival order, rules; dates; private inference."""

import datetime

import pytest
from pyspark.sql import functions as F

from privloom import sources
from privloom.operators import dates
from privloom.operators import inference as I
from privloom.operators import private_inference as PI
from privloom.operators.privacy import SeededNoise
from privloom.schema import Schema


@pytest.fixture(scope="module")
def table(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(i % 2, float(i * 7 % 90 + 1), 20 + i % 50, "abc"[i % 3], (day + datetime.timedelta(days=i)).strftime("%d/%m/%Y"), i * 1.55 if i > 3 else None) for i in range(200)]
    return spark.createDataFrame(rows, "event int, time double, age int, k string, seen string, x double")


def test_round_trip_of_everything(table):
    doc = I.infer(table, survival=True, rules={"cross_column_constraints": [{"name": "own", "type": "order"}]})
    doc["note"] = {"any": ["thing"]}
    schema = Schema.parse(doc)
    assert schema.document() == doc and Schema.parse(schema.document()) == schema
    assert [r["name"] for r in schema.cross_rules()] == ["survival_pair_definition", "own"]
    assert schema.problems() == [] and "target: no horizon (tau)" in schema.warnings()


def test_survival_pair_is_event_then_time(spark):
    base = {"column_types": {"e": "binary", "t": "integer"}, "public_bounds": {"t": [0, 1000]}, "dataset_info": {"n_records": 10}}
    for target in ({"targets": ["e", "t"], "primary_target": "e"}, {"targets": ["t", "e"], "primary_target": "e"}, {"targets": ["e", "t"]}):
        schema = Schema.parse({**base, "target_spec": {"kind": "survival_pair", "tau": 50, **target}})
        assert schema.survival_pair() == ("e", "t")
        rows = sources.dummy_rows(spark, schema, 300)
        assert rows.filter("e = 1 and t > 50").count() == 0 and rows.filter("e = 0 and t > 50").count() > 50
    ruled = Schema.parse({**base, "target_spec": {"kind": "survival_pair", "targets": ["t", "e"]}, "constraints": {"cross_column_constraints": [{"type": "survival_pair", "event_col": "e", "time_col": "t"}]}})
    assert ruled.survival_pair() == ("e", "t")
    assert Schema.parse(base).survival_pair() is None


@pytest.mark.parametrize("change,said", [
    ({"column_types": {}}, "no columns"), ({"public_bounds": {}}, "x: no bounds"), ({"public_bounds": {"x": [2, 1]}}, "x: bounds are not in order"), ({"public_categories": {}}, "k: no categories"),
    ({"public_categories": {"k": ["a"], "b": ["0", "1", "2"]}}, "b: a binary column has two categories"), ({"target_spec": {"kind": "single", "targets": ["b"]}}, "target: no primary_target"),
    ({"target_spec": {"kind": "single", "targets": ["q"], "primary_target": "q"}}, "target: q is not a column"), ({"target_spec": {"kind": "survival_pair", "targets": ["b", "x"], "primary_target": "b"}}, "target: no rule of the survival pair"),
    ({"extensions": {"max_parents": 0}}, "extensions: max_parents is a whole number from 1"), ({"extensions": {"forbidden_parents": {"x": ["q"]}}}, "extensions: q is not a column"),
    ({"extensions": {"bins": {"x": 5}, "null_bins": {"x": 3}}}, "extensions: the null bin of x is not its last"), ({"extensions": {"alpha": {"x": 0}}}, "extensions: alpha of x is not above 0"),
])
def test_problems(change, said):
    good = {"column_types": {"x": "continuous", "k": "ordinal", "b": "binary"}, "public_bounds": {"x": [0, 1]}, "public_categories": {"k": ["1", "2"]}, "target_spec": {"kind": "single", "targets": ["b"], "primary_target": "b"}, "extensions": {"max_parents": 2, "null_bins": {"x": None}}}
    assert Schema.parse(good).problems() == []
    assert said in Schema.parse({**good, **change}).problems()


def test_warnings_and_remarks(spark):
    schema = Schema.parse({"column_types": {"x": "continuous", "k": "categorical", "b": "integer"}, "public_bounds": {"x": [0.123456, 1], "k": [0, 1], "b": [0, 1000]}, "public_categories": {"k": ["1", "2"]}, "domain_provenance": {"x": {"source": "public"}}})
    assert set(schema.warnings()) == {"k: both bounds and categories", "k: no provenance", "b: no provenance", "x: bounds of many digits look like data"}
    df = spark.createDataFrame([("0.5", 1.0, 3), ("0.9", 2.0, 5)], "x string, k double, b int")
    assert {"b: uses 0.2% of its range", "x: numbers kept as text", "k: labels kept as fractions"} <= set(I.remarks(schema, df))
    assert I.validate_rows(schema, df.select(F.lit(1).alias("other"))).collect() == []
    assert "x: not in the table" in I.complaints(schema, df.select(F.lit(1).alias("other")))


def test_dates_become_integers_and_come_back(spark, table):
    doc = I.infer(table)
    assert doc["column_types"]["seen"] == "integer" and doc["datetime_spec"]["seen"]["output_format"] == "%d/%m/%Y"
    first = datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc).timestamp()
    assert doc["public_bounds"]["seen"]["min"] == first and doc["public_bounds"]["seen"]["max"] == first + 199 * 86400
    formats = dates.elect(table)
    assert formats == {"seen": "%d/%m/%Y"}
    back = dates.from_epochs(dates.to_epochs(table, formats), formats)
    assert back.exceptAll(table).count() == 0
    mixed = spark.createDataFrame([("2020-01-0%d" % i if i < 5 else "never",) for i in range(1, 8)] + [(None,), ("",)], "d string")
    assert dates.elect(mixed) == {} and dates.elect(mixed, least=0.5) == {"d": "%Y-%m-%d"}
    assert dates.elect(mixed.limit(0)) == {} and dates.elect(spark.range(3).toDF("n")) == {}


def test_overrides(table):
    doc = I.infer(table, overrides={"age": {"type": "ordinal", "domain": [20, 30]}, "seen": {"type": "categorical", "domain": ["a"]}, "x": {"type": "integer"}})
    assert doc["column_types"] | {"age": "ordinal", "seen": "categorical", "x": "integer"} == doc["column_types"]
    assert doc["public_categories"]["age"] == ["20", "30"] and "age" not in doc["public_bounds"] and doc["public_bounds"]["x"]["min"] == 6.2
    with pytest.raises(ValueError):
        I.infer(table, overrides={"nothing": {"type": "integer"}})


@pytest.mark.parametrize("method", ["range", "histogram"])
def test_private_document(table, method):
    doc = PI.infer_private(table, 4.0, survival=True, method=method, noise=SeededNoise(3), declared={"k": ["a", "b", "c", "d"]})
    plain = I.infer(table, survival=True)
    held = doc["privacy_ledger"]
    assert PI.ledger_problems(doc) == [] and held["spent"] == pytest.approx(4.0)
    assert {q["query"] for q in held["queries"]} == {"n_records", "missing_rate", "bounds", "strategy"}
    assert doc["dataset_info"]["n_records"] != 200 or method == "histogram"
    for c in ("age", "x", "time"):
        b, p = doc["public_bounds"][c], plain["public_bounds"][c]
        assert b["max"] >= p["max"] if method == "range" else b["max"] >= p["max"] / 2
        assert doc["domain_provenance"][c]["source"] == "private" and doc["domain_provenance"][c]["epsilon_spent"] > 0
    assert doc["public_bounds"]["time"]["min"] == 0 and doc["target_spec"]["tau"] >= doc["public_bounds"]["time"]["max"]
    assert doc["public_categories"]["k"] == ["a", "b", "c", "d"] and doc["domain_provenance"]["k"]["source"] == "public"
    assert Schema.parse(doc).problems() == []
    again = PI.infer_private(table, 4.0, survival=True, method=method, noise=SeededNoise(3), declared={"k": ["a", "b", "c", "d"]})
    assert again == doc


def test_private_document_of_marked_and_empty_domains(spark, table):
    doc = PI.infer_private(table, 1.0, noise=SeededNoise(1))
    assert doc["domain_provenance"]["k"]["source"] == "non_private_auxiliary"
    none = PI.infer_private(table.limit(0), 1.0, noise=SeededNoise(1))
    assert PI.ledger_problems(none) == [] and none["dataset_info"]["n_records"] >= 1
    assert PI.ledger_problems({"privacy_ledger": {"epsilon": 1, "spent": 2, "queries": [{"epsilon": 3}]}}) == ["the sum differs from the queries", "more than the budget"]
