"""A schema document whose numbers are released by mechanisms, with a ledger of what each costs.

The measurements (extremes or log histograms, quartiles, missing rates, the number of rows) are aggregations; noise is drawn for what they
return. Category values can't be released this way: they are declared, or marked as read without a mechanism.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privloom.functions import number
from privloom.operators import inference as I
from privloom.operators import privacy as D
from privloom.operators import profile as P
from privloom.operators.prefix import quantiles

#: From this skewness on, bins are at quantiles.
SKEWED = 0.2


def measured(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, lo, hi, q1, q2, q3, n, missing): what a private document needs of its columns, before noise."""
    x = {c: F.when(F.abs(number(F.col(f"`{c}`").cast("string"))) < float("inf"), number(F.col(f"`{c}`").cast("string"))) for c in columns}
    numbers = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("x")) for c, v in x.items()])).alias("e")).select("e.*")
    quarters = quantiles(numbers, F.col("x"), [0.25, 0.5, 0.75], ["column"]).select("column", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])
    rows = [F.struct(F.lit(c).alias("column"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.avg(F.col(f"`{c}`").isNull().cast("int")).alias("missing")).alias(f"c{i}") for i, (c, v) in enumerate(x.items())]
    plain = df.agg(*rows).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(rows))])).alias("m")).select("m.*")
    return plain.join(F.broadcast(quarters), "column", "left").select("column", "lo", "hi", "q1", "q2", "q3", "n", "missing")  # a row a column


def log_histogram(df: DataFrame, column: str) -> list[int]:
    """Rows in each of the 64 bins of ``privacy.log_edges``."""
    counts = [0] * 64
    for r in df.select(P.log_bucket(number(F.col(f"`{column}`").cast("string"))).alias("b")).filter("b is not null").groupBy("b").count().collect():
        counts[r.b] = r["count"]
    return counts


def infer_private(df: DataFrame, epsilon: float, targets: Sequence[str] | None = None, survival: bool = False, pad: float = 0.0, method: str = "range", declared: dict[str, list[str]] | None = None, rules: dict | None = None, strategy: float = 0.05, noise: D.SecureNoise | None = None) -> dict:
    """The document of ``infer`` with noisy bounds, missing rates, number of rows and binning strategies, all for ``epsilon``; what each cost is its
    ``privacy_ledger``, which never sums to more.

    ``method`` "range" moves each end outwards by noise of the observed span, which follows the data's own span and so is no strict guarantee;
    "histogram" reads bounds from noisy log-scale counts, which is one. ``declared`` gives categories that are public. A horizon follows from
    the time's released bound and is free.
    """
    noise = noise or D.SecureNoise()
    doc = I.infer(df, targets, survival, 0.0, rules=rules)
    kinds = doc["column_types"]
    numeric = [c for c, k in kinds.items() if k in ("continuous", "integer")]
    found = {r.column: r for r in measured(df, list(kinds)).collect()} if kinds else {}  # a row a column
    share = D.split_budget(epsilon, len(numeric), strategy)
    ledger: list[dict] = []

    def spend(query: str, column: str | None, cost: float) -> None:
        if cost:
            ledger.append({"query": query, "column": column, "epsilon": cost})

    rows = max(doc["dataset_info"]["n_records"], 1)
    released = max(1, round(D.scalar(float(rows), 1.0, share["n_records"], 0.0, noise=noise)))
    spend("n_records", None, share["n_records"])
    doc["dataset_info"]["n_records"] = released
    for c in kinds:
        each = share["missing"] / len(kinds)
        doc["missing_value_rates"][c] = D.scalar(float(found[c].missing or 0.0), 1 / rows, each, 0.0, 1.0, noise)
        spend("missing_rate", c, each)
    bins, spent = P.sturges(released, P.auto_cap(released)), {}
    doc["binning"] = {}
    stamps = {c for c in numeric if c in doc.get("datetime_spec", {})}
    skewed = [c for c in numeric if c not in stamps and found[c].n >= 4]
    for c in numeric:
        lo, hi, cost = (found[c].lo, found[c].hi, 0.0) if found[c].n else (0.0, 1.0, 0.0)
        stamp = c in stamps
        if stamp:  # measured as seconds
            at = doc["public_bounds"][c]
            lo, hi = at["min"], at["max"]
        if method == "histogram" and not stamp:
            got = D.bounds_from_histogram(log_histogram(df, c), share["bounds_each"], noise)
            (lo, hi), cost = (got or (0.0, 1.0)), share["bounds_each"]
        elif found[c].n or stamp:
            lo, hi, cost = D.widened_bounds(lo, hi, share["bounds_each"], noise)
        spend("bounds", c, cost)
        by = pad * (hi - lo) if hi > lo else max(abs(lo) * pad, 1.0) if pad else 0.0
        lo, hi = (math.floor(lo - by), math.ceil(hi + by)) if kinds[c] == "integer" else (lo - by, hi + by)
        skew, cost = D.noisy_skew((found[c].q1, found[c].q2, found[c].q3), found[c].n, lo, hi, share["strategy"] / len(skewed), noise) if c in skewed else (0.0, 0.0)
        spend("strategy", c, cost)
        doc["binning"][c] = "quantile" if abs(skew) > SKEWED else "uniform"
        doc["public_bounds"][c] = {"min": float(lo), "max": float(hi if hi > lo else lo + 1), "n_bins": bins}
        spent[c] = sum(x["epsilon"] for x in ledger if x["column"] == c)
    pair = I.pair_of(doc["target_spec"])
    if pair and pair[1] in doc["public_bounds"]:
        doc["public_bounds"][pair[1]]["min"] = 0.0
        doc["target_spec"]["tau"] = math.ceil(doc["public_bounds"][pair[1]]["max"])
    doc["public_categories"] |= {c: list(map(str, v)) for c, v in (declared or {}).items() if c in kinds}
    read = {c for c in doc["public_categories"] if c not in (declared or {})}
    doc["domain_provenance"] = I.provenance(kinds, set(numeric), spent, read)
    schema = I.Schema.parse(doc)
    doc["constraints"] = I.constraints(schema, doc["dataset_info"].get("constant_columns", []), rules)
    doc["sensitivity_bounds"] |= {c: max(b["max"] - b["min"], 1.0) for c, b in doc["public_bounds"].items() if c in numeric}
    doc["extensions"] |= {"max_parents": P.max_parents(released, bins), "alpha": {c: P.perks(bins if c in numeric else len(doc["public_categories"].get(c, [])) or 2) for c in kinds}}
    doc["privacy_ledger"] = {"epsilon": epsilon, "spent": sum(x["epsilon"] for x in ledger), "queries": ledger}
    return doc


def ledger_problems(doc: dict, tolerance: float = 1e-9) -> list[str]:
    """What is wrong with a private document's ledger: a sum that isn't its queries' or exceeds the budget, a numeric column without a price."""
    held = doc.get("privacy_ledger") or {}
    total = sum(q["epsilon"] for q in held.get("queries", []))
    out = [] if abs(total - held.get("spent", 0.0)) <= tolerance else ["the sum differs from the queries"]
    return out + (["more than the budget"] if total > held.get("epsilon", 0.0) + tolerance else [])
