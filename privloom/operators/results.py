"""Result documents to rows, and guards that keep one failed family from losing the others.

A result document is a JSON object of synthesizer names to families of metrics. Any family or metric may be missing, null, or an
error object in place of a value.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the flat table and where each stands in a result document.
FIELDS = {
    "fit_time_sec": ("performance", "fit_time_sec"), "sample_time_sec": ("performance", "sample_time_sec"), "peak_memory_mb": ("performance", "peak_memory_max_mb"),
    "km_l1": ("survival", "km_l1"), "km_ci_overlap": ("survival", "km_ci_overlap"), "logrank_p": ("survival", "logrank_p"), "cox_spearman": ("survival", "cox_spearman"),
    "tstr_cindex": ("survival", "tstr_cindex"), "censoring_err": ("survival", "censoring_rate_error"), "joint_censoring": ("survival", "joint_survival_censoring", "mean"),
    "rmst": ("survival", "rmst", "mean"), "marginal_l1": ("utility", "marginal", "mean_overall"), "tvd_mean": ("utility", "tvd", "mean"),
    "corr_spearman": ("utility", "correlation", "numeric_spearman"), "tstr_auc": ("utility", "tstr", "roc_auc"), "cat_coverage": ("utility", "coverage", "mean"),
    "wasserstein_mean": ("utility", "wasserstein", "mean"), "unk_rate": ("utility", "unknown_token_rate", "overall"), "mia_auc": ("privacy", "mia", "auc"),
    "mia_advantage": ("privacy", "mia", "advantage"), "nndr_mean": ("privacy", "nndr", "mean_ratio"), "nndr_median": ("privacy", "nndr", "median_ratio"),
    "nndr_frac_below": ("privacy", "nndr", "fraction_below_1"), "attr_inference_auc": ("privacy", "attribute_inference", "auc"),
    "constraint_viol": ("constraints", "overall_violation_rate"), "constraint_viol_event": ("constraints", "survival_pair_event_violation_rate"),
    "constraint_viol_time": ("constraints", "survival_pair_time_violation_rate"), "ledger_complete": ("compliance", "ledger_completeness"),
    "composition_gap": ("compliance", "composition", "gap_flag"),
}


def _declared() -> str:
    """The schema of a result: of each family its metrics as the text they have, numbers or objects alike, and the family's own error."""
    families: dict[str, list[str]] = {}
    for family, metric, *_ in FIELDS.values():
        families.setdefault(family, [])
        if metric not in families[family]:
            families[family].append(metric)
    return "status string, error string, " + ", ".join(f"{f} struct<error: string, {', '.join(f'{m}: string' for m in ms)}>" for f, ms in families.items())


def flatten_results(documents: DataFrame, document: str = "document") -> DataFrame:
    """``documents`` with one row for each synthesizer of its JSON column: (other columns, implementation, status, one double for each of ``FIELDS``,
    errors array<string>).

    What is missing, null, not a number or an error is null; true is 1. Errors are ``family: message`` or ``family.metric: message``. A
    document that isn't an object of objects has no row.
    """
    others = [c for c in documents.columns if c != document]
    rows = documents.select(*others, F.explode(F.from_json(document, "map<string,string>")).alias("implementation", "__text"))
    rows = rows.withColumn("__r", F.from_json("__text", _declared())).filter(F.trim("__text").startswith("{"))
    raw = lambda path: F.col("__r").getField(path[0]).getField(path[1])

    def value(path):
        text = raw(path) if len(path) == 2 else F.get_json_object(raw(path), f"$.{path[2]}")
        plain = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
        return F.when(~F.isnan(plain) & F.get_json_object(raw(path), "$.error").isNull() & F.col("__r").getField(path[0]).getField("error").isNull(), plain)

    families = list(dict.fromkeys(p[0] for p in FIELDS.values()))
    metrics = list(dict.fromkeys(p[:2] for p in FIELDS.values()))
    said = [F.concat(F.lit(f"{f}: "), F.col("__r").getField(f).getField("error")) for f in families]
    said += [F.concat(F.lit(f"{f}.{m}: "), F.get_json_object(raw((f, m)), "$.error")) for f, m in metrics]
    said.append(F.concat(F.lit("result: "), F.col("__r.error")))
    return rows.select(*others, "implementation", F.coalesce("__r.status", F.lit("ok")).alias("status"), *[value(p).alias(c) for c, p in FIELDS.items()], F.array_compact(F.array(*said)).alias("errors"))


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """(epsilon, seed, implementation, ...) of all files of a pattern whose names have ``eps<number>_seed<number>``; other files are passed over."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(name, r"eps(\d+(?:\.\d+)?)_seed(\d+)", 1).alias("e"), F.regexp_extract(name, r"eps(\d+(?:\.\d+)?)_seed(\d+)", 2).alias("s"), F.col("value").alias("document"))
    return flatten_results(files.filter("e <> ''").select(F.col("e").cast("double").alias("epsilon"), F.col("s").cast("int").alias("seed"), "document"))


def guarded(work: Callable[[], object]) -> object:
    """What ``work`` gives, or its error in place of a value."""
    try:
        return work()
    except Exception as e:  # a metric that can't be had must not lose the report
        return {"error": str(e).split("\n")[0], "value": None}


def report(real: DataFrame, synthetic: DataFrame, schema, implementation: str, ledger: dict | None = None, test: DataFrame | None = None, performance: dict | None = None, key: str | None = None, codes: int = 20) -> dict:
    """All metric families of a synthetic table as one result document, each metric guarded.

    Survival metrics need the schema's pair, distances to neighbours a ``key`` that both tables have; what can't be asked is null.
    """
    from privloom.functions import bucket, cat_code, edges, number
    from privloom.metrics import risk, survival, utility
    from privloom.operators.counts import spearman_pairs

    kinds = schema.kinds
    numeric = [c for c, k in kinds.items() if k in ("continuous", "integer") and c in schema.bounds]
    labelled = [c for c in kinds if schema.categories.get(c)]
    both = utility.sides(real.select(*kinds), synthetic.select(*kinds))
    code = {c: bucket(number(F.col(c)), edges(*schema.bounds[c], codes), clamp=True) for c in numeric} | {c: cat_code(F.col(c).cast("string"), schema.categories[c], len(schema.categories[c])) for c in labelled}
    one = lambda df: df.first()[0]

    def mean_of(values: dict) -> dict:
        known = [v for v in values.values() if v is not None and not math.isnan(v)]
        return {"mean": sum(known) / len(known) if known else None, "per_column": values}

    def marginal():
        each = {c: one(utility.cell_distance(both.select("side", e.alias("x")), ["x"])) for c, e in code.items()}
        known = [v for v in each.values() if v is not None]
        return {"mean_overall": sum(known) / len(known) if known else None, "per_column": each}

    def correlation():
        pairs = spearman_pairs(both.select("side", *[number(F.col(c).cast("string")).alias(c) for c in numeric]), numeric, ["side"]).groupBy("a", "b").pivot("side", [0, 1]).agg(F.first("rho"))
        return {"numeric_spearman": one(pairs.agg(F.corr("0", "1"))) if len(numeric) > 2 else None}

    utilities = {
        "marginal": guarded(marginal),
        "tvd": guarded(lambda: {"mean": one(utility.pairwise_distance(both, code).agg(F.avg("distance")))}) if len(code) > 1 else None,
        "correlation": guarded(correlation) if len(numeric) > 1 else None,
        "wasserstein": guarded(lambda: mean_of({c: one(utility.wasserstein(both.select("side", F.col(c).cast("string").alias(c)), c)) for c in numeric})),
        "coverage": guarded(lambda: mean_of({c: one(utility.coverage(synthetic, c, schema.categories[c])) for c in labelled})),
        "unknown_token_rate": guarded(lambda: {"overall": one(synthetic.agg(sum((F.avg((F.coalesce(F.col(c).cast("string"), F.lit("")) == "__UNK__").cast("int")) for c in kinds), F.lit(0.0)) / len(kinds)))}),
    }
    pair = schema.survival_pair()
    survivals = None
    if pair:
        event, time = pair
        rows = both.select("side", number(F.col(time).cast("string")).alias("t"), number(F.col(event).cast("string")).cast("int").alias("e"))
        taus = [schema.target["tau"]] if schema.target.get("tau") else []

        def grid():
            curve = survival.kaplan_meier(rows, "t", "e", "side")
            longest = one(rows.agg(F.max("t"))) or 1.0
            return survival.on_grid(curve, "side", curve.select("side").distinct(), longest / 99, 100)

        def mean_error():
            r = {x.side: x.rmst for x in survival.restricted_mean(survival.kaplan_meier(rows, "t", "e", "side"), "side", float(taus[0])).collect()}
            return {"mean": abs(r[0] - r[1])}

        survivals = {
            "km_l1": guarded(lambda: one(survival.curve_distance(grid(), "side", 0, 1))),
            "km_ci_overlap": guarded(lambda: one(survival.inside_band(grid(), "side", 0, 1))),
            "logrank_p": guarded(lambda: math.erfc(math.sqrt(one(survival.log_rank(rows, "t", "e", "side", 0)) / 2))),
            "censoring_rate_error": guarded(lambda: abs(one(rows.agg(F.avg(F.when(F.col("side") == 0, F.col("e"))) - F.avg(F.when(F.col("side") == 1, F.col("e"))))))),
            "joint_survival_censoring": guarded(lambda: {"mean": one(utility.wasserstein(rows, "t", ["e"]).agg(F.avg("distance")))}),
            "rmst": guarded(mean_error) if taus else None,
        }
    vector = F.array(*[F.coalesce((number(F.col(c).cast("string")) - schema.bounds[c][0]) / (schema.bounds[c][1] - schema.bounds[c][0]), F.lit(0.5)) for c in numeric])
    near = lambda df: df.select(key, vector.alias("v"))

    def distances():
        r = risk.neighbour_ratio(near(real), near(synthetic), key, "v").first()
        return {"mean_ratio": r.mean_ratio, "median_ratio": r.median_ratio, "fraction_below_1": r.below_one}

    privacy = {"nndr": guarded(distances) if key and numeric else None}
    if test is not None and key and numeric:
        privacy["mia"] = guarded(lambda: risk.membership(near(real), near(test), near(synthetic), key, "v").first().asDict())
    rates = guarded(lambda: {"overall_violation_rate": one(synthetic.agg(F.avg(_broken(schema).cast("int"))))})
    return {"implementation": implementation, "status": "ok", "compliance": {"ledger": (held := risk.ledger(ledger or {})), "ledger_completeness": held["completeness"], "composition": risk.composition(ledger or {})}, "utility": utilities, "survival": survivals, "privacy": privacy, "performance": performance or {}, "constraints": rates}


def _broken(schema):
    """Whether a row breaks a bound or has an undeclared level."""
    from privloom.functions import number

    out = F.lit(False)
    for c, (lo, hi) in schema.bounds.items():
        x = number(F.col(c).cast("string"))
        out = out | F.coalesce((x < lo) | (x > hi), F.lit(False))
    for c, levels in schema.categories.items():
        out = out | F.coalesce(~F.col(c).cast("string").isin(levels), F.lit(False))
    return out


def document(results: dict[str, dict]) -> str:
    """The JSON of results by synthesizer, as ``flatten_results`` reads it."""
    return json.dumps(results, default=str)
