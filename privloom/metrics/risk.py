"""Constraint violations, privacy risks by nearest neighbours, budget ledgers, and models trained on synthetic rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.metrics.utility import auc
from privloom.operators.neighbours import nearest_distances
from privloom.operators.prefix import quantiles

#: Keys of a complete ledger: fixed values.
LEDGER = ("epsilon_total", "epsilon_structure", "epsilon_cpt", "epsilon_metadata", "delta", "mechanism_structure", "mechanism_cpt", "metadata_source", "adjacency", "composition")


def violates(x: Column, minimum=None, maximum=None, above=None, below=None) -> Column:
    """Whether a value breaks any of the bounds; a null doesn't."""
    tests = [x < minimum if minimum is not None else None, x > maximum if maximum is not None else None, x <= above if above is not None else None, x >= below if below is not None else None]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False)) if t is not None else out
    return out


def pair_violates(event: Column, time: Column, allowed: Sequence = (0, 1), above: float = 0.0, null_time: bool = True) -> Column:
    """Whether a survival pair is invalid: an event code that isn't allowed (or null), or a time not above the bound."""
    late = F.coalesce(time > above, F.lit(not null_time))
    return ~F.coalesce(event.isin(*allowed), F.lit(False)) | ~late


def neighbour_ratio(real: DataFrame, synthetic: DataFrame, key: str, vector: str, floor: float = 1e-6) -> DataFrame:
    """One row (mean_ratio, median_ratio, below_one, n): each real row's distance to the nearest synthetic row over that to the nearest other real row."""
    to_synthetic = nearest_distances(real, synthetic, key, vector).select(key, F.col("distances")[0].alias("s"))
    to_real = nearest_distances(real, real, key, vector).select(key, F.col("distances")[0].alias("r"))
    ratio = to_synthetic.join(to_real, key).filter(F.col("r") > 0).select((F.col("s") / F.greatest("r", F.lit(floor))).alias("x"))
    # a row a real row, from much work: stored, as the median reads it again
    ratio = ratio.persist()
    one = ratio.agg(F.avg("x").alias("mean_ratio"), F.avg((F.col("x") < 1).cast("int")).alias("below_one"), F.count(F.lit(1)).alias("n"))
    median = quantiles(ratio, F.col("x"), [0.5]).select(F.col("q")[0].alias("median_ratio"))
    return one.join(F.broadcast(median), F.lit(True), "left").select("mean_ratio", "median_ratio", "below_one", "n")


def membership(members: DataFrame, others: DataFrame, synthetic: DataFrame, key: str, vector: str) -> DataFrame:
    """One row (auc, advantage) of the attack that takes rows near a synthetic one for members of the training data."""
    near = lambda d, y: nearest_distances(d, synthetic, key, vector).select((-F.col("distances")[0]).alias("score"), F.lit(y).alias("member"))
    one = auc(near(members, 1).unionByName(near(others, 0)), "score", "member")
    return one.select("auc", F.abs(2 * F.col("auc") - 1).alias("advantage"))


def train_and_test(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row (auc): logistic regression trained on one table, ranked on the other."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = lambda d: d.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"))
    filled = [f"{c}__f" for c in features]
    stages = [Imputer(inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=50)]
    scored = Pipeline(stages=stages).fit(rows(train)).transform(rows(test))
    return auc(scored.select(vector_to_array("probability")[1].alias("s"), "label"), "s", "label")


def cox(df: DataFrame, time: str, event: str, covariates: Sequence[str], penalty: float = 0.0, steps: int = 25) -> dict[str, float]:
    """Coefficients of a proportional-hazards model (Efron's ties), by Newton's method.

    Each step is one aggregation to a row for each distinct time, whose risk-set sums are windows over times; the driver sees sums only.
    """
    p = len(covariates)
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    mean = rows.agg(*[F.avg(f"x{i}") for i in range(p)], *[F.stddev_pop(f"x{i}") for i in range(p)]).first()
    centre, spread = np.array(mean[:p], float), np.maximum(np.array(mean[p:], float), 1e-12)
    rows = rows.select("t", "e", *[((F.col(f"x{i}") - float(centre[i])) / float(spread[i])).alias(f"x{i}") for i in range(p)]).persist()
    beta = np.zeros(p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(steps):
        w = F.exp(sum((F.col(f"x{i}") * float(beta[i]) for i in range(p)), F.lit(0.0)))
        parts = {"s": w, **{f"s{i}": w * F.col(f"x{i}") for i in range(p)}, **{f"s{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        sums = rows.groupBy("t").agg(*[F.sum(v).alias(k) for k, v in parts.items()], *[F.sum(F.when(F.col("e") == 1, v).otherwise(0.0)).alias(f"d_{k}") for k, v in parts.items()], F.sum("e").alias("d"), *[F.sum(F.when(F.col("e") == 1, F.col(f"x{i}")).otherwise(0.0)).alias(f"y{i}") for i in range(p)])
        down = Window.partitionBy(F.lit(1)).orderBy(F.desc("t"))
        sums = sums.withColumns({f"r_{k}": F.sum(k).over(down) for k in parts}).filter("d > 0")
        share = F.explode(F.transform(F.sequence(F.lit(0), F.col("d").cast("int") - 1), lambda i: i / F.col("d"))).alias("l")
        tied = sums.select("*", share)
        part = lambda k: F.col(f"r_{k}") - F.col("l") * F.col(f"d_{k}")
        grads = [F.sum(F.col(f"y{i}") / F.col("d") - part(f"s{i}") / part("s")) for i in range(p)]
        hess = [F.sum(part(f"s{i}_{j}") / part("s") - part(f"s{i}") * part(f"s{j}") / (part("s") * part("s"))) for i, j in pairs]
        got = np.array(tied.agg(*grads, *hess).first(), float)
        g, h = got[:p] - penalty * beta, np.zeros((p, p))
        for (i, j), v in zip(pairs, got[p:]):
            h[i, j] = h[j, i] = v
        step = np.linalg.solve(h + (penalty + 1e-9) * np.eye(p), g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    rows.unpersist()
    return dict(zip(covariates, (beta / spread).tolist()))


def ledger(report: dict) -> dict:
    """The ten standard keys (None where the report has none), the share that is there, and how much of the total the phases declare."""
    out = {k: report.get(k) for k in LEDGER}
    total = out["epsilon_total"]
    phases = [out[k] for k in ("epsilon_structure", "epsilon_cpt", "epsilon_metadata") if out[k] is not None]
    out["completeness"] = sum(out[k] is not None for k in LEDGER) / len(LEDGER)
    out["budget_coverage"] = sum(phases) / total if total else math.nan
    return out


def composition(report: dict) -> dict:
    """What a synthesizer's report says of how its budget adds up: the phases that name a cost, the steps that read rows without one, and the declared phases
    over the total (above 1: more is spent than declared; None: no total)."""
    phases = {k: report[k] for k in ("epsilon_structure", "epsilon_cpt", "epsilon_metadata") if report.get(k)}
    total, gaps = report.get("epsilon_total"), list(report.get("undeclared") or [])
    ratio = round(sum(phases.values()) / total, 4) if total else None
    return {"declared_phases": list(phases), "undeclared_data_dependent_phases": gaps, "gap_flag": bool(gaps), "n_gaps": len(gaps), "composition_gap_ratio": ratio}
