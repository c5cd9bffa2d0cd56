"""Bayesian networks over coded columns: structure from counted scores, conditional tables, ancestral sampling.

Counting is Spark's; what is fitted on the driver has the size of the attribute set or of a conditional table, never of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privloom.functions import hash_uniform
from privloom.operators.counts import conditional, contingency, keyed_counts

#: Cells of one conditional table at most; parents are dropped from the end beyond it.
CELLS = 2_000_000


def column_order(columns: Sequence[str], first: Sequence[str] = ()) -> list[str]:
    """The columns with those of a declared partial order in front, the others after them as they were; only earlier columns can be parents."""
    ahead = [c for c in dict.fromkeys(first) if c in columns]
    return [*ahead, *[c for c in columns if c not in ahead]]


def tempered(table: np.ndarray, temperature: float) -> np.ndarray:
    """Rows of probabilities to the power of 1 / temperature, as shares again: below 1 likely codes become likelier, above 1 all more alike."""
    if temperature <= 0:
        raise ValueError("a temperature is above 0")
    if temperature == 1:
        return table
    with np.errstate(divide="ignore"):
        logs = np.log(table) / temperature
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def rank_parents(scores: dict[tuple[str, str], float], order: Sequence[str], most: int, forbidden: dict[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """For each column the ``most`` earlier ones with the largest score (ties by name), without the forbidden."""
    out = {}
    for i, child in enumerate(order):
        allowed = [p for p in order[:i] if p not in (forbidden or {}).get(child, ())]
        out[child] = sorted(allowed, key=lambda p: (-scores.get((p, child), scores.get((child, p), 0.0)), p))[:most]
    return out


def information(counts: np.ndarray) -> float:
    """Natural-log mutual information of a two-way table; negative cells (noise) count as none."""
    n = np.maximum(counts, 0) + 1e-8
    p = n / n.sum()
    return max(0.0, float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum()))


@dataclass
class Network:
    """Columns in sampling order, their numbers of codes, parents, and dense conditional tables (cells of parents x codes)."""

    order: list[str]
    sizes: dict[str, int]
    parents: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    spent: dict[str, float] = field(default_factory=dict)

    def key(self, child: str):
        key = F.lit(0).cast("long")
        for p in self.parents[child]:
            key = key * self.sizes[p] + F.col(p).cast("long")
        return key

    def sample(self, rows: DataFrame, id_column: str, uniform: Callable | None = None, seed: str = "sample", temperature: float = 1.0) -> DataFrame:
        """``rows`` with a code for each column: the first whose cumulative probability, at a temperature, reaches a uniform number.

        Small tables are array literals, so a row is sampled within one stage; larger ones are joined by their key.
        """
        spark = rows.sparkSession
        uniform = uniform or (lambda tag: hash_uniform(seed, tag, F.col(id_column)))
        for child in self.order:
            table = np.cumsum(tempered(self.tables[child], temperature), axis=1)
            u = uniform(child)
            pick = lambda cdf: F.least(F.size(F.filter(cdf, lambda c: c < u)), F.lit(self.sizes[child] - 1)).cast("int")  # noqa: B023, E731
            if table.size <= 4096:
                literal = F.from_json(F.lit(str([list(map(float, r)) for r in table])), "array<array<double>>")
                rows = rows.withColumn(child, pick(F.get(literal, self.key(child).cast("int"))))
            else:
                cdf = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(table)], "__key long, __cdf array<double>")
                rows = rows.join(F.broadcast(cdf), self.key(child) == F.col("__key")).withColumn(child, pick(F.col("__cdf"))).drop("__key", "__cdf")
        return rows


def dense_pairs(df: DataFrame, sizes: dict[str, int]) -> dict[tuple[str, str], np.ndarray]:
    """All two-way tables of the coded columns, zeros included, from one grouping-sets job; only cells are collected."""
    names = list(sizes)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in pairs}
    if not pairs:
        return out
    for row in contingency(df, pairs, name="__n").collect():
        a, b = pairs[row.set_id]
        out[a, b][row[a], row[b]] = row["__n"]
    return out


def fit(df: DataFrame, sizes: dict[str, int], order: Sequence[str], epsilon: float | None = None, most: int = 2, alpha: float | dict[str, float] = 1.5, noise=None, forbidden=None, structure_share: float = 0.3) -> Network:
    """A network with Laplace-noised two-way tables for its structure and Laplace-noised conditional counts, smoothed by ``alpha`` (of all or of each).

    ``epsilon`` None adds no noise; ``noise`` is a ``privloom.operators.privacy`` source, secure by default.
    """
    from privloom.operators.privacy import SecureNoise

    noise = noise or SecureNoise()
    net = Network(list(order), dict(sizes))
    pairs = dense_pairs(df.select(*order), {c: sizes[c] for c in order})
    eps_s, eps_c = (epsilon * structure_share, epsilon * (1 - structure_share)) if epsilon else (None, None)
    scale = len(pairs) / eps_s if eps_s and pairs else 0.0
    scores = {p: information(t + (noise.laplace(scale, t.shape) if scale else 0.0)) for p, t in pairs.items()}
    net.parents = rank_parents(scores, order, most, forbidden)
    net.spent = {"structure": eps_s or 0.0, "tables": eps_c or 0.0}
    for child in order:
        while int(np.prod([sizes[p] for p in net.parents[child]], dtype=float)) * sizes[child] > CELLS:
            net.parents[child].pop()
        keys = int(np.prod([sizes[p] for p in net.parents[child]], dtype=np.int64))
        counts = np.zeros((keys, sizes[child]))
        for row in keyed_counts(df, [(p, sizes[p]) for p in net.parents[child]], (child, sizes[child])).collect():
            counts[row.key, row.child] = row.n
        if eps_c:
            counts = counts + noise.laplace(len(order) / eps_c, counts.shape)
        mass = np.maximum(counts, 0) + (alpha.get(child, 1.5) if isinstance(alpha, dict) else alpha)
        total = mass.sum(1, keepdims=True)
        net.tables[child] = np.where(total > 1e-12, mass / np.maximum(total, 1e-12), 1 / sizes[child])
    return net


def noiseless_table(df: DataFrame, parents: Sequence[tuple[str, int]], child: tuple[str, int], alpha: float) -> DataFrame:
    """(key, child, p), as a DataFrame."""
    keys = int(np.prod([s for _, s in parents], dtype=np.int64)) if parents else 1
    return conditional(keyed_counts(df, parents, child), keys, child[1], alpha)
