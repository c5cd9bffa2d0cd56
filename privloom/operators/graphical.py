"""Graphical models of noisy marginals: domains, dense factors, a junction tree, belief propagation, mirror descent.

All of it has the size of the attributes' cliques; rows stay in Spark, which counts the marginals and draws the sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.functions import hash_uniform
from privloom.operators.counts import contingency
from privloom.operators.privacy import SecureNoise, rho_of


@dataclass(frozen=True)
class Domain:
    """Attributes in order, with their numbers of codes."""

    sizes: dict[str, int]

    def project(self, names: Sequence[str]) -> "Domain":
        return Domain({n: self.sizes[n] for n in names})

    def without(self, names: Sequence[str]) -> "Domain":
        return Domain({n: s for n, s in self.sizes.items() if n not in names})

    def merge(self, other: "Domain") -> "Domain":
        return Domain({**self.sizes, **other.sizes})

    def __contains__(self, name: str) -> bool:
        return name in self.sizes

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.sizes)

    @property
    def cells(self) -> int:
        return math.prod(self.sizes.values())


@dataclass
class Factor:
    """A dense table over a domain."""

    domain: Domain
    values: np.ndarray

    @classmethod
    def constant(cls, domain: Domain, value: float = 0.0) -> "Factor":
        return cls(domain, np.full(tuple(domain.sizes.values()), value))

    def on(self, domain: Domain) -> np.ndarray:
        """Its values with an axis for each attribute of a larger domain."""
        order = [n for n in domain.names if n in self.domain]
        moved = np.transpose(self.values, [self.domain.names.index(n) for n in order])
        return moved.reshape([domain.sizes[n] if n in self.domain else 1 for n in domain.names])

    def _with(self, other: "Factor", op) -> "Factor":
        d = self.domain.merge(other.domain)
        return Factor(d, op(np.broadcast_to(self.on(d), tuple(d.sizes.values())), other.on(d)))

    def __add__(self, other: "Factor") -> "Factor":
        return self._with(other, np.add)

    def __sub__(self, other: "Factor") -> "Factor":
        return self._with(other, np.subtract)

    def __mul__(self, other: "Factor") -> "Factor":
        return self._with(other, np.multiply)

    def reduce(self, names: Sequence[str], log: bool = False) -> "Factor":
        """Onto ``names``, the rest summed out (of logarithms: by log-sum-exp)."""
        gone = tuple(i for i, n in enumerate(self.domain.names) if n not in names)
        kept = self.domain.project([n for n in self.domain.names if n in names])
        if not log:
            out = self.values.sum(axis=gone)
        else:
            top = self.values.max(axis=gone, keepdims=True)
            top = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                out = np.log(np.exp(self.values - top).sum(axis=gone)) + top.reshape(out_shape(self.values.shape, gone))
        wanted = [n for n in names if n in kept]
        return Factor(self.domain.project(wanted), np.transpose(out, [kept.names.index(n) for n in wanted]))


def out_shape(shape: Sequence[int], gone: Sequence[int]) -> tuple[int, ...]:
    return tuple(s for i, s in enumerate(shape) if i not in gone)


def elimination(domain: Domain, cliques: Sequence[Sequence[str]]) -> tuple[list[str], list[tuple[str, ...]]]:
    """An order in which each step makes the smallest new clique, and the maximal cliques it makes."""
    near = {n: set() for n in domain.names}
    for c in cliques:
        for a, b in combinations(c, 2):
            near[a].add(b)
            near[b].add(a)
    left, order, made = set(domain.names), [], []
    while left:
        def cost(n: str) -> tuple[int, str]:
            return math.prod(domain.sizes[x] for x in (near[n] & left) | {n}), n

        n = min(left, key=cost)
        clique = (near[n] & left) | {n}
        for a, b in combinations(clique, 2):
            near[a].add(b)
            near[b].add(a)
        made.append(tuple(x for x in domain.names if x in clique))
        order.append(n)
        left.discard(n)
    maximal = [c for i, c in enumerate(made) if not any(set(c) < set(d) or c == d and j < i for j, d in enumerate(made))]
    return order, maximal


def spanning_tree(cliques: Sequence[tuple[str, ...]]) -> list[tuple[int, int]]:
    """Edges of a tree of cliques with the largest overlaps."""
    root = list(range(len(cliques)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for i, j in sorted(combinations(range(len(cliques)), 2), key=lambda e: (-len(set(cliques[e[0]]) & set(cliques[e[1]])), e)):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


class Model:
    """A log-linear model over the junction tree of some cliques, for a total number of rows."""

    def __init__(self, domain: Domain, cliques: Sequence[Sequence[str]], total: float, most_cells: int = 50_000_000):
        self.domain, self.total = domain, total
        self.order, self.cliques = elimination(domain, cliques)
        if sum(domain.project(c).cells for c in self.cliques) > most_cells:
            raise ValueError("the model's cliques are too large")
        self.potentials = [Factor.constant(domain.project(c)) for c in self.cliques]
        self.edges = spanning_tree(self.cliques)

    def home(self, names: Sequence[str]) -> int:
        return next(i for i, c in enumerate(self.cliques) if set(names) <= set(c))

    def marginals(self, potentials: list[Factor] | None = None) -> list[Factor]:
        """Each clique's expected counts, by messages in both directions along the tree."""
        theta = potentials or self.potentials
        near: dict[int, list[int]] = {i: [] for i in range(len(theta))}
        for i, j in self.edges:
            near[i].append(j)
            near[j].append(i)
        messages: dict[tuple[int, int], Factor] = {}
        walk, seen = [(0, -1)], []
        while walk:
            i, parent = walk.pop()
            seen.append((i, parent))
            walk += [(j, i) for j in near[i] if j != parent]
        for i, parent in [*reversed(seen), *[(p, i) for i, p in seen]]:
            if i < 0 or parent < 0:
                continue
            belief = theta[i]
            for j in near[i]:
                if j != parent:
                    belief = belief + messages[j, i]
            shared = [n for n in self.cliques[i] if n in self.cliques[parent]]
            messages[i, parent] = belief.reduce(shared, log=True)
        out = []
        for i in range(len(theta)):
            belief = theta[i]
            for j in near[i]:
                belief = belief + messages[j, i]
            v = belief.values - belief.values.max()
            p = np.exp(v)
            out.append(Factor(belief.domain, self.total * p / p.sum()).reduce(self.cliques[i]))
        return out

    def fit(self, measured: Sequence[tuple[tuple[str, ...], np.ndarray, float]], steps: int = 500, tolerance: float = 1e-7) -> float:
        """Mirror descent on the weighted squared error of ``measured`` (clique, noisy counts, sigma of all or of each); gives the last loss."""

        def loss(mu: list[Factor]) -> tuple[float, list[Factor]]:
            total, grads = 0.0, [Factor.constant(f.domain) for f in mu]
            for names, y, sigma in measured:
                i = self.home(names)
                x = mu[i].reduce(names)
                gap = (x.values - y) / np.maximum(sigma, 1e-9) ** 2
                total += 0.5 * float(((x.values - y) * gap).sum())
                grads[i] = grads[i] + Factor(x.domain, gap)
            return total, [g.reduce(c) for g, c in zip(grads, self.cliques)]

        mu = self.marginals()
        now, grads = loss(mu)
        step = max(min(float(np.min(s)) for _, _, s in measured), 1e-9) ** 2 / max(self.total, 1.0)
        for t in range(steps):
            for _ in range(30):
                new = [t - Factor(g.domain, g.values * step) for t, g in zip(self.potentials, grads)]
                mu_new = self.marginals(new)
                after, grads_new = loss(mu_new)
                slope = sum(float((g.values * (a.values - b.values)).sum()) for g, a, b in zip(grads, mu, mu_new))
                if now - after >= 0.5 * slope or step < 1e-300:
                    break
                step *= 0.5
            done = t >= 20 and abs(now - after) <= tolerance * max(now, 1e-12)
            self.potentials, mu, grads, now = new, mu_new, grads_new, after
            step *= 1.5
            if done:
                break
        return now

    def marginal(self, names: Sequence[str]) -> Factor:
        """Expected counts over any attributes: from one clique that holds them, else by eliminating the others."""
        try:
            return self.marginals()[self.home(names)].reduce(list(names))
        except StopIteration:
            parts = list(self.potentials)
            for n in self.order:
                if n in names:
                    continue
                held = [f for f in parts if n in f.domain]
                if held:
                    product = held[0]
                    for f in held[1:]:
                        product = product + f
                    parts = [f for f in parts if n not in f.domain] + [product.reduce([x for x in product.domain.names if x != n], log=True)]
            whole = parts[0]
            for f in parts[1:]:
                whole = whole + f
            p = np.exp(whole.values - whole.values.max())
            return Factor(whole.domain, self.total * p / p.sum()).reduce(list(names))

    def sample(self, rows: DataFrame, id_column: str, seed: str = "sample") -> DataFrame:
        """``rows`` with codes: attributes against the order of elimination, each by systematic rounding within its parents' codes."""
        spark = rows.sparkSession
        done: list[str] = []
        for name in reversed(self.order):
            parents = [p for p in done if any(p in c and name in c for c in self.cliques)]
            table = self.marginal([*parents, name]).values
            flat = np.maximum(table.reshape(-1, self.domain.sizes[name]), 0)
            p = np.where(flat.sum(1, keepdims=True) > 0, flat / np.maximum(flat.sum(1, keepdims=True), 1e-300), 1 / flat.shape[1])
            key = F.lit(0).cast("long")
            for q in parents:
                key = key * self.domain.sizes[q] + F.col(q)
            cdf = spark.createDataFrame([(i, np.cumsum(r).tolist()) for i, r in enumerate(p)], "__key long, __cdf array<double>")
            w = Window.partitionBy("__key", "__part")
            # rows of a cell are dealt over parts, so that a cell of any size is rounded in bounded groups
            rows = rows.withColumn("__key", key).withColumn("__part", F.pmod(F.xxhash64(id_column, F.lit(name)), F.lit(64)))
            rows = rows.withColumn("__i", F.row_number().over(w.orderBy(hash_uniform(seed, name, F.col(id_column)), id_column)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
            rows = rows.join(F.broadcast(cdf), "__key")
            # a group's start is random, so that groups of a row or two are still drawn in proportion
            at = (F.col("__i") + hash_uniform(seed, f"{name}|start", F.col("__key"), F.col("__part"))) / F.col("__n")
            rows = rows.withColumn(name, F.least(F.size(F.filter("__cdf", lambda c: c <= at)), F.lit(self.domain.sizes[name] - 1)).cast("int")).drop("__key", "__part", "__i", "__n", "__cdf")
            done.append(name)
        return rows


def measure(df: DataFrame, domain: Domain, cliques: Sequence[Sequence[str]], epsilon: float | None, delta: float = 1e-5, noise: SecureNoise | None = None) -> list[tuple[tuple[str, ...], np.ndarray, float]]:
    """Marginals of all cliques in one pass, with Gaussian noise for (epsilon, delta) as one zCDP budget; without noise if None."""
    sets = [tuple(c) for c in cliques]
    counts = {c: np.zeros(tuple(domain.sizes[n] for n in c)) for c in sets}
    for row in contingency(df, sets, name="__n").collect():
        c = sets[row.set_id]
        counts[c][tuple(row[n] for n in c)] = row["__n"]
    sigma = 0.0
    if epsilon is not None:
        sigma = math.sqrt(len(sets) / (2 * rho_of(epsilon, delta)))
        noise = noise or SecureNoise()
        counts = {c: v + noise.gaussian(sigma, v.shape) for c, v in counts.items()}
    return [(c, v, sigma or 1.0) for c, v in counts.items()]


def total_of(measured) -> float:
    """The number of rows, weighting each marginal's sum by the inverse of its variance; one at least."""
    weight = [1 / float(np.sum(np.broadcast_to(s, v.shape) ** 2)) for _, v, s in measured]
    return max(1.0, float(np.dot(weight, [v.sum() for _, v, _ in measured]) / sum(weight)))


def greedy_cliques(scores: dict[tuple[str, str], float], names: Sequence[str], epsilon: float | None = None, sensitivity: float = 1.0, noise: SecureNoise | None = None) -> list[tuple[str, ...]]:
    """A tree of pairs, grown by the exponential mechanism on the edges' scores (the largest without ``epsilon``)."""
    from privloom.operators.privacy import exponential_probabilities

    noise = noise or SecureNoise()
    score = lambda a, b: scores.get((a, b), scores.get((b, a), 0.0))
    first = names[int(noise.uniform() * len(names))] if epsilon else names[0]
    joined, out = [first], []
    while len(joined) < len(names):
        edges = [(a, b) for a in joined for b in names if b not in joined]
        values = np.array([score(a, b) for a, b in edges])
        if epsilon:
            p = exponential_probabilities(values, epsilon / len(names), sensitivity)
            pick = int(np.searchsorted(np.cumsum(p), noise.uniform()))
        else:
            pick = int(values.argmax())
        a, b = edges[min(pick, len(edges) - 1)]
        joined.append(b)
        out.append((a, b))
    return out or [(names[0],)]
