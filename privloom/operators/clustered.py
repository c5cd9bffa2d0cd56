"""A network whose candidate parents are judged through clusters of their codes.

Each step scores every column that is left with every set of chosen ones: the sets' distinct codes, weighted by how many rows have
them, are clustered, and the information that the cluster and the column share, over the mean of their entropies, is the score. One scan
counts the cells of all candidates of a step; clustering and scores work on these cells. Centroids, scores and sparse tables go to
the driver, rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.functions import hash_uniform
from privloom.operators.privacy import SecureNoise, information_sensitivity, most_parents_useful
from privloom.operators.relational import lookup

#: Clusters of a set's codes, rounds of clustering, and the heaviest codes that its first centroids are chosen from.
CLUSTERS, ROUNDS, SEEDS = 10, 8, 256
#: Distinct codes of all sets that the driver clusters itself; more are clustered by Spark, in the same way.
SMALL = 100_000
#: Observed cells of a conditional table at most: it is on the driver when noise is drawn. The last parent goes beyond that.
CELLS = 2_000_000


def candidate_cells(coded: DataFrame, sets: Sequence[Sequence[str]], children: Sequence[str]) -> DataFrame:
    """(set, child, codes, code, n): of each set of parents, by place in ``sets``, with each child, from one scan. A child in a set is passed over."""
    each = [F.struct(F.lit(i).alias("set"), F.lit(c).alias("child"), F.array(*[F.col(p).cast("int") for p in s]).alias("codes"), F.col(c).cast("int").alias("code")) for i, s in enumerate(sets) for c in children if c not in s]
    return coded.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("set", "child", "codes", "code").agg(F.count(F.lit(1)).alias("n"))


def _nearest(centroids: Column, codes: Column) -> Column:
    """Place of the nearest centroid, the first of equals."""
    far = F.transform(centroids, lambda c: F.aggregate(F.zip_with(c, codes, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b))
    return F.array_position(far, F.array_min(far)).cast("int") - 1


def _with_centroids(df: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    rows = [(s, c.tolist()) for s, c in centroids.items()]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, "set int, centroids array<array<double>>")), "set")  # a row a set


def first_centroids(points: np.ndarray, weights: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """The heaviest point, then again and again the one with the largest weighted distance to those chosen."""
    chosen = [int(np.argmax(weights))]
    far = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(points)) and far.max() > 0:
        chosen.append(int(np.argmax(far * weights)))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen].astype(float)


def cluster(cells: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Centroids of each set's distinct codes, weighted by their rows: Lloyd's rounds, of all sets at once, until none moves."""
    one = cells.groupBy("set", "codes", "child").agg(F.sum("n").alias("w")).groupBy("set", "codes").agg(F.max("w").alias("w"))
    few = one.limit(SMALL + 1).collect()
    if len(few) <= SMALL:
        return _cluster_few([(r["set"], r["codes"], r["w"]) for r in few], k, rounds)
    heavy = Window.partitionBy("set").orderBy(F.desc("w"), "codes")
    found: dict[int, list] = {}
    for row in one.withColumn("r", F.row_number().over(heavy)).filter(F.col("r") <= SEEDS).orderBy("set", "r").collect():
        found.setdefault(row["set"], []).append((row["codes"], row["w"]))
    centroids = {s: first_centroids(np.array([c for c, _ in v], float).reshape(len(v), -1), np.array([w for _, w in v], float), k) for s, v in found.items()}
    for _ in range(rounds):
        dealt = _with_centroids(one, centroids).withColumn("cluster", _nearest(F.col("centroids"), F.col("codes")))
        dealt = dealt.select("set", "cluster", "w", F.posexplode("codes").alias("axis", "x")).groupBy("set", "cluster", "axis").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
        moved = {s: c.copy() for s, c in centroids.items()}
        for row in dealt.collect():  # a row a centroid's coordinate
            moved[row["set"]][row.cluster, row.axis] = row.x
        if all(np.allclose(moved[s], centroids[s], atol=1e-9) for s in moved):
            break
        centroids = moved
    return centroids


def _cluster_few(rows: list[tuple[int, list[int], int]], k: int, rounds: int) -> dict[int, np.ndarray]:
    """``cluster`` of codes that are all here."""
    held: dict[int, list] = {}
    for s, codes, w in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        held.setdefault(s, []).append((codes, w))
    out = {}
    for s, v in held.items():
        points, weights = np.array([c for c, _ in v], float).reshape(len(v), -1), np.array([w for _, w in v], float)
        centroids = first_centroids(points[:SEEDS], weights[:SEEDS], k)
        for _ in range(rounds):
            near = ((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
            mass = np.bincount(near, weights, len(centroids))
            moved = np.stack([np.bincount(near, weights * points[:, i], len(centroids)) for i in range(points.shape[1])], 1) / np.maximum(mass, 1e-300)[:, None]
            moved = np.where(mass[:, None] > 0, moved, centroids)
            if np.allclose(moved, centroids, atol=1e-9):
                break
            centroids = moved
        out[s] = centroids
    return out


def cluster_scores(cells: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """(set, child, score): the information of cluster and child over the mean of their entropies; 1 if both are constant, 0 if one is."""
    dealt = _with_centroids(cells, centroids).withColumn("cluster", _nearest(F.col("centroids"), F.col("codes")))
    dealt = dealt.groupBy("set", "child", "cluster", "code").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("set", "child"))
    dealt = dealt.withColumns({
        "p": F.col("n") / total, "pu": F.sum("n").over(Window.partitionBy("set", "child", "cluster")) / total, "pv": F.sum("n").over(Window.partitionBy("set", "child", "code")) / total,
    })
    one = dealt.groupBy("set", "child").agg(
        F.greatest(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pu") * F.col("pv")))), F.lit(0.0)).alias("mi"), (-F.sum(F.col("p") * F.log("pu"))).alias("hu"), (-F.sum(F.col("p") * F.log("pv"))).alias("hv"), F.count(F.lit(1)).alias("cells"),
    )
    return one.select("set", "child", F.when(F.col("cells") == 1, 1.0).when(F.col("mi") > 1e-12, 2 * F.col("mi") / (F.col("hu") + F.col("hv"))).otherwise(0.0).alias("score"))


def binned(code: Column, size: int, bins: int) -> Column:
    """A child's code for scoring: itself, or one of ``bins`` equal right-closed bins where it has more values."""
    return code if size <= bins else F.greatest(F.ceil(code * F.lit(bins / (size - 1))) - 1, F.lit(0)).cast("int")


def edge_probabilities(scores: Sequence[float], reaches: Sequence[float], epsilon: float, columns: int) -> np.ndarray:
    """Chances of the exponential mechanism over a step's candidates, each with its own sensitivity; a network of ``columns`` shares the budget."""
    z = np.array(scores) / (2 * (columns - 1) * np.array(reaches) / epsilon)
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class SparseNetwork:
    """Columns in order with their parents and tables; a table has rows for the parents' codes that were observed: key to probabilities."""

    sizes: dict[str, int]
    edges: list[tuple[str, list[str]]] = field(default_factory=list)
    tables: dict[str, dict[int, np.ndarray]] = field(default_factory=dict)

    def key(self, parents: Sequence[str]) -> Column:
        key = F.lit(0).cast("long")
        for p in parents:
            key = key * self.sizes[p] + F.col(p).cast("long")
        return key

    def sample(self, rows: DataFrame, id_column: str, uniform: Callable | None = None, seed: str = "sample") -> DataFrame:
        """``rows`` with a code for each column: the first whose cumulative probability reaches a uniform number; parents' codes that were never
        observed give every code the same chance."""
        spark = rows.sparkSession
        uniform = uniform or (lambda tag: hash_uniform(seed, tag, F.col(id_column)))
        for child, parents in self.edges:
            table = spark.createDataFrame([(int(k), np.cumsum(p).tolist()) for k, p in self.tables[child].items()], "key long, cdf array<double>")
            last, u = self.sizes[child] - 1, uniform(child)
            found = F.least(F.size(F.filter("cdf", lambda c: c < u)), F.lit(last))  # noqa: B023
            unseen = F.least(F.floor(u * self.sizes[child]), F.lit(last))
            rows = lookup(rows, self.key(parents), table, "cdf").withColumn(child, F.when(F.col("cdf").isNotNull(), found).otherwise(unseen).cast("int")).drop("cdf")
        return rows


def search(coded: DataFrame, sizes: dict[str, int], epsilon: float | None, most: int, bins: int = 100, least: float = 0.01, noise: SecureNoise | None = None, root: str | None = None) -> list[tuple[str, list[str]]]:
    """The network's edges in order: a root by chance, then each time one candidate of a column left and chosen ones (``most`` at most, as many as there
    are), by the exponential mechanism, or the best without ``epsilon``. A chosen score of ``least`` or less leaves the column without parents."""
    noise = noise or SecureNoise()
    names = sorted(sizes)
    n = coded.count()
    root = root or names[min(int(noise.uniform() * len(names)), len(names) - 1)]
    edges = [(root, [])]
    for _ in range(len(names) - 1):
        chosen = [c for c, _ in edges]
        left = [c for c in names if c not in chosen]
        sets = list(combinations(sorted(chosen), min(len(chosen), most)))
        if not sets[0]:  # no parents allowed
            edges.append((left[0], []))
            continue
        both = coded.select(*[F.col(c) for c in chosen], *[binned(F.col(c), sizes[c], bins).alias(c) for c in left])
        cells = candidate_cells(both, sets, left).persist()
        try:
            scored = sorted((r["set"], r.child, r.score) for r in cluster_scores(cells, cluster(cells)).collect())  # a row a candidate
        finally:
            cells.unpersist()
        two = lambda s, c: sizes[c] <= 2 or len(s) == 1 and sizes[s[0]] <= 2
        reaches = [information_sensitivity(n, two(sets[s], c)) for s, c, _ in scored]
        if epsilon:
            chances = np.cumsum(edge_probabilities([x for _, _, x in scored], reaches, epsilon, len(names)))
            at = min(int(np.searchsorted(chances, noise.uniform())), len(scored) - 1)
        else:
            at = max(range(len(scored)), key=lambda i: (scored[i][2], -i))
        s, child, score = scored[at]
        edges.append((child, list(sets[s]) if score > least else []))
    return edges


def _counted(coded: DataFrame, columns: Sequence[str], scale: float, noise: SecureNoise) -> tuple[np.ndarray, np.ndarray]:
    """Observed cells of some columns and their noisy counts, none below 0."""
    rows = coded.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).orderBy(*columns).collect()
    n = np.array([r["__n"] for r in rows], float)
    n = n + noise.laplace(scale, n.shape) if scale else n
    return np.array([[r[c] for c in columns] for r in rows], np.int64).reshape(len(rows), len(columns)), np.maximum(n, 0)


def _table(cells: np.ndarray, n: np.ndarray, sizes: Sequence[int]) -> dict[int, np.ndarray]:
    """Observed parents' codes (row-major) to the child's probabilities, a count more in each cell; without parents the counts alone."""
    key = np.zeros(len(cells), np.int64)
    for i, size in enumerate(sizes[:-1]):
        key = key * size + cells[:, i]
    out: dict[int, np.ndarray] = {}
    order = np.argsort(key, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(key[order])) + 1).tolist(), len(order)]
    for a, b in pairwise(cuts):
        own = order[a:b]
        mass = np.bincount(cells[own, -1], n[own], sizes[-1]) + (len(sizes) > 1)
        out[int(key[own[0]])] = mass / mass.sum() if mass.sum() > 0 else np.full(sizes[-1], 1 / sizes[-1])
    return out


def tables(coded: DataFrame, net: SparseNetwork, most: int, epsilon: float | None, noise: SecureNoise | None = None) -> SparseNetwork:
    """``net`` with its tables: the first ``most`` columns share one noisy joint count, each other column has its own; Laplace noise of scale
    2 (columns - most) / (rows * epsilon) on shares, hence so many rows on counts."""
    noise = noise or SecureNoise()
    scale = 2 * (len(net.edges) - most) / epsilon if epsilon else 0.0
    first = [c for c, _ in net.edges[:most]]
    joint = _counted(coded, first, scale, noise) if first else None
    for i, (child, parents) in enumerate(net.edges):
        while parents and coded.select(*parents, child).distinct().limit(CELLS + 1).count() > CELLS:
            parents.pop()
        wanted = [*parents, child]
        if i < most and all(c in first for c in wanted):
            cells, n = joint[0][:, [first.index(c) for c in wanted]], joint[1]
        else:
            cells, n = _counted(coded, wanted, scale, noise)
        net.tables[child] = _table(cells, n, [net.sizes[c] for c in wanted])
    return net


def fit(coded: DataFrame, sizes: dict[str, int], epsilon: float | None = None, most: int = 0, bins: int = 100, target: float = 5.0, least: float = 0.01, noise: SecureNoise | None = None, root: str | None = None) -> SparseNetwork:
    """Half of ``epsilon`` for the edges and half for the tables; ``most`` parents, by their usefulness if 0."""
    half = epsilon / 2 if epsilon else None
    most = most or most_parents_useful(coded.count(), len(sizes), half or 1e9, target)
    net = SparseNetwork(dict(sizes), search(coded, sizes, half, most, bins, least, noise, root))
    return tables(coded, net, most, half, noise)
