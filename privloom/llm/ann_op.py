"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected onto a few Gaussian directions, made orthogonal, which keeps their law and lessens its spread: for a distance d the
squared projected distance divided by d^2 follows (nearly) a chi-square law with as many degrees of freedom. A query takes its
neighbours in the order of their projected distance and verifies them one chunk after the other; it stops once a vector as far as its
k-th best would, with the wanted probability, have come up by now. What comes after the stop is never compared in full. Inner
products become distances by one more coordinate that gives all vectors the same length.

On Spark the projected space is cut by a kd-tree's upper levels (fitted on a bounded sample) into cells, and cells into blocks of
bounded size, each with a kd-tree of its own. A query first searches that sample; the k-th distance that it finds bounds how far any
cell may be that the stopping test could still want, and the query visits those blocks alone. A block's vectors lie in one task, once,
and its queries stream past them. A block answers with what is within the bound, which is seldom more than a few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.llm.common import durable, sample_rows, slices, table

#: Neighbours, projections, probability of the stopping test.
NEAREST, DIRECTIONS, SURE = 20, 32, 0.8
#: Bytes of the sample at most: it is sent to every executor.
SAMPLE_BYTES = 16_000_000
#: Vectors of the sample (an eighth of all at most) that cells are fitted on and that queries look at first, vectors of a block, cells at
#: most, queries that are projected and searched together, points of a leaf, and projected neighbours verified between two looks at the stopping test.
SAMPLE, BLOCK, CELLS, QUERIES, LEAF, STEP = 20_000, 4_096, 1_024, 64, 64, 64


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection of the regularised lower incomplete gamma function (its series)."""

    def cdf(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < 1e-16 * total:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x else 0.0

    lo, hi = 0.0, 20.0 * (k + 10)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


@dataclass
class Space:
    """The projection, the longest vector's squared length, and the cells: boxes in the projected space."""

    directions: np.ndarray
    longest: float
    splits: list[tuple[int, float]]  # a complete tree's inner nodes, level by level: dimension and value
    depth: int
    stop: float

    def project(self, x: np.ndarray, stored: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.longest - (x**2).sum(1), 0)) if stored else np.zeros(len(x))
        return x @ self.directions[:-1] + extra[:, None] * self.directions[-1]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        if self.depth:
            dims, values = np.array([d for d, _ in self.splits]), np.array([v for _, v in self.splits])
            for _ in range(self.depth):
                node = 2 * node + 1 + (p[np.arange(len(p)), dims[node]] > values[node])
        return node - (2**self.depth - 1)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        m = self.directions.shape[1]
        lo, hi = [np.full(m, -np.inf)], [np.full(m, np.inf)]
        for level in range(self.depth):
            new_lo, new_hi = [], []
            for i in range(2**level):
                d, v = self.splits[2**level - 1 + i]
                left, right = hi[i].copy(), lo[i].copy()
                left[d], right[d] = min(left[d], v), max(right[d], v)
                new_lo += [lo[i], right]
                new_hi += [left, hi[i]]
            lo, hi = new_lo, new_hi
        return np.array(lo), np.array(hi)


def fit_splits(p: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Medians of the widest dimension, level by level."""
    out, groups = [], [p]
    for _ in range(depth):
        new = []
        for g in groups:
            d = int(np.argmax(g.max(0) - g.min(0))) if len(g) else 0
            v = float(np.median(g[:, d])) if len(g) else 0.0
            out.append((d, v))
            new += [g[g[:, d] <= v], g[g[:, d] > v]] if len(g) else [g, g]
        groups = new
    return out


class KdTree:
    """A balanced kd-tree over the projected points of one block: leaves are slices of one order, with their boxes."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF):
        order, edges = np.arange(len(p)), [(0, len(p))]
        while edges and max(b - a for a, b in edges) > leaf:
            new = []
            for a, b in edges:
                if b - a <= leaf:
                    new.append((a, b))
                    continue
                part = order[a:b]
                d = int(np.argmax(p[part].max(0) - p[part].min(0)))
                mid = (b - a) // 2  # by place, so that equal points split too
                order[a:b] = part[np.argpartition(p[part, d], mid)]
                new += [(a, a + mid), (a + mid, b)]
            edges = new
        self.order, self.edges = order, edges
        self.points = p[order]
        self.rows = [np.arange(a, b) for a, b in edges]
        self.lo = np.array([self.points[a:b].min(0) for a, b in edges])
        self.hi = np.array([self.points[a:b].max(0) for a, b in edges])

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of projected queries to the leaves' boxes (queries x leaves)."""
        gap = np.maximum(np.maximum(self.lo[None] - q[:, None], q[:, None] - self.hi[None]), 0)
        return (gap**2).sum(2)


@dataclass
class Found:
    rows: list[np.ndarray]  # of each query: places in the block, best first
    scores: list[np.ndarray]
    verified: int


class Block:
    """Vectors of one block behind their kd-tree. ``ids`` decide ties; ``x`` and ``ids`` are reordered to the tree's order."""

    def __init__(self, space: Space, ids: np.ndarray, x: np.ndarray):
        self.space, self.tree = space, KdTree(space.project(x, True))
        self.place = self.tree.order
        self.ids, self.x = ids[self.place], x[self.place]
        self.size = (self.tree.points**2).sum(1)

    def search(self, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> Found:
        """The best of each query among the vectors of other ids. ``bounds``: squared distances within which a query already has k neighbours."""
        out = Found([], [], 0)
        for at in range(0, len(q), QUERIES):
            some = slice(at, at + QUERIES)
            qp, reach = self.space.project(q[some], False), self.space.stop * bounds[some]
            # leaves that no query of the group could want stay closed
            near = (self.tree.leaf_distances(qp) <= reach[:, None]).any(axis=0)
            opened = np.concatenate([r for r, want in zip(self.tree.rows, near.tolist()) if want] or [np.zeros(0, np.int64)])
            far = np.maximum((qp**2).sum(1)[:, None] + self.size[opened] - 2 * (qp @ self.tree.points[opened].T), 0)
            for i in range(len(qp)):
                rows, scores, n = self._one(qids[at + i], q[at + i], far[i], opened, bounds[at + i], k)
                out.rows.append(rows)
                out.scores.append(scores)
                out.verified += n
        return out

    def _one(self, qid: int, q: np.ndarray, far: np.ndarray, opened: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        stop, base, worst = self.space.stop, float((q**2).sum() + self.space.longest), bound
        wanted = np.flatnonzero((far <= stop * worst) & (self.ids[opened] != qid))
        order = wanted[np.argsort(far[wanted], kind="stable")]  # projected neighbours, nearest first
        far, order = far[order], opened[order]
        best, score = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, STEP
        while at < len(order) and far[at] <= stop * worst:
            end = at + step if math.isinf(worst) else min(at + step, int(np.searchsorted(far, stop * worst, side="right")))
            rows = order[at:end]
            # sums along each row, whatever its place: equal vectors get equal scores, and ties are ties
            best, score = np.append(best, rows), np.append(score, (self.x[rows] * q).sum(1))
            at, step = at + len(rows), 2 * step
            if len(best) > k:
                keep = np.lexsort((self.ids[best], -score))[:k]
                best, score = best[keep], score[keep]
            if len(best) >= k:
                worst = min(worst, max(base - 2 * float(score.min()), 0) * (1 + 1e-12))
        keep = np.lexsort((self.ids[best], -score))
        best, score = best[keep], score[keep]
        if math.isfinite(bound):  # others are not among the k nearest
            within = 2 * score >= base - bound * (1 + 1e-9)
            best, score = best[within], score[within]
        return self.place[best], score, at


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>, tag) of the different rows that take part: finite, not null, not zero. ``tag`` tells vectors of one id apart."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad) & F.exists("x", lambda v: v != 0))
    return rows.distinct().withColumn("tag", F.xxhash64("x"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def fit_space(rows: DataFrame, directions: int = DIRECTIONS, sure: float = SURE, seed: int = 11) -> tuple[Space, pa.Table]:
    """The space of vectors of one length, and the sample (rows of the smallest hashes of their ids)."""
    n, longest, dim = rows.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.max(F.size("x"))).first()
    space = new_space(dim, float(longest) * (1 + 1e-9), directions, sure, seed)
    sample = sample_rows(rows, F.col("vec_id"), max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim), n // 8))).toArrow()
    depth = min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(n / BLOCK))), max(0, int(math.log2(max(1, sample.num_rows / 16)))))
    if depth:
        space.splits, space.depth = fit_splits(space.project(_matrix(sample.column("x")), True), depth), depth
    return space, sample


def new_space(dim: int, longest: float, directions: int = DIRECTIONS, sure: float = SURE, seed: int = 11) -> Space:
    directions = min(directions, dim + 1)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim + 1, directions)))[0] * math.sqrt(dim + 1)
    return Space(basis, longest, [], 0, chi_square_quantile(sure, directions))


def nearest(vectors: DataFrame, every: int = 20, k: int = NEAREST, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of the query's length but those with its own vec_id. Ties go
    to the smaller vec_id. Vectors null, zero, or with null or non-finite components take no part, nor do rows with a null vec_id; an empty table
    gives an empty one. A repeated vec_id is a candidate (and a query) once for each different vector; repeats of the whole row count
    once. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = durable(valid_vectors(vectors), "vectors")
    lengths = [r.n for r in rows.select(F.size("x").alias("n")).distinct().orderBy("n").collect()]  # one row a length
    found = spark.createDataFrame([], "query_id long, tag long, vec_id long, other long, score double")
    for n in lengths:
        found = found.unionByName(_nearest_of(rows.filter(F.size("x") == n), every, k, sure))
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id", "other")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of(rows: DataFrame, every: int, k: int, sure: float) -> DataFrame:
    """(query_id, tag, vec_id, other, score): candidates of each query among vectors of one length; ``other`` is the candidate's tag."""
    space, sample_table = fit_space(rows, sure=sure)
    sample = rows.sparkSession.sparkContext.broadcast((sample_table.column("vec_id").to_numpy(), _matrix(sample_table.column("x")), sample_table.column("tag").to_numpy()))  # SAMPLE_BYTES at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = space.cell(space.project(_matrix(batch.column(1)), True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["vec_id", "x", "tag", "cell"])

    shape = "vec_id long, x array<double>, tag long"
    placed = rows.mapInArrow(place, f"{shape}, cell int")
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # CELLS rows at most
    parts = np.array([max(1, math.ceil(sizes.get(c, 0) / BLOCK)) for c in range(2**space.depth)])
    first = np.concatenate(([0], np.cumsum(parts)))
    lo, hi = space.boxes()
    columns = ["vec_id", "x", "tag", "block", "bound"]

    def to_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(3).to_numpy()
            ids = batch.column(0).to_numpy().view(np.uint64)
            sub = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first[cell] + sub, pa.int64()), pa.nulls(len(cell), pa.float64())], columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The squared distance within which the sample has k others, and these."""
        known, x, tags = sample.value
        block = Block(space, known, x)
        for batch in slices(batches, None, 4 * QUERIES):
            q, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            found = block.search(ids, q, np.full(len(q), np.inf), k)
            bound = np.array([max((v**2).sum() + space.longest - 2 * s.min(), 0) * (1 + 1e-9) if len(s) == k else np.inf for v, s in zip(q, found.scores)])
            near = [[{"vec_id": i, "other": t, "score": s} for i, t, s in zip(known[r].tolist(), tags[r].tolist(), each.tolist())] for r, each in zip(found.rows, found.scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bound), pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])))], ["vec_id", "x", "tag", "bound", "near"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, bound = space.project(_matrix(batch.column(1)), False), batch.column(3).to_numpy(zero_copy_only=False)
            for i in range(len(p)):
                gap = np.maximum(np.maximum(lo - p[i], p[i] - hi), 0)
                wanted = np.flatnonzero((gap**2).sum(1) <= space.stop * bound[i])
                to = np.concatenate([np.arange(first[c], first[c + 1]) for c in wanted] or [np.zeros(0, np.int64)])
                if len(to):
                    row = batch.slice(i, 1)
                    again = pa.array(np.zeros(len(to), np.int64))
                    yield pa.RecordBatch.from_arrays([*(row.column(c).take(again) for c in range(3)), pa.array(to), row.column(3).take(again)], columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, its vectors (without a bound) before its queries: the vectors are kept, the queries stream past."""
        at, vectors, block, tags = None, [], None, None
        for whole in batches:
            blocks, stored = whole.column(3).to_numpy(), np.asarray(whole.column(4).is_null())
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (stored[1:] != stored[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                if a == b:
                    continue
                part = whole.slice(a, b - a)
                if blocks[a] != at:
                    at, vectors, block = blocks[a], [], None
                if stored[a]:
                    vectors.append(part)
                    continue
                if block is None:
                    if not vectors:
                        continue
                    ids = np.concatenate([v.column(0).to_numpy() for v in vectors])
                    block, tags = Block(space, ids, np.concatenate([_matrix(v.column(1)) for v in vectors])), np.concatenate([v.column(2).to_numpy() for v in vectors])
                    vectors = [part.slice(0, 0)]
                qids, qtags = part.column(0).to_numpy(), part.column(2).to_numpy()
                found = block.search(qids, _matrix(part.column(1)), part.column(4).to_numpy(zero_copy_only=False), k)
                n, rows_of = [len(r) for r in found.rows], np.concatenate(found.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, n)), pa.array(np.repeat(qtags, n)), pa.array(ids[rows_of]), pa.array(tags[rows_of]), pa.array(np.concatenate(found.scores))],
                    ["query_id", "tag", "vec_id", "other", "score"],
                )

    with_block = f"{shape}, block long, bound double"
    asked = rows.filter(F.col("vec_id") % every == 0).mapInArrow(look, f"{shape}, bound double, near array<struct<vec_id: long, other: long, score: double>>")
    asked = durable(asked, "queries")
    seen = asked.select(F.col("vec_id").alias("query_id"), "tag", F.explode("near").alias("f")).select("query_id", "tag", "f.vec_id", "f.other", "f.score")
    both = placed.mapInArrow(to_block, with_block).unionByName(asked.select("vec_id", "x", "tag", "bound").mapInArrow(reach, with_block))
    both = both.repartition("block").sortWithinPartitions("block", F.col("bound").asc_nulls_first())
    return both.mapInArrow(meet, "query_id long, tag long, vec_id long, other long, score double").union(seen)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
