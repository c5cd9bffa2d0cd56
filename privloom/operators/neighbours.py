"""Exact nearest neighbours by balls around pivots.

Candidates belong to their nearest pivot, and each pivot's ball has the radius of its farthest one. A query first meets its own
pivot's ball; the distance it finds there rules out every ball that it can't reach within it, and only the others are visited.

Balls that lie near each other share a cell, and queries of one cell form a block, so that a task holds one block and one cell whatever
the number of balls. Inside it matrix products rule out the pairs that can't count, and what is left is measured by differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points of a block at least, numbers of a block at most, blocks aimed at between these; pivots at most; pairs of a piece of work.
LEAST_BLOCK, BLOCK_NUMBERS, BLOCKS, PIVOTS, PAIRS = 4_096, 1 << 22, 16, 512, 1 << 17
#: Components from this size on are measured one by one, as their squares may overflow.
HUGE, HUGE_SINGLE = 1e150, 1e36


def _matrix(column) -> np.ndarray:
    """Rows of equal length without a copy of each number as an object."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ListArray) and not column.null_count:
        flat, n = column.flatten(), len(column)
        sizes = np.diff(column.offsets.to_numpy())
        if n and not flat.null_count and (sizes == sizes[0]).all():
            return flat.to_numpy().reshape(n, -1).astype(float)
    return np.array(column.to_pylist(), float)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows of x to rows of y by one product, and how far off they may be."""
    at = y[np.isfinite(y).all(1)].mean(0) if np.isfinite(y).all(1).any() else 0.0
    x, y = x - at, y - at
    size = (x**2).sum(1)[:, None] + (y**2).sum(1)[None]
    return size - 2 * x @ y.T, 4 * (x.shape[1] + 8) * np.finfo(float).eps * size


def pivots_of(points: DataFrame, n: int, most: int = PIVOTS) -> np.ndarray:
    """About a root of ``n`` different vectors, those with the smallest hashes."""
    rows = points.select(F.xxhash64("v").alias("h"), "v")
    last = rows.select("h").distinct().orderBy("h").limit(min(most, max(1, int(n**0.5)))).agg(F.max("h")).first()[0]
    return np.array([r.v for r in rows.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()], float)


@dataclass(frozen=True)
class Balls:
    """Pivots with the radius and the number of candidates of each; of each ball the first of its cells and their number."""

    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    cell: np.ndarray
    slices: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray, block: int) -> "Balls":
        left, order = set(range(len(pivots))), []
        while left:  # from each pivot to the nearest that is left
            rest = np.array(sorted(left))
            far = np.nan_to_num(((pivots[rest] - pivots[order[-1]]) ** 2).sum(1), nan=np.inf) if order else np.zeros(len(rest))
            order.append(int(rest[far.argmin()]))
            left.remove(order[-1])
        cell, slices, at, held = np.zeros(len(pivots), int), np.maximum(1, -(-sizes // block)), 0, 0
        for i in order:
            if held and held + sizes[i] > block:
                at, held = at + 1, 0
            cell[i], held = at, held + sizes[i]
            if slices[i] > 1:  # a large ball has cells of its own
                at, held = at + int(slices[i]), 0
        return cls(pivots, radius, sizes, cell, slices)

    def within(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Whether a query's bound reaches a ball (all, or ``of`` some) that isn't its own."""
        of = np.arange(len(self.pivots)) if of is None else of
        square, off = _squares(x, self.pivots[of])
        reach = bound[:, None] + self.radius[of][None]
        near = ~(square - off > reach**2 * (1 + 1e-12) + 1e-12) & (self.sizes[of] > 0)[None]  # also where a distance is no number
        return near & (own[:, None] != of[None])

    def column(self, values: np.ndarray) -> Column:
        """Of the ball in column ``part`` its value."""
        return F.get(F.from_json(F.lit(str(values.tolist())), "array<int>"), F.col("part"))


def _placed(points: DataFrame, pivots: np.ndarray, kind: str, number: str) -> DataFrame:
    """(k, v, part, far): a nearest pivot and the distance to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                x = _matrix(piece.column(1))
                part = _squares(x, pivots)[0].argmin(1)
                far = np.sqrt(((x - pivots[part]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(part, pa.int32()), pa.array(far)], ["k", "v", "part", "far"])

    return points.mapInArrow(work, f"k {kind}, v {number}, part int, far double")


def _bounds(column) -> np.ndarray:
    return np.array([np.inf if x is None else x for x in column.to_pylist()], float)


def _visits(queries: DataFrame, balls: Balls, kind: str, number: str) -> DataFrame:
    """(k, v, part, bound, cell) of each cell with a ball but the query's own that is within reach of its ``bound`` (null: all)."""
    cells = int((balls.cell + balls.slices).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                near = balls.within(_matrix(piece.column(1)), piece.column(2).to_numpy(), _bounds(piece.column(3)))
                seen = np.zeros((piece.num_rows, cells), bool)
                for p in np.flatnonzero(near.any(0)).tolist():
                    seen[near[:, p], balls.cell[p] : balls.cell[p] + balls.slices[p]] = True
                i, cell = np.nonzero(seen)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(i)) for c in piece.columns] + [pa.array(cell, pa.int32())], ["k", "v", "part", "bound", "cell"])

    return queries.select("k", "v", "part", "bound").mapInArrow(work, f"k {kind}, v {number}, part int, bound double, cell int")


def _merge(best: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
    """Puts distances d of rows i into ``best``, a row's smallest in order; what is no number comes last."""
    rows, at = np.unique(i, return_inverse=True)
    k = best.shape[1]
    owner, every = np.concatenate([np.repeat(np.arange(len(rows)), k), at]), np.concatenate([best[rows].ravel(), d])
    every = every[np.lexsort((every, owner))]
    start = np.searchsorted(np.sort(owner), np.arange(len(rows)))
    best[rows] = every[start[:, None] + np.arange(k)]


def _measure(best: np.ndarray, rows: np.ndarray, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Exact distances of pairs, in pieces that keep memory small; by differences, as products lose digits of small distances."""
    step = max(1, PAIRS // max(x.shape[1], 1))
    for a in range(0, len(i), step):
        p, q = i[a : a + step], j[a : a + step]
        _merge(best, rows[p], np.sqrt(((x[p] - y[q]) ** 2).sum(1)))


def _nearest(best: np.ndarray, bound: np.ndarray, rows: np.ndarray, x: np.ndarray, y: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Puts the distances of x to those of y with other keys into the ``rows`` of ``best``, but for those that k nearer ones or the ``bound`` rule out; gives
    the number of these others of each row."""
    k = best.shape[1]
    order = np.argsort(other, kind="stable")
    lo, hi = np.searchsorted(other[order], mine), np.searchsorted(other[order], mine, side="right")
    fine, good = (np.abs(x) < HUGE).all(1), (np.abs(y) < HUGE).all(1)
    if not (fine.all() and good.all()):  # few: what is no finite number, or a huge one, is measured with all
        for p in range(len(x)):
            j = np.flatnonzero((other != mine[p]) & (~good | ~fine[p]))
            _measure(best, rows, x, y, np.full(len(j), p), j)
    if not (fine.any() and good.any()):
        return len(y) - (hi - lo)
    at = y[good].mean(0)
    u, z = np.where(fine[:, None], x - at, 0.0), np.where(good[:, None], y - at, 0.0)
    own, size = (u**2).sum(1), (z**2).sum(1)
    # single precision on a scale by which no square overflows; its error is below ``off``
    scale = max(np.sqrt(size.max()), 1e-6 * np.sqrt(own.max())) or 1.0
    u, own, size = (u / scale).astype(np.float32), own / scale**2, np.where(good, size / scale**2, HUGE_SINGLE).astype(np.float32)
    z = np.vstack([(z / scale).astype(np.float32).T, size[None]])
    u = np.hstack([-2 * u, np.ones((len(u), 1), np.float32)])
    off = 2 * (x.shape[1] + 8) * np.finfo(np.float32).eps * (own + 1)
    step = max(1, PAIRS // len(y))
    for a in range(0, len(x), step):
        b = np.arange(a, min(a + step, len(x)))[fine[a : a + step]]
        if not len(b):
            continue
        g = u[b] @ z  # squared distances less the row's own square
        first, last = lo[b], hi[b]
        while (first < last).any():
            p = np.flatnonzero(first < last)
            g[p, order[first[p]]] = HUGE_SINGLE
            first = first + (first < last)
        least = g.min(1)
        upto = least if k == 1 else np.partition(g, k - 1, axis=1)[:, k - 1] if g.shape[1] > k else np.full(len(b), np.inf)
        known = (np.fmin(best[rows[b], -1], bound[rows[b]]) / scale) ** 2 * (1 + 1e-9)
        limit = np.fmin(upto + 2 * off[b], known - own[b] + off[b])
        limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        hit = np.flatnonzero(least <= limit)
        i, j = np.nonzero((g[hit] <= limit[hit, None]) & (g[hit] < HUGE_SINGLE / 2))
        _measure(best, rows, x, y, b[hit[i]], j)
    return len(y) - (hi - lo)


def _few_copies(v: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Which candidates to keep: of equal vectors, unless keys repeat, one more than can count."""
    if len(np.unique(keys)) < len(keys) or not v.shape[1]:
        return np.ones(len(v), bool)
    same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    sizes = np.bincount(same)
    place = np.empty(len(v), int)
    place[order] = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place <= k


def _meet(queries: DataFrame, candidates: DataFrame, asked: np.ndarray, balls: Balls, k: int, block: int, kind: str, first: bool) -> DataFrame:
    """(k, d): each query's ``k`` smallest distances in each cell of column ``cell``: to its own ball's candidates (``first``), or to those of other balls
    that its bound reaches."""
    # blocks of queries: those of balls of one cell, in pieces of a block
    homes = np.bincount(balls.cell, weights=asked, minlength=int(balls.cell.max()) + 1).astype(int)
    pieces = np.maximum(1, -(-homes // block))
    start = np.cumsum(pieces) - pieces
    group = balls.column(start[balls.cell]) + F.pmod(F.xxhash64("k"), balls.column(pieces[balls.cell])).cast("int")
    left = queries.select("k", "v", "part", "bound", group.alias("qb"), "cell")
    if first:
        groups = F.sequence(balls.column(start[balls.cell]), balls.column((start + pieces - 1)[balls.cell]))
    else:
        groups = F.sequence(F.lit(0), F.lit(int(pieces.sum()) - 1))
    right = candidates.select("k", "v", "part", F.explode(groups).alias("qb"), "cell")

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a.column("k")
        if not (a.num_rows and b.num_rows):
            return pa.table({"k": ids.slice(0, 0), "d": pa.array([], pa.list_(pa.float64()))})
        codes = pa.chunked_array([*ids.chunks, *b.column("k").chunks]).dictionary_encode(null_encoding="encode").combine_chunks()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        mine, other = codes[: a.num_rows], codes[a.num_rows :]
        x, y, own, part = _matrix(a.column("v")), _matrix(b.column("v")), a.column("part").to_numpy(), b.column("part").to_numpy()
        keep = _few_copies(y, other, k)
        y, other, part = y[keep], other[keep], part[keep]
        bound = _bounds(a.column("bound"))
        best, n = np.full((len(x), k), np.nan), np.zeros(len(x), int)
        parts = np.unique(part)
        near = np.concatenate([own[s : s + 1024, None] == parts if first else balls.within(x[s : s + 1024], own[s : s + 1024], bound[s : s + 1024], parts) for s in range(0, len(x), 1024)])
        for c, p in enumerate(parts.tolist()):
            rows, those = np.flatnonzero(near[:, c]), np.flatnonzero(part == p)
            if len(rows):
                n[rows] += _nearest(best, bound, rows, x[rows], y[those], mine[rows], other[those])
        # what is no number counts only where fewer than k distances were known before
        kept = (np.arange(k)[None] < n[:, None]) & ~(np.isnan(best) & np.isfinite(bound)[:, None])
        at = pa.array(np.concatenate(([0], np.cumsum(kept.sum(1)))), pa.int32())
        return pa.table({"k": ids, "d": pa.ListArray.from_arrays(at, pa.array(best[kept]))})

    found = left.groupBy("qb", "cell").cogroup(right.groupBy("qb", "cell")).applyInArrow(work, f"k {kind}, d array<double>")
    return found.select("k", F.explode("d").alias("d"))


def _smallest(found: DataFrame, k: int) -> DataFrame:
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("d"))).filter(F.col("r") <= k)
    return best.groupBy("k").agg(F.sort_array(F.collect_list("d")).alias("distances"))


def _plan(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int, block: int | None):
    kind = dict(queries.dtypes)[key]
    number = "array<float>" if dict(queries.dtypes)[vector] == dict(candidates.dtypes)[vector] == "array<float>" else "array<double>"
    points = lambda df: df.select(F.col(key).alias("k"), F.col(vector).cast(number).alias("v"))
    left, right = points(queries), points(candidates)
    count = right.count()
    if not count:
        return None
    pivots = pivots_of(right, count)
    if block is None:
        block = min(max(LEAST_BLOCK, count // BLOCKS), max(1, BLOCK_NUMBERS // max(pivots.shape[1], 1)))
    held = _placed(right, pivots, kind, number)
    found = {r.part: (r.radius, r.n) for r in held.groupBy("part").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    radius, sizes = (np.array([found.get(i, (-np.inf, 0))[f] for i in range(len(pivots))]) for f in (0, 1))
    balls = Balls.of(pivots, radius, sizes.astype(int), block)
    cell = balls.column(balls.cell)
    held = held.select("k", "v", "part", (cell + F.pmod(F.xxhash64("k"), balls.column(balls.slices)).cast("int")).alias("cell"))
    asking = _placed(left, pivots, kind, number)
    asked = np.zeros(len(pivots), int)
    for r in asking.groupBy("part").count().collect():  # a row a pivot
        asked[r.part] = r["count"]
    own = asking.select("k", "v", "part", F.lit(None).cast("double").alias("bound"), F.explode(F.sequence(cell, cell + balls.column(balls.slices) - 1)).alias("cell"))
    first = _meet(own, held, asked, balls, k, block, kind, True)
    bound = _smallest(first, k).select(F.col("k").alias("__k"), F.when(F.size("distances") >= k, F.element_at("distances", -1)).alias("bound"))
    bounded = asking.join(bound, F.col("k") == F.col("__k"), "left")
    return first, bounded, held, asked, balls, kind, number, block


def nearest_distances(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int = 1, block: int | None = None) -> DataFrame:
    """(key, distances array<double>): the k smallest Euclidean distances of each query to the candidates but those with its own key. Queries without any
    candidate have no row. Keys of queries differ."""
    plan = _plan(queries, candidates, key, vector, k, block)
    if plan is None:
        return queries.select(key).limit(0).withColumn("distances", F.array().cast("array<double>"))
    first, bounded, held, asked, balls, kind, number, block = plan
    second = _meet(_visits(bounded, balls, kind, number), held, asked, balls, k, block, kind, False)
    return _smallest(first.unionByName(second), k).withColumnRenamed("k", key)


def visited_share(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int = 1, block: int | None = None) -> float:
    """The share of all pairs of queries and candidates that ``nearest_distances`` compares."""
    plan = _plan(queries, candidates, key, vector, k, block)
    if plan is None:
        return 0.0
    _, bounded, _, asked, balls, _, _, _ = plan

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = balls.within(_matrix(b.column(1)), b.column(2).to_numpy(), _bounds(b.column(3))) if b.num_rows else np.zeros((0, len(balls.sizes)), bool)
            yield pa.RecordBatch.from_arrays([pa.array(near @ balls.sizes, pa.int64())], ["n"])

    met = int(asked @ balls.sizes) + (bounded.select("k", "v", "part", "bound").mapInArrow(work, "n long").agg(F.sum("n").alias("n")).first().n or 0)
    return met / max(queries.count() * candidates.count(), 1)
