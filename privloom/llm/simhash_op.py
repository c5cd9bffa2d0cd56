"""SimHash near-duplicates with pivot distance tables.

Each fingerprint gets its Hamming distances to a zero fingerprint and to 64 reference fingerprints (pivots), ten or eleven of which differ from
zero within one of six bit ranges only. So the distances to one range's pivots, less that to zero, depend on that range's bits alone, and tell
them (the pivots of a range are linearly independent). Two fingerprints that differ in three bits or fewer have equal relative distances in
at least three ranges: those coordinates are the keys by which candidates meet, in at least one of 20 cells. Within a cell, by
the triangle inequality, pairs whose largest coordinate difference exceeds three bits are discarded, in the order of the first coordinate, and
only survivors are compared bit by bit. Copies of a fingerprint are one row; a cell passes on a spanning forest of its
links, never all pairs, and a large cell is cut into chunks whose pairs meet in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.llm.common import components, durable, join_counted, slices, table

WORDS, SEED, RADIUS = 3, 42, 3
#: Rows of a cell that meet in one task; a larger cell is cut into chunks of about half of it.
BLOCK = 1024


@lru_cache(maxsize=4)
def pivots(groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Reference fingerprints, the first of them zero, and the bit range (0, 1, ...) of each of the others: random patterns within one range, as many
    as it has bits and linearly independent."""
    rng = np.random.default_rng(SEED)
    edges = np.linspace(0, 64, groups + 1).astype(int).tolist()
    out, group = [0], []
    for g, (lo, hi) in enumerate(zip(edges, edges[1:])):
        patterns = np.zeros((hi - lo, hi - lo), int)
        while np.linalg.matrix_rank(patterns) < hi - lo:
            patterns = rng.integers(0, 2, (hi - lo, hi - lo))
        out += [sum(1 << (lo + int(b)) for b in np.flatnonzero(row)) for row in patterns]
        group += [g] * (hi - lo)
    return np.array(out, np.uint64), np.array(group)


def distances(fps: np.ndarray, groups: int) -> np.ndarray:
    """The pivot distance table (n x pivots)."""
    return np.bitwise_count(fps[:, None] ^ pivots(groups)[0][None, :]).astype(np.int16)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The majority bits of the hashes of all word shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    parts = [found[i : n + i] for i in range(words)] if len(found) >= words else None
    joined = map(b" ".join, zip(*parts)) if parts else (b" ".join(found),)
    hashes = np.fromiter((digest(x, SEED) for x in joined), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the 64 bits as signed) of each row; a null or empty text has the fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, fp long")


def cells(fps: np.ndarray, groups: int, keep: int) -> Iterator[np.ndarray]:
    """For each choice of ``keep`` ranges the cell of each fingerprint: a hash of its relative distances to those ranges' pivots."""
    near, group = distances(fps, groups), pivots(groups)[1]
    relative = (near[:, 1:] - near[:, :1]).astype(np.uint64)
    mix = np.random.default_rng(SEED + 1).integers(1, 2**63, len(group), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    part = [(relative[:, group == g] * mix[group == g]).sum(axis=1, dtype=np.uint64) for g in range(groups)]
    for k, chosen in enumerate(combinations(range(groups), keep)):
        key = np.full(len(fps), k + 1, np.uint64)
        for g in chosen:
            key = (key ^ part[g]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        yield key


def linked(fps: np.ndarray, near: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (index pairs) of the links among ``fps``, given their pivot distances ``near`` (n x pivots)."""
    order = np.argsort(near[:, 0], kind="stable")
    fps, near = fps[order], near[order]
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    ends = np.searchsorted(near[:, 0], near[:, 0] + radius, side="right")
    for i in range(len(fps)):
        rest = slice(i + 1, ends[i])
        close = np.flatnonzero(np.abs(near[rest] - near[i]).max(axis=1, initial=0) <= radius)
        if len(close):
            close = close[np.bitwise_count(fps[rest][close] ^ fps[i]) <= radius] + i + 1
        for j in close.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)
    return order[left].astype(int), order[right].astype(int)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the distinct fingerprints ``fps`` (fp long) into their components."""
    groups = 2 * radius if radius else 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, None, 4096):
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for key in cells(fp.view(np.uint64), groups, groups - radius):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp)], ["key", "fp"])

    same_key = Window.partitionBy("key")
    rows = fps.select("fp").mapInArrow(spread, "key long, fp long").withColumn("count", F.count("*").over(same_key)).filter("count > 1")
    # chunk i of c meets each chunk j >= i: c + 1 copies of a row at most, and pairs of one chunk meet in (i, i)
    chunks = F.ceil(F.col("count") / F.lit(block // 2)).cast("int")
    rows = rows.withColumn("c", F.when(F.col("count") <= block, 1).otherwise(chunks))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")

    def meet(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        a, b = linked(fp, distances(fp, groups), radius)
        return pa.table({"a": pa.array(fp[a].view(np.int64)), "b": pa.array(fp[b].view(np.int64))})

    return rows.groupBy("key", "lo", "hi").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    Documents are linked if their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest doc_id
    reachable (null where no document of the component has one). Null, empty and word-less texts have the fingerprint zero and are linked like
    any other. Very long texts are hashed whole. A repeated row gives a repeated result row, an empty table none. Other columns of ``docs`` are not read.
    """
    marked = durable(fingerprints(docs), "simhash")
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash_distinct")
    total, some = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    joined = components(links(distinct, radius))
    by_fp = distinct.join(joined, distinct.fp == joined.id, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("c"))
    lowest = by_fp.groupBy("c").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    by_fp = durable(join_counted(by_fp.select("fp", "c", F.col("n").alias("copies")), lowest, "c", some).select("fp", "component_id", F.col("copies").alias("n")), "simhash_component")
    out = join_counted(marked, by_fp, "fp", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, small: int = 500_000) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the smallest doc_id, and one row of it.

    All columns pass through. Rows with a null doc_id are kept, as they can't be told apart. Null and empty texts are one component. An
    empty table gives an empty one.
    """
    found = durable(near_duplicates(docs.filter("doc_id is not null"), radius).select("doc_id", "component_id"), "near_duplicates")
    gone = durable(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near_gone")
    gone = F.broadcast(gone) if gone.count() <= small else gone
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    repeated = found.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__twice"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"].cast("long") == repeated["__twice"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, kept["doc_id"].cast("long") == repeated["__twice"], "left_anti").unionByName(once)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
