"""Distances between two tables, as grouped counts and windows over distinct values."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.functions import number
from privloom.operators.prefix import scan


def everything():
    """One window over all cells: these are distinct values or groups, never the rows themselves."""
    return Window.partitionBy(F.lit(1))


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))


def cell_distance(both: DataFrame, cells: Sequence[str]) -> DataFrame:
    """One row (distance): half the summed difference of the two sides' fractions over the cells; rows with a null cell are left out."""
    one = both.dropna(subset=list(cells)).groupBy(*cells).agg(F.sum((F.col("side") == 0).cast("long")).alias("n0"), F.sum((F.col("side") == 1).cast("long")).alias("n1"))
    # numbers of both sides come with the same single pass over the cells
    one = one.withColumns({"t0": F.sum("n0").over(everything()), "t1": F.sum("n1").over(everything())})
    return one.agg((F.sum(F.abs(F.col("n0") / F.col("t0") - F.col("n1") / F.col("t1"))) / 2).alias("distance"))


def sampled_pairs(names: Sequence[str], most: int | None = None, seed: str = "pairs") -> list[tuple[str, str]]:
    """All pairs of names, or ``most`` of them by the hash of seed and names: the same ones in every run."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if most is None or len(pairs) <= most:
        return pairs
    return sorted(pairs, key=lambda p: hashlib.md5(f"{seed}|{p[0]}|{p[1]}".encode()).hexdigest())[:most]


def pairwise_distance(both: DataFrame, codes: dict[str, Column], most: int | None = None, seed: str = "pairs") -> DataFrame:
    """(a, b, distance) for all pairs of coded columns, or ``most`` sampled ones, of one scan."""
    pairs = sampled_pairs(list(codes), most, seed)
    rows = both.select("side", *[v.cast("int").alias(k) for k, v in codes.items() if any(k in p for p in pairs)])
    long = rows.select("side", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("c")).select("side", "c.*")
    cells = long.groupBy("a", "b", "x", "y").agg(F.sum((F.col("side") == 0).cast("long")).alias("n0"), F.sum((F.col("side") == 1).cast("long")).alias("n1"))
    w = Window.partitionBy("a", "b")
    cells = cells.withColumns({"t0": F.sum("n0").over(w), "t1": F.sum("n1").over(w)})
    return cells.groupBy("a", "b").agg((F.sum(F.abs(F.col("n0") / F.col("t0") - F.col("n1") / F.col("t1"))) / 2).alias("distance"))


def wasserstein(both: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (distance), or one for each group (by, distance): the area between the two sides' distribution functions."""
    cells = both.select("side", *by, number(F.col(column)).alias("x")).dropna(subset=["x"]).groupBy(*by, "x").agg(F.sum((F.col("side") == 0).cast("long")).alias("n0"), F.sum((F.col("side") == 1).cast("long")).alias("n1"))
    cells = scan(cells, "x", {"c0": F.col("n0"), "c1": F.col("n1")}, by, following="next")
    gap = F.abs(F.try_divide("c0", "c0_total") - F.try_divide("c1", "c1_total"))  # null where a side has no rows
    return cells.groupBy(*by).agg(F.coalesce(F.sum(gap * (F.col("next") - F.col("x"))), F.lit(0.0)).alias("distance"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc): chance that a row of label 1 scores above one of label 0, ties half."""
    cells = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).dropna().groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    cells = scan(cells, "s", {"upto": F.col("q")})
    return cells.withColumn("w", F.col("p") * (F.col("upto") - F.col("q") / 2)).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("auc"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (v): bias-corrected association of two columns; null if one has a single level."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).dropna()
    wa, wb = Window.partitionBy(a), Window.partitionBy(b)
    cells = cells.withColumns({"t": F.sum("n").over(everything()), "ra": F.sum("n").over(wa), "rb": F.sum("n").over(wb)})
    # chi-square over n: the sum of n^2 / (row * column) over observed cells, less one
    one = cells.agg((F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))) - 1).alias("phi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("k"), F.max("t").alias("n"))
    fixed = F.greatest(F.lit(0.0), F.col("phi2") - (F.col("k") - 1) * (F.col("r") - 1) / (F.col("n") - 1))
    size = lambda c: F.col(c) - (F.col(c) - 1) * (F.col(c) - 1) / (F.col("n") - 1)
    least = F.least(size("r"), size("k")) - 1
    return one.select(F.when(least > 0, F.sqrt(fixed / least)).alias("v"))


def coverage(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """One row (coverage): share of the declared categories that occur."""
    text = F.col(column).cast("string")
    return df.agg((F.count_distinct(F.when(text.isin(*map(str, categories)), text)) / F.lit(len(set(categories)))).alias("coverage"))
