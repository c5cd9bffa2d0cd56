"""Joins, order statistics, sampling and set operations beyond what one DataFrame call says."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.functions import hash_uniform
from privloom.operators.prefix import order_statistics, scan

def lookup(df: DataFrame, key: Column, table: DataFrame, value: str, most: int = 2_000_000) -> DataFrame:
    """``df`` with the row of a conditional table (key, value): broadcast if the table has ``most`` cells at most, else a shuffled join."""
    t = table.select(F.col("key").alias("__key"), value)
    return df.join(F.broadcast(t) if t.count() <= most else t, key == F.col("__key"), "left").drop("__key")


def split(df: DataFrame, key: str, shares: Sequence[float], seed: str = "split") -> DataFrame:
    """``df`` with ``part``: rows fall into parts by a hash of their key, whatever the partitioning; sizes are near the shares."""
    u, out, upto = hash_uniform(seed, "split", F.col(key)), F.lit(len(shares) - 1), 0.0
    for i, s in reversed(list(enumerate(np.cumsum(shares)[:-1]))):
        out = F.when(u < float(s), i).otherwise(out)
    return df.withColumn("part", out.cast("int"))


def exact_split(df: DataFrame, key: str, shares: Sequence[float], seed: str = "split") -> DataFrame:
    """``df`` with ``part`` of exact sizes (floored shares, the rest to the last): ranks of hashes, counted in hash ranges first."""
    n, ranges = df.count(), max(1, df.count() // 50_000)
    u = hash_uniform(seed, "split", F.col(key))
    rows = df.withColumn("__u", u).withColumn("__b", F.floor(F.col("__u") * ranges).cast("int"))
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__b", (F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__b")) - F.col("__n")).alias("__base"))
    ranked = rows.join(F.broadcast(sizes), "__b").withColumn("__r", F.col("__base") + F.row_number().over(Window.partitionBy("__b").orderBy("__u", key)) - 1)
    cuts = [int(n * s) for s in np.cumsum(shares)[:-1]]
    part = sum(((F.col("__r") >= c).cast("int") for c in cuts), F.lit(0))
    return ranked.withColumn("part", part).drop("__u", "__b", "__base", "__r")


def global_rank(df: DataFrame, by: str, ties: Sequence[str], name: str = "rank", group: int = 50_000) -> DataFrame:
    """``df`` with exact ranks from 0 by a number and then by ``ties``, without sorting all rows in one task.

    Rows fall into ranges cut at approximate quantiles; counts of the ranges give each its first rank. Equal numbers share a range, so a
    number that very many rows have should come with a second number in front.
    """
    n = df.count()
    parts = max(1, min(4_096, n // group))
    cuts = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    at = F.from_json(F.lit(str(sorted({float(c) for c in cuts or []}))), "array<double>")
    rows = df.withColumn("__part", F.size(F.filter(at, lambda c: c < F.col(by).cast("double"))))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part")) - F.col("__n")
    rows = rows.join(F.broadcast(sizes.select("__part", first.alias("__base"))), "__part")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(by, *ties)) - 1
    return rows.withColumn(name, F.col("__base") + inside).drop("__part", "__base")


def tiles(df: DataFrame, by: str, ties: Sequence[str], k: int, name: str = "part") -> DataFrame:
    """``df`` with tiles from 1 to ``k`` of equal sizes in an order, the first ones a row larger where the rows don't divide."""
    n = df.count()
    small, larger = divmod(n, k)
    rank = F.col("__rank")
    tile = F.when(rank < larger * (small + 1), F.floor(rank / F.lit(small + 1)) + 1).otherwise(larger + F.floor((rank - larger * (small + 1)) / F.lit(max(small, 1))) + 1)
    return global_rank(df, by, ties, "__rank").withColumn(name, tile.cast("int")).drop("__rank")


def sample(df: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    """``n`` rows without replacement, those with the smallest hashes of their key."""
    return df.orderBy(hash_uniform(seed, "sample", F.col(key)), key).limit(n)


def allot(df: DataFrame, groups: Sequence[str], shares: DataFrame, key: str, seed: str = "allot") -> DataFrame:
    """Systematic rounding: each group's rows, in hash order, get the codes of ``shares`` (groups, code, p) in proportion.

    A row of rank i of n gets the first code whose cumulative share exceeds (i + 0.5) / n.
    """
    ranked = scan(df.withColumn("__u", hash_uniform(seed, "allot", F.col(key))), "__u", {"__i": F.lit(1)}, groups, ties=[key])
    ranked = ranked.withColumn("__i", F.col("__i") - 1).withColumnRenamed("__i_total", "__n").drop("__u")
    table = shares.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("code", "p"))).alias("__s"))
    joined = ranked.join(table, list(groups))
    at = (F.col("__i") + 0.5) / F.col("__n")
    cdf = F.transform(F.sequence(F.lit(1), F.size("__s")), lambda i: F.aggregate(F.slice("__s", F.lit(1), i), F.lit(0.0), lambda a, x: a + x["p"]))
    code = F.get(F.col("__s"), F.least(F.size(F.filter(cdf, lambda c: c <= at)), F.size("__s") - 1))["code"]
    return joined.withColumn("code", code).drop("__i", "__n", "__s")


def around_rank(df: DataFrame, column: str, q: float, k: int) -> DataFrame:
    """(rank, x): the order statistics within ``k`` of the one at quantile ``q``."""
    at = F.floor(F.lit(q) * (F.col("n") - 1))
    return order_statistics(df.select(column).dropna(), column, at - k, at + k).select("rank", "x")
