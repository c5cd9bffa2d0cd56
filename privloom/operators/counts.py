"""Contingency tables: the counting that every model and metric rests on.

All tables of a step come from one scan by grouping sets; only aggregated cells are ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.operators import prefix
from privloom.operators.prefix import value_ranks


#: Values of a column, by group, whose ranks are sent to every task.
FEW_LEVELS = 100_000


def contingency(df: DataFrame, sets: Sequence[Sequence[str]], weight: str | None = None, name: str = "n") -> DataFrame:
    """Counts of each attribute set in one pass: (set_id, columns of all sets, ``name``). Columns outside a set are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id().alias("__gid"), n.alias(name))
    ids = {sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in s): k for k, s in enumerate(sets)}
    which = F.create_map(*[x for gid, k in ids.items() for x in (F.lit(gid).cast("long"), F.lit(k))])
    return out.withColumn("set_id", F.element_at(which, F.col("__gid").cast("long"))).select("set_id", *names, name)


def histogram(df: DataFrame, code: Column, size: int, name: str = "n") -> DataFrame:
    """(code, n) for every code from 0 to size - 1, zeros included."""
    cells = df.sparkSession.range(size).select(F.col("id").cast("int").alias("code"))
    found = df.select(code.alias("code")).filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias(name))
    return cells.join(F.broadcast(found.filter(F.col("code").between(0, size - 1))), "code", "left").select("code", F.coalesce(name, F.lit(0)).alias(name))


def keyed_counts(df: DataFrame, parents: Sequence[tuple[str, int]], child: tuple[str, int]) -> DataFrame:
    """(key, child, n): counts of a child's codes by the row-major key of its parents' codes; observed cells only."""
    key = F.lit(0).cast("long")
    for name, size in parents:
        key = key * size + F.col(name).cast("long")
    return df.groupBy(key.alias("key"), F.col(child[0]).alias("child")).agg(F.count(F.lit(1)).alias("n"))


def conditional(counts: DataFrame, keys: int, size: int, alpha: float) -> DataFrame:
    """(key, child, p): the dense conditional table from ``keyed_counts``, smoothed by ``alpha``; a row without mass is uniform."""
    spark = counts.sparkSession
    cells = spark.range(keys * size).select((F.floor(F.col("id") / size)).cast("long").alias("key"), F.pmod("id", F.lit(size)).cast("int").alias("child"))
    full = cells.join(counts.withColumn("child", F.col("child").cast("int")), ["key", "child"], "left")
    mass = F.greatest(F.coalesce(F.col("n"), F.lit(0)).cast("double"), F.lit(0.0)) + F.lit(float(alpha))
    full = full.withColumn("mass", mass).withColumn("total", F.sum("mass").over(Window.partitionBy("key")))
    return full.select("key", "child", F.when(F.col("total") > 1e-12, F.col("mass") / F.col("total")).otherwise(F.lit(1.0 / size)).alias("p"))


def mutual_information(df: DataFrame, a: str, b: str, smooth: float = 0.0) -> DataFrame:
    """One row (mi): natural-log mutual information of two columns, floored at 0."""
    cells = df.groupBy(a, b).agg((F.count(F.lit(1)) + F.lit(smooth)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    cells = cells.withColumns({"p": F.col("n") / total, "pa": F.sum("n").over(Window.partitionBy(a)) / total, "pb": F.sum("n").over(Window.partitionBy(b)) / total})
    return cells.agg(F.greatest(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))), F.lit(0.0)).alias("mi"))


def pairwise_mi(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, mi, ha, hb): natural-log mutual information and entropies of all pairs, from one grouping-sets job over the rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])).alias("c")).select("c.*")
    cells = long.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("a", "b"))
    cells = cells.withColumns({
        "p": F.col("n") / total,
        "px": F.sum("n").over(Window.partitionBy("a", "b", "x")) / total,
        "py": F.sum("n").over(Window.partitionBy("a", "b", "y")) / total,
    })
    return cells.groupBy("a", "b").agg(
        F.greatest(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))), F.lit(0.0)).alias("mi"),
        (-F.sum(F.col("p") * F.log("px"))).alias("ha"), (-F.sum(F.col("p") * F.log("py"))).alias("hb"),
    )


def value_fractions(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """(value, fraction) of the declared categories, of all rows (nulls and others count in the denominator)."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    declared = spark.createDataFrame([(str(c), i) for i, c in enumerate(categories)], "value string, place int")
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row for each value
    return declared.join(counts, "value", "left").select("value", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("fraction"))


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """One row (quantiles): linear-interpolated quantiles."""
    return prefix.quantiles(df, F.col(column), at).select(F.col("q").alias("quantiles"))


def with_average_rank(df: DataFrame, column: str, name: str = "average_rank") -> DataFrame:
    """``df`` with 1-based ranks in which ties share the mean, from ranks of distinct values, which join back."""
    return df.join(value_ranks(df, column).select(column, F.col("rank").alias(name)), column, "left")


def _full_pairs(df: DataFrame, columns: Sequence[str], by: Sequence[str], levels: dict[str, int]) -> DataFrame:
    """``spearman_pairs`` of columns without nulls: each has the same ranks in all its pairs. Ranks of all columns but that of most values (``levels``) join
    the rows, broadcast where these are few; that one's rows are summed by value, and its ranks meet the sums."""
    *others, last = sorted(columns, key=lambda c: levels[c])
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    ranked = rows
    for c in others:
        ranks = value_ranks(rows, c, by=by).select(*by, c, F.col("rank").alias(f"__r_{c}"))
        ranked = prefix._joined(ranked, ranks, [*by, c], levels[c] <= FEW_LEVELS)
    rank = {c: F.col(f"__r_{c}") for c in others}
    products = [(a, b) for i, a in enumerate(others) for b in others[i:]]
    cells = ranked.groupBy(*by, last).agg(F.count(F.lit(1)).alias("__m"), *[F.sum(rank[a]).alias(f"__s{i}") for i, a in enumerate(others)], *[F.sum(rank[a] * rank[b]).alias(f"__p{i}") for i, (a, b) in enumerate(products)])
    cells = prefix.scan(cells, last, {"__upto": F.col("__m")}, by, at=prefix.cuts(rows, last))
    mine = F.col("__upto") - (F.col("__m") - 1) / F.lit(2.0)
    one = cells.groupBy(*by).agg(
        F.sum("__m").alias("n"), F.sum(F.col("__m") * mine).alias("m"), F.sum(F.col("__m") * mine * mine).alias("mm"),
        *[F.sum(f"__s{i}").alias(f"s{i}") for i in range(len(others))], *[F.sum(mine * F.col(f"__s{i}")).alias(f"x{i}") for i in range(len(others))], *[F.sum(f"__p{i}").alias(f"p{i}") for i in range(len(products))],
    )
    total = {last: F.col("m")} | {a: F.col(f"s{i}") for i, a in enumerate(others)}
    product = {(last, last): F.col("mm")} | {(a, b): F.col(f"p{i}") for i, (a, b) in enumerate(products)} | {(a, last): F.col(f"x{i}") for i, a in enumerate(others)}
    product |= {(b, a): p for (a, b), p in product.items()}
    n = F.col("n")
    spread = lambda a, b: n * product[a, b] - total[a] * total[b]
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(spread(a, b), F.sqrt(spread(a, a) * spread(b, b))).alias("rho")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return one.select(*by, F.explode(F.array(*pairs)).alias("e")).select(*by, "e.*")


def spearman_pairs(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, rho): rank correlations of all pairs of columns over the rows where both are there, null if one is constant. All pairs' cells come of one scan, and all
    their ranks of another; columns without nulls need their ranks once for all pairs."""
    number = {c: F.col(c).cast("double") for c in columns}
    of = lambda c: F.struct(*by, c) if by else F.col(c)
    gaps = F.count_if(F.exists(F.array(*number.values()), lambda x: x.isNull() | F.isnan(x)))
    one = df.agg(gaps.alias("gaps"), *[F.approx_count_distinct(of(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    if not one.gaps and len(columns) > 1 and len({*columns, *by}) == len(columns) + len(by):
        return _full_pairs(df, columns, by, {c: one[f"d{i}"] for i, c in enumerate(columns)})
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))
    keys = [*by, "a", "b"]
    cells = df.select(*by, each.alias("c")).select(*by, "c.*").dropna(subset=["x", "y"]).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("cell"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("__axis"), F.col(s).alias("__value")) for s in ("x", "y")]))
    ranks = value_ranks(cells.select(*keys, "cell", sides.alias("v")).select(*keys, "cell", "v.*"), "__value", F.col("cell"), [*keys, "__axis"])
    out = cells
    for s in ("x", "y"):
        own = ranks.filter(F.col("__axis") == s).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__value").alias("__v"), F.col("rank").alias(f"r{s}"))
        same = F.col(s) == F.col("__v")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = out.join(own, same).drop("__v", *[f"__{k}" for k in keys])
    n, mx, my = F.sum("cell"), F.sum(F.col("cell") * F.col("rx")), F.sum(F.col("cell") * F.col("ry"))
    xy, xx, yy = (F.sum(F.col("cell") * F.col(p) * F.col(q)) for p, q in (("rx", "ry"), ("rx", "rx"), ("ry", "ry")))
    return out.groupBy(*keys).agg(F.try_divide(n * xy - mx * my, F.sqrt((n * xx - mx * mx) * (n * yy - my * my))).alias("rho"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rho): rank correlation of the rows where both columns are there."""
    return spearman_pairs(df, [a, b]).select("rho")
