"""Running sums, ranks and order statistics over any number of rows, without a window over all of them.

A scan has two levels: values fall into ranges cut at quantiles, each range is summed, and a window inside each range starts
from the sum of the ranges before it. Only the ranges, ``RANGES`` a group at most, ever meet in one window.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range, and ranges: beyond that many, ranges grow, and sort and spill like any other window.
RANGE_ROWS, RANGES = 20_000, 1_024
#: Groups whose cuts are sent to every task.
FEW_GROUPS = 10_000


def cuts(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> list[str]:
    """Values, as text, that cut the order into ranges of about ``rows`` rows; none for a small table."""
    kind = dict(df.dtypes)[order]
    if kind == "string":
        n = df.count()
        parts = min(n // rows, RANGES)
        if parts < 2:
            return []
        share = min(1.0, 50 * parts / n)  # by a hash of the value: the same values whatever the partitioning
        h = F.xxhash64(order)
        found = [x[0] for x in df.filter(F.col(order).isNotNull() & (h <= min(int(share * 2**64) - 2**63, 2**63 - 1))).select(order).distinct().orderBy(order).collect()]  # 50 a range
        return list(dict.fromkeys(found[len(found) * i // parts] for i in range(1, parts))) if found else []
    at = [i / RANGES for i in range(1, RANGES)]
    one = df.agg(F.count(order).alias("n"), F.percentile_approx(order, at, 10_000).cast("array<string>").alias("at")).first()
    parts = min(one.n // rows, RANGES)
    return list(dict.fromkeys(one["at"][RANGES * i // parts - 1] for i in range(1, parts))) if parts > 1 else []


def range_of(value: Column, kind: str, at: Sequence[str]) -> Column:
    """How many of the cuts are at or below a value; 0 for null. Two steps of a root of the cuts each."""
    if not at:
        return F.lit(0)
    width = max(1, int(len(at) ** 0.5))
    blocks = [list(at[i : i + width]) for i in range(0, len(at), width)]
    known = F.from_json(F.lit(json.dumps(blocks)), "array<array<string>>").cast(f"array<array<{kind}>>")
    outer = F.size(F.filter(known, lambda b: F.get(b, 0) <= value))
    inner = F.size(F.filter(F.get(known, outer - 1), lambda c: c <= value))
    return F.coalesce(F.when(outer > 0, (outer - 1) * width + inner).otherwise(0), F.lit(0))


def scan(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (), following: str | None = None, rows: int = RANGE_ROWS, ties: Sequence[str] = (), at: Sequence[str] | None = None) -> DataFrame:
    """``df`` with, for each of ``sums``, its running sum in the order of a column (this row's value included) and, as ``<name>_total``, its group's
    sum; ``following`` names the next value of the order. Groups are by ``by``, nulls first.

    Rows that are equal in group and order go by ``ties``, or else get the sums after some of them: aggregate them to one first, which also keeps
    a value that very many rows share from filling one range. ``at`` gives cuts that are known.
    """
    kind = dict(df.dtypes)[order]
    keys = list(by)
    placed = df.withColumns({"__range": range_of(F.col(order), kind, cuts(df, order, rows) if at is None else at), **{f"__{n}": c for n, c in sums.items()}})
    ranges = placed.groupBy(*keys, "__range").agg(F.min(order).alias("__first"), *[F.coalesce(F.sum(f"__{n}"), F.lit(0)).alias(f"__all_{n}") for n in sums])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a row a range
    ahead = {f"__before_{n}": F.sum(f"__all_{n}").over(group.orderBy("__range")) - F.col(f"__all_{n}") for n in sums} | {f"{n}_total": F.sum(f"__all_{n}").over(group) for n in sums}
    ranges = ranges.withColumns(ahead | {"__next": F.lead("__first").over(group.orderBy("__range"))})
    ranges = ranges.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__range").alias("__at"), "__next", *ahead)
    same = F.col("__range") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    joined = placed.join(ranges, same)
    inside = Window.partitionBy(*keys, "__range").orderBy(order, *ties)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.col(f"__before_{n}") + F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)) for n in sums}
    if following:
        out[following] = F.coalesce(F.lead(order).over(inside), F.col("__next"))
    joined = joined.withColumns(out)
    return joined.select(*df.columns, *[c for n in sums for c in (n, f"{n}_total")], *([following] if following else []))


def value_ranks(df: DataFrame, column: str, weight: Column | None = None, by: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """(by, column, m, upto, n, rank): of each distinct value how many rows have it, how many are not above it and how many there are, and the 1-based
    rank that ties share. Nulls are left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("m"))
    ranked = scan(counts, column, {"upto": F.col("m")}, by, rows=rows).withColumnRenamed("upto_total", "n")
    return ranked.select(*by, column, "m", "upto", "n", (F.col("upto") - (F.col("m") - 1) / F.lit(2.0)).alias("rank"))


def order_statistics(df: DataFrame, column: str, first: Column, last: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """(rank, x, n): the order statistics of 0-based ranks from ``first`` to ``last``, which may use the number of values ``n``; ranks outside the table
    have no row."""
    values = df.select(F.col(column).cast("double").alias("x")).filter(~F.isnan("x"))
    held = value_ranks(values, "x", rows=rows).withColumns({"lo": F.col("upto") - F.col("m"), "first": first, "last": last})
    held = held.filter((F.col("upto") > F.col("first")) & (F.col("lo") <= F.col("last")))
    ranks = F.sequence(F.greatest("lo", "first", F.lit(0)), F.least(F.col("upto") - 1, F.col("last")))
    return held.select(F.explode(ranks).alias("rank"), "x", "n")


def quantiles(df: DataFrame, column: Column, at: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(by, q array<double>, n): linear-interpolated quantiles, as ``F.percentile`` gives them, and the number of values that aren't null; a group
    without values has null and 0.

    ``percentile_approx`` brackets each quantile; the ranges between brackets are counted, and only the values of ranges that hold the ranks asked for
    meet. So the brackets may be wrong: the result is exact, and only the ranges would be larger.
    """
    keys = list(by)
    values = df.select(*keys, column.cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    ends = sorted({min(max(q + side * 4 / accuracy, 0.0), 1.0) for q in at for side in (-1, 1)})
    cuts = values.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("__x", ends, accuracy)).alias("__cuts"))
    few = cuts.limit(FEW_GROUPS + 1).collect()  # a row a group, unless there are many
    small = len(few) <= FEW_GROUPS
    if not keys:
        known = F.array(*[F.lit(c) for c in (few[0]["__cuts"] if few else None) or []])
        placed = values.withColumn("__cuts", known.cast("array<double>"))
    else:
        placed = _joined(values, df.sparkSession.createDataFrame(few, cuts.schema) if small else cuts, keys, small)
    # 0 below the first cut, 1 at it, 2 between it and the second
    code = sum((F.coalesce((F.get("__cuts", i) < F.col("__x")).cast("int") + (F.get("__cuts", i) <= F.col("__x")).cast("int"), F.lit(0)) for i in range(len(ends))), F.lit(0))
    placed = placed.select(*keys, "__x", code.alias("__code"))
    ranges = placed.groupBy(*keys, "__code").agg(F.count(F.lit(1)).alias("__m"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a row a range
    ranges = ranges.withColumns({"__before": F.sum("__m").over(group.orderBy("__code")) - F.col("__m"), "n": F.sum("__m").over(group)})
    places = [(F.col("n") - 1) * F.lit(float(q)) for q in at]
    ranks = [f(p).cast("long") for p in places for f in (F.floor, F.ceil)]
    wanted = ranges.filter(any_of([(F.col("__before") <= r) & (r < F.col("__before") + F.col("__m")) for r in ranks])).drop("__m")
    band = _joined(placed, wanted, [*keys, "__code"], small).groupBy(*keys, "__code", "__x").agg(F.count(F.lit(1)).alias("__m"), F.first("__before").alias("__before"), F.first("n").alias("n"))
    upto = F.col("__before") + F.sum("__m").over(Window.partitionBy(*keys, "__code").orderBy("__x"))
    band = band.withColumn("__upto", upto).withColumn("__lo", F.col("__upto") - F.col("__m"))
    found = band.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when((F.col("__lo") <= r) & (r < F.col("__upto")), F.col("__x"))).alias(f"__r{i}") for i, r in enumerate(ranks)])
    q = []
    for i, p in enumerate(places):
        low, high = F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}")
        q.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    found = found.select(*keys, F.when(F.col("n") > 0, F.array(*q)).alias("q"), F.col("n").alias("__n"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    return _joined(groups, found, keys, small, "left").select(*keys, "q", F.coalesce("__n", F.lit(0)).alias("n"))


def any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, whose keys may be null; broadcast if ``right`` is small."""
    right = right.select(*[F.col(k).alias(f"__of{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of{k}"))
    return left.join(F.broadcast(right) if small else right, same, how).drop(*[f"__of{k}" for k in keys])
