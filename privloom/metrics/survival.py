"""Survival curves and what compares them, over one row for each distinct time.

The windows run over distinct times (of groups), so their size follows the time grid, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.operators.prefix import scan

Z95 = 1.959963984540054


def kaplan_meier(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """(by, t, at_risk, events, survival, variance) at each distinct time; variance is Greenwood's sum. Rows with nulls are left out."""
    rows = df.select(F.col(by).alias(by), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e")).dropna()
    cells = rows.groupBy(by, "t").agg(F.sum("e").alias("events"), F.count(F.lit(1)).alias("n"))
    down, up = Window.partitionBy(by).orderBy(F.desc("t")), Window.partitionBy(by).orderBy("t")
    cells = cells.withColumn("at_risk", F.sum("n").over(down))
    end = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(up)
    step = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)
    spread = F.when(F.col("events") < F.col("at_risk"), F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(0.0)
    return cells.withColumns({"survival": F.when(end == 1, 0.0).otherwise(F.exp(F.sum(step).over(up))), "variance": F.sum(spread).over(up)}).select(by, "t", "at_risk", "events", "survival", "variance")


def on_grid(curve: DataFrame, by: str, groups: DataFrame, step: float, n: int) -> DataFrame:
    """(by, i, t, survival, variance) at the times i * step, i < n: the last value at or before, 1 before the first time."""
    spark = curve.sparkSession
    grid = groups.select(by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("i") * F.lit(step))
    points = curve.select(by, "t", F.lit(None).cast("int").alias("i"), "survival", "variance").unionByName(grid.select(by, "t", "i", F.lit(None).cast("double").alias("survival"), F.lit(None).cast("double").alias("variance")))
    w = Window.partitionBy(by).orderBy("t", F.col("i").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    filled = points.withColumns({"s": F.last("survival", True).over(w), "v": F.last("variance", True).over(w)}).filter("i is not null")
    return filled.select(by, "i", "t", F.coalesce("s", F.lit(1.0)).alias("survival"), F.coalesce("v", F.lit(0.0)).alias("variance"))


def curve_distance(grid: DataFrame, by: str, a, b) -> DataFrame:
    """One row (distance): trapezoid of the difference of two groups' curves, over the length of the grid."""
    one = grid.groupBy("i", "t").agg(F.max(F.when(F.col(by) == a, F.col("survival"))).alias("sa"), F.max(F.when(F.col(by) == b, F.col("survival"))).alias("sb"))
    w = Window.partitionBy(F.lit(1)).orderBy("t")
    one = one.withColumn("gap", F.abs(F.col("sa") - F.col("sb")))
    one = one.withColumns({"area": (F.lead("t").over(w) - F.col("t")) * (F.lead("gap").over(w) + F.col("gap")) / 2})
    return one.agg((F.sum("area") / F.max("t")).alias("distance"))


def inside_band(grid: DataFrame, by: str, a, b) -> DataFrame:
    """One row (share): grid points at which group b's curve is within group a's 95 % log-log interval."""
    one = grid.groupBy("i").agg(*[F.max(F.when(F.col(by) == g, F.col(c))).alias(n) for g, c, n in ((a, "survival", "sa"), (a, "variance", "va"), (b, "survival", "sb"))])
    inner = (F.col("sa") > 0) & (F.col("sa") < 1)
    log_s = F.when(inner, F.log("sa"))
    bound = lambda z: F.when(inner, F.exp(-F.exp(F.log(-log_s) + F.lit(z) * F.sqrt("va") / log_s))).otherwise(F.col("sa"))
    lo, hi = F.least(bound(Z95), bound(-Z95)), F.greatest(bound(Z95), bound(-Z95))
    return one.agg(F.avg(((F.col("sb") >= lo) & (F.col("sb") <= hi)).cast("int")).alias("share"))


def log_rank(df: DataFrame, time: str, event: str, by: str, a) -> DataFrame:
    """One row (chi2): log-rank statistic of group ``a`` against the rest."""
    rows = df.select((F.col(by) == a).cast("int").alias("g"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e")).dropna()
    cells = rows.groupBy("t").agg(F.sum("e").alias("d"), F.sum(F.col("e") * F.col("g")).alias("d1"), F.count(F.lit(1)).alias("n"), F.sum("g").alias("n1"))
    cells = scan(cells, "t", {"upto": F.col("n"), "upto1": F.col("n1")})
    left = lambda total, upto, n: (F.col(total) - F.col(upto) + F.col(n)).cast("double")
    cells = cells.withColumns({"r": left("upto_total", "upto", "n"), "r1": left("upto1_total", "upto1", "n1")}).filter("d > 0")
    share = F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    return cells.agg((F.pow(F.sum("d1") - F.sum(F.col("d") * share), F.lit(2.0)) / F.sum(v)).alias("chi2"))


def restricted_mean(curve: DataFrame, by: str, tau: float) -> DataFrame:
    """(by, rmst): trapezoid over the curve's points up to ``tau``, from time 0 at 1."""
    start = curve.select(by).distinct().select(by, F.lit(0.0).alias("t"), F.lit(1.0).alias("survival"))
    points = start.unionByName(curve.filter((F.col("t") <= tau) & (F.col("t") > 0)).select(by, "t", "survival"))
    w = Window.partitionBy(by).orderBy("t")
    area = (F.lead("t").over(w) - F.col("t")) * (F.lead("survival").over(w) + F.col("survival")) / 2
    return points.withColumn("area", area).groupBy(by).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("rmst"))


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """One row (concordance, pairs): of the pairs whose earlier time is an event, those in which it has the greater risk, ties half.

    Times are numbered, and the numbers are halved again and again: two different times are in the two halves of exactly one range. In
    each range a running sum over risks counts, for the events of its earlier half, the rows of the later half with a lower risk. So the work
    is distinct (time, risk) times the logarithm of the times, whether risks are few or all different.
    """
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r")).dropna()
    cells = rows.groupBy("t", "r").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("d"))
    times = scan(cells.select("t").distinct(), "t", {"place": F.lit(1)})
    most = times.agg(F.max("place").alias("n")).first().n or 1
    halved = cells.join(times.select("t", (F.col("place") - 1).alias("i")), "t").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(max(int(most) - 1, 1).bit_length() - 1))))
    halved = halved.withColumns({"node": F.expr("shiftright(i, b + 1)"), "later": F.expr("shiftright(i, b) & 1")})
    each = halved.groupBy("b", "node", "r").agg(F.sum(F.when(F.col("later") == 1, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("later") == 0, F.col("d")).otherwise(0)).alias("d"))
    each = scan(each, "r", {"upto": F.col("n")}, ["b", "node"])
    pairs = F.sum(F.col("d") * F.col("upto_total"))
    return each.agg(F.try_divide(F.sum(F.col("d") * (F.col("upto") - F.col("n") / 2)), pairs).alias("concordance"), F.coalesce(pairs, F.lit(0)).alias("pairs"))
