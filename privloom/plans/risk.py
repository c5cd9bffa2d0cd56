"""Queries over constraints, privacy risks, trained models and the aggregation of results."""

from pyspark.sql import functions as F

from privloom.metrics import risk as R
from privloom.operators import analysis as A
from privloom.operators.analysis import student_quantile
from privloom.operators.results import flatten_results
from privloom.plans.base import query, r, rounded, survival


@query("con_column", f"SELECT {r('avg((l_quantity - 5 <= 0 OR l_quantity - 5 > 40)::INT)', 'quantity')}, {r('avg((l_discount < 0.01 OR l_discount >= 0.1)::INT)', 'discount')} FROM lineitem")
def _(spark, read):
    q, d = F.col("l_quantity") - 5, F.col("l_discount")
    return rounded(read("lineitem").agg(F.avg(R.violates(q, above=0, maximum=40).cast("int")).alias("quantity"), F.avg(R.violates(d, minimum=0.01, below=0.1).cast("int")).alias("discount")))


_PAIR = "(SELECT CASE WHEN l_linenumber = 7 THEN 2 ELSE (l_returnflag = 'R')::INT END AS e, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity - 5 END AS t FROM lineitem)"


def _pair(read):
    return read("lineitem").select(F.when(F.col("l_linenumber") == 7, 2).otherwise((F.col("l_returnflag") == "R").cast("int")).alias("e"), F.when(F.col("l_linenumber") != 6, F.col("l_quantity") - 5).alias("t"))


@query("con_cross", f"SELECT {r('avg((e NOT IN (0, 1) OR NOT coalesce(t > 0, false))::INT)', 'rate')} FROM {_PAIR}")
def _(spark, read):
    return rounded(_pair(read).agg(F.avg(R.pair_violates(F.col("e"), F.col("t")).cast("int")).alias("rate")))


@query("con_any", f"SELECT {r('avg((e NOT IN (0, 1) OR NOT coalesce(t > 0, true))::INT)', 'rate')}, count(*) FILTER (WHERE e NOT IN (0, 1)) AS event_bad, count(*) FILTER (WHERE t <= 0) AS time_bad FROM {_PAIR}")
def _(spark, read):
    """A null time is no violation here."""
    return rounded(_pair(read).agg(F.avg(R.pair_violates(F.col("e"), F.col("t"), null_time=False).cast("int")).alias("rate"), F.count_if(~F.col("e").isin(0, 1)).alias("event_bad"), F.count_if(F.col("t") <= 0).alias("time_bad")))


@query("A_validate", f"SELECT e, {r('avg((coalesce(t, 0) <= 0)::INT)', 'violation')} FROM {_PAIR} GROUP BY e")
def _(spark, read):
    return rounded(_pair(read).groupBy("e").agg(F.avg(R.violates(F.coalesce("t", F.lit(0.0)), above=0).cast("int")).alias("violation")))


@query("B_checks", "SELECT count(*) FILTER (WHERE l_linenumber IS NULL) AS nulls, count(*) FILTER (WHERE l_linenumber < 0) AS negative, count(*) FILTER (WHERE l_linenumber >= 7) AS outside FROM lineitem")
def _(spark, read):
    c = F.col("l_linenumber")
    return read("lineitem").agg(F.count_if(c.isNull()).alias("nulls"), F.count_if(c < 0).alias("negative"), F.count_if(c >= 7).alias("outside"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))))"


@query("m_nndr", f"""WITH s AS (SELECT a.vec_id, min({_DIST}) AS s FROM embeddings a JOIN embeddings b ON b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0 GROUP BY 1),
r AS (SELECT a.vec_id, min({_DIST}) AS r FROM embeddings a JOIN embeddings b ON b.vec_id % 2 = 0 AND a.vec_id <> b.vec_id WHERE a.vec_id % 2 = 0 GROUP BY 1),
x AS (SELECT s / greatest(r, 1e-6) AS x FROM s JOIN r USING (vec_id) WHERE r > 0) SELECT {r('avg(x)', 'mean_ratio')}, {r('quantile_cont(x, 0.5)', 'median_ratio')}, {r('avg((x < 1)::INT)', 'below_one')}, count(*) AS n FROM x""")
def _(spark, read):
    side = lambda k: read("embeddings").filter(F.col("vec_id") % 2 == k)
    return rounded(R.neighbour_ratio(side(0), side(1), "vec_id", "embedding"))


_MIA = f"(SELECT a.vec_id % 3 AS k, -min({_DIST}) AS s FROM embeddings a JOIN embeddings b ON b.vec_id % 3 = 2 WHERE a.vec_id % 3 < 2 GROUP BY a.vec_id)"


@query("m_mia", f"""WITH x AS (SELECT (k = 0)::INT AS y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM {_MIA}),
a AS (SELECT (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM x)
SELECT {r('auc', 'auc')}, {r('abs(2 * auc - 1)', 'advantage')} FROM a""")
def _(spark, read):
    side = lambda k: read("embeddings").filter(F.col("vec_id") % 3 == k)
    return rounded(R.membership(side(0), side(1), side(2), "vec_id", "embedding"))


@query("m_tstr")
def _(spark, read):
    """Train on odd orders, test on even ones: is a line shipped late in its order's life returned."""
    df = read("lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(R.train_and_test(df.filter("l_orderkey % 2 = 1"), df.filter("l_orderkey % 2 = 0"), features, "y"), 4)


@query("m_attr_inf")
def _(spark, read):
    """Guess a sensitive status from the other columns, trained on synthetic (odd) rows."""
    df = read("orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")).withColumn("year", F.year("o_orderdate"))
    return rounded(R.train_and_test(df.filter("o_orderkey % 2 = 1"), df.filter("o_orderkey % 2 = 0"), ["o_totalprice", "year"], "y"), 4)


@query("m_cox")
def _(spark, read):
    beta = R.cox(survival(read).withColumn("other", (F.col("stratum") == "O").cast("int")), "t", "e", ["risk", "side"])
    return rounded(spark.createDataFrame(list(beta.items()), "covariate string, coefficient double"), 6)


def _seed_sql() -> str:
    # the groups have the counts that the table gives them: the quantile is looked up by n
    t = " ".join(f"WHEN {n} THEN {student_quantile(0.975, n - 1)!r}" for n in range(2, 11))
    return f"""WITH runs AS (SELECT event_type, user_id % 3 AS eps, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY 1, 2, 3)
SELECT event_type, eps, count(m) AS n, {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'std')}, {r('stddev_samp(m) / sqrt(count(m))', 'se')}, {r(f'(CASE count(m) {t} END) * stddev_samp(m) / sqrt(count(m))', 'half')} FROM runs GROUP BY 1, 2"""


def _runs(read):
    u = F.col("user_id")
    return read("events").groupBy("event_type", (u % 3).alias("eps"), (u % 5).alias("seed")).agg(F.avg("value").alias("m"))


@query("an_agg_seeds", _seed_sql())
def _(spark, read):
    return rounded(A.over_seeds(_runs(read), ["event_type", "eps"], "m"))


@query("an_at_eps", _seed_sql() + " HAVING eps = 1")
def _(spark, read):
    return rounded(A.over_seeds(_runs(read).filter("eps = 1"), ["event_type", "eps"], "m"))


@query("an_best", "WITH runs AS (SELECT event_type, user_id % 3 AS eps, avg(value) AS m FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1, 2) SELECT eps, arg_min(event_type, m) AS best FROM runs GROUP BY 1")
def _(spark, read):
    runs = read("events").groupBy("event_type", (F.col("user_id") % 3).alias("eps")).agg(F.avg("value").alias("m"))
    first = read("events").agg(F.min("event_type")).first()[0]
    return A.best(runs, ["eps"], "event_type", "m", True, [first])


@query("an_km_band", f"SELECT event_type, {r('avg(value)', 'mean')}, {r('quantile_cont(value, 0.025)', 'lo')}, {r('quantile_cont(value, 0.975)', 'hi')} FROM events GROUP BY 1")
def _(spark, read):
    return rounded(A.band(read("events"), ["event_type"], "value"))


@query("an_gap_eps", f"WITH runs AS (SELECT event_type, user_id % 3 + 1 AS eps, avg(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, {r('eps * (CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 2.0 ELSE 1.1 END)::DOUBLE', 'adjusted')}, {r('m', 'm')} FROM runs")
def _(spark, read):
    """Budgets scaled by how much of what is spent is declared."""
    first = read("events").agg(F.min("event_type")).first()[0]
    runs = read("events").groupBy("event_type", (F.col("user_id") % 3 + 1).alias("eps")).agg(F.avg("value").alias("m"))
    return rounded(runs.select("event_type", (F.col("eps") * F.when(F.col("event_type") == first, 2.0).otherwise(1.1)).alias("adjusted"), "m"))


@query("an_perf_series", f"SELECT event_type, user_id % 3 AS eps, {r('avg(value)', 'mean')}, {r('1.96 * stddev_samp(value) / sqrt(count(value))', 'bar')} FROM events GROUP BY 1, 2")
def _(spark, read):
    g = read("events").groupBy("event_type", (F.col("user_id") % 3).alias("eps"))
    return rounded(g.agg(F.avg("value").alias("mean"), (F.lit(1.96) * F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("bar")))


@query("an_viol_breakdown", f"SELECT l_returnflag, {r('avg((l_quantity <= 5)::INT)', 'mean')}, {r('stddev_samp((l_quantity <= 5)::INT)', 'std')} FROM lineitem GROUP BY 1")
def _(spark, read):
    bad = R.violates(F.col("l_quantity"), above=5).cast("int")
    return rounded(read("lineitem").groupBy("l_returnflag").agg(F.avg(bad).alias("mean"), F.stddev_samp(bad).alias("std")))


@query("an_invariance", "SELECT event_type, m AS metric, coalesce(stddev_samp(v), 0) <= 1e-9 AS constant FROM (SELECT event_type, unnest(['value', 'one']) AS m, unnest([value, 1.0]) AS v FROM events) GROUP BY 1, 2")
def _(spark, read):
    return A.invariant(read("events").withColumn("one", F.lit(1.0)), ["event_type"], ["value", "one"])


@query("an_median_iqr", f"WITH runs AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, {r('quantile_cont(m, 0.5)', 'median')}, {r('quantile_cont(m, 0.75) - quantile_cont(m, 0.25)', 'iqr')} FROM runs GROUP BY 1")
def _(spark, read):
    runs = read("events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rounded(runs.groupBy("event_type").agg(q.alias("q")).select("event_type", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")))


@query("abl_output", f"SELECT {r('avg((c_mktsegment NOT IN (' + chr(39) + 'BUILDING' + chr(39) + ', ' + chr(39) + 'FURNITURE' + chr(39) + '))::INT)', 'invalid_rate')}, {r('avg((c_acctbal < 0 OR c_acctbal > 9000)::INT)', 'outside_rate')} FROM customer")
def _(spark, read):
    return rounded(read("customer").agg(F.avg((~F.col("c_mktsegment").isin("BUILDING", "FURNITURE")).cast("int")).alias("invalid_rate"), F.avg(R.violates(F.col("c_acctbal"), minimum=0, maximum=9000).cast("int")).alias("outside_rate")))


@query("an_flatten", """WITH g AS (SELECT user_id % 20 AS g, max(value) AS hi, min(value) AS lo, count(*) AS n FROM events GROUP BY 1)
SELECT g, 'a' AS implementation, 'ok' AS status, hi AS fit_time_sec, CASE WHEN g % 3 <> 0 THEN lo END AS km_l1, CASE WHEN g % 4 <> 0 THEN n::DOUBLE END AS marginal_l1, CASE WHEN g % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS composition_gap,
  CASE WHEN g % 4 = 0 THEN ['utility: lost'] ELSE [] END || CASE WHEN g % 3 = 0 THEN ['survival.km_l1: no events'] ELSE [] END AS errors FROM g
UNION ALL SELECT g, 'b', 'failed', NULL, NULL, NULL, NULL, ['result: timeout'] FROM g WHERE g % 5 = 0""")
def _(spark, read):
    """Result documents built from events: some families and metrics are errors, some synthesizers failed."""
    g = read("events").groupBy((F.col("user_id") % 20).alias("g")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count(F.lit(1)).alias("n"))
    km = F.when(F.col("g") % 3 == 0, F.lit('{"error": "no events", "value": NaN}')).otherwise(F.col("lo").cast("string"))
    utility = F.when(F.col("g") % 4 == 0, F.lit('{"error": "lost", "value": NaN}')).otherwise(F.concat(F.lit('{"marginal": {"mean_overall": '), F.col("n").cast("string"), F.lit("}}")))
    gap = F.when(F.col("g") % 2 == 0, "true").otherwise("false")
    a = F.concat(F.lit('"a": {"performance": {"fit_time_sec": '), F.col("hi").cast("string"), F.lit('}, "privacy": null, "survival": {"km_l1": '), km, F.lit('}, "compliance": {"composition": {"gap_flag": '), gap, F.lit('}}, "utility": '), utility, F.lit("}"))
    b = F.when(F.col("g") % 5 == 0, F.lit(', "b": {"status": "failed", "error": "timeout"}')).otherwise("")
    documents = g.select("g", F.concat(F.lit("{"), a, b, F.lit("}")).alias("document"))
    return flatten_results(documents).select("g", "implementation", "status", "fit_time_sec", "km_l1", "marginal_l1", "composition_gap", "errors")


_T_OF_RUNS = ", ".join(f"({n}, {student_quantile(0.975, n - 1)!r}::DOUBLE)" for n in range(2, 12))


@query("an_abl_ci", f"""WITH t(runs, t) AS (VALUES {_T_OF_RUNS}), x AS (SELECT event_type, user_id % 4 AS condition, user_id % 7 AS run, avg(value) AS v FROM events GROUP BY 1, 2, 3),
m AS (SELECT event_type, condition, CASE WHEN run >= condition * 2 THEN v END AS m FROM x), a AS (SELECT event_type, condition, count(*) AS runs, count(m) AS n, avg(m) AS mean, CASE WHEN count(m) = 1 THEN 0 ELSE stddev_samp(m) END AS std FROM m GROUP BY 1, 2)
SELECT event_type, condition, runs, n, {r('mean', 'mean')}, {r('std', 'std')}, {r('std / sqrt(n)', 'se')}, {r('t * std / sqrt(n)', 'half')} FROM a LEFT JOIN t USING (runs)""")
def _(spark, read):
    """Intervals of conditions of which some runs failed, pseudo-runs of events."""
    u = F.col("user_id")
    runs = read("events").groupBy("event_type", (u % 4).alias("condition"), (u % 7).alias("run")).agg(F.avg("value").alias("v"))
    runs = runs.withColumn("m", F.when(F.col("run") >= F.col("condition") * 2, F.col("v")))
    return rounded(A.ablation_intervals(runs, ["event_type", "condition"], "m"))
