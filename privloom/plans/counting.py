"""Queries over counting, joins, windows, sorting, sampling and set operations."""

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.functions import bucket, edges, hash_uniform
from privloom.operators import counts as C
from privloom.operators import neighbours as NN
from privloom.operators import quantiles as Q
from privloom.operators import relational as R
from privloom.operators.prefix import quantiles
from privloom.plans.base import query, r, rounded, sql_bucket

PRICE10 = edges(900.0, 105000.0, 10)
_U = "((('0x' || substr(md5('{seed}|{tag}|' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("agg_count1", "SELECT q::INT AS code, count(l_orderkey) AS n FROM range(0, 60) v(q) LEFT JOIN lineitem ON l_quantity = q GROUP BY q")
def _(spark, read):
    return C.histogram(read("lineitem"), F.col("l_quantity").cast("int"), 60)


_SETS = [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linenumber"], ["l_linestatus", "l_linenumber"]]


@query("agg_joint2", "SELECT CASE grouping_id(l_returnflag, l_linestatus, l_linenumber) WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS set_id, l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber), (l_linestatus, l_linenumber))")
def _(spark, read):
    return C.contingency(read("lineitem"), _SETS)


_FLAG_SQL = "(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)"
_CODES_SQL = f"(SELECT {_FLAG_SQL} AS f, (l_linestatus = 'O')::INT AS s, (l_linenumber - 1)::INT AS c FROM lineitem)"


def _coded(read):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return read("lineitem").select(flag.alias("f"), (F.col("l_linestatus") == "O").cast("int").alias("s"), (F.col("l_linenumber") - 1).cast("int").alias("c"), "l_orderkey", "l_linenumber")


@query("agg_cpt", f"SELECT (f * 2 + s)::BIGINT AS key, c AS child, count(*) AS n FROM {_CODES_SQL} GROUP BY 1, 2")
def _(spark, read):
    return C.keyed_counts(_coded(read), [("f", 3), ("s", 2)], ("c", 7))


_CPT = f"""g AS (SELECT (f * 2 + s)::BIGINT AS key, c AS child, count(*) AS n FROM {_CODES_SQL} GROUP BY 1, 2),
d AS (SELECT k::BIGINT AS key, h::INT AS child, coalesce(n, 0) + 1.5::DOUBLE AS m FROM range(0, 6) a(k) CROSS JOIN range(0, 7) b(h) LEFT JOIN g ON g.key = k AND g.child = h),
cpt AS (SELECT key, child, m / sum(m) OVER (PARTITION BY key) AS p FROM d)"""


@query("A_cpt", f"WITH {_CPT} SELECT key, child, {r('p', 'p')} FROM cpt")
def _(spark, read):
    return rounded(C.conditional(C.keyed_counts(_coded(read), [("f", 3), ("s", 2)], ("c", 7)), 6, 7, 1.5))


@query("join_lookup", f"WITH {_CPT} SELECT key, count(*) AS n, {r('sum(p)', 'mass')} FROM (SELECT (f * 2 + s)::BIGINT AS key, c AS child FROM {_CODES_SQL}) JOIN cpt USING (key, child) GROUP BY key")
def _(spark, read):
    rows = _coded(read).withColumn("k", (F.col("f") * 2 + F.col("s")).cast("long"))
    cpt = C.conditional(C.keyed_counts(rows, [("f", 3), ("s", 2)], ("c", 7)), 6, 7, 1.5)
    wide = cpt.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("child", "p"))), lambda x: x["p"]).alias("probs"))
    found = R.lookup(rows, F.col("k"), wide, "probs")
    return rounded(found.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("probs", F.col("c"))).alias("mass")))


@query("win_cdf", f"WITH {_CPT} SELECT key, child, {r('sum(p) OVER (PARTITION BY key ORDER BY child)', 'cdf')} FROM cpt")
def _(spark, read):
    cpt = C.conditional(C.keyed_counts(_coded(read), [("f", 3), ("s", 2)], ("c", 7)), 6, 7, 1.5)
    return rounded(cpt.select("key", "child", F.sum("p").over(Window.partitionBy("key").orderBy("child")).alias("cdf")))


@query("agg_datavector", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) + 0.0 AS n FROM lineitem GROUP BY 1, 2")
def _(spark, read):
    return rounded(C.contingency(read("lineitem"), [["l_returnflag", "l_linestatus"]], weight="l_quantity").drop("set_id"))


@query("agg_groupsize", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, read):
    return read("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("agg_resum", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, read):
    """A marginal from a joint count, without another pass over the rows."""
    joint = read("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return joint.groupBy("o_orderpriority").agg(F.sum("n").alias("n"))


@query("agg_crosstab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(spark, read):
    wide = read("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.select("o_orderpriority", *[F.col(c).alias(c.lower()) for c in "FOP"])


@query("agg_hist", f"SELECT {sql_bucket('l_extendedprice', PRICE10)} AS code, count(*) AS n FROM lineitem GROUP BY 1 HAVING code IS NOT NULL")
def _(spark, read):
    return C.histogram(read("lineitem"), bucket(F.col("l_extendedprice"), PRICE10), 10).filter("n > 0")


@query("agg_hist2d", f"SELECT {sql_bucket('l_extendedprice', PRICE10)} AS a, {sql_bucket('l_quantity', edges(1.0, 50.0, 5))} AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, read):
    return read("lineitem").groupBy(bucket(F.col("l_extendedprice"), PRICE10).alias("a"), bucket(F.col("l_quantity"), edges(1.0, 50.0, 5)).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_value_counts", f"SELECT v AS value, {r('coalesce(n / t::DOUBLE, 0)', 'fraction')} FROM (VALUES ('BUILDING'), ('MACHINERY'), ('SPACE')) d(v) LEFT JOIN (SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer) AS t FROM customer GROUP BY 1) c ON c_mktsegment = v")
def _(spark, read):
    return rounded(C.value_fractions(read("customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "SPACE"]))


@query("agg_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_shipdate) AS days FROM lineitem")
def _(spark, read):
    return read("lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_shipdate").alias("days"))


@query("agg_stats", f"SELECT event_type, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('var_samp(value)', 'var')}, count(value) AS n FROM events GROUP BY 1")
def _(spark, read):
    return rounded(read("events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("var"), F.count("value").alias("n")))


@query("agg_median_iqr", f"SELECT event_type, {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')} FROM events GROUP BY 1")
def _(spark, read):
    q = quantiles(read("events"), F.col("value"), [0.25, 0.5, 0.75], ["event_type"])
    return rounded(q.select("event_type", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")))


@query("agg_quantile", f"SELECT {r('quantile_cont(l_extendedprice, 0.025)', 'lo')}, {r('quantile_cont(l_extendedprice, 0.99)', 'hi')} FROM lineitem")
def _(spark, read):
    return rounded(C.quantiles(read("lineitem"), "l_extendedprice", [0.025, 0.99]).select(F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi")))


_RK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("agg_corr", f"SELECT {r('corr(a, b)', 'rho')} FROM (SELECT {_RK.format('value')} AS a, {_RK.format('user_id')} AS b FROM events)")
def _(spark, read):
    return rounded(C.spearman(read("events"), "value", "user_id"))


@query("win_rank", f"SELECT event_id, {_RK.format('user_id')} AS average_rank FROM events")
def _(spark, read):
    return C.with_average_rank(read("events"), "user_id").select("event_id", "average_rank")


@query("A_mi", f"""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM c)
SELECT {r('greatest(sum(p * ln(p / (pa * pb))), 0)', 'mi')} FROM p""".replace(", 6)", ", 9)"))
def _(spark, read):
    return rounded(C.mutual_information(read("orders"), "o_orderstatus", "o_orderpriority"), 9)


_COLS = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")


def _nmi_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::VARCHAR AS x, {b}::VARCHAR AS y FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :])
    return f"""c AS (SELECT a, b, x, y, count(*) AS n FROM ({parts}) GROUP BY ALL),
p AS (SELECT a, b, n / sum(n) OVER w AS p, sum(n) OVER (PARTITION BY a, b, x) / sum(n) OVER w AS px, sum(n) OVER (PARTITION BY a, b, y) / sum(n) OVER w AS py FROM c WINDOW w AS (PARTITION BY a, b)),
m AS (SELECT a, b, greatest(sum(p * ln(p / (px * py))), 0) AS mi, -sum(p * ln(px)) AS ha, -sum(p * ln(py)) AS hb FROM p GROUP BY a, b)"""


@query("B_mi", f"WITH {_nmi_sql()} SELECT a, b, {r('CASE WHEN ha > 0 AND hb > 0 THEN mi / sqrt(ha * hb) ELSE 0 END', 'score')} FROM m")
def _(spark, read):
    m = C.pairwise_mi(read("lineitem"), _COLS)
    return rounded(m.select("a", "b", F.when((F.col("ha") > 0) & (F.col("hb") > 0), F.col("mi") / F.sqrt(F.col("ha") * F.col("hb"))).otherwise(0.0).alias("score")))


@query("A_parents", f"WITH {_nmi_sql()} SELECT b AS child, a AS parent, rank FROM (SELECT a, b, (row_number() OVER (PARTITION BY b ORDER BY round(mi, 12) DESC, a))::INT AS rank FROM m) WHERE rank <= 2")
def _(spark, read):
    m = C.pairwise_mi(read("lineitem"), _COLS)
    w = Window.partitionBy("b").orderBy(F.desc(F.round("mi", 12)), "a")
    return m.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select(F.col("b").alias("child"), F.col("a").alias("parent"), "rank")


@query("dp_exp_mech_C", f"""WITH {_nmi_sql()}, t AS (SELECT count(*)::DOUBLE AS t, {", ".join(f"count(DISTINCT {c}) AS d_{c}" for c in _COLS)} FROM lineitem),
s AS (SELECT a, b, mi, t, least({", ".join(f"CASE WHEN a = '{c}' OR b = '{c}' THEN d_{c} ELSE 99 END" for c in _COLS)}) <= 2 AS two FROM m, t),
z AS (SELECT a, b, mi / (2 * 3 * CASE WHEN two THEN ln(t) / t + (t - 1) / t * ln(t / (t - 1)) ELSE 2 / t * ln((t + 1) / 2) + (1 - 1 / t) * ln(1 + 2 / (t - 1)) END / 0.01) AS x FROM s),
e AS (SELECT a, b, exp(x - max(x) OVER ()) AS e FROM z) SELECT a, b, {r('e / sum(e) OVER ()', 'p')} FROM e""")
def _(spark, read):
    """Chances of the exponential mechanism over candidate edges at epsilon 0.01: the sensitivity is less where a column has two values, and the
    budget is shared by the edges of a tree."""
    df = read("lineitem").select(*_COLS)
    m = C.pairwise_mi(df, _COLS)
    sizes = df.agg(F.count("*").cast("double").alias("t"), *[F.count_distinct(c).alias(f"d_{c}") for c in _COLS])
    t = F.col("t")
    two = F.least(*[F.when((F.col("a") == c) | (F.col("b") == c), F.col(f"d_{c}")).otherwise(99) for c in _COLS]) <= 2
    reach = F.when(two, F.log(t) / t + (t - 1) / t * F.log(t / (t - 1))).otherwise(2 / t * F.log((t + 1) / 2) + (1 - 1 / t) * F.log1p(2 / (t - 1)))
    scored = m.join(F.broadcast(sizes)).withColumn("x", F.col("mi") / (2 * (len(_COLS) - 1) * reach / F.lit(0.01)))
    top = scored.agg(F.max("x").alias("top"))
    e = scored.join(F.broadcast(top)).withColumn("e", F.exp(F.col("x") - F.col("top")))  # a row a pair
    return rounded(e.join(F.broadcast(e.agg(F.sum("e").alias("all")))).select("a", "b", (F.col("e") / F.col("all")).alias("p")))


@query("dp_heavy_hitters", "SELECT b::INT AS bucket, count(p_partkey) AS n FROM range(0, 64) v(b) LEFT JOIN part ON (('0x' || substr(md5(p_type), 1, 8))::BIGINT % 64) = b GROUP BY b")
def _(spark, read):
    """Counts of all hash buckets, empty ones too, before noise."""
    code = F.pmod(F.conv(F.substring(F.md5("p_type"), 1, 8), 16, 10).cast("long"), F.lit(64)).cast("int")
    return C.histogram(read("part"), code, 64).withColumnRenamed("code", "bucket")


_EPSILON, _DELTA = 0.5, 1e-6
_BETA = _EPSILON / (2 * math.log(1 / _DELTA))


def _smooth_sql(q: float) -> str:
    return f"""SELECT {q}::DOUBLE AS q, any_value(x) FILTER (WHERE k = 0) AS value, round(max(exp(-{_BETA!r}::DOUBLE * k) * (h - l)), 6) + 0.0 AS sensitivity FROM (
  SELECT k, v[i + 1] AS x, v[least(i + k, n - 1) + 1] AS h, v[greatest(i - k, 0) + 1] AS l FROM (
    SELECT v, n, ceil({q}::DOUBLE * n)::BIGINT - 1 AS i, unnest(range(0, least(n - 1, ceil(4 * sqrt(n + 1))::BIGINT) + 1)) AS k FROM s))"""


@query("dp_quantile_smooth", f"WITH s AS (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS v, count(*) AS n FROM lineitem) {_smooth_sql(0.05)} UNION ALL {_smooth_sql(0.95)}")
def _(spark, read):
    """Two quantiles with their smooth sensitivity over all ranks that the mechanism looks at, before noise."""
    rows = read("lineitem").select("l_extendedprice")
    each = [Q.smooth_sensitivity(rows, "l_extendedprice", q, _EPSILON, _DELTA).select(F.lit(q).alias("q"), "value", F.round("sensitivity", 6).alias("sensitivity")) for q in (0.05, 0.95)]
    return each[0].unionByName(each[1])


@query("dp_bounds_smooth", f"WITH s AS (SELECT list(c_acctbal ORDER BY c_acctbal) AS v, count(*) AS n FROM customer) SELECT q, value, sensitivity, sensitivity * {2 / _EPSILON} AS scale FROM ({_smooth_sql(0.01)} UNION ALL {_smooth_sql(0.99)})")
def _(spark, read):
    """What ``smooth_bounds`` measures of a pair of ends before noise, and the scale of the noise."""
    rows = read("customer").select("c_acctbal")
    each = [Q.smooth_sensitivity(rows, "c_acctbal", q, _EPSILON, _DELTA).select(F.lit(q).alias("q"), "value", F.round("sensitivity", 6).alias("sensitivity")) for q in (0.01, 0.99)]
    return each[0].unionByName(each[1]).withColumn("scale", F.col("sensitivity") * F.lit(2 / _EPSILON))


@query("win_order_stats", "WITH k AS (SELECT l_quantity AS x, row_number() OVER (ORDER BY l_quantity) - 1 AS rank, count(*) OVER () AS t FROM lineitem) SELECT rank, x FROM k WHERE abs(rank - floor(0.5 * (t - 1))) <= 25")
def _(spark, read):
    return R.around_rank(read("lineitem"), "l_quantity", 0.5, 25)


@query("win_repeat", f"""WITH s AS (SELECT l_linestatus, l_returnflag AS code, count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus) AS p FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_linestatus, code, sum(p) OVER (PARTITION BY l_linestatus ORDER BY code) AS hi FROM s),
o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS l_linestatus FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY {_U.format(seed='allot', tag='allot', key='o_orderkey')}, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY l_linestatus) AS n FROM o)
SELECT l_linestatus, code, count(*) AS n FROM (SELECT k.l_linestatus, o_orderkey, min(code) AS code FROM k JOIN c ON k.l_linestatus = c.l_linestatus AND hi > (i + 0.5) / n GROUP BY 1, 2) GROUP BY 1, 2""")
def _(spark, read):
    """Systematic rounding of the observed return flags onto orders, by line status."""
    counts = read("lineitem").groupBy("l_linestatus", F.col("l_returnflag").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select("l_linestatus", "code", (F.col("n") / F.sum("n").over(Window.partitionBy("l_linestatus"))).alias("p"))
    rows = read("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("l_linestatus"))
    return R.allot(rows, ["l_linestatus"], shares, "o_orderkey").groupBy("l_linestatus", "code").agg(F.count(F.lit(1)).alias("n"))


def _sample_sql() -> str:
    return f"""WITH {_CPT}, x AS (SELECT key, list(cdf ORDER BY child) AS cdf FROM (SELECT key, child, sum(p) OVER (PARTITION BY key ORDER BY child) AS cdf FROM cpt) GROUP BY key),
s AS (SELECT l_orderkey, l_linenumber, (f * 2 + s)::BIGINT AS key, {_U.format(seed='sample', tag='c', key="l_orderkey || '|' || l_linenumber")} AS u FROM (SELECT l_orderkey, l_linenumber, {_FLAG_SQL} AS f, (l_linestatus = 'O')::INT AS s FROM lineitem))
SELECT l_orderkey, l_linenumber, least(len(list_filter(cdf, lambda c: c < u)), 6)::INT AS code FROM s JOIN x USING (key)"""


@query("A_sample", _sample_sql())
def _(spark, read):
    """The last column of an ancestral sample given two sampled ones, by inverse distribution functions."""
    from privloom.operators.network import Network

    rows = _coded(read)
    cpt = C.conditional(C.keyed_counts(rows, [("f", 3), ("s", 2)], ("c", 7)), 6, 7, 1.5)
    import numpy as np

    table = np.zeros((6, 7))
    for x in cpt.collect():  # 42 cells
        table[x.key, x.child] = x.p
    net = Network(["c"], {"f": 3, "s": 2, "c": 7}, {"c": ["f", "s"]}, {"c": table})
    u = lambda tag: hash_uniform("sample", tag, F.col("l_orderkey"), F.col("l_linenumber"))
    return net.sample(rows.drop("c"), "l_orderkey", u).select("l_orderkey", "l_linenumber", F.col("c").alias("code"))


@query("join_index", f"SELECT event_type, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, count(*) AS n FROM events GROUP BY 1")
def _(spark, read):
    return rounded(read("events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n")))


@query("join_map", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, read):
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("join_outer_hist", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n0, coalesce(b.n, 0) AS n1 FROM (SELECT p_size AS k, count(*) AS n FROM part WHERE p_brand < 'Brand#3' GROUP BY 1) a FULL JOIN (SELECT p_size AS k, count(*) AS n FROM part WHERE p_brand >= 'Brand#3' GROUP BY 1) b ON a.k = b.k")
def _(spark, read):
    low = F.col("p_brand") < "Brand#3"
    one = lambda cond, name: read("part").filter(cond).groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return one(low, "n0").join(one(~low, "n1"), "k", "full_outer").select("k", F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"))


@query("join_algebra", f"""WITH a AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*)::DOUBLE AS x FROM lineitem GROUP BY 1, 2), b AS (SELECT l_linestatus AS s, l_linenumber AS c, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2)
SELECT f, c, {r('sum(x * y)', 'value')} FROM a JOIN b USING (s) GROUP BY 1, 2""".replace(", 6)", ", 3)"))
def _(spark, read):
    """A product of two factors over the attribute they share, summed out."""
    df = read("lineitem")
    a = df.groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    b = df.groupBy(F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("c")).agg(F.avg("l_quantity").alias("y"))
    return rounded(a.join(b, "s").groupBy("f", "c").agg(F.sum(F.col("x") * F.col("y")).alias("value")), 3)


@query("join_knn", f"SELECT a.vec_id, {r('min(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))))', 'distance')} FROM embeddings a JOIN embeddings b ON b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0 GROUP BY 1")
def _(spark, read):
    side = lambda k: read("embeddings").filter(F.col("vec_id") % 2 == k)
    return rounded(NN.nearest_distances(side(0), side(1), "vec_id", "embedding").select("vec_id", F.col("distances")[0].alias("distance")))


@query("srt_topk_buckets", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5")
def _(spark, read):
    return read("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(5)


@query("srt_cols", "SELECT n_regionkey, n_name, (row_number() OVER (ORDER BY n_regionkey, n_name DESC))::INT AS place FROM nation")
def _(spark, read):
    return read("nation").select("n_regionkey", "n_name", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("n_regionkey", F.desc("n_name"))).alias("place"))


@query("smp_split", f"""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_U.format(seed='split', tag='split', key='o_orderkey')}, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, ((i >= (n * 0.6::DOUBLE)::DECIMAL(30, 6)::BIGINT)::INT + (i >= (n * 0.8::DOUBLE)::DECIMAL(30, 6)::BIGINT)::INT) AS part FROM k""")
def _(spark, read):
    return R.exact_split(read("orders"), "o_orderkey", [0.6, 0.2, 0.2]).select("o_orderkey", "part")


@query("smp_rows", f"SELECT c_custkey FROM customer ORDER BY {_U.format(seed='sample', tag='sample', key='c_custkey')}, c_custkey LIMIT 250")
def _(spark, read):
    return R.sample(read("customer"), "c_custkey", 250).select("c_custkey")


@query("lim_head", "SELECT p_partkey, (ntile(5) OVER (ORDER BY p_retailprice, p_partkey))::INT AS part FROM part")
def _(spark, read):
    """Fifths of the rows in an order, such as the first fifth that one profile tests on."""
    return R.tiles(read("part"), "p_retailprice", ["p_partkey"], 5).select("p_partkey", "part")


@query("set_union", "SELECT origin, count(*) AS n, round(sum(balance), 4) + 0.0 AS total FROM (SELECT 'c' AS origin, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY 1")
def _(spark, read):
    a = read("customer").select(F.lit("c").alias("origin"), F.col("c_acctbal").alias("balance"))
    b = read("supplier").select(F.col("s_acctbal").alias("balance"), F.lit("s").alias("origin"))
    return rounded(a.unionByName(b).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("total")), 4)


@query("set_dedupe", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def _(spark, read):
    first = F.min(F.struct("l_orderkey", "l_linenumber"))
    return read("lineitem").groupBy("l_partkey").agg(first.alias("f")).select("l_partkey", "f.l_orderkey", "f.l_linenumber")


@query("set_intersect", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(spark, read):
    return read("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(read("supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("set_except", "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(spark, read):
    return read("nation").select(F.col("n_nationkey").alias("nation")).exceptAll(read("supplier").filter("s_acctbal > 5000").select("s_nationkey").distinct())


@query("flt_dropna", "SELECT count(*) AS n FROM (SELECT nullif(l_discount, 0.05) AS d, nullif(l_returnflag, 'N') AS f FROM lineitem) WHERE d IS NOT NULL AND f IS NOT NULL")
def _(spark, read):
    return read("lineitem").select(F.nullif(F.col("l_discount"), F.lit(0.05)).alias("d"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("f")).na.drop("any").agg(F.count(F.lit(1)).alias("n"))


@query("flt_mask", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def _(spark, read):
    return read("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber")


@query("prd_isin", "SELECT coalesce(f IN ('A', 'N'), false) AS member, count(*) AS n FROM (SELECT nullif(l_returnflag, 'N') AS f FROM lineitem) GROUP BY 1")
def _(spark, read):
    flag = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return read("lineitem").groupBy(F.coalesce(flag.isin("A", "N"), F.lit(False)).alias("member")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_cols", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, read):
    return read("orders").select("o_orderkey", "o_totalprice")
