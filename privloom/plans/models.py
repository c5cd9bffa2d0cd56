"""Queries over models: measured marginals, conditional tables, fitted models and their samples."""

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.functions import hash_uniform
from privloom.operators import clustered as K
from privloom.operators import encode as E
from privloom.operators import graphical as G
from privloom.operators import network as N
from privloom.operators.cliques import set_information
from privloom.operators.compression import Compression
from privloom.operators.counts import contingency, pairwise_mi
from privloom.operators.privacy import most_parents_useful, tree_of_rows
from privloom.plans.base import query, r, rounded
from privloom.plans.counting import _COLS, _nmi_sql
from privloom.streaming import windowed_counts

_SIZES = {"f": 3, "s": 2, "n": 7}
_CODES = "(SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f, (l_linestatus = 'O')::INT AS s, (l_linenumber - 1)::INT AS n FROM lineitem)"


def _coded(read):
    flag = F.col("l_returnflag")
    return read("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("f"), (F.col("l_linestatus") == "O").cast("int").alias("s"), (F.col("l_linenumber") - 1).cast("int").alias("n"))


@query("B_measure", f"SELECT 0 AS set_id, f, s, NULL::INT AS n, count(*) AS m FROM {_CODES} GROUP BY f, s UNION ALL SELECT 1, NULL, s, n, count(*) FROM {_CODES} GROUP BY s, n UNION ALL SELECT 2, NULL, NULL, n, count(*) FROM {_CODES} GROUP BY n")
def _(spark, read):
    """Marginals of all cliques in one pass, before noise."""
    return contingency(_coded(read), [["f", "s"], ["s", "n"], ["n"]], name="m")


@query("C_cpd", f"WITH c AS (SELECT f, s, count(*) + 1 AS m FROM {_CODES} GROUP BY 1, 2) SELECT f, s, {r('m / sum(m) OVER (PARTITION BY f)', 'p')} FROM c")
def _(spark, read):
    """Conditional table of the observed cells, each count plus one."""
    cells = _coded(read).groupBy("f", "s").agg((F.count(F.lit(1)) + 1).alias("m"))
    return rounded(cells.select("f", "s", (F.col("m") / F.sum("m").over(Window.partitionBy("f"))).alias("p")))


@query("dp_exp_mech_B", f"""WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py, sum(n) OVER () AS t FROM c),
m AS (SELECT greatest(sum(p * log2(p / (px * py))), 0) AS mi, max(t)::DOUBLE AS t FROM p), z AS (SELECT mi, (2 / t * ln((t + 1) / 2) + (1 - 1 / t) * ln(1 + 2 / (t - 1))) / (1.0 / 2) AS d FROM m)
SELECT {r('1 / (1 + exp(-mi / (2 * d)))', 'p')} FROM z""")
def _(spark, read):
    """The chance that the exponential mechanism at epsilon 1, over two columns, takes an edge with its information in bits rather than one without."""
    m = pairwise_mi(read("orders"), ["o_orderstatus", "o_orderpriority"])
    n = read("orders").agg(F.count("*").cast("double").alias("t"))
    t = F.col("t")
    reach = 2 / t * F.log((t + 1) / 2) + (1 - 1 / t) * F.log1p(2 / (t - 1))  # of the information, in nats
    score = F.col("mi") / F.lit(math.log(2)) * F.lit(1.0 / 2) / (2 * reach)
    return rounded(m.join(F.broadcast(n)).select((1 / (1 + F.exp(-score))).alias("p")))


@query("C_K", f"""SELECT CASE WHEN n * 0.1 / ((9 - 3) * pow(2, 3 + 3)) > 5 OR n * 0.1 / (9 * pow(2, 3)) < 5 THEN 3 ELSE (SELECT min(k) FROM range(1, 8) v(k) WHERE n * 0.1 / ((9 - k) * pow(2, k + 3)) <= 5) END::INT AS k FROM (SELECT count(*) AS n FROM orders)""")
def _(spark, read):
    """The most parents of a node whose tables are useful, for the rows and nine columns of orders at epsilon 0.1."""
    n = read("orders").count()
    return spark.createDataFrame([(most_parents_useful(n, 9, 0.1),)], "k int")


@query("B_sample")
def _(spark, read):
    """A graphical model of exact marginals, and the counts of as many sampled rows as the table has."""
    rows = _coded(read)
    domain, cliques = G.Domain(_SIZES), [("f", "s"), ("s", "n")]
    measured = G.measure(rows, domain, cliques, None)
    model = G.Model(domain, cliques, G.total_of(measured))
    model.fit(measured, 300)
    return model.sample(rows.select("id"), "id").groupBy("f", "s").agg(F.count(F.lit(1)).alias("n"))


@query("A_fit")
def _(spark, read):
    """A noiseless network of the coded rows, and the counts of as many sampled rows as the table has."""
    rows = _coded(read)
    net = N.fit(rows.drop("id"), _SIZES, ["f", "s", "n"], None)
    return net.sample(rows.select("id"), "id").groupBy("f", "s").agg(F.count(F.lit(1)).alias("n"))


@query("A_root", f"""WITH m AS (SELECT p, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p FROM orders) GROUP BY 1), c AS (SELECT p, sum(n) OVER (ORDER BY p) / sum(n) OVER () AS hi FROM m),
l AS (SELECT list(hi ORDER BY p) AS cdf FROM c), u AS (SELECT o_orderkey, (('0x' || substr(md5('sample|status|' || o_orderkey), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM orders)
SELECT o_orderkey, least(len(list_filter(cdf, lambda c: c < u)), 2)::INT AS status FROM u, l""")
def _(spark, read):
    """The first column of an ancestral sample: its own distribution, by hash uniforms."""
    rows = read("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("status"))
    net = N.fit(rows.select("status"), {"status": 3}, ["status"], None, alpha=0.0)
    return net.sample(rows.select("o_orderkey"), "o_orderkey", lambda tag: hash_uniform("sample", tag, F.col("o_orderkey"))).select("o_orderkey", "status")


@query("enc_table_B", "SELECT l_orderkey, l_linenumber, (l_discount = 0.05)::INT AS missing, CASE WHEN l_discount = 0.05 THEN 0 ELSE least(list_position([0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.07, 0.08, 0.09, 0.1], l_discount), 10) - 1 END::INT AS code FROM lineitem")
def _(spark, read):
    """A null indicator beside the code; the fill value is a declared level."""
    levels = ["0.0", "0.01", "0.02", "0.03", "0.04", "0.06", "0.07", "0.08", "0.09", "0.1"]
    d = F.nullif(F.col("l_discount"), F.lit(0.05))
    return read("lineitem").select("l_orderkey", "l_linenumber", d.isNull().cast("int").alias("missing"), E.encode_category(d.cast("string"), levels, unknown=False).alias("code"))


@query("stream_counts", "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, read):
    """Windowed counts of the stream's release, on the table."""
    events = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events, "ts", "event_type").select(F.to_date("start").alias("day"), "event_type", "n")


_CENTROIDS = {0: [[0.0, 1.0], [2.0, 5.0], [1.0, 3.0]], 1: [[0.0, 0.0], [2.0, 1.0]]}
_SETS = (("f", "n"), ("f", "s"))


def _scores_sql() -> str:
    parts = []
    for i, (a, b) in enumerate(_SETS):
        child = ({"f", "s", "n"} - {a, b}).pop()
        far = [f"(({a} - {x}) * ({a} - {x}) + ({b} - {y}) * ({b} - {y}))" for x, y in _CENTROIDS[i]]
        where = " ".join(f"WHEN {d} = least({', '.join(far)}) THEN {j}" for j, d in enumerate(far))
        parts.append(f"SELECT {i} AS set, '{child}' AS child, CASE {where} END AS u, {child} AS v FROM {_CODES}")
    return f"""WITH c AS (SELECT set, child, u, v, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL),
p AS (SELECT set, child, n / sum(n) OVER w AS p, sum(n) OVER (PARTITION BY set, child, u) / sum(n) OVER w AS pu, sum(n) OVER (PARTITION BY set, child, v) / sum(n) OVER w AS pv FROM c WINDOW w AS (PARTITION BY set, child))
SELECT set, child, {r('2 * sum(p * ln(p / (pu * pv))) / (-sum(p * ln(pu)) - sum(p * ln(pv)))', 'score')} FROM p GROUP BY 1, 2"""


@query("C_nmi", _scores_sql())
def _(spark, read):
    """What clusters of two sets of parents tell of the column that is left, for given centroids."""
    cells = K.candidate_cells(_coded(read), _SETS, ["f", "s", "n"])
    return rounded(K.cluster_scores(cells, {i: np.array(c) for i, c in _CENTROIDS.items()}))


@query("C_greedy")
def _(spark, read):
    """The noiseless network of four columns of lineitem from a given root: (place, child, parents)."""
    rows = read("lineitem").select(*[x.alias(n) for n, x in _four().items()])
    edges = K.search(rows, {"f": 3, "s": 2, "n": 7, "d": 11}, None, 2, root="s")
    found = spark.createDataFrame([(i, c, ",".join(p)) for i, (c, p) in enumerate(edges)], "place int, child string, parents string")
    n = {c: rows.agg(F.count_distinct(c).alias("levels")).withColumn("child", F.lit(c)) for c in ("f", "s", "n", "d")}
    return found.join(n["f"].unionByName(n["s"]).unionByName(n["n"]).unionByName(n["d"]), "child")


def _four():
    flag = F.col("l_returnflag")
    return {"f": F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2), "s": (F.col("l_linestatus") == "O").cast("int"), "n": (F.col("l_linenumber") - 1).cast("int"), "d": F.rint(F.col("l_discount") * 100).cast("int")}


_UNIFORM = "((('0x' || substr(md5('sample|{tag}|' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("C_sample", f"""WITH d AS (SELECT f, s, n FROM {_CODES} WHERE NOT (f = 1 AND s = 0)), root AS (SELECT list(hi ORDER BY s) AS cdf FROM (SELECT s, sum(count(*)) OVER (ORDER BY s) / sum(count(*)) OVER () AS hi FROM d GROUP BY s)),
seen AS (SELECT DISTINCT f, s FROM d), fc AS (SELECT s, list(hi ORDER BY f) AS cdf FROM (SELECT s, f, sum(m) OVER (PARTITION BY s ORDER BY f) / sum(m) OVER (PARTITION BY s) AS hi FROM (
  SELECT k.s, g.f, count(d.f) + 1 AS m FROM (SELECT DISTINCT s FROM d) k CROSS JOIN range(3) g(f) LEFT JOIN d ON d.s = k.s AND d.f = g.f GROUP BY 1, 2)) GROUP BY s),
nc AS (SELECT f, s, list(hi ORDER BY n) AS cdf FROM (SELECT f, s, n, sum(m) OVER (PARTITION BY f, s ORDER BY n) / sum(m) OVER (PARTITION BY f, s) AS hi FROM (
  SELECT k.f, k.s, g.n, count(d.n) + 1 AS m FROM seen k CROSS JOIN range(7) g(n) LEFT JOIN d ON d.s = k.s AND d.f = k.f AND d.n = g.n GROUP BY 1, 2, 3)) GROUP BY f, s),
o AS (SELECT o_orderkey AS id, {', '.join(f"{_UNIFORM.format(tag=t, key='o_orderkey')} AS u{t}" for t in 'sfn')} FROM orders),
x AS (SELECT id, uf, un, least(len(list_filter(cdf, lambda c: c < us)), 1) AS s FROM o, root), y AS (SELECT id, un, s, least(len(list_filter(cdf, lambda c: c < uf)), 2) AS f FROM x JOIN fc USING (s))
SELECT id, s::INT AS s, f::INT AS f, CASE WHEN cdf IS NULL THEN least(floor(un * 7), 6) ELSE least(len(list_filter(cdf, lambda c: c < un)), 6) END::INT AS n FROM y LEFT JOIN nc USING (f, s)""")
def _(spark, read):
    """A sample as long as orders of a network of sparse tables: parents' codes that were never observed give all codes alike."""
    rows = _coded(read).filter(~((F.col("f") == 1) & (F.col("s") == 0)))
    net = K.SparseNetwork(dict(_SIZES), [("s", []), ("f", ["s"]), ("n", ["f", "s"])])
    net = K.tables(rows, net, 0, None)
    ids = read("orders").select(F.col("o_orderkey").alias("id"))
    return net.sample(ids, "id", lambda tag: hash_uniform("sample", tag, F.col("id")))


_FOUR = ("f", "s", "n", "d")
_TRIPLES = [(a, b, c) for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :] for c in _FOUR if c not in (a, b)]


@query("B_select", "WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f, (l_linestatus = 'O')::INT AS s, (l_linenumber - 1)::INT AS n, round(l_discount * 100)::INT AS d FROM lineitem), c AS (" + " UNION ALL ".join(
    f"SELECT '{a},{b}' AS parents, '{c}' AS child, {a} AS p, {b} AS q, {c} AS v, count(*) AS n FROM x GROUP BY ALL" for a, b, c in _TRIPLES) + f"""),
p AS (SELECT parents, child, n / sum(n) OVER w AS p, sum(n) OVER (PARTITION BY parents, child, p, q) / sum(n) OVER w AS pu, sum(n) OVER (PARTITION BY parents, child, v) / sum(n) OVER w AS pv FROM c WINDOW w AS (PARTITION BY parents, child)),
m AS (SELECT parents, child, {r('greatest(sum(p * ln(p / (pu * pv))), 0)', 'mi')} FROM p GROUP BY 1, 2) SELECT parents, child, mi, rank() OVER (ORDER BY mi DESC)::INT AS place FROM m""")
def _(spark, read):
    """The information of all cliques of three columns, from one exploded pass, and their order."""
    sets = list(dict.fromkeys((a, b) for a, b, _ in _TRIPLES))
    cells = K.candidate_cells(read("lineitem").select(*[x.alias(n) for n, x in _four().items()]), sets, _FOUR)
    named = F.get(F.array(*[F.lit(",".join(s)) for s in sets]), F.col("set"))
    found = rounded(set_information(cells).select(named.alias("parents"), "child", "mi"))
    return found.withColumn("place", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mi"))))  # a row a candidate


_HOLES = E.Holed.of([0, 10, 20, 30, 40, 50], [(3, 5), (12, 18), (15, 22), (30, 40)])
_UZ = "((('0x' || substr(md5('zeros|q|' || l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("enc_zeros_B", f"""WITH x AS (SELECT l_orderkey, l_linenumber, least(floor(l_quantity / 10), 4)::INT AS code, {_UZ} AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, code, round(CASE code WHEN 0 THEN CASE WHEN u * 8 < 3 THEN u * 8 ELSE 5 + (u * 8 - 3) END WHEN 1 THEN 10 + u * 2 WHEN 2 THEN 22 + u * 8 WHEN 4 THEN 40 + u * 10 END, 6) AS value FROM x""")
def _(spark, read):
    """Bins and values drawn from what structural zeros leave of them; of one bin nothing is left."""
    u = hash_uniform("zeros", "q", F.col("l_orderkey"), F.col("l_linenumber"))
    coded = read("lineitem").select("l_orderkey", "l_linenumber", _HOLES.encode(F.col("l_quantity")).alias("code"))
    return rounded(coded.withColumn("value", _HOLES.decode(F.col("code"), u)))


_LO, _HI, _DEEP, _BINS = 900.0, 105000.0, 12, 16


@query("dp_privtree", f"""WITH c AS (SELECT least(greatest(floor((l_extendedprice - {_LO}) / ({_HI} - {_LO}) * {2**_DEEP}), 0), {2**_DEEP - 1})::BIGINT AS code FROM lineitem),
k AS (SELECT d, code >> ({_DEEP} - d) AS leaf, count(*) AS n FROM c, range(0, {_DEEP + 1}) v(d) GROUP BY 1, 2), t AS (SELECT count(*) / {_BINS}::DOUBLE AS theta FROM c),
s AS (SELECT d, leaf FROM k, t WHERE n > theta AND d < {_DEEP}), x AS (SELECT d + 1 AS d, 2 * leaf + side AS leaf FROM s, (VALUES (0), (1)) v(side) UNION ALL SELECT 0, 0)
SELECT {r(f'{_LO} + ({_HI} - {_LO}) * leaf / pow(2, d)', 'lower')}, {r(f'{_LO} + ({_HI} - {_LO}) * (leaf + 1) / pow(2, d)', 'upper')}, coalesce(n, 0) AS n FROM x LEFT JOIN k USING (d, leaf) WHERE (d, leaf) NOT IN (SELECT (d, leaf) FROM s)""")
def _(spark, read):
    """Leaves of a PrivTree over rows, without noise."""
    leaves = tree_of_rows(read("lineitem"), "l_extendedprice", _LO, _HI, _BINS, enforce=False, deepest=_DEEP)
    return rounded(spark.createDataFrame(leaves, "lower double, upper double, n long"))


@query("B_compress", """WITH n AS (SELECT p_size - 1 AS code, count(*) AS n FROM part GROUP BY 1), t AS (SELECT avg(n) / 3 AS sigma FROM n), k AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS place FROM n, t WHERE n >= 3 * sigma),
m AS (SELECT code, sum(n) OVER (ORDER BY code) / sum(n) OVER () AS hi FROM n, t WHERE n < 3 * sigma), p AS (SELECT list(code ORDER BY code) AS members, list(hi ORDER BY code) AS cdf FROM m), q AS (SELECT count(*) AS size FROM k),
x AS (SELECT p_partkey, p_size - 1 AS code, ((('0x' || substr(md5('pool|p_size|pool|' || p_partkey), 1, 8))::BIGINT + 0.5) / 4294967296.0) AS u FROM part)
SELECT p_partkey, coalesce(place, size)::INT AS pooled, CASE WHEN place IS NOT NULL THEN x.code ELSE members[least(len(list_filter(cdf, lambda c: c <= u)), len(members) - 1) + 1] END::INT AS restored FROM x LEFT JOIN k ON x.code = k.code, p, q""")
def _(spark, read):
    """Rare sizes pooled by a threshold of three sigma, and each pooled one given back as one of the pool's by its share."""
    rows = read("part").select("p_partkey", (F.col("p_size") - 1).cast("int").alias("p_size"))
    found = {x.p_size: x["count"] for x in rows.groupBy("p_size").count().collect()}  # a row a size
    counts = np.zeros(max(found) + 1)
    for code, n in found.items():
        counts[code] = n
    pools = Compression.learn({"p_size": len(counts)}, {"p_size": (counts, float(np.mean(list(found.values()))) / 3)}, {"p_size": [i for i in range(len(counts)) if i not in found]})
    pooled = pools.encode(rows)
    back = pools.decode(pooled, "p_partkey", "pool").select("p_partkey", F.col("p_size").alias("restored"))
    return pooled.withColumnRenamed("p_size", "pooled").join(back, "p_partkey")


_FIRST = ("l_linenumber", "l_linestatus")
_ORDER = N.column_order(_COLS, _FIRST)


@query("A_order", f"""WITH {_nmi_sql()}, o(place, c) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_ORDER))}), e AS (SELECT a AS x, b AS y, mi FROM m UNION ALL SELECT b, a, mi FROM m)
SELECT o.place, o.c AS child, p.parent FROM o LEFT JOIN (SELECT y AS child, arg_min(x, (-round(mi, 12), x)) AS parent FROM e JOIN o a ON a.c = x JOIN o b ON b.c = y WHERE a.place < b.place GROUP BY y) p ON p.child = o.c""")
def _(spark, read):
    """Columns with a declared partial order in front, and of each the best parent among the earlier ones."""
    m = pairwise_mi(read("lineitem"), _COLS)
    places = spark.createDataFrame(list(enumerate(_ORDER)), "place int, child string")
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("child")), F.struct(F.col("b").alias("x"), F.col("a").alias("child"))))
    edges = m.select(ends.alias("e"), F.round("mi", 12).alias("mi")).select("e.*", "mi")
    earlier = places.withColumnsRenamed({"place": "at", "child": "x"})
    best = edges.join(F.broadcast(places), "child").join(F.broadcast(earlier), "x").filter("at < place").groupBy("child").agg(F.min_by("x", F.struct(-F.col("mi"), "x")).alias("parent"))
    return places.join(best, "child", "left").select("place", "child", "parent")
