"""Queries over the metrics: two halves of ``lineitem``, ``events`` or ``orders`` as real and synthetic tables."""

from pyspark.sql import functions as F

from privloom.functions import bucket, edges
from privloom.metrics import survival as S
from privloom.metrics import utility as U
from privloom.plans.base import SURVIVAL_SQL, halves, query, r, rounded, sql_bucket, survival

QTY16, QTY50 = edges(1.0, 50.0, 16), edges(1.0, 50.0, 50)
PRICE8, DISC8, QTY8 = edges(900.0, 105000.0, 8), edges(0.0, 0.1, 8), edges(1.0, 50.0, 8)


def _marginal_sql(cell: str, table: str = "lineitem", key: str = "l_orderkey") -> str:
    return f"""
WITH c AS (SELECT {cell} AS k, count(*) FILTER (WHERE {key} % 2 = 0) AS n0, count(*) FILTER (WHERE {key} % 2 = 1) AS n1 FROM {table} GROUP BY 1),
f AS (SELECT n0 / sum(n0) OVER () AS p, n1 / sum(n1) OVER () AS q FROM c WHERE k IS NOT NULL)
SELECT {r('sum(abs(p - q)) / 2', 'distance')} FROM f"""


@query("m_marginal", _marginal_sql(sql_bucket("l_quantity", QTY16)))
def _(spark, read):
    return rounded(U.cell_distance(halves(read, [bucket(F.col("l_quantity"), QTY16).alias("k")]), ["k"]))


@query("m_marginal_report", _marginal_sql(sql_bucket("l_quantity", QTY50)))
def _(spark, read):
    return rounded(U.cell_distance(halves(read, [bucket(F.col("l_quantity"), QTY50).alias("k")]), ["k"]))


@query("m_marginal_categorical", _marginal_sql("l_returnflag"))
def _(spark, read):
    return rounded(U.cell_distance(halves(read, ["l_returnflag"]), ["l_returnflag"]))


_CODES = {
    "l_quantity": sql_bucket("l_quantity", QTY8, True), "l_extendedprice": sql_bucket("l_extendedprice", PRICE8, True),
    "l_discount": sql_bucket("l_discount", DISC8, True), "l_returnflag": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 0 END",
}


def _tvd_sql() -> str:
    names = list(_CODES)
    parts = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, l_orderkey % 2 AS side, {_CODES[a]} AS x, {_CODES[b]} AS y FROM lineitem" for i, a in enumerate(names) for b in names[i + 1 :])
    return f"""
WITH c AS (SELECT a, b, x, y, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM ({parts}) GROUP BY ALL),
f AS (SELECT a, b, n0 / sum(n0) OVER (PARTITION BY a, b) AS p, n1 / sum(n1) OVER (PARTITION BY a, b) AS q FROM c)
SELECT a, b, {r('sum(abs(p - q)) / 2', 'distance')} FROM f GROUP BY a, b"""


def _coded_columns():
    flag = F.col("l_returnflag")
    return {"l_quantity": bucket(F.col("l_quantity"), QTY8, True), "l_extendedprice": bucket(F.col("l_extendedprice"), PRICE8, True), "l_discount": bucket(F.col("l_discount"), DISC8, True),
            "l_returnflag": F.when(flag == "N", 1).when(flag == "R", 2).otherwise(0)}


@query("m_tvd", _tvd_sql())
def _(spark, read):
    return rounded(U.pairwise_distance(halves(read, list(_CODES)), _coded_columns()))


@query("smp_pairs", f"SELECT * FROM ({_tvd_sql()}) ORDER BY md5('pairs|' || a || '|' || b) LIMIT 3")
def _(spark, read):
    """Distances of three sampled pairs of columns."""
    return rounded(U.pairwise_distance(halves(read, list(_CODES)), _coded_columns(), 3))


def _w1_sql(x: str, table: str, key: str) -> str:
    return f"""
WITH c AS (SELECT {x} AS x, count(*) FILTER (WHERE {key} % 2 = 0) AS n0, count(*) FILTER (WHERE {key} % 2 = 1) AS n1 FROM {table} GROUP BY 1),
g AS (SELECT x, abs(sum(n0) OVER w / sum(n0) OVER () - sum(n1) OVER w / sum(n1) OVER ()) AS gap, lead(x) OVER w - x AS width FROM c WINDOW w AS (ORDER BY x))
SELECT {r('coalesce(sum(gap * width), 0)', 'distance')} FROM g"""


@query("m_wasserstein", _w1_sql("l_quantity", "lineitem", "l_orderkey"))
def _(spark, read):
    return rounded(U.wasserstein(halves(read, ["l_quantity"]), "l_quantity"))


@query("m_joint_cens", f"""
WITH s AS ({SURVIVAL_SQL}), c AS (SELECT e, t AS x, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM s GROUP BY 1, 2),
g AS (SELECT e, abs(sum(n0) OVER w / sum(n0) OVER (PARTITION BY e) - sum(n1) OVER w / sum(n1) OVER (PARTITION BY e)) AS gap, lead(x) OVER w - x AS width FROM c WINDOW w AS (PARTITION BY e ORDER BY x)),
d AS (SELECT e, sum(gap * width) AS d FROM g GROUP BY e) SELECT {r('avg(d)', 'distance')} FROM d""")
def _(spark, read):
    return rounded(U.wasserstein(survival(read), "t", ["e"]).agg(F.avg("distance").alias("distance")))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("m_auc", f"""
WITH x AS (SELECT n_chars::DOUBLE AS s, toxic AS y FROM labels JOIN documents USING (doc_id)), k AS (SELECT y, {_RANK.format('s')} AS rk FROM x)
SELECT {r('(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))', 'auc')} FROM k""")
def _(spark, read):
    return rounded(U.auc(read("labels").join(read("documents"), "doc_id"), "n_chars", "toxic"))


def _spearman_sql(a: str, b: str, source: str) -> str:
    return f"SELECT corr(ra, rb) AS rho FROM (SELECT {_RANK.format('a')} AS ra, {_RANK.format('b')} AS rb FROM (SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM {source}))"


_NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query("m_spearman_sim", f"SELECT {r('greatest(least(corr(x, y), 1), -1)', 'similarity')} FROM (" + " UNION ALL ".join(
    f"SELECT a.rho AS x, b.rho AS y FROM ({_spearman_sql(_NUM[i], _NUM[j], 'lineitem WHERE l_orderkey % 2 = 0')}) a, ({_spearman_sql(_NUM[i], _NUM[j], 'lineitem WHERE l_orderkey % 2 = 1')}) b" for i in range(3) for j in range(i + 1, 3)) + ")")
def _(spark, read):
    """Pearson's correlation of the two sides' upper triangles of rank correlations."""
    from privloom.operators.counts import spearman_pairs

    out = spearman_pairs(halves(read, list(_NUM)), _NUM, ["side"]).groupBy("a", "b").pivot("side", [0, 1]).agg(F.first("rho")).select(F.col("0").alias("x"), F.col("1").alias("y"))
    return rounded(out.agg(F.greatest(F.least(F.corr("x", "y"), F.lit(1.0)), F.lit(-1.0)).alias("similarity")))


@query("m_cramers", f"""
WITH c AS (SELECT p_brand AS a, p_size AS b, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb FROM c),
o AS (SELECT sum(n * n / (ra::DOUBLE * rb)) - 1 AS phi, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k, max(t)::DOUBLE AS n FROM t),
s AS (SELECT greatest(0, phi - (k - 1) * (r - 1) / (n - 1)) AS f, least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1 AS l FROM o)
SELECT {r('CASE WHEN l > 0 THEN sqrt(f / l) END', 'v')} FROM s""")
def _(spark, read):
    return rounded(U.cramers_v(read("part"), "p_brand", "p_size"))


@query("m_coverage", f"SELECT {r('count(DISTINCT c_mktsegment) FILTER (WHERE c_mktsegment IN (' + chr(39) + 'BUILDING' + chr(39) + ',' + chr(39) + 'MACHINERY' + chr(39) + ',' + chr(39) + 'SPACE' + chr(39) + ')) / 3.0', 'coverage')} FROM customer")
def _(spark, read):
    return rounded(U.coverage(read("customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "SPACE"]))


@query("m_unk", f"SELECT {r('avg((CASE WHEN c_mktsegment = ' + chr(39) + 'MACHINERY' + chr(39) + ' THEN 1 ELSE 0 END))', 'rate')} FROM customer")
def _(spark, read):
    masked = read("customer").select(F.when(F.col("c_mktsegment") == "MACHINERY", "__UNK__").otherwise(F.col("c_mktsegment")).alias("c"))
    return rounded(masked.agg(F.avg((F.col("c") == "__UNK__").cast("int")).alias("rate")))


def _km_sql(by: str) -> str:
    return f"""s AS ({SURVIVAL_SQL}), c AS (SELECT {by}, t, sum(e) AS events, count(*) AS n FROM s GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY t DESC) AS at_risk FROM c),
km AS (SELECT {by}, t, at_risk, events, CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival,
  sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS variance FROM k WINDOW w AS (PARTITION BY {by} ORDER BY t))"""


@query("m_km", f"WITH {_km_sql('side')} SELECT side, t, at_risk::BIGINT AS at_risk, events::BIGINT AS events, {r('survival', 'survival')} FROM km")
def _(spark, read):
    return rounded(S.kaplan_meier(survival(read), "t", "e", "side").drop("variance"))


@query("win_km", f"WITH {_km_sql('stratum')} SELECT stratum, t, at_risk::BIGINT AS at_risk, {r('survival', 'survival')}, round(variance, 9) + 0.0 AS variance FROM km")
def _(spark, read):
    out = S.kaplan_meier(survival(read), "t", "e", "stratum")
    return out.select("stratum", "t", "at_risk", (F.round("survival", 6) + 0.0).alias("survival"), (F.round("variance", 9) + 0.0).alias("variance"))


_STEP, _N = 13.0, 200
_GRID = f"g AS (SELECT side, i, (i * {_STEP})::DOUBLE AS t FROM (SELECT DISTINCT side FROM s), range(0, {_N}) q(i)), f AS (SELECT g.side, g.i, g.t, coalesce(km.survival, 1.0) AS survival, coalesce(km.variance, 0.0) AS variance FROM g ASOF LEFT JOIN km ON g.side = km.side AND g.t >= km.t)"
_WIDE = "p AS (SELECT i, t, max(survival) FILTER (WHERE side = 0) AS sa, max(variance) FILTER (WHERE side = 0) AS va, max(survival) FILTER (WHERE side = 1) AS sb FROM f GROUP BY 1, 2)"


def _grid(read):
    both = survival(read)
    return S.on_grid(S.kaplan_meier(both, "t", "e", "side"), "side", both, _STEP, _N)


@query("join_interp", f"WITH {_km_sql('side')}, {_GRID} SELECT side, i::INT AS i, t, {r('survival', 'survival')} FROM f")
def _(spark, read):
    """As-of lookup of a step curve on a grid."""
    return rounded(_grid(read).drop("variance"))


@query("m_km_l1", f"WITH {_km_sql('side')}, {_GRID}, {_WIDE} SELECT {r('sum(a) / max(t)', 'distance')} FROM (SELECT t, (lead(t) OVER w - t) * (lead(abs(sa - sb)) OVER w + abs(sa - sb)) / 2 AS a FROM p WINDOW w AS (ORDER BY t))")
def _(spark, read):
    return rounded(S.curve_distance(_grid(read), "side", 0, 1))


@query("m_km_ci", f"""WITH {_km_sql('side')}, {_GRID}, {_WIDE},
b AS (SELECT sb, CASE WHEN sa > 0 AND sa < 1 THEN exp(-exp(ln(-ln(sa)) + {S.Z95} * sqrt(va) / ln(sa))) ELSE sa END AS x, CASE WHEN sa > 0 AND sa < 1 THEN exp(-exp(ln(-ln(sa)) - {S.Z95} * sqrt(va) / ln(sa))) ELSE sa END AS y FROM p)
SELECT {r('avg((sb >= least(x, y) AND sb <= greatest(x, y))::INT)', 'share')} FROM b""")
def _(spark, read):
    return rounded(S.inside_band(_grid(read), "side", 0, 1))


_STRATA = f"""WITH s AS ({SURVIVAL_SQL}), c AS (SELECT stratum, side, t, sum(e) AS events, count(*) AS n FROM s GROUP BY 1, 2, 3),
k AS (SELECT *, sum(n) OVER (PARTITION BY stratum, side ORDER BY t DESC) AS at_risk FROM c),
km AS (SELECT stratum, side, t, CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival FROM k WINDOW w AS (PARTITION BY stratum, side ORDER BY t)),
g AS (SELECT stratum, side, (i * {_STEP})::DOUBLE AS t FROM (SELECT DISTINCT stratum, side FROM s), range(0, {_N}) q(i)),
f AS (SELECT g.stratum, g.side, g.t, coalesce(km.survival, 1.0) AS survival FROM g ASOF LEFT JOIN km ON g.stratum = km.stratum AND g.side = km.side AND g.t >= km.t),
p AS (SELECT stratum, t, abs(max(survival) FILTER (WHERE side = 0) - max(survival) FILTER (WHERE side = 1)) AS gap FROM f GROUP BY 1, 2),
a AS (SELECT stratum, t, (lead(t) OVER w - t) * (lead(gap) OVER w + gap) / 2 AS a FROM p WINDOW w AS (PARTITION BY stratum ORDER BY t))
SELECT stratum, {r('sum(a) / max(t)', 'distance')} FROM a GROUP BY stratum"""


@query("m_km_strat", _STRATA)
def _(spark, read):
    out = None
    for name in ("F", "O"):
        part = survival(read).filter(F.col("stratum") == name)
        grid = S.on_grid(S.kaplan_meier(part, "t", "e", "side"), "side", part, _STEP, _N)
        row = S.curve_distance(grid, "side", 0, 1).select(F.lit(name).alias("stratum"), "distance")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("m_logrank", f"""WITH s AS ({SURVIVAL_SQL}), c AS (SELECT t, sum(e) AS d, sum(e * (side = 0)::INT) AS d1, count(*) AS n, sum((side = 0)::INT) AS n1 FROM s GROUP BY t),
k AS (SELECT *, sum(n) OVER w::DOUBLE AS r, sum(n1) OVER w::DOUBLE AS r1 FROM c WINDOW w AS (ORDER BY t DESC))
SELECT {r('pow(sum(d1) - sum(d * r1 / r), 2) / sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END)', 'chi2')} FROM k WHERE d > 0""".replace("OVER w::DOUBLE", "OVER w"))
def _(spark, read):
    return rounded(S.log_rank(survival(read), "t", "e", "side", 0))


@query("m_rmst", f"""WITH {_km_sql('side')}, p AS (SELECT side, t, survival FROM km WHERE t <= 1500 AND t > 0 UNION ALL SELECT DISTINCT side, 0.0, 1.0 FROM km)
SELECT side, {r('sum(a)', 'rmst')} FROM (SELECT side, (lead(t) OVER w - t) * (lead(survival) OVER w + survival) / 2 AS a FROM p WINDOW w AS (PARTITION BY side ORDER BY t)) GROUP BY side""")
def _(spark, read):
    return rounded(S.restricted_mean(S.kaplan_meier(survival(read), "t", "e", "side"), "side", 1500.0))


@query("m_cens_rate", f"SELECT {r('abs(avg(1 - e) FILTER (WHERE side = 0) - avg(1 - e) FILTER (WHERE side = 1))', 'difference')} FROM ({SURVIVAL_SQL})")
def _(spark, read):
    return rounded(survival(read).agg(F.abs(F.avg(F.when(F.col("side") == 0, 1 - F.col("e"))) - F.avg(F.when(F.col("side") == 1, 1 - F.col("e")))).alias("difference")))


@query("m_cindex", f"""WITH s AS ({SURVIVAL_SQL}), c AS (SELECT t, risk AS r, count(*) AS n, sum(e) AS d FROM s GROUP BY 1, 2),
g AS (SELECT a.t, b.r, coalesce(c.n, 0) AS n, coalesce(c.d, 0) AS d FROM (SELECT DISTINCT t FROM c) a CROSS JOIN (SELECT DISTINCT r FROM c) b LEFT JOIN c ON c.t = a.t AND c.r = b.r),
l AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY t DESC) - n AS later FROM g),
w AS (SELECT d, later, sum(later) OVER (PARTITION BY t ORDER BY r) - later AS lower, sum(later) OVER (PARTITION BY t) AS everything FROM l)
SELECT {r('sum(d * (lower + later / 2.0)) / sum(d * everything)', 'concordance')}, sum(d * everything)::BIGINT AS pairs FROM w""")
def _(spark, read):
    return rounded(S.concordance(survival(read), "t", "e", "risk"))
