"""Queries over profiling and encoding."""

import math

from pyspark.sql import functions as F

from privloom.functions import clip, edges, hash_uniform, number
from privloom.operators import counts as C
from privloom.operators import dates as DT
from privloom.operators import encode as E
from privloom.operators import inference as I
from privloom.operators import privacy
from privloom.operators import private_inference as PI
from privloom.operators import profile as P
from privloom.operators.prefix import quantiles
from privloom.plans.base import query, r, rounded, sql_bucket
from privloom.schema import Schema

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber")


def _each(expr: str, columns=_LINE, table: str = "lineitem", **extra) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} FROM {table}" for c in columns)


@query("prof_missing", _each(r("avg((nullif({c}::VARCHAR, 'N') IS NULL)::INT)", "missing"), ("l_returnflag", "l_linestatus", "l_linenumber")))
def _(spark, read):
    """Missing shares after one level is masked, as the given tables have no nulls."""
    df = read("lineitem").select(*[F.nullif(F.col(c).cast("string"), F.lit("N")).alias(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber")])
    return rounded(P.profile(df).select("column", "missing"))


@query("prof_nunique", _each("count(DISTINCT {c}) AS n_distinct"))
def _(spark, read):
    return P.profile(read("lineitem").select(*_LINE)).select("column", "n_distinct")


@query("prof_bounds", _each("floor(min({c}::DOUBLE) - 0.05 * (max({c}::DOUBLE) - min({c}::DOUBLE))) AS lo, ceil(max({c}::DOUBLE) + 0.05 * (max({c}::DOUBLE) - min({c}::DOUBLE))) AS hi", ("l_quantity", "l_extendedprice", "l_linenumber")))
def _(spark, read):
    df = P.profile(read("lineitem").select("l_quantity", "l_extendedprice", "l_linenumber"))
    lo, hi = P.bounds(F.col("lo"), F.col("hi"), 0.05, True)
    return df.select("column", lo.alias("low"), hi.alias("high")).select("column", F.col("low").alias("lo"), F.col("high").alias("hi"))


@query("prof_int_like", _each("min((abs({c}::DOUBLE - round({c}::DOUBLE)) <= 1e-8 + 1e-5 * abs(round({c}::DOUBLE)))::INT) AS integer_like", ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def _(spark, read):
    return P.profile(read("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")).select("column", "integer_like")


@query("prof_guid", f"SELECT {r('avg(regexp_full_match(md5(c_name), ' + chr(39) + '[0-9a-fA-F]{32}' + chr(39) + ')::INT)', 'guid_share')}, {r('avg(0)', 'name_share')} FROM customer")
def _(spark, read):
    p = P.profile(read("customer").select(F.md5("c_name").alias("g"), "c_name"))
    return rounded(p.agg(F.max(F.when(F.col("column") == "g", F.col("guid_share"))).alias("guid_share"), F.max(F.when(F.col("column") == "c_name", F.col("guid_share"))).alias("name_share")))


_MESSY = "CASE WHEN o_orderkey % 50 = 0 THEN 'na' WHEN o_orderkey % 97 = 0 THEN 'x' ELSE o_totalprice::VARCHAR END"


def _messy(read):
    k = F.col("o_orderkey")
    return read("orders").select(F.when(k % 50 == 0, "na").when(k % 97 == 0, "x").otherwise(F.col("o_totalprice").cast("string")).alias("v"))


@query("prof_numeric_like", f"SELECT {r('avg((TRY_CAST(v AS DOUBLE) IS NOT NULL)::INT)', 'number_share')} FROM (SELECT {_MESSY} AS v FROM orders)")
def _(spark, read):
    return rounded(P.profile(_messy(read)).select("number_share"))


@query("val_numeric", f"""SELECT count(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NULL AND lower(trim(v)) NOT IN ('', 'na', 'n/a', 'null', 'none', 'nan')) AS garbage,
count(*) FILTER (WHERE lower(trim(v)) IN ('', 'na', 'n/a', 'null', 'none', 'nan')) AS missing, count(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) <> round(TRY_CAST(v AS DOUBLE))) AS fractions FROM (SELECT {_MESSY} AS v FROM orders)""")
def _(spark, read):
    """Counts only: no value or row of the data leaves the validation."""
    from privloom.schema import numeric_violations

    return numeric_violations(_messy(read), "v")


@query("prof_datetime", """SELECT f AS format, share FROM (SELECT round(avg((try_strptime(s, '%Y-%m-%d') IS NOT NULL)::INT), 6) + 0.0 AS a, round(avg((try_strptime(s, '%m/%d/%Y') IS NOT NULL)::INT), 6) + 0.0 AS b, round(avg((try_strptime(s, '%Y/%m/%d') IS NOT NULL)::INT), 6) + 0.0 AS c
FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)), LATERAL (VALUES ('yyyy-MM-dd', a), ('MM/dd/yyyy', b), ('yyyy/MM/dd', c)) v(f, share)""")
def _(spark, read):
    s = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rounded(P.date_shares(read("orders").select(s.alias("s")), "s").filter(F.col("format").isin("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd")))


@query("prof_binary_dom", "SELECT count(DISTINCT v) = 2 AS two, min(v) = 0 AND max(v) = 1 AS zero_one FROM (SELECT (l_returnflag = 'R')::INT AS v FROM lineitem)")
def _(spark, read):
    p = P.profile(read("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("v")))
    return p.select((F.col("n_distinct") == 2).alias("two"), ((F.col("lo") == 0) & (F.col("hi") == 1)).alias("zero_one"))


@query("prof_small_int", "SELECT 'l_linenumber' AS \"column\", list(DISTINCT l_linenumber::VARCHAR ORDER BY l_linenumber::VARCHAR) AS categories FROM lineitem")
def _(spark, read):
    return P.levels(read("lineitem"), ["l_linenumber", "l_extendedprice"], 20)


@query("prof_categories", "SELECT 'p_brand' AS \"column\", list(DISTINCT p_brand ORDER BY p_brand) AS categories FROM part UNION ALL SELECT 'p_type', list(DISTINCT p_type ORDER BY p_type) FROM part HAVING count(DISTINCT p_type) <= 200")
def _(spark, read):
    return P.levels(read("part"), ["p_brand", "p_type", "p_name"], 200).filter(F.col("column") != "p_name")


@query("prof_bowley", f"SELECT {r('(q[3] + q[1] - 2 * q[2]) / (q[3] - q[1])', 'skew')} FROM (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)")
def _(spark, read):
    return rounded(P.bowley(read("lineitem"), "l_extendedprice"))


@query("prof_tau", "SELECT ceil(max(date_diff('day', DATE '1992-01-01', l_shipdate::DATE)))::BIGINT AS tau FROM lineitem")
def _(spark, read):
    from privloom.plans.base import survival

    return survival(read).agg(F.ceil(F.max("t")).alias("tau"))


_TYPED = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linenumber", "l_shipdate")


def _types_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS c, typeof(any_value({c})) AS t, count(DISTINCT {c}) AS d, count(TRY_CAST({c}::VARCHAR AS DOUBLE)) / count(*) AS s, min(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS lo, "
        f"max(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS hi, bool_and(abs(TRY_CAST({c}::VARCHAR AS DOUBLE) - round(TRY_CAST({c}::VARCHAR AS DOUBLE))) <= 1e-8 + 1e-5 * abs(round(TRY_CAST({c}::VARCHAR AS DOUBLE)))) AS w FROM lineitem"
        for c in _TYPED
    )
    return f"""SELECT c AS "column", CASE WHEN d <= 1 THEN 'constant' WHEN t LIKE 'TIMESTAMP%' OR t = 'DATE' THEN 'integer' WHEN s >= 0.95 AND w AND d = 2 THEN CASE WHEN lo = 0 AND hi = 1 THEN 'binary' ELSE 'categorical' END
WHEN s >= 0.95 AND w AND d <= 20 THEN 'ordinal' WHEN s >= 0.95 AND w THEN 'integer' WHEN s >= 0.95 THEN 'continuous' ELSE 'categorical' END AS type FROM ({each})"""


@query("prof_type_rules", _types_sql())
def _(spark, read):
    return P.column_types(read("lineitem").select(*_TYPED))


@query("prof_sensitivity", "SELECT 'l_quantity' AS \"column\", greatest(max(l_quantity) - min(l_quantity), 1) AS gamma FROM lineitem UNION ALL SELECT 'l_discount', 1.0 UNION ALL SELECT 'l_returnflag', 2.0")
def _(spark, read):
    df = read("lineitem").select("l_quantity", "l_discount", "l_returnflag")
    kinds = P.column_types(df)
    return P.profile(df).select("column", "lo", "hi").join(F.broadcast(kinds), "column").select("column", P.sensitivity(F.col("type"), F.col("lo"), F.col("hi")).alias("gamma"))


# ---- encoding

_QTY = E.Numeric.equal(1.0, 50.0, 7, nan_bin=True)
_Z = "greatest(least((nullif(l_quantity, 7) - 1.0) / 49.0, 1.0), 0.0)"


@query("enc_num_A", f"SELECT l_orderkey, l_linenumber, CASE WHEN nullif(l_quantity, 7) IS NULL THEN 7 ELSE {sql_bucket(_Z, _QTY.at, True)} END AS code FROM lineitem")
def _(spark, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", _QTY.encode(F.nullif(F.col("l_quantity"), F.lit(7.0))).alias("code"))


@query("enc_edges_A", """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT count(*) AS n, ((l_extendedprice - lo) / (hi - lo) >= (q[1] - lo) / (hi - lo))::INT + ((l_extendedprice - lo) / (hi - lo) >= (q[2] - lo) / (hi - lo))::INT + ((l_extendedprice - lo) / (hi - lo) >= (q[3] - lo) / (hi - lo))::INT AS code FROM lineitem, q GROUP BY code""")
def _(spark, read):
    df = read("lineitem")
    lo, hi = df.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    bins = E.quantile_bins(df, "l_extendedprice", lo, hi, 4)
    return df.groupBy(bins.encode(F.col("l_extendedprice")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


_SEG = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
_SEG_SQL = "list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'], {0})"


@query("enc_cat_A", f"SELECT c_custkey, (coalesce(nullif({_SEG_SQL.format('c_mktsegment')}, 0), 5) - 1)::INT AS code FROM customer")
def _(spark, read):
    return read("customer").select("c_custkey", E.encode_category(F.col("c_mktsegment"), _SEG).alias("code"))


@query("dec_cat_A", f"SELECT c_custkey, CASE WHEN {_SEG_SQL.format('c_mktsegment')} > 0 THEN c_mktsegment END AS label FROM customer")
def _(spark, read):
    return read("customer").select("c_custkey", E.decode_category(E.encode_category(F.col("c_mktsegment"), _SEG), _SEG).alias("label"))


@query("enc_uniform_B", f"SELECT c_custkey, {sql_bucket('greatest(least(c_acctbal, 9000), 0)', edges(0.0, 9000.0, 12), True)} AS code FROM customer")
def _(spark, read):
    return read("customer").select("c_custkey", E.uniform_bins(F.col("c_acctbal"), 0.0, 9000.0, 12).alias("code"))


@query("enc_C", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def _(spark, read):
    return E.label_encode(read("part").select("p_partkey", "p_brand"), "p_brand", "code").select("p_partkey", "code")


@query("enc_compress", """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, n >= 3.0 * 5 AS kept FROM c)
SELECT p_type, (CASE WHEN kept THEN row_number() OVER (ORDER BY kept::INT DESC, p_type) - 1 ELSE sum(kept::INT) OVER () END)::INT AS code FROM k""")
def _(spark, read):
    return E.compress(read("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "p_type", 5.0)


_U = "((('0x' || substr(md5('7|dec|' || l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("dec_num_A", f"""WITH c AS (SELECT l_orderkey, l_linenumber, {sql_bucket('(l_quantity - 1.0) / 49.0', _QTY.at, True)} AS code, {_U} AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('1.0 + (' + str(list(_QTY.at[:-1])) + '[code + 1]::DOUBLE + u * ' + str([b - a for a, b in zip(_QTY.at, _QTY.at[1:])]) + '[code + 1]::DOUBLE) * 49.0', 'value')} FROM c""")
def _(spark, read):
    u = hash_uniform("7", "dec", F.col("l_orderkey"), F.col("l_linenumber"))
    return rounded(read("lineitem").select("l_orderkey", "l_linenumber", _QTY.decode(_QTY.encode(F.col("l_quantity")), u).alias("value")))


@query("cst_to_numeric", f"SELECT count(TRY_CAST(v AS DOUBLE)) AS n, round(sum(TRY_CAST(v AS DOUBLE)), 2) + 0.0 AS total FROM (SELECT {_MESSY} AS v FROM orders)")
def _(spark, read):
    return rounded(_messy(read).select(number(F.col("v")).alias("x")).agg(F.count("x").alias("n"), F.sum("x").alias("total")), 2)


@query("cst_binary", "SELECT c_custkey, (coalesce(TRY_CAST(nullif(c_acctbal, c_acctbal) AS DOUBLE), c_acctbal / 10000) >= 0.5)::INT AS flag FROM customer")
def _(spark, read):
    return read("customer").select("c_custkey", E.binary(F.col("c_acctbal") / 10000).alias("flag"))


@query("cst_repair_cat", "SELECT p_partkey, CASE WHEN p_size IN (1, 5, 10) THEN (CASE p_size WHEN 1 THEN '1.0' WHEN 5 THEN '5' ELSE '10' END) ELSE '1.0' END AS size FROM part")
def _(spark, read):
    from privloom.functions import repair_category

    return read("part").select("p_partkey", repair_category(F.col("p_size"), ["1.0", "5", "10"]).alias("size"))


@query("nrm_output", """SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity = 7 THEN 0 ELSE round_even(greatest(least(l_quantity / 2, 20.0), 2.0), 0) END)::BIGINT AS quantity, greatest(least(l_discount, 0.08), 0.02) AS discount,
CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag ELSE 'A' END AS flag FROM lineitem""")
def _(spark, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", E.normalise(F.nullif(F.col("l_quantity"), F.lit(7.0)) / 2, "integer", 2, 20).alias("quantity"), E.normalise(F.col("l_discount"), "continuous", 0.02, 0.08).alias("discount"), E.normalise(F.col("l_returnflag"), "categorical", categories=["A", "R"]).alias("flag"))


@query("nrm_fit_B", "SELECT c_custkey, CASE WHEN s IS NULL THEN '__NAN__' WHEN s IN ('BUILDING', 'FURNITURE') THEN s ELSE 'BUILDING' END AS segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS s FROM customer)")
def _(spark, read):
    return read("customer").select("c_custkey", E.for_graphical(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), "categorical", ["BUILDING", "FURNITURE"], True).alias("segment"))


@query("nrm_fit_C", "SELECT c_custkey, CASE WHEN s IN ('BUILDING', 'FURNITURE') THEN s WHEN s IS NOT NULL THEN 'BUILDING' END AS segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS s FROM customer)")
def _(spark, read):
    return read("customer").select("c_custkey", E.for_network(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), "categorical", ["BUILDING", "FURNITURE"]).alias("segment"))


@query("clip_constraints", "SELECT l_orderkey, l_linenumber, greatest(least(l_quantity - 5, 40.0), 1.0) AS quantity FROM lineitem")
def _(spark, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", E.clip_to_constraints(F.col("l_quantity") - 5, -4, 45, maximum=40, above=0, integer=True).alias("quantity"))


@query("prj_reindex", "SELECT c_custkey, NULL::DOUBLE AS age, c_acctbal FROM customer")
def _(spark, read):
    return E.reindex(read("customer"), [("c_custkey", "long"), ("age", "double"), ("c_acctbal", "double")])


@query("val_data", """SELECT 'c_mktsegment' AS "column", count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')) AS undeclared, 0::BIGINT AS below, 0::BIGINT AS above, 0::BIGINT AS not_number FROM customer
UNION ALL SELECT 'c_acctbal', 0, count(*) FILTER (WHERE c_acctbal < 0), count(*) FILTER (WHERE c_acctbal > 9000), 0 FROM customer
UNION ALL SELECT 'c_nationkey', count(*) FILTER (WHERE c_nationkey NOT IN (0, 1, 2, 3)), 0, 0, 0 FROM customer""")
def _(spark, read):
    """Rules of a schema that the rows break, column by column."""
    schema = Schema({"c_mktsegment": "categorical", "c_acctbal": "continuous", "c_nationkey": "ordinal"}, {"c_acctbal": (0.0, 9000.0)}, categories={"c_mktsegment": ["BUILDING", "FURNITURE"], "c_nationkey": ["0", "1.0", "2", "3"]})
    return I.validate_rows(schema, read("customer")).drop("levels")


# ---- what private profiling measures, before noise

@query("dp_approx_bounds", """WITH e AS (SELECT i, CASE WHEN i < 32 THEN -(2.0 ** (31 - i)) WHEN i = 32 THEN 0 ELSE 2.0 ** (i - 33) END AS x FROM range(65) r(i)),
b AS (SELECT a.i, a.x AS lo, b.x AS hi FROM e a JOIN e b ON b.i = a.i + 1)
SELECT i::INT AS bucket, count(c_acctbal) AS n FROM b LEFT JOIN customer ON c_acctbal >= lo AND (c_acctbal < hi OR (c_acctbal = hi AND i = 63 AND false)) GROUP BY i""")
def _(spark, read):
    """Counts over signed powers of two, empty bins too: what the noisy bounds are read from."""
    return C.histogram(read("customer"), P.log_bucket(F.col("c_acctbal")), 64).withColumnRenamed("code", "bucket")


@query("dp_missing", f"SELECT 'v' AS \"column\", {r('avg((v IS NULL)::INT)', 'rate')}, {r('1.0 / count(*)', 'sensitivity')}, {r('1.0 / count(*) / (0.1 * 1.0)', 'scale')} FROM (SELECT nullif(l_linenumber, 3) AS v FROM lineitem)")
def _(spark, read):
    """Missing rates with the noise scale of a tenth of the budget: one row changes a rate by 1 / n."""
    df = read("lineitem").select(F.nullif(F.col("l_linenumber"), F.lit(3)).alias("v"))
    share = privacy.split_budget(1.0, 1)["missing"]
    return rounded(df.agg(F.avg(F.col("v").isNull().cast("int")).alias("rate"), (F.lit(1.0) / F.count("*")).alias("sensitivity")).select(F.lit("v").alias("column"), "rate", "sensitivity", (F.col("sensitivity") / F.lit(share)).alias("scale")))


@query("dp_nrecords", f"SELECT count(*) AS n, {r('1.0 / (0.05 * 1.0)', 'scale')} FROM orders")
def _(spark, read):
    """The record count with the noise scale of a twentieth of the budget."""
    return rounded(read("orders").agg(F.count("*").alias("n")).withColumn("scale", F.lit(1 / privacy.split_budget(1.0, 1)["n_records"])))


@query("dp_bounds_range", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {r(f'(max({c}) - min({c})) / (0.5 / 2)', 'scale')} FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, read):
    """Bounds with the scale of the noise that widens them, half of the budget for each end."""
    p = P.profile(read("lineitem").select("l_quantity", "l_extendedprice", "l_discount"))
    return rounded(p.select("column", "lo", "hi", ((F.col("hi") - F.col("lo")) / F.lit(0.5 / 2)).alias("scale")))


@query("dp_bowley", f"SELECT {r('q[1]', 'q1')}, {r('q[2]', 'q2')}, {r('q[3]', 'q3')}, n, {r('3 * (50.0 - 1.0) / n / 0.5', 'scale')} FROM (SELECT quantile_cont(greatest(least(l_quantity, 50.0), 1.0), [0.25, 0.5, 0.75]) AS q, count(l_quantity) AS n FROM lineitem)")
def _(spark, read):
    """Quartiles within public bounds and the scale of their noise, a third of the budget each."""
    one = quantiles(read("lineitem"), clip(F.col("l_quantity"), 1.0, 50.0), [0.25, 0.5, 0.75])
    return rounded(one.select(*[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)], "n", (F.lit(3 * 49.0 / 0.5) / F.col("n")).alias("scale")))


@query("enc_bins_auto", "SELECT o_orderstatus, ceil(least(greatest(2 * count(*) ** (1.0 / 3) / (1 + exp(-0.5)), 5), 40))::BIGINT AS bins FROM orders GROUP BY 1")
def _(spark, read):
    """Histogram bins of each group, damped by a budget of one half."""
    n = F.count("*").cast("double")
    damped = F.greatest(2 * F.pow(n, F.lit(1.0 / 3)) / F.lit(1 + math.exp(-0.5)), F.lit(5.0))
    return read("orders").groupBy("o_orderstatus").agg(F.ceil(F.least(damped, F.lit(40.0))).alias("bins"))


@query("temperature", f"WITH p AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1) SELECT v, {r('p ** (1 / 0.5) / sum(p ** (1 / 0.5)) OVER ()', 'p')} FROM p")
def _(spark, read):
    """Shares sharpened by a temperature of one half."""
    cells = read("orders").groupBy(F.col("o_orderpriority").alias("v")).agg(F.count("*").alias("n"))  # a row a value
    cells = cells.groupBy().agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("c"))
    power = F.transform("c", lambda x: F.pow(x["n"] / F.aggregate("c", F.lit(0.0), lambda s, y: s + y["n"]), F.lit(1 / 0.5)))
    out = cells.select("c", power.alias("w")).select(F.explode(F.arrays_zip("c", "w")).alias("e"), F.aggregate("w", F.lit(0.0), lambda s, y: s + y).alias("t"))
    return rounded(out.select(F.col("e.c.v").alias("v"), (F.col("e.w") / F.col("t")).alias("p")))


@query("prof_constraints", """SELECT 'l_quantity' AS "column", 'integer' AS type, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, NULL::VARCHAR[] AS allowed FROM lineitem
UNION ALL SELECT 'l_discount', 'continuous', min(l_discount), max(l_discount), NULL FROM lineitem UNION ALL SELECT 'l_returnflag', 'categorical', NULL, NULL, list_sort(list(DISTINCT l_returnflag)) FROM lineitem""")
def _(spark, read):
    """Column rules of the inferred document."""
    rules = I.infer(read("lineitem").select("l_quantity", "l_discount", "l_returnflag"))["constraints"]["column_constraints"]  # a rule a column
    rows = [(c, r["type"], r.get("min"), r.get("max"), r.get("allowed_values")) for c, r in rules.items()]
    return spark.createDataFrame(rows, "column string, type string, lo double, hi double, allowed array<string>")


_DATED = "(SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y.%m.%d') END AS b, o_orderpriority AS c FROM orders)"
_SCORES = " UNION ALL ".join(
    f"SELECT col, {i} AS place, '{f}' AS format, avg(CASE WHEN t IS NOT NULL THEN (try_strptime(t, '{f}') IS NOT NULL)::INT END) AS share, min(epoch(try_strptime(t, '{f}')))::BIGINT AS lo, max(epoch(try_strptime(t, '{f}')))::BIGINT AS hi FROM x GROUP BY col" for i, f in enumerate(DT.FORMATS))


@query("prof_dt_format", f"""WITH x AS (SELECT 'a' AS col, a AS t FROM {_DATED} UNION ALL SELECT 'b', nullif(b, 'n/a') FROM {_DATED} UNION ALL SELECT 'c', c FROM {_DATED}), s AS ({_SCORES})
SELECT col AS "column", format, round(share, 6) + 0.0 AS share, lo, hi FROM s WHERE share >= 0.8 QUALIFY row_number() OVER (PARTITION BY col ORDER BY share DESC, place) = 1""")
def _(spark, read):
    """The elected format of text columns, and the epochs that the elected ones hold."""
    d = F.to_date("o_orderdate")
    rows = read("orders").select(
        F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format(d, "dd/MM/yyyy")).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format(d, "yyyy.MM.dd")).alias("b"), F.col("o_orderpriority").alias("c"),
    )
    formats = DT.elect(rows)
    epochs = DT.to_epochs(rows, formats)
    ends = epochs.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(f).alias("format"), F.min(c).alias("lo"), F.max(c).alias("hi")) for c, f in formats.items()]).alias("a")).select(F.explode("a").alias("e")).select("e.*")
    return ends.join(F.broadcast(rounded(DT.date_scores(rows))), ["column", "format"])


@query("dp_measured", "SELECT 'c_acctbal' AS \"column\", min(c_acctbal) AS lo, max(c_acctbal) AS hi, " + ", ".join(r(f"quantile_cont(c_acctbal, {q})", n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))) + f", count(*) AS n, 0.0::DOUBLE AS missing FROM customer UNION ALL SELECT 'k', min(k), max(k), quantile_cont(k, 0.25), quantile_cont(k, 0.5), quantile_cont(k, 0.75), count(k), {r('avg((k IS NULL)::INT)', 'missing')} FROM (SELECT nullif(c_nationkey, 3)::DOUBLE AS k FROM customer)")
def _(spark, read):
    """All that a private schema document measures of two columns, before noise."""
    return rounded(PI.measured(read("customer").select("c_acctbal", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k")), ["c_acctbal", "k"]))


@query("val_range", "SELECT 'c_acctbal' AS \"column\", round((max(c_acctbal) - min(c_acctbal)) / 100000, 6) + 0.0 AS used, true AS numbers FROM customer UNION ALL SELECT 'p', round((max(c_custkey) - min(c_custkey)) / 5000000.0, 6) + 0.0, false FROM customer")
def _(spark, read):
    """How much of their declared ranges two columns use, one of them kept as text."""
    schema = Schema({"c_acctbal": "continuous", "p": "integer"}, {"c_acctbal": (-50000.0, 50000.0), "p": (0.0, 5000000.0)})
    return rounded(I.range_use(schema, read("customer").select("c_acctbal", F.col("c_custkey").cast("string").alias("p"))))
