"""Schema inference: one aggregation over all columns, then plain rules on its single row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privloom.functions import GUID, number, value_counts
from privloom.operators.prefix import quantiles

#: Date formats tried in order: fixed values.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def measures(name: str, kind: T.DataType) -> dict[str, Column]:
    """What the rules need of one column, but for distinct values. Numbers are not spelled out to be parsed again."""
    c, text = _q(name), _q(name).cast("string")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        x = F.when(~F.isnan(x), x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x
    elif isinstance(kind, T.StringType):
        x = number(text)
    else:
        x = F.lit(None).cast("double")
    finite = F.when(F.abs(x) != float("inf"), x)
    whole = F.abs(finite - F.rint(finite)) <= 1e-8 + 1e-5 * F.abs(F.rint(finite))
    # a number is no GUID unless it has 32 digits, which of numbers only decimals can have
    guid = F.trim(text).rlike(GUID) if isinstance(kind, (T.StringType, T.DecimalType)) else F.lit(False)
    return {
        "missing": F.avg(c.isNull().cast("int")),
        "guid_share": F.avg(F.when(c.isNotNull(), guid.cast("int"))),
        "number_share": F.avg(x.isNotNull().cast("int")),
        "lo": F.min(finite), "hi": F.max(finite),
        "integer_like": F.min(whole.cast("int")),
    }


def _by_column(df: DataFrame, names: Sequence[str], of) -> DataFrame:
    structs = [F.struct(F.lit(n).alias("column"), *[v.alias(k) for k, v in of(n).items()]).alias(f"c{i}") for i, n in enumerate(names)]
    return df.agg(*structs).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("m")).select("m.*")


def _by_value(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The profile of text columns: each different text is judged once, as a text that is no number costs the most to parse."""
    cells = value_counts(df, names, _q)
    x = number(F.col("v"))
    cells = cells.withColumns({"finite": F.when(F.abs(x) < float("inf"), x), "number": F.when(x.isNotNull(), F.col("n")).otherwise(0), "guid": F.when(F.trim("v").rlike(GUID), F.col("n")).otherwise(0)})
    f, held = F.col("finite"), F.col("v").isNotNull()
    some = F.sum(F.when(held, F.col("n")))
    one = cells.groupBy("i").agg(
        (F.sum(F.when(held, 0).otherwise(F.col("n"))) / F.sum("n")).alias("missing"), F.count("v").alias("n_distinct"), (F.sum(F.when(held, F.col("guid"))) / some).alias("guid_share"),
        (F.sum("number") / F.sum("n")).alias("number_share"), F.min("finite").alias("lo"), F.max("finite").alias("hi"),
        F.min((F.abs(f - F.rint(f)) <= 1e-8 + 1e-5 * F.abs(F.rint(f))).cast("int")).alias("integer_like"),
    )
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("__i"), F.get(F.array(*map(F.lit, names)), F.col("id").cast("int")).alias("column"))
    one = every.join(F.broadcast(one), F.col("__i") == F.col("i"), "left")  # a row a column, also without rows
    return one.select("column", "missing", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "guid_share", "number_share", "lo", "hi", "integer_like")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a column: missing share, distinct values, GUID and number shares, finite bounds, whether all numbers are whole.

    Distinct values are an aggregation of their own: beside the others each row would be copied for every column with all they need.
    """
    names = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [n for n in names if kinds[n] == T.StringType()]
    rest = [n for n in names if n not in texts]
    if texts and not rest:
        return _by_value(df, texts)
    plain = _by_column(df, rest, lambda n: measures(n, kinds[n]))
    distinct = _by_column(df.select(*[_q(n) for n in rest]), rest, lambda n: {"n_distinct": F.count_distinct(_q(n))})
    out = plain.join(F.broadcast(distinct), "column")  # a row a column
    out = out.select("column", "missing", "n_distinct", "guid_share", "number_share", "lo", "hi", "integer_like")
    return out.unionByName(_by_value(df, texts)) if texts else out


def bounds(lo: Column, hi: Column, pad: float, integer: bool) -> tuple[Column, Column]:
    """Padded bounds: by the share ``pad`` of the span (a zero span: of the value, 1 at least); none: 0 to 1."""
    span = hi - lo
    by = F.when(span > 0, span * pad).otherwise(F.greatest(F.abs(lo) * pad, F.lit(1.0)) if pad > 0 else F.lit(0.0))
    low, high = F.coalesce(lo - by, F.lit(0.0)), F.coalesce(hi + by, F.lit(1.0))
    return (F.floor(low).cast("double"), F.ceil(high).cast("double")) if integer else (low, high)


def log_bucket(x: Column, n: int = 32) -> Column:
    """The bin of a value among -2^(n-1) ... -1, 0, 1 ... 2^(n-1); null outside. Each bin holds its lower edge."""
    size = F.abs(x)
    up = F.when(size < 1, 0).otherwise(F.floor(F.log2(size)).cast("int") + 1)  # between powers of two
    exact = F.pow(F.lit(2.0), (up - 1).cast("double")) == size
    down = F.when(size <= 1, 0).otherwise(F.when(exact, up - 1).otherwise(up))
    at = F.when(x >= 0, F.lit(n) + up).otherwise(F.lit(n - 1) - down)
    return F.when((at >= 0) & (at < 2 * n), at)


def levels(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """(column, categories): sorted distinct texts of the columns that have ``most`` or fewer."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("v")) for c in columns])).alias("e")).select("e.*")
    counts = values.filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= most)
    return counts.join(F.broadcast(few), "column").groupBy("column").agg(F.sort_array(F.collect_list("v")).alias("categories"))


def date_shares(df: DataFrame, column: str) -> DataFrame:
    """(format, share): of the rows that aren't null, how many parse; the first format with the largest share is the column's."""
    text = F.trim(_q(column).cast("string"))
    shares = [F.avg(F.when(text.isNotNull(), F.try_to_timestamp(text, F.lit(f)).isNotNull().cast("int"))).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)]
    one = df.agg(*shares)
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"f{i}").alias("share")) for i, f in enumerate(DATE_FORMATS)])).alias("e")).select("e.*")


def bowley(df: DataFrame, column: str) -> DataFrame:
    """One row (skew): quartile skewness, 0 with fewer than four values or hardly any spread."""
    x = number(_q(column))
    one = quantiles(df, x, [0.25, 0.5, 0.75])
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    return one.select(F.when((F.col("n") >= 4) & (q3 - q1 >= 1e-10), (q3 + q1 - 2 * q2) / (q3 - q1)).otherwise(0.0).alias("skew"))


def optimal_bins(n: int, epsilon: float | None = None, most: int | None = None) -> int:
    """Bins of a histogram of ``n`` rows: 2 n^(1/3), damped by the logistic of epsilon (five at least), and ``most`` at most."""
    bins = 2 * n ** (1 / 3)
    bins = bins if epsilon is None else max(bins / (1 + math.exp(-epsilon)), 5)
    return math.ceil(bins if most is None else min(bins, most))


def sturges(n: int, cap: int) -> int:
    return max(5, min(math.ceil(math.log2(max(n, 1)) + 1), cap))


def auto_cap(n: int, ceiling: int = 20) -> int:
    n = max(n, 1)
    return min(max(math.ceil(math.log2(n) + 1), math.ceil(n ** (1 / 3) - 1e-12), 5), ceiling)


def max_parents(n: int, bins: int) -> int:
    """The fewest parents (five at most) whose cells reach the number of rows; else three."""
    return next((k for k in range(1, 6) if bins**k >= n), 3)


def perks(cells: int) -> float:
    return round(1 / max(cells, 1), 6)


def column_types(df: DataFrame, max_levels: int = 20, max_categories: int = 200, guid_share: float = 0.95) -> DataFrame:
    """(column, type): the logical type that the rules give to each column.

    In this order: guid, constant (both excluded from the model), binary, ordinal or categorical for few whole levels, integer, continuous,
    timestamp as integer, else categorical.
    """
    return types_of(df, profile(df), max_levels, guid_share)


#: Columns of ``profile``.
PROFILE = "column string, missing double, n_distinct long, guid_share double, number_share double, lo double, hi double, integer_like int"


def types_of(df: DataFrame, p: DataFrame, max_levels: int = 20, guid_share: float = 0.95) -> DataFrame:
    """``column_types`` of a profile that is there already."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stamps = [n for n, k in kinds.items() if isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    flags = [n for n, k in kinds.items() if isinstance(k, T.BooleanType)]
    numeric = F.col("number_share") >= 0.95
    whole = F.col("integer_like") == 1
    kind = (
        F.when(F.col("guid_share") >= guid_share, "guid").when(F.col("n_distinct") <= 1, "constant")
        .when(F.col("column").isin(flags), "binary").when(F.col("column").isin(stamps), "integer")
        .when(numeric & whole & (F.col("n_distinct") == 2), F.when((F.col("lo") == 0) & (F.col("hi") == 1), "binary").otherwise("categorical"))
        .when(numeric & whole & (F.col("n_distinct") <= max_levels), "ordinal")
        .when(numeric & whole, "integer").when(numeric, "continuous").otherwise("categorical")
    )
    return p.select("column", kind.alias("type"))


def sensitivity(kind: Column, lo: Column, hi: Column) -> Column:
    """How much one row can change the column: 1 for binary, 2 for categorical, else the span, 1 at least."""
    return F.when(kind == "binary", 1.0).when(kind == "categorical", 2.0).otherwise(F.greatest(F.coalesce(hi - lo, F.lit(1.0)), F.lit(1.0)))
