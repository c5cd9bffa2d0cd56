"""How queries are registered, the derived tables they share, and small SQL builders for their oracles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a function (spark, read) under ``name``; ``read(table)`` gives a table of the folder."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; minus zero becomes zero."""
    return df.select(*[(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def r(sql: str, name: str) -> str:
    return f"round({sql}, {DIGITS}) + 0.0 AS {name}"


def halves(read, columns: Sequence[str], table: str = "lineitem", key: str = "l_orderkey") -> DataFrame:
    """Both sides of a comparison: even keys as side 0 (real), odd as side 1 (synthetic)."""
    return read(table).select((F.col(key) % 2).cast("int").alias("side"), *columns)


SURVIVAL_SQL = "SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS t, (l_returnflag = 'R')::INT AS e, (l_orderkey % 2)::INT AS side, l_linestatus AS stratum, l_quantity AS risk FROM lineitem"


def survival(read) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double")
    return read("lineitem").select(day.alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"), (F.col("l_orderkey") % 2).cast("int").alias("side"), F.col("l_linestatus").alias("stratum"), F.col("l_quantity").alias("risk"))


def sql_bucket(x: str, at: Sequence[float], clamp: bool = False) -> str:
    inner = " + ".join(["0"] + [f"({x} >= {e!r}::DOUBLE)::INT" for e in at[1:-1]])
    return f"({inner})" if clamp else f"(CASE WHEN {x} >= {at[0]!r}::DOUBLE AND {x} <= {at[-1]!r}::DOUBLE THEN {inner} END)"
