"""Readers and writers: delimited files with a sniffed separator, result files by name pattern, schema-conforming random tables, models."""

from __future__ import annotations

import csv
import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.functions import hash_uniform
from privloom.operators.network import Network
from privloom.schema import Schema

SEPARATORS = ",;\t|"
#: Name of a run's table: implementation, budget, seed.
RUN = r"([^/]+)_eps([0-9.]+)_seed([0-9]+)\.csv$"


def sniff(spark: SparkSession, path: str, lines: int = 50) -> str:
    """The separator of a delimited file, from its first lines; a comma if that can't be told."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(lines).collect())[:8192]
    try:
        return csv.Sniffer().sniff(head, SEPARATORS).delimiter
    except csv.Error:
        return ","


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A CSV file with a header (types inferred without a schema) or Parquet."""
    if str(path).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("sep", sniff(spark, path))
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_runs(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """All runs' tables that a path pattern names, with the implementation, epsilon and seed of their names."""
    name = F.input_file_name()
    df = spark.read.option("header", True).schema(schema).csv(pattern)
    return df.withColumns({"implementation": F.regexp_extract(name, RUN, 1), "epsilon": F.regexp_extract(name, RUN, 2).cast("double"), "seed": F.regexp_extract(name, RUN, 3).cast("int")})


def write_runs(df: DataFrame, path: str) -> None:
    """A table with implementation, epsilon and seed as partitions: readers of some of them skip the rest."""
    df.write.mode("overwrite").partitionBy("implementation", "epsilon", "seed").parquet(path)


def uniform_rows(spark: SparkSession, sizes: dict[str, int], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of independent uniform codes."""
    return spark.range(n).select("id", *[F.least(F.floor(F.rand(seed + i) * k), F.lit(k - 1)).cast("int").alias(c) for i, (c, k) in enumerate(sizes.items())])


def dummy_rows(spark: SparkSession, schema: Schema, n: int, seed: str = "dummy", missing: dict[str, float] | None = None) -> DataFrame:
    """``n`` random rows that a schema allows; a survival time depends on its event; nulls by rate.

    Hash uniforms of the row number, so the same rows come out on any partitioning.
    """
    pair = schema.survival_pair()
    rows = spark.range(n)
    out = {}
    for name, kind in schema.kinds.items():
        u = hash_uniform(seed, name, F.col("id"))
        if kind == "binary":
            value = (u < 0.5).cast("int")
        elif schema.categories.get(name):
            labels = schema.categories[name]
            value = F.get(F.array(*[F.lit(x) for x in labels]), F.floor(u * len(labels)).cast("int"))
        else:
            lo, hi = schema.bounds[name]
            if pair and name == pair[1]:
                event = hash_uniform(seed, pair[0], F.col("id")) < 0.5
                hi_of = F.when(event, F.lit(float(schema.target.get("tau", hi)))).otherwise(F.lit(float(hi)))
                value = F.lit(lo) + u * (hi_of - lo)
            else:
                value = F.lit(lo) + u * (hi - lo)
            if kind in ("integer", "ordinal"):
                value = F.least(F.floor(F.lit(lo) + u * (hi - lo + 1)), F.lit(math.floor(hi))).cast("long") if not (pair and name == pair[1]) else F.rint(value).cast("long")
        rate = (missing or {}).get(name, 0.0)
        out[name] = F.when(hash_uniform(seed, f"{name}|null", F.col("id")) >= rate, value) if rate else value
    return rows.select("id", *[v.alias(k) for k, v in out.items()])


def clean(value):
    """For JSON: not-a-number and infinities become null, throughout."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_model(spark: SparkSession, net: Network, path: str) -> None:
    """A network as two tables: its columns with sizes and parents, and the cells of its conditional tables."""
    spark.createDataFrame([(i, c, net.sizes[c], net.parents[c]) for i, c in enumerate(net.order)], "place int, column string, size int, parents array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    cells = [(c, k, list(map(float, row))) for c, t in net.tables.items() for k, row in enumerate(t)]
    spark.createDataFrame(cells, "column string, key long, probabilities array<double>").write.mode("overwrite").parquet(f"{path}/tables")


def read_model(spark: SparkSession, path: str) -> Network:
    import numpy as np

    columns = spark.read.parquet(f"{path}/columns").orderBy("place").collect()
    net = Network([r.column for r in columns], {r.column: r["size"] for r in columns}, {r.column: list(r.parents) for r in columns})
    cells = spark.read.parquet(f"{path}/tables").orderBy("column", "key").collect()
    for c in net.order:
        net.tables[c] = np.array([r.probabilities for r in cells if r.column == c])
    return net


def latex_table(df: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    """The rows of a small result as a LaTeX tabular."""
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = "\n".join(" & ".join(cell(r[c]) for c in columns) + r" \\" for r in df.select(*columns).toLocalIterator())
    return "\\begin{tabular}{" + "l" * len(columns) + "}\n" + " & ".join(c.replace("_", r"\_") for c in columns) + " \\\\\n\\hline\n" + body + "\n\\end{tabular}\n"


def markdown_table(df: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).toLocalIterator()]]) + "\n"


def dump(value, indent: int = 2) -> str:
    return json.dumps(clean(value), indent=indent, default=str)
