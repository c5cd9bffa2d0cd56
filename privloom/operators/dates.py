"""Text columns that are dates: the format of each by one pass over all, their epochs, and the format that output keeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privloom.functions import MISSING_TOKENS, value_counts

# Output formats in the order in which they are tried, and the same in Spark's letters.
FORMATS = {
    "%Y-%m-%d %H:%M:%S": "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d": "yyyy-MM-dd", "%d/%m/%Y %H:%M": "dd/MM/yyyy HH:mm", "%d/%m/%Y": "dd/MM/yyyy",
    "%m-%d-%Y %H:%M": "MM-dd-yyyy HH:mm", "%m-%d-%Y": "MM-dd-yyyy", "%Y/%m/%dT%H:%M:%SZ": "yyyy/MM/dd'T'HH:mm:ss'Z'", "%Y/%m/%d %H:%M:%S": "yyyy/MM/dd HH:mm:ss",
    "%Y/%m/%d": "yyyy/MM/dd", "%Y.%m.%d %H:%M:%S": "yyyy.MM.dd HH:mm:ss", "%Y.%m.%d": "yyyy.MM.dd", "%Y-%m-%dT%H:%M:%S": "yyyy-MM-dd'T'HH:mm:ss", "%m/%d/%Y": "MM/dd/yyyy",
}
#: The format of columns that are timestamps already.
DEFAULT = "%Y-%m-%dT%H:%M:%S"


def _text(name: str) -> Column:
    """The trimmed text; null for missing values and tokens."""
    text = F.trim(F.col(f"`{name}`"))
    return F.when(~F.lower(text).isin(*MISSING_TOKENS), text)


def date_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, format, share): of the text columns' values that aren't missing, how many parse by each format. Each different text is parsed once, as
    a text that is no date costs the most. Shares of a column without values are null."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, format string, share double")
    texts = value_counts(df, names, _text).filter(F.col("v").isNotNull())
    parsed = [F.sum(F.when(F.try_to_timestamp(F.col("v"), F.lit(java)).isNotNull(), F.col("n")).otherwise(0)).alias(f"s{j}") for j, java in enumerate(FORMATS.values())]
    found = texts.groupBy("i").agg(F.sum("n").alias("n"), *parsed)  # a row a column
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("__i"))
    joined = every.join(F.broadcast(found), F.col("__i") == F.col("i"), "left")
    rows = [F.struct(F.lit(f).alias("format"), (F.col(f"s{j}") / F.col("n")).alias("share")) for j, f in enumerate(FORMATS)]
    column = F.get(F.array(*map(F.lit, names)), F.col("__i"))
    return joined.select(column.alias("column"), F.explode(F.array(*rows)).alias("r")).select("column", "r.*")


def elect(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.8) -> dict[str, str]:
    """The format of each text column of which a share of ``least`` or more are dates: the one by which most parse, the first of equals."""
    best: dict[str, tuple[float, int, str]] = {}
    place = {f: i for i, f in enumerate(FORMATS)}
    for r in date_scores(df, columns).collect():  # a row a column and format
        if r.share is not None and r.share >= least:
            best[r.column] = max(best.get(r.column, (-1.0, 0, "")), (r.share, -place[r.format], r.format))
    return {c: f for c, (_, _, f) in best.items()}


def to_epochs(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """``df`` with the elected columns as seconds since 1970 in UTC-like session time; what doesn't parse is null."""
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(_text(c), F.lit(FORMATS[formats[c]])))
    return df.select(*[(seconds(c) if c in formats else F.col(f"`{c}`")).alias(c) for c in df.columns])


def from_epochs(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """The columns as text again, each in its format."""
    text = lambda c: F.date_format(F.timestamp_seconds(F.col(f"`{c}`").cast("double")), FORMATS[formats[c]])
    return df.select(*[(text(c) if c in formats else F.col(f"`{c}`")).alias(c) for c in df.columns])
