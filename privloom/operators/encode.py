"""Encoders, decoders and coercions, as expressions over columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.functions import bucket, cat_code, clip, edges, number, repair_category
from privloom.operators.prefix import quantiles, scan

UNKNOWN, NO_VALUE = "__UNK__", "__NAN__"


@dataclass(frozen=True)
class Numeric:
    """Bins of a number column on [0, 1] of its bounds; ``nan_bin`` adds a code for nulls."""

    lo: float
    hi: float
    at: tuple[float, ...]
    nan_bin: bool = False

    @classmethod
    def equal(cls, lo: float, hi: float, n: int, nan_bin: bool = False) -> "Numeric":
        return cls(lo, hi, tuple(edges(0.0, 1.0, n)), nan_bin)

    @property
    def size(self) -> int:
        return len(self.at) - 1 + self.nan_bin

    def encode(self, c: Column) -> Column:
        """The bin's index; a null gets the extra code, or the middle without one. The upper bound is in the last bin."""
        x = number(c)
        z = F.greatest(F.least((x - self.lo) / (self.hi - self.lo), F.lit(1.0)), F.lit(0.0))
        code = bucket(F.coalesce(z, F.lit(0.5)), self.at, clamp=True)
        return F.when(x.isNull(), F.lit(len(self.at) - 1)).otherwise(code) if self.nan_bin else code

    def decode(self, code: Column, u: Column, integer: bool = False) -> Column:
        """A value in the bin, by the uniform ``u``; null for the extra code."""
        low, width = F.array(*map(F.lit, self.at[:-1])), F.array(*[F.lit(b - a) for a, b in zip(self.at, self.at[1:])])
        z = F.get(low, code) + u * F.get(width, code)
        x = F.lit(self.lo) + z * (self.hi - self.lo)
        x = F.rint(x) if integer else x
        return F.when(code < len(self.at) - 1, x)


def merged_intervals(intervals: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted intervals without overlaps; those that touch are one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def complement(lo: float, hi: float, holes: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """What merged ``holes`` leave of [lo, hi], pieces of no width left out."""
    out, at = [], lo
    for a, b in holes:
        if b > lo and a < hi:
            if a > at:
                out.append((at, a))
            at = max(at, b)
    return [*out, (at, hi)] if at < hi else out


@dataclass(frozen=True)
class Holed:
    """Bins of a number column at ``at`` where values inside the intervals ``zeros`` can't occur (structural zeros)."""

    at: tuple[float, ...]
    zeros: tuple[tuple[float, float], ...] = ()

    @classmethod
    def of(cls, at: Sequence[float], zeros: Sequence[tuple[float, float]] = ()) -> "Holed":
        return cls(tuple(map(float, at)), tuple(merged_intervals(zeros)))

    def pieces(self) -> list[list[tuple[float, float]]]:
        """Of each bin what the zeros leave."""
        return [complement(a, b, self.zeros) for a, b in zip(self.at, self.at[1:])]

    def zero_codes(self) -> list[int]:
        """Bins of which nothing is left."""
        return [i for i, p in enumerate(self.pieces()) if not p]

    def encode(self, x: Column) -> Column:
        """The bin of a number, left-closed, those outside in the first and last; null for null."""
        return bucket(clip(number(x), self.at[0], self.at[-1]), self.at, clamp=True)

    def decode(self, code: Column, u: Column) -> Column:
        """A value drawn evenly from what is left of the bin, by the uniform ``u``; null for null and for a bin of which nothing is left."""
        value = F.lit(None).cast("double")
        for i, pieces in reversed(list(enumerate(self.pieces()))):
            width, here, before = sum(b - a for a, b in pieces), F.lit(None).cast("double"), sum(b - a for a, b in pieces)
            for a, b in reversed(pieces):
                before -= b - a
                here = F.when((u * width >= before) & (u * width < before + (b - a)), F.lit(a) + (u * width - before)).otherwise(here)
            value = F.when(code == i, here).otherwise(value)
        return value


def quantile_bins(df: DataFrame, column: str, lo: float, hi: float, n: int) -> Numeric:
    """Bins at the column's quantiles (repeated ones merge)."""
    at = (quantiles(df, number(F.col(column)), [i / n for i in range(1, n)]).first().q if n > 1 else None) or []
    inner = sorted({(x - lo) / (hi - lo) for x in at if lo < x < hi})
    return Numeric(lo, hi, (0.0, *inner, 1.0))


def encode_category(c: Column, categories: Sequence[str], unknown: bool = True) -> Column:
    """Index of the category; null and others get the index after the last if ``unknown``, else the first's."""
    return cat_code(c, categories, len(categories) if unknown else 0)


def decode_category(code: Column, categories: Sequence[str]) -> Column:
    """The label, null for a code past the last."""
    return F.get(F.array(*[F.lit(str(x)) for x in categories]), code)


def uniform_bins(c: Column, lo: float, hi: float, n: int) -> Column:
    """Left-closed equal bins, values outside in the first and last; null stays null."""
    return bucket(clip(number(c), lo, hi), edges(lo, hi, n), clamp=True)


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with codes from 0 by the sorted distinct values; the dictionary is shuffled, or broadcast if Spark finds it small."""
    values = df.select(column).dropna().distinct()
    codes = scan(values, column, {"__place": F.lit(1)}).select(column, (F.col("__place") - 1).cast("int").alias(name))
    return df.join(codes, column, "left")


def compress(counts: DataFrame, column: str, sigma: float, times: float = 3.0) -> DataFrame:
    """(column, code): levels with a count of ``times`` sigma or more keep a code of their own, by value; the rest share the next."""
    kept = F.col("n") >= times * sigma
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(kept.cast("int")), column)
    total = F.sum(kept.cast("int")).over(Window.partitionBy(F.lit(1)))
    return counts.select(column, F.when(kept, F.row_number().over(w) - 1).otherwise(total).cast("int").alias("code"))


def binary(c: Column) -> Column:
    return F.when(F.coalesce(number(c), F.lit(0.0)) >= 0.5, 1).otherwise(0)


def normalise(column: Column, kind: str, lo: float = 0.0, hi: float = 1.0, categories: Sequence[str] = ()) -> Column:
    """What the evaluation compares: clipped numbers (whole ones rounded half to even, null as 0), 0/1, repaired categories."""
    if kind == "continuous":
        return clip(number(column), lo, hi)
    if kind == "integer":
        return F.coalesce(F.rint(clip(number(column), lo, hi)), F.lit(0.0)).cast("long")
    return binary(column) if kind == "binary" else repair_category(column, categories)


def for_graphical(column: Column, kind: str, categories: Sequence[str] = (), nan_bin: bool = False) -> Column:
    """Fit-time coercion: numbers keep nulls; categories outside the domain are repaired, nulls become a level of their own or the first."""
    if kind in ("continuous", "integer"):
        return number(column)
    missing = F.lit(NO_VALUE if nan_bin else str(categories[0]))
    return F.when(column.isNull(), missing).otherwise(repair_category(column, categories))


def for_network(column: Column, kind: str, categories: Sequence[str] = ()) -> Column:
    """Fit-time coercion that preserves nulls."""
    if kind in ("continuous", "integer"):
        return number(column)
    return F.when(column.isNotNull(), binary(column).cast("string") if kind == "binary" else repair_category(column, categories))


def clip_to_constraints(x: Column, lo: float, hi: float, minimum: float | None = None, maximum: float | None = None, above: float | None = None, below: float | None = None, integer: bool = False) -> Column:
    """Within the bounds and constraints; an exclusive one is kept off by 1 for whole numbers, else by 1e-9."""
    off = 1.0 if integer else 1e-9
    low = max([lo, *([minimum] if minimum is not None else []), *([above + off] if above is not None else [])])
    high = min([hi, *([maximum] if maximum is not None else []), *([below - off] if below is not None else [])])
    return clip(x, low, high)


def reindex(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly these (name, type): others are dropped, missing ones are null."""
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in columns])
