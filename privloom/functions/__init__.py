"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value: fixed values.
MISSING_TOKENS = ("", "na", "n/a", "null", "none", "nan")
#: A GUID of versions 1 to 5 with hyphens; also in braces, as urn, or as 32 digits.
_HYPHENATED = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
GUID = rf"^(?:{_HYPHENATED}|\{{{_HYPHENATED}\}}|urn:uuid:{_HYPHENATED}|[0-9a-fA-F]{{32}})$"


def number(c: Column) -> Column:
    """As double; what isn't a finite-or-infinite number (also the text ``nan``) is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING_TOKENS)


def value_counts(df: DataFrame, names: Sequence[str], of: Callable[[str], Column]) -> DataFrame:
    """(i, v, n): of each of the columns, by its place, how many rows have each text ``of`` it, nulls included."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), of(c).alias("v")) for i, c in enumerate(names)]))
    return df.select(each.alias("e")).select("e.*").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Between the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def edges(lo: float, hi: float, n: int) -> list[float]:
    """n + 1 equally spaced bin edges, worked out once so that every engine compares against the same numbers."""
    return [lo + (hi - lo) * i / n for i in range(n)] + [hi]


def bucket(x: Column, at: Sequence[float], clamp: bool = False) -> Column:
    """Index of the left-closed bin of ``at`` (sorted edges), the last also right-closed; null outside unless ``clamp``."""
    inner = F.lit(0)
    for e in at[1:-1]:
        inner = inner + (x >= F.lit(float(e))).cast("int")
    if clamp:
        return F.when(x.isNotNull(), inner)
    return F.when((x >= F.lit(float(at[0]))) & (x <= F.lit(float(at[-1]))), inner)


def hash_uniform(seed: str, tag: str, *key: Column) -> Column:
    """A number in (0, 1) from a key: the same on any partitioning. For tests and reproducible sampling, never for privacy noise."""
    text = F.concat_ws("|", F.lit(seed), F.lit(tag), *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def laplace_from(u: Column, scale: float) -> Column:
    """Laplace noise by the inverse distribution function."""
    return F.when(u < 0.5, F.lit(scale) * F.log(2 * u)).otherwise(F.lit(-scale) * F.log(2 * (1 - u)))


def cat_code(c: Column, categories: Sequence[str], default: int | None = None) -> Column:
    """Position of the text in ``categories`` from 0; ``default`` for another one or null."""
    at = F.array_position(F.array(*[F.lit(str(x)) for x in categories]), c.cast("string")).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.lit(default).cast("int"))


def repair_category(c: Column, categories: Sequence[str]) -> Column:
    """The category equal as text, else equal as number, else the first."""
    text, value = c.cast("string"), number(c.cast("string"))
    out = F.when(text.isin(*map(str, categories)), text)
    for x in categories:
        try:
            out = out.when(value == float(x), F.lit(str(x)))
        except ValueError:
            continue
    return out.otherwise(F.lit(str(categories[0])))
