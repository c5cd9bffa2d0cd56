"""From a table to its schema document: types, bounds, categories, target, hints, provenance and constraints in one call.

The table is read by aggregations; what they give is a row for each column, and the rules on it are plain Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import deepcopy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privloom.functions import MISSING_TOKENS, number
from privloom.operators import dates as D
from privloom.operators import profile as P
from privloom.schema import DISCRETE, NUMERIC, Schema

#: Column names that tell a target or a time, the likelier first: fixed values.
TARGET_NAMES = ("target", "label", "class", "outcome", "income", "event", "status", "died", "death", "recurrence", "arrest", "failure", "relapse", "deceased", "censored")
TIME_NAMES = ("time", "duration", "survival_time", "follow_up", "days", "weeks", "months", "time_to_event", "week")
#: The mechanism that suits a type, as a hint: fixed values.
MECHANISMS = {"binary": "exponential", "categorical": "exponential", "ordinal": "laplace", "integer": "laplace", "continuous": "gaussian"}


def named(columns: Sequence[str], names: Sequence[str], but: str | None = None) -> str | None:
    """The column whose lower-cased name is the earliest of ``names``; a column ``but`` is passed over."""
    by_name = {c.lower(): c for c in reversed(list(columns))}
    return next((by_name[n] for n in names if n in by_name and by_name[n] != but), None)


def target_of(columns: Sequence[str], targets: Sequence[str] | None = None, survival: bool = False) -> dict | None:
    """The target's description. Without ``targets`` names decide; a survival pair is (event, time)."""
    if targets is None:
        event = named(columns, TARGET_NAMES)
        time = named(columns, TIME_NAMES, event) if survival else None
        targets = [t for t in (event, time) if t]
    if not targets:
        return None
    if survival and len(targets) >= 2:
        return {"targets": list(targets[:2]), "kind": "survival_pair", "primary_target": targets[0], "dtypes": {targets[0]: "binary", targets[1]: "continuous"}}
    return {"targets": list(targets), "kind": "single" if len(targets) == 1 else "multi_target", "primary_target": targets[0]}


def pair_of(target: dict | None) -> tuple[str, str] | None:
    return tuple(target["targets"][:2]) if target and target.get("kind") == "survival_pair" else None


def mechanism_hints(kinds: dict[str, str], target: dict | None = None) -> dict[str, str]:
    """A mechanism for each column; an event is chosen from two values and a time is a positive number, whatever their types say."""
    hints = {c: MECHANISMS.get(k, "laplace") for c, k in kinds.items()}
    pair = pair_of(target)
    return hints | {c: m for c, m in zip(pair, ("exponential", "laplace")) if c in hints} if pair else hints


def provenance(kinds: dict[str, str], inferred: set[str], spent: dict[str, float] | None = None, unprotected: set[str] = frozenset()) -> dict[str, dict]:
    """Where each column's domain comes from. ``spent`` (a private schema's budget by column, else None): inferred domains are private
    with what they cost, those read without a mechanism are marked as not private."""
    out = {}
    for c in kinds:
        if spent is not None and c in unprotected:
            out[c] = {"source": "non_private_auxiliary", "warning": "The domain was read from the rows without a private mechanism; declare it, or release it by one."}
        elif spent is not None and c in inferred:
            out[c] = {"source": "private"} | ({"epsilon_spent": round(spent[c], 10)} if c in spent else {})
        else:
            out[c] = {"source": "public"}
    return out


def constraints(schema: Schema, constants: Sequence[str] = (), user: dict | None = None) -> dict:
    """Rules of each column and between columns; a user's rules of a column replace its keys, and further rules are appended."""
    rules: dict[str, dict] = {}
    for c, kind in schema.kinds.items():
        rule: dict = {"type": kind}
        if c in schema.categories:
            rule["allowed_values"] = list(schema.categories[c])
        if c in schema.bounds:
            rule["min"], rule["max"] = schema.bounds[c]
        if c in schema.bins:
            rule["n_bins"] = schema.bins[c]
        if c in constants:
            rule["note"] = "constant_column_excluded_from_synthesis"
        rules[c] = rule
    between = []
    pair = pair_of(schema.target)
    if pair:
        event, time = pair
        between.append({"name": "survival_pair_definition", "type": "survival_pair", "event_col": event, "time_col": time, "event_allowed_values": [0, 1], "time_min_exclusive": 0})
        rules.setdefault(event, {"type": "binary"})["allowed_values"] = ["0", "1"]
        rules.setdefault(time, {"type": "continuous"})["min_exclusive"] = 0
    out = {"column_constraints": rules, "cross_column_constraints": between, "row_group_constraints": []}
    extra = deepcopy(user or {})
    for c, rule in (extra.get("column_constraints") or {}).items():
        if isinstance(rule, dict):
            rules.setdefault(c, {}).update(rule)
    for key in ("cross_column_constraints", "row_group_constraints"):
        out[key] += extra.get(key) or []
    return out


def infer(df: DataFrame, targets: Sequence[str] | None = None, survival: bool = False, pad: float = 0.0, max_levels: int = 20, max_categories: int = 200, rules: dict | None = None, overrides: dict[str, dict] | None = None) -> dict:
    """The schema document of ``df``: one profile of all columns, and one count of the values of those that have few.

    GUID-like columns are left out. Timestamps, and text columns that are dates, are seconds; how dates are written is kept. ``overrides`` gives
    columns a ``type`` and, if it is a discrete one, a ``domain``. An empty table gives categorical columns without categories.
    """
    kinds_of = {f.name: f.dataType for f in df.schema.fields}
    wrong = [c for c, o in (overrides or {}).items() if c not in kinds_of or o.get("type") not in (*NUMERIC, *DISCRETE)]
    if wrong:
        raise ValueError(f"overrides of unknown columns or types: {wrong}")
    dates = D.elect(df, [c for c in df.columns if c not in (overrides or {})])
    df = D.to_epochs(df, dates)
    profiled = P.profile(df).collect()  # a row a column
    found = {r.column: r for r in profiled}
    types = {r.column: r.type for r in P.types_of(df, df.sparkSession.createDataFrame(profiled, P.PROFILE), max_levels).collect()}
    types |= {c: "integer" for c in dates if types[c] != "constant"} | {c: o["type"] for c, o in (overrides or {}).items()}
    guids = [c for c in df.columns if types[c] == "guid"]
    constant = [c for c in df.columns if types[c] == "constant"]
    target = target_of([c for c in df.columns if c not in guids], targets, survival)
    pair = pair_of(target)
    kinds = {}
    for c in df.columns:
        if c in guids:
            continue
        kind = types[c]
        if kind == "constant":
            kind = "continuous" if found[c].lo is not None else "categorical"
        kinds[c] = "binary" if pair and c == pair[0] else kind
    labelled = [c for c, k in kinds.items() if k in ("categorical", "ordinal")]
    categories = {r.column: list(r.categories) for r in P.levels(df, labelled, max_categories).collect()} if labelled else {}
    categories |= {c: [str(x) for x in o["domain"]] for c, o in (overrides or {}).items() if o["type"] in DISCRETE and o.get("domain") is not None}
    stamps = [c for c, k in kinds_of.items() if c in kinds and isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    ends = {c: (found[c].lo, found[c].hi) for c in kinds if c not in stamps}
    if stamps:
        row = df.agg(*[f(F.unix_timestamp(F.col(f"`{c}`").cast("timestamp"))).alias(f"{n}{i}") for i, c in enumerate(stamps) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        ends |= {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(stamps)}
    bounds, bins = {}, {}
    n = df.count()
    for c, kind in kinds.items():
        if kind not in ("continuous", "integer"):
            continue
        lo, hi = (0.0, 1.0) if ends[c][0] is None else map(float, ends[c])
        span = hi - lo
        by = pad * span if span > 0 else max(abs(lo) * pad, 1.0)
        bounds[c] = (lo - by, hi + by)
        bins[c] = P.sturges(n, P.auto_cap(n))
    if pair and pair[1] in bounds:
        bounds[pair[1]] = (0.0, bounds[pair[1]][1])
    schema = Schema(kinds, bounds, bins, categories, {}, target or {}, [], n)
    doc = schema.document()
    doc["dataset_info"] |= {"columns": list(kinds), "guid_like_columns": guids, "constant_columns": constant}
    doc["missing_value_rates"] = {c: float(found[c].missing or 0.0) for c in kinds}
    doc["mechanism_hints"] = mechanism_hints(kinds, target)
    doc["domain_provenance"] = provenance(kinds, set(bounds) | set(categories))
    doc["sensitivity_bounds"] = {c: 1.0 if k == "binary" else 2.0 if k == "categorical" else max(bounds.get(c, (0.0, 1.0))[1] - bounds.get(c, (0.0, 1.0))[0], 1.0) for c, k in kinds.items()}
    doc["constraints"] = constraints(schema, constant, rules)
    if target and target["kind"] == "single":
        doc["label_domain"] = categories.get(target["primary_target"], ["0", "1"] if kinds.get(target["primary_target"]) == "binary" else [])
    stamped = {c: D.DEFAULT for c in stamps} | dates
    if stamped:
        doc["datetime_spec"] = {c: {"storage": "epoch_s", "output_format": f, "timezone": "UTC"} for c, f in stamped.items() if c in kinds}
    cells = max(bins.values(), default=5)
    doc["extensions"] = {"max_parents": P.max_parents(n, cells), "partial_order": list(pair) if pair else [], "alpha": {c: P.perks(bins.get(c, len(categories.get(c, [])) or 2)) for c in kinds}}
    return doc


def without_labels(document: dict) -> dict:
    """The document with the target's values taken out: its label domain, categories and allowed values."""
    out = deepcopy(document)
    out.pop("label_domain", None)
    for c in (out.get("target_spec") or {}).get("targets", []):
        out.get("public_categories", {}).pop(c, None)
        out.get("constraints", {}).get("column_constraints", {}).get(c, {}).pop("allowed_values", None)
    return out


def validate_rows(schema: Schema, df: DataFrame) -> DataFrame:
    """(column, undeclared, below, above, not_number, levels) for each column of the schema that the table has, by one aggregation.

    Undeclared are values outside the categories, where 1 and 1.0 are the same value; missing values and tokens break no rule.
    """
    out = []
    for c, kind in schema.kinds.items():
        if c not in df.columns:
            continue
        text = F.trim(F.col(f"`{c}`").cast("string"))
        missing = text.isNull() | F.lower(text).isin(*MISSING_TOKENS)
        x = number(text)
        same = lambda v: F.when(number(v) == F.rint(number(v)), number(v).cast("long").cast("string")).otherwise(v)
        known = schema.categories.get(c) or (["0", "1"] if kind == "binary" else None)
        undeclared = F.count_if(~missing & ~same(text).isin([*map(_whole, known)])) if known else F.lit(0).cast("long")
        lo, hi = schema.bounds.get(c, (None, None))
        below = F.count_if(~missing & (x < lo)) if lo is not None else F.lit(0).cast("long")
        above = F.count_if(~missing & (x > hi)) if hi is not None else F.lit(0).cast("long")
        spelled = F.count_if(~missing & x.isNull()) if lo is not None else F.lit(0).cast("long")
        levels = F.approx_count_distinct(F.when(~missing, text), 0.01)
        out.append(F.struct(F.lit(c).alias("column"), undeclared.alias("undeclared"), below.alias("below"), above.alias("above"), spelled.alias("not_number"), levels.alias("levels")))
    if not out:
        return df.sparkSession.createDataFrame([], "column string, undeclared long, below long, above long, not_number long, levels long")
    return df.agg(F.array(*out).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def range_use(schema: Schema, df: DataFrame) -> DataFrame:
    """(column, used, numbers): what share of its declared range a numeric column's values span, null without values, and whether the column is stored as
    numbers; by one aggregation."""
    plain = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))}
    out = []
    for c, kind in schema.kinds.items():
        if c in df.columns and c in schema.bounds and kind in NUMERIC:
            lo, hi = schema.bounds[c]
            x = number(F.col(f"`{c}`").cast("string"))
            out.append(F.struct(F.lit(c).alias("column"), ((F.max(x) - F.min(x)) / F.lit(hi - lo)).alias("used"), F.lit(c in plain).alias("numbers")))
    if not out:
        return df.sparkSession.createDataFrame([], "column string, used double, numbers boolean")
    return df.agg(F.array(*out).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def remarks(schema: Schema, df: DataFrame, least: float = 0.1) -> list[str]:
    """What doesn't forbid the schema's use with the table but is worth a look: little of a range used, numbers kept as text, labels kept as fractions."""
    out = schema.warnings()
    for r in range_use(schema, df).collect():  # a row a column
        out += [f"{r.column}: uses {r.used:.1%} of its range"] if r.used is not None and r.used < least else []
        out += [] if r.numbers else [f"{r.column}: numbers kept as text"]
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return out + [f"{c}: labels kept as fractions" for c, k in schema.kinds.items() if k in ("categorical", "ordinal") and c in fractions]


def _whole(value: str) -> str:
    """1.0 as 1."""
    try:
        return str(int(float(value))) if float(value) == int(float(value)) else value
    except (ValueError, OverflowError):
        return value


def complaints(schema: Schema, df: DataFrame) -> list[str]:
    """What speaks against using the schema with the table: missing or additional columns, rules broken, two values that are more."""
    out = [f"{c}: not in the table" for c in schema.kinds if c not in df.columns] + [f"{c}: not in the schema" for c in df.columns if c not in schema.kinds]
    for r in validate_rows(schema, df).collect():  # a row a column
        out += [f"{r.column}: {r[k]} {k.replace('_', ' ')}" for k in ("undeclared", "below", "above", "not_number") if r[k]]
        if schema.kinds[r.column] == "binary" and r.levels > 2:
            out.append(f"{r.column}: more than two values")
    return out


def ready(schema: Schema, df: DataFrame | None = None) -> dict:
    """Whether tables can be made from the schema, and what stands against it."""
    wrong = schema.problems() + ([] if schema.n_records else ["no record count"]) + ([] if schema.target else ["no target"])
    wrong += complaints(schema, df) if df is not None else []
    return {"ready": not [w for w in wrong if w != "no target"], "problems": wrong}
