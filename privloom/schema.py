"""The logical schema: a JSON document of types, bounds, categories, constraints and targets; its loader and checks."""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privloom.functions import MISSING_TOKENS, number

VERSION = "1.6.0"
NUMERIC, DISCRETE = ("continuous", "integer"), ("categorical", "ordinal", "binary")
KINDS = ("continuous", "integer", "binary", "ordinal", "categorical", "datetime", "timedelta")


@dataclass(frozen=True)
class Schema:
    kinds: dict[str, str]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    bins: dict[str, int] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    constraints: dict[str, dict] = field(default_factory=dict)
    target: dict = field(default_factory=dict)
    sensitive: list[str] = field(default_factory=list)
    n_records: int | None = None
    #: Whatever else the document says: cross-column rules, hints, provenance, missing rates, extensions and unknown keys.
    rest: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, document: str | dict) -> "Schema":
        """Bounds may be [lo, hi] or an object; the record count stands in ``dataset`` or ``dataset_info``; names with ``__`` are notes."""
        d = json.loads(document) if isinstance(document, str) else document
        kinds = {k: v for k, v in d.get("column_types", {}).items() if not k.startswith("__")}
        wrong = sorted(k for k, v in kinds.items() if v not in KINDS)
        if wrong:
            raise ValueError(f"unknown types of columns {wrong}")
        bounds, bins = {}, {}
        for name, b in d.get("public_bounds", {}).items():
            lo, hi = (b["min"], b["max"]) if isinstance(b, dict) else (b[0], b[1])
            bounds[name] = (float(lo), float(hi))
            if isinstance(b, dict) and b.get("n_bins"):
                bins[name] = int(b["n_bins"])
        data = d.get("dataset")
        n = data.get("n_records") if isinstance(data, dict) else d.get("dataset_info", {}).get("n_records")
        limits = d.get("constraints") if isinstance(d.get("constraints"), dict) else {}
        rules = limits.get("column_constraints", {})
        rest = {k: v for k, v in d.items() if k not in ("column_types", "public_bounds", "public_categories", "target_spec", "sensitive_attributes")}
        rest["schema_version"] = d.get("schema_version", VERSION)
        rest["dataset_info"] = {"n_records": n} | (d.get("dataset_info") or {})
        rest["constraints"] = {k: v for k, v in limits.items() if k != "column_constraints"}
        return cls(kinds, bounds, bins, {k: [str(x) for x in v] for k, v in d.get("public_categories", {}).items()}, rules if isinstance(rules, dict) else {}, d.get("target_spec", {}) or {}, list(d.get("sensitive_attributes", []) or []), n, deepcopy(rest))

    def document(self) -> dict:
        """The document that ``parse`` reads to the same schema."""
        bounds = {k: {"min": lo, "max": hi, **({"n_bins": self.bins[k]} if k in self.bins else {})} for k, (lo, hi) in self.bounds.items()}
        own = {"schema_version": VERSION, "dataset_info": {"n_records": self.n_records}, "column_types": self.kinds, "public_bounds": bounds, "public_categories": self.categories}
        own |= {k: v for k, v in self.rest.items() if k != "constraints"}
        return deepcopy(own | {"constraints": {"column_constraints": self.constraints, **self.rest.get("constraints", {})}, "target_spec": self.target, "sensitive_attributes": self.sensitive})

    def cross_rules(self) -> list[dict]:
        """Rules between columns."""
        return list(self.rest.get("constraints", {}).get("cross_column_constraints") or [])

    def problems(self) -> list[str]:
        """What is wrong with the schema alone, so that no tables can be made from it. Binary columns without categories have 0 and 1."""
        out = [] if self.kinds else ["no columns"]
        for name, kind in self.kinds.items():
            if kind in (*NUMERIC, "datetime", "timedelta") and name not in self.bounds:
                out.append(f"{name}: no bounds")
            if kind in ("categorical", "ordinal") and not self.categories.get(name):
                out.append(f"{name}: no categories")
            if kind == "binary" and name in self.categories and len(self.categories[name]) != 2:
                out.append(f"{name}: a binary column has two categories")
            if len(set(self.categories.get(name, []))) != len(self.categories.get(name, [])):
                out.append(f"{name}: repeated categories")
        out += [f"{k}: bounds are not in order" for k, (lo, hi) in self.bounds.items() if not lo < hi]
        out += [f"{k}: not a column" for k in [*self.bounds, *self.categories] if k not in self.kinds]
        return out + self._target_problems() + self._extension_problems()

    def _target_problems(self) -> list[str]:
        if not self.target:
            return []
        out = [f"target: no {k}" for k in ("kind", "targets", "primary_target") if not self.target.get(k)]
        targets = self.target.get("targets") or []
        out += [f"target: {t} is not a column" for t in targets if t not in self.kinds]
        if self.target.get("primary_target") and self.target["primary_target"] not in targets:
            out.append("target: the primary one is not a target")
        if self.target.get("kind") == "survival_pair":
            if len(targets) < 2:
                out.append("target: a survival pair has two columns")
            if not any(r.get("type") == "survival_pair" for r in self.cross_rules()):
                out.append("target: no rule of the survival pair")
        return out

    def _extension_problems(self) -> list[str]:
        """Of what models are told beside the types: parents, their bans, order, weights and bins."""
        more = self.rest.get("extensions") or {}
        out = []
        if "max_parents" in more and not (isinstance(more["max_parents"], int) and more["max_parents"] >= 1):
            out.append("extensions: max_parents is a whole number from 1")
        named = [*more.get("partial_order", []), *more.get("alpha", {}), *more.get("forbidden_parents", {}), *[p for ps in more.get("forbidden_parents", {}).values() for p in ps], *more.get("null_bins", {}), *more.get("bins", {})]
        out += [f"extensions: {c} is not a column" for c in dict.fromkeys(named) if c not in self.kinds]
        out += [f"extensions: alpha of {c} is not above 0" for c, a in more.get("alpha", {}).items() if not a > 0]
        for c, at in more.get("null_bins", {}).items():
            total = more.get("bins", {}).get(c)
            if at is not None and total is not None and at != total - 1:
                out.append(f"extensions: the null bin of {c} is not its last")
        return out

    def warnings(self) -> list[str]:
        """What may be meant, but is worth a look: columns with both bounds and categories, a survival pair without a horizon, bounds of unknown origin,
        bounds that look as if they had been read from the rows."""
        out = [f"{c}: both bounds and categories" for c, k in self.kinds.items() if k != "ordinal" and c in self.bounds and c in self.categories]
        if self.target.get("kind") == "survival_pair" and not self.target.get("tau"):
            out.append("target: no horizon (tau)")
        origin = self.rest.get("domain_provenance") or {}
        out += ["no provenance of domains"] if not origin else [f"{c}: no provenance" for c in self.kinds if c not in origin]
        for c, (lo, hi) in self.bounds.items():
            if self.kinds.get(c) == "continuous" and not origin.get(c, {}).get("source") == "private" and any(abs(x * 100 - round(x * 100)) > 1e-6 for x in (lo, hi)):
                out.append(f"{c}: bounds of many digits look like data")
        return out

    def attack_target(self) -> str | None:
        """The column that attribute inference guesses: the first sensitive one, else the primary target."""
        return self.sensitive[0] if self.sensitive else self.target.get("primary_target")

    def survival_pair(self) -> tuple[str, str] | None:
        """(event, time): as the pair's rule says, else the primary target and the other, else in the order of the targets."""
        if self.target.get("kind") != "survival_pair":
            return None
        rule = next((r for r in self.cross_rules() if r.get("type") == "survival_pair" and r.get("event_col") and r.get("time_col")), None)
        if rule:
            return rule["event_col"], rule["time_col"]
        targets = self.target["targets"][:2]
        event = self.target.get("primary_target")
        event = event if event in targets else targets[0]
        return event, next(t for t in targets if t != event)

    def check_rows(self, n: int, share: float = 0.001) -> None:
        if self.n_records is None:
            raise ValueError("the schema has no record count")
        if abs(n - self.n_records) > max(share * self.n_records, 1):
            raise ValueError("the number of records differs from the declared one")


def numeric_violations(df: DataFrame, column: str) -> DataFrame:
    """One row (garbage, missing, fractions) of counts; missing tokens are no garbage."""
    text = F.col(column).cast("string")
    x, missing = number(text), F.lower(F.trim(text)).isin(*MISSING_TOKENS)
    return df.agg(F.count_if(x.isNull() & ~missing).alias("garbage"), F.count_if(missing).alias("missing"), F.count_if(x != F.rint(x)).alias("fractions"))


def check_numeric(df: DataFrame, column: str, kind: str) -> None:
    """Raises with counts alone if a number column holds what its kind doesn't allow."""
    text = F.col(column).cast("string")
    x = number(text)
    bad = numeric_violations(df, column).first()
    infinite, other = df.agg(F.count_if(F.abs(x) == float("inf")), F.count_if(~x.isin(0.0, 1.0))).first()
    found = {"not numbers": bad.garbage, "infinite": infinite, "not whole": bad.fractions if kind in ("integer", "ordinal", "binary") else 0, "not 0 or 1": other if kind == "binary" else 0}
    if any(found.values()):
        raise ValueError(f"{column}: " + ", ".join(f"{v} {k}" for k, v in found.items() if v))
