"""Rare levels of coded columns pooled for a model, and taken apart again in its samples.

Which levels are rare is told by noisy counts alone. A pooled level remembers its members with their noisy weights: a sample that
has the pooled code gets one of them by a uniform number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privloom.functions import hash_uniform

#: Sigmas that a level's noisy count must reach to keep a code of its own.
TIMES = 3.0


@dataclass
class Compression:
    """For each column the codes that stay, the pooled ones with their shares, and the impossible ones (structural zeros)."""

    sizes: dict[str, int]
    kept: dict[str, np.ndarray] = field(default_factory=dict)
    pooled: dict[str, np.ndarray] = field(default_factory=dict)
    shares: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def learn(cls, sizes: dict[str, int], measured: dict[str, tuple[np.ndarray, float]], zeros: dict[str, list[int]] | None = None, times: float = TIMES) -> "Compression":
        """From each column's noisy counts and their sigma. Without noise (sigma 0) all levels that are possible stay, and so they do where none reaches
        the threshold."""
        out = cls(dict(sizes))
        for c, size in sizes.items():
            possible = np.ones(size, bool)
            possible[list((zeros or {}).get(c, []))] = False
            if not possible.any():
                raise ValueError(f"{c}: no level is possible")
            n, sigma = measured.get(c, (np.zeros(size), 0.0))
            large = possible & (n >= times * sigma) if sigma else possible.copy()
            large = large if large.any() else possible
            rest = np.flatnonzero(possible & ~large)
            out.kept[c], out.pooled[c] = np.flatnonzero(large), rest
            weight = np.maximum(n[rest], 0)
            out.shares[c] = weight / weight.sum() if weight.sum() > 0 else np.full(len(rest), 1 / max(len(rest), 1))
        return out

    def size(self, column: str) -> int:
        return len(self.kept[column]) + bool(len(self.pooled[column]))

    def new_sizes(self) -> dict[str, int]:
        return {c: self.size(c) for c in self.sizes}

    def codes(self, column: str) -> np.ndarray:
        """The new code of each old one: its place among those kept, the pooled code, and for an impossible one that of the nearest kept."""
        kept = self.kept[column]
        out = np.array([int(np.argmin(np.abs(kept - c))) for c in range(self.sizes[column])])
        out[self.pooled[column]] = len(kept)
        return out

    def encode(self, coded: DataFrame) -> DataFrame:
        table = lambda c: F.from_json(F.lit(str(self.codes(c).tolist())), "array<int>")
        return coded.withColumns({c: F.get(table(c), F.col(c)) for c in self.sizes})

    def decode(self, coded: DataFrame, id_column: str, seed: str = "sample") -> DataFrame:
        """Old codes: of a pooled one a member, by its share and a hash uniform of the id."""
        out = {}
        for c in self.sizes:
            old = F.from_json(F.lit(str(self.kept[c].tolist())), "array<int>")
            code = F.get(old, F.col(c))
            if len(self.pooled[c]):
                upto = F.from_json(F.lit(str(np.cumsum(self.shares[c]).tolist())), "array<double>")
                members = F.from_json(F.lit(str(self.pooled[c].tolist())), "array<int>")
                u = hash_uniform(seed, f"{c}|pool", F.col(id_column))
                place = F.least(F.size(F.filter(upto, lambda x: x <= u)), F.lit(len(self.pooled[c]) - 1))  # noqa: B023
                code = F.when(F.col(c) == len(self.kept[c]), F.get(members, place)).otherwise(code)
            out[c] = code
        return coded.withColumns(out)

    def measurement(self, column: str, n: np.ndarray, sigma: float) -> tuple[tuple[str], np.ndarray, np.ndarray]:
        """A column's noisy counts over the new codes with each one's sigma: a pool adds up the noise of its members."""
        y, s = n[self.kept[column]], np.full(len(self.kept[column]), sigma)
        if len(self.pooled[column]):
            y = np.append(y, n[self.pooled[column]].sum())
            s = np.append(s, sigma * np.sqrt(len(self.pooled[column])))
        return (column,), y, s
