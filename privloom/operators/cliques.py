"""Cliques of any degree for the graphical model, grown level by level from counted scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.operators.clustered import candidate_cells
from privloom.operators.privacy import SecureNoise, exponential_probabilities, information_sensitivity


def set_information(cells: DataFrame) -> DataFrame:
    """(set, child, mi): natural-log information of a set's joint codes and the child, from ``candidate_cells``, floored at 0."""
    total = F.sum("n").over(Window.partitionBy("set", "child"))
    dealt = cells.withColumns({
        "p": F.col("n") / total, "pu": F.sum("n").over(Window.partitionBy("set", "child", "codes")) / total, "pv": F.sum("n").over(Window.partitionBy("set", "child", "code")) / total,
    })
    return dealt.groupBy("set", "child").agg(F.greatest(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pu") * F.col("pv")))), F.lit(0.0)).alias("mi"))


def cells_of(clique: Sequence[str], sizes: dict[str, int]) -> float:
    return float(np.prod([float(sizes[c]) for c in clique]))


def fitting(parents: Sequence[tuple[str, ...]], child: str, sizes: dict[str, int], most_cells: float | None) -> list[tuple[str, ...]]:
    """The sets that with the child have ``most_cells`` at most; if none has, the smallest of them."""
    sized = sorted((cells_of((*p, child), sizes), p) for p in parents)
    within = [p for n, p in sized if most_cells is None or n <= most_cells]
    return sorted(within) or [sized[0][1]]


def grow_cliques(coded: DataFrame, sizes: dict[str, int], degree: int = 2, epsilon: float | None = None, most_candidates: int = 20, most_cells: float | None = None, noise: SecureNoise | None = None) -> list[tuple[str, ...]]:
    """Cliques of ``degree`` columns at most: a root, then at each level one column that is left with a set of chosen ones, by the exponential mechanism over
    all candidates' information (without ``epsilon`` the largest), each level a share of the budget.

    The cells of a level's candidates are counted in one exploded pass, also those of three columns and more. ``most_cells`` bounds
    the model: a clique takes its share of it, and where no set fits the smallest is taken. Of more than ``most_candidates`` sets of a column so many
    are drawn.
    """
    noise = noise or SecureNoise()
    names = sorted(sizes)
    share = most_cells / len(names) if most_cells else None
    roots = [c for c in names if share is None or sizes[c] <= share] or names
    root = roots[min(int(noise.uniform() * len(roots)), len(roots) - 1)] if epsilon else roots[0]
    used, out, n = [root], [(root,)], coded.count()
    while len(used) < len(names):
        sets = list(combinations(sorted(used), min(len(used), max(degree - 1, 1))))
        candidates: list[tuple[tuple[str, ...], str]] = []
        for child in names:
            if child not in used:
                own = fitting(sets, child, sizes, share)
                if len(own) > most_candidates:
                    own = [own[i] for i in sorted(np.argsort([float(noise.uniform()) for _ in own])[:most_candidates])]
                candidates += [(p, child) for p in own]
        places = sorted({p for p, _ in candidates})
        found = {(places[r["set"]], r.child): r.mi for r in set_information(candidate_cells(coded, places, sorted({c for _, c in candidates}))).collect()}  # a row a candidate
        scores = [found[c] for c in candidates]
        if epsilon:
            p = exponential_probabilities(scores, epsilon / len(names), information_sensitivity(n))
            at = min(int(np.searchsorted(np.cumsum(p), noise.uniform())), len(p) - 1)
        else:
            at = max(range(len(scores)), key=lambda i: (round(scores[i], 12), -i))
        parents, child = candidates[at]
        used.append(child)
        out.append((*parents, child))
    # a clique within another says nothing more
    return [c for c in out if not any(set(c) < set(d) for d in out)]
