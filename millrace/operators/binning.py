"""Supervised bins: cuts where the share of the target changes, found on the counts of many fine bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known
from .categorical import unpivoted


def information(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Each bin's part of the information value, half a row added to both classes."""
    b, g = (pos + 0.5) / max(pos.sum(), 1), (neg + 0.5) / max(neg.sum(), 1)
    return (b - g) * np.log(b / g)


def best_cuts(pos: np.ndarray, neg: np.ndarray, bins: int, least: float) -> list[int]:
    """Positions in the fine bins (in order) that cut them into at most bins parts, each with at least the share least of all rows,
    so that the information value is largest: exact, by dynamic programming over the fine bins."""
    n, p, q = len(pos), np.concatenate([[0.0], np.cumsum(pos)]), np.concatenate([[0.0], np.cumsum(neg)])
    rows = p + q
    lo, hi = np.triu_indices(n + 1, 1)
    b, g = (p[hi] - p[lo] + 0.5) / max(p[-1], 1), (q[hi] - q[lo] + 0.5) / max(q[-1], 1)
    worth = np.full((n + 1, n + 1), -np.inf)
    worth[lo, hi] = np.where(rows[hi] - rows[lo] >= least * rows[-1], (b - g) * np.log(b / g), -np.inf)
    best, back = worth[0].copy(), [np.zeros(n + 1, int)]
    top, parts = best[n], 1
    for k in range(2, bins + 1):
        step = best[:, None] + worth
        back.append(step.argmax(axis=0))
        best = step.max(axis=0)
        if best[n] > top + 1e-12:
            top, parts = best[n], k
    cuts, at = [], n
    for k in range(parts, 1, -1):
        at = int(back[k - 1][at])
        cuts.append(at)
    return sorted(cuts)


@dataclass
class SupervisedBins:
    """sbin__x: the number of the bin of x, 0 if it is missing. cuts: upper edges, a value on an edge is below it."""

    cuts: dict[str, list[float]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], target: str, bins: int = 5, fine: int = 64, least: float = 0.05) -> SupervisedBins:
        """One pass for the fine edges of all columns, one for their counts; the driver sees fine numbers a column."""
        row = df.agg(*[F.percentile_approx(known(F.col(c)), [i / fine for i in range(1, fine)], 20 * fine).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        edges = {c: sorted(set(row[i] or [])) for i, c in enumerate(columns)}
        coded = df.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), *[number(known(F.col(c)), edges[c]).alias(c) for c in columns])
        counts = unpivoted(coded, columns, "_y").groupBy("feature", "value").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")).collect()
        cuts = {}
        for c in columns:
            pos, neg = np.zeros(len(edges[c]) + 1), np.zeros(len(edges[c]) + 1)
            for r in counts:
                if r.feature == c and int(r.value):
                    pos[int(r.value) - 1], neg[int(r.value) - 1] = r.pos, r.neg
            cuts[c] = [float(edges[c][k - 1]) for k in best_cuts(pos, neg, bins, least)] if pos.sum() + neg.sum() else []
        return SupervisedBins(cuts)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"sbin__{c}": number(known(F.col(c)), e) for c, e in self.cuts.items()})


def number(value: Column, edges: list[float]) -> Column:
    """1 + how many edges are below the value; 0 for null."""
    above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < value)) if edges else F.lit(0)
    return F.when(value.isNull(), 0).otherwise(above + 1).cast("int")
