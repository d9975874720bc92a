"""Blending of models' predictions, which are columns of one table; a missing prediction is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known


def mean_blend(columns: list[str]) -> Column:
    """Mean of the models that predicted; null if none did."""
    return weighted_blend(columns, [1.0] * len(columns))


def weighted_blend(columns: list[str | Column], weights: list[float]) -> Column:
    """Weighted mean, the weights scaled to those of the models that predicted; null if none with a weight did."""
    pairs = [(known(F.col(c) if isinstance(c, str) else c), float(w)) for c, w in zip(columns, weights)]
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in pairs), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for x, w in pairs), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def class_blend(n_classes: int) -> Callable[[list[str], list[float]], Column]:
    """The weighted blend of models whose predictions are arrays with a probability for each class."""

    def blend(columns: list[str], weights: list[float]) -> Column:
        each = F.array(*[weighted_blend([F.col(c)[i] for c in columns], weights) for i in range(n_classes)])
        return F.when(~F.exists(each, lambda p: p.isNull()), each)

    return blend


def hits(columns: list[str], label: str) -> tuple[list[Column], Column]:
    """(each model's probability of a row's own class, null if it has none; whether an array holds missing ones among others).

    Where no row is of that kind, the weighted blend of the hits is the class blend's probability of the row's class.
    """
    some = lambda v: known(v).isNotNull()
    mixed = [F.coalesce(F.exists(c, some) & ~F.forall(c, some), F.lit(False)) for c in columns]
    at = F.col(label).cast("int") + 1
    return [F.when(F.forall(c, some), F.element_at(c, at)) for c in columns], F.greatest(*mixed, F.lit(False))


def best_model(df: DataFrame, columns: list[str], metric: Callable[[Column], Column], sign: int = 1) -> str:
    """The column with the best metric (an aggregate of a prediction column); one pass for all."""
    row = df.agg(*[(metric(F.col(c)) * sign).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return max(columns, key=lambda c: row[f"m{columns.index(c)}"])


def shifted(weights: list[float], i: int, value: float, least: float = 0.05) -> list[float]:
    """weights with the i-th set to value and the others scaled to the rest; those below least become 0, smallest first."""
    rest = sum(w for k, w in enumerate(weights) if k != i)
    out = [value if k == i else w / rest * (1 - value) if rest else 0.0 for k, w in enumerate(weights)]
    for k in sorted(range(len(out)), key=lambda k: out[k]):
        if out[k] >= least:
            break
        out[k] = 0.0
        total = sum(out)
        if not total:
            return weights
        out = [w / total for w in out]
    return out


def optimise_weights(df: DataFrame, columns: list[str], metric: Callable[[Column], Column], sign: int = 1, rounds: int = 5, grid: int = 10, refine: int = 4, blended: Callable[[list[str], list[float]], Column] = weighted_blend) -> list[float]:
    """Weights found coordinate by coordinate; each pass tries a whole grid of values in one aggregate, then a finer
    one between the best one's neighbours: with grid 10 and refine 4 a weight is found to 1 / 5**3 / 10 where one search has one
    minimum. (One step of a bounded search in one dimension would cost as much as a grid.)"""
    weights = [1.0 / len(columns)] * len(columns)

    def scores(cands: list[list[float]]) -> list[float]:
        row = df.agg(*[(metric(blended(columns, w)) * sign).alias(f"m{i}") for i, w in enumerate(cands)]).first()
        return [float("-inf") if v is None else v for v in row]

    best = scores([weights])[0]
    for _ in range(rounds):
        moved = False
        for i in range(len(columns)):
            if weights[i] == 1.0:
                continue
            lo, hi, keep = 0.0, 1.0, weights
            for _ in range(refine):
                at = [lo + (hi - lo) * k / grid for k in range(grid + 1)]
                got = scores([shifted(weights, i, v) for v in at])
                k = max(range(len(at)), key=lambda k: got[k])
                lo, hi = at[max(0, k - 1)], at[min(grid, k + 1)]
                if got[k] > best + 1e-12:
                    best, moved = got[k], True
                    keep = shifted(weights, i, at[k])
            weights = keep
        if not moved:
            break
    return weights
