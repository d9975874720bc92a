"""Parameter search by Parzen estimators: trials are jobs of their own, a few at a time, on one persisted holdout."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import Loss
from ..functions.scalar import hash_unit
from ..operators import boosting
from ..operators.boosting import Params
from ..operators.models import Timer


@dataclass(frozen=True)
class Space:
    """The values of a parameter: uniform or log between bounds, int (both bounds included), or one of choices."""

    kind: str
    low: float = 0.0
    high: float = 1.0
    choices: tuple = ()

    def value(self, u: float):
        """The value at u in [0, 1)."""
        if self.kind == "choice":
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        if self.kind == "log":
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        if self.kind == "int":
            return min(int(self.low + u * (self.high - self.low + 1)), int(self.high))
        return self.low + u * (self.high - self.low)


def uniform(low: float, high: float) -> Space:
    return Space("uniform", low, high)


def log(low: float, high: float) -> Space:
    return Space("log", low, high)


def integer(low: int, high: int) -> Space:
    return Space("int", low, high)


def choice(*values) -> Space:
    return Space("choice", choices=values)


class Parzen:
    """Trials so far split into the best ones and the rest; for each parameter, candidates drawn near good values, and of them
    the one whose density among the good is largest against that among the rest. Trials still running count as bad."""

    def __init__(self, space: dict[str, Space], seed: int = 42, startup: int = 10, candidates: int = 24, part: float = 0.1) -> None:
        self.space, self.startup, self.candidates, self.part = space, startup, candidates, part
        self.rng = np.random.default_rng(seed)
        self.seen: list[tuple[float, dict[str, float]]] = []
        self.running: list[dict[str, float]] = []

    def ask(self) -> dict[str, float]:
        """Positions in [0, 1) of the next trial's parameters."""
        if len(self.seen) < self.startup:
            got = {k: float(self.rng.random()) for k in self.space}
        else:
            ranked = sorted(self.seen, key=lambda t: t[0])
            n = max(1, math.ceil(self.part * len(ranked)))
            good, bad = [p for _, p in ranked[:n]], [p for _, p in ranked[n:]] + self.running
            got = {k: self._pick(s, np.array([p[k] for p in good]), np.array([p[k] for p in bad])) for k, s in self.space.items()}
        self.running.append(got)
        return got

    def tell(self, at: dict[str, float], loss: float) -> None:
        self.running.remove(at)
        self.seen.append((loss if loss == loss else math.inf, at))

    def values(self, at: dict[str, float]) -> dict:
        return {k: s.value(at[k]) for k, s in self.space.items()}

    def _pick(self, s: Space, good: np.ndarray, bad: np.ndarray) -> float:
        if s.kind == "choice":
            k = len(s.choices)
            share = [np.bincount(np.minimum((v * k).astype(int), k - 1), minlength=k) + 1.0 for v in (good, bad)]
            drawn = self.rng.choice(k, self.candidates, p=share[0] / share[0].sum())
            best = max(drawn.tolist(), key=lambda i: share[0][i] / share[1][i])
            return (best + 0.5) / k
        mid, width = _kernels(good)
        c = np.empty(0)
        while len(c) < self.candidates:
            i = self.rng.integers(0, len(mid), 4 * self.candidates)
            x = self.rng.normal(mid[i], width[i])
            c = np.concatenate([c, x[(x >= 0) & (x < 1)]])
        c = c[: self.candidates]
        return float(c[np.argmax(_density(c, mid, width) / np.maximum(_density(c, *_kernels(bad)), 1e-300))])


def _kernels(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal kernels at the points, as wide as the gap to the farther neighbour, and a wide one over the whole range."""
    mid = np.sort(np.append(at, 0.5))
    gap = np.diff(np.concatenate([[0.0], mid, [1.0]]))
    width = np.clip(np.maximum(gap[:-1], gap[1:]), 1 / min(100, len(mid) + 1), 1.0)
    return np.append(mid, 0.5), np.append(width, 1.0)


def _density(x: np.ndarray, mid: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Mean of the kernels, each cut off at 0 and 1."""
    inside = np.array([0.5 * (math.erf((1 - m) / w / math.sqrt(2)) - math.erf(-m / w / math.sqrt(2))) for m, w in zip(mid, width)])
    z = (x[:, None] - mid) / width
    return (np.exp(-0.5 * z * z) / (width * math.sqrt(2 * math.pi) * np.maximum(inside, 1e-12))).mean(axis=1)


@dataclass
class Search:
    """best: the parameters of the least loss; trials: (parameters, loss) in the order they ended."""

    best: dict
    loss: float
    trials: list[tuple[dict, float]]


def minimise(objective: Callable[[dict], float], space: dict[str, Space], trials: int, parallel: int = 1, seed: int = 42, timer: Timer | None = None, startup: int = 10) -> Search:
    """Search with up to parallel trials at a time; none is started when the time is out, one is always made."""
    p = Parzen(space, seed, startup)
    done: list[tuple[dict, float]] = []
    begun = 0
    with ThreadPoolExecutor(parallel) as pool:
        live: dict = {}
        while True:
            while len(live) < parallel and begun < trials and not (begun and timer is not None and timer.out()):
                at = p.ask()
                live[pool.submit(objective, p.values(at))] = at
                begun += 1
            if not live:
                break
            ended, _ = wait(live, return_when=FIRST_COMPLETED)
            for f in ended:
                at = live.pop(f)
                loss = float(f.result())
                p.tell(at, loss)
                done.append((p.values(at), loss))
    best = min(done, key=lambda t: t[1] if t[1] == t[1] else math.inf)
    return Search(*best, done)


def boosting_space(trials: int) -> dict[str, Space]:
    """What is searched grows with the trials that there are. Bounds are fixed values."""
    space = {"columns": uniform(0.5, 1.0), "leaves": integer(16, 255)}
    if trials > 30:
        space |= {"rows": uniform(0.5, 1.0), "least_curvature": log(1e-3, 10.0)}
    if trials > 100:
        space |= {"alpha": log(1e-8, 10.0), "ridge": log(1e-8, 10.0)}
    return space


def tune_boosting(df: DataFrame, features: list[str], target: str, loss: Loss, params: Params, key: str, trials: int, parallel: int = 2, space: dict[str, Space] | None = None,
                  share: float = 0.2, timer: Timer | None = None, categorical: tuple[str, ...] = ()) -> tuple[Params, Search]:
    """(params with the best values found, the search). All trials read one persisted table, whose holdout a hash of the key picks."""
    h = hash_unit(F.concat_ws(":", F.lit("tune"), F.col(key).cast("string")))
    x = df.select(key, target, *[f for f in features if f not in (key, target)]).withColumn("_hold", F.when(h < share, 0).otherwise(1))
    x = x.persist(StorageLevel.MEMORY_AND_DISK)

    def objective(v: dict) -> float:
        b, _ = boosting.boost(x, features, target, loss, replace(params, **v), 1, "_p", key, fold="_hold", categorical=categorical)
        return b.history[0][b.best[0]]

    try:
        found = minimise(objective, space or boosting_space(trials), trials, parallel, params.seed, timer)
    finally:
        x.unpersist()
    return replace(params, **found.best), found

