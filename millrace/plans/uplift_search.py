"""Search over uplift learners: a graph of base models, each fitted once and shared, judged on held-out rows.

Learners differ in what they make of a few base models (outcomes of both arms and of all, the propensity, effects on
residuals). For each kind of base model these are fitted on the training rows when a learner first asks for them; every
learner's uplift is then scored on the holdout, and the one with the best area under its curve wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from ..functions.scalar import clip
from ..operators import boosting, metalearners, uplift
from ..operators.boosting import Params
from .folds import holdout

#: fit(df, features, target, task, key, weight) gives a model with a name and predict.
Fit = Callable[[DataFrame, list[str], str, str, str, str | None], object]


def linear(df: DataFrame, features: list[str], target: str, task: str, key: str, weight: str | None = None):
    return metalearners._fit(df, features, target, task, "_m", weight)


def boosted(params: Params = Params(rounds=20, rate=0.2, depth=4, patience=5)) -> Fit:
    """Boosted trees, stopped on a fifth of the rows that they are given."""

    def fit(df: DataFrame, features: list[str], target: str, task: str, key: str, weight: str | None = None):
        x = holdout(df, key, 0.2, "_stop").withColumn("_stop", F.when(F.col("_stop"), 0).otherwise(1))
        return boosting.boost(x, features, target, losses.of(task), params, 1, "_m", key, fold="_stop", weight=weight)[0]

    return fit


@dataclass
class Bases:
    """The base models of one kind; fits counts how often one was fitted."""

    train: DataFrame
    features: list[str]
    target: str
    treatment: str
    key: str
    task: str
    fit: Fit
    fits: int = 0
    known: dict[str, object] = field(default_factory=dict)

    def model(self, what: str, name: str):
        """A base model whose predictions are called name: outcome, outcome0, outcome1, propensity, effect0, effect1, residual, dependent."""
        if what not in self.known:
            self.known[what] = self._make(what)
            self.fits += 1
        return replace(self.known[what], name=name)

    @property
    def first(self) -> int:
        """The larger arm."""
        if not hasattr(self, "_first"):
            self._first = int((self.train.agg(F.avg(F.col(self.treatment).cast("double"))).first()[0] or 0.0) > 0.5)
        return self._first

    def _make(self, what: str):
        x, t, y = self.train, F.col(self.treatment), F.col(self.target).cast("double")
        if what == "outcome":
            return self.fit(x, self.features, self.target, self.task, self.key, None)
        if what in ("outcome0", "outcome1"):
            return self.fit(x.where(t == int(what[-1])), self.features, self.target, self.task, self.key, None)
        if what == "propensity":
            return self.fit(x, self.features, self.treatment, "binary", self.key, None)
        if what in ("effect0", "effect1"):  # what the other arm's model says of this arm's rows
            arm = int(what[-1])
            other = self.model(f"outcome{1 - arm}", "_o").predict(x.where(t == arm))
            return self.fit(other.withColumn("_d", (y - F.col("_o")) * (1 if arm else -1)), self.features, "_d", "reg", self.key, None)
        if what == "residual":
            z = self.model("outcome", "_o").predict(self.model("propensity", "_prop").predict(x))
            r = t.cast("double") - clip(F.col("_prop"), 0.01, 0.99)
            return self.fit(z.withColumns({"_d": (y - F.col("_o")) / r, "_w": r * r}), self.features, "_d", "reg", self.key, "_w")
        if what == "dependent":  # the smaller arm's outcome, knowing the larger arm's model
            z = self.model(f"outcome{self.first}", "_a").predict(x.where(t != self.first))
            return self.fit(z, [*self.features, "_a"], self.target, self.task, self.key, None)
        raise ValueError(what)


def t_learner(b: Bases, df: DataFrame) -> DataFrame:
    out = b.model("outcome1", "_m1").predict(b.model("outcome0", "_m0").predict(df))
    return out.withColumn("uplift", F.col("_m1") - F.col("_m0")).drop("_m0", "_m1")


def x_learner(b: Bases, df: DataFrame) -> DataFrame:
    out = b.model("propensity", "_prop").predict(b.model("effect1", "_e1").predict(b.model("effect0", "_e0").predict(df)))
    p: Column = F.col("_prop")
    return out.withColumn("uplift", p * F.col("_e0") + (F.lit(1.0) - p) * F.col("_e1")).drop("_prop", "_e0", "_e1")


def r_learner(b: Bases, df: DataFrame) -> DataFrame:
    return b.model("residual", "uplift").predict(df)


def td_learner(b: Bases, df: DataFrame) -> DataFrame:
    out = b.model("dependent", "_b").predict(b.model(f"outcome{b.first}", "_a").predict(df))
    sign = -1 if b.first else 1
    return out.withColumn("uplift", (F.col("_b") - F.col("_a")) * sign).drop("_a", "_b")


LEARNERS: dict[str, Callable[[Bases, DataFrame], DataFrame]] = {"t": t_learner, "x": x_learner, "r": r_learner, "td": td_learner}


@dataclass
class Found:
    """best: (kind, learner); areas of all candidates on the holdout; bases by kind, which predict new rows."""

    best: tuple[str, str]
    areas: dict[tuple[str, str], float]
    bases: dict[str, Bases]

    @property
    def fits(self) -> int:
        return sum(b.fits for b in self.bases.values())

    def predict(self, df: DataFrame) -> DataFrame:
        """df with uplift by the best learner."""
        kind, learner = self.best
        return LEARNERS[learner](self.bases[kind], df)


def search(df: DataFrame, features: list[str], target: str, treatment: str, key: str, task: str = "binary", kinds: dict[str, Fit] | None = None, learners: tuple[str, ...] = tuple(LEARNERS),
           share: float = 0.3, mode: str = "adj_qini") -> Found:
    """The learner and kind of base model with the best area on a hash holdout, in the order of ties: kinds, learners."""
    x = holdout(df, key, share, "_held").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = x.where(~F.col("_held")).drop("_held"), x.where(F.col("_held")).drop("_held")
        bases = {k: Bases(train, features, target, treatment, key, task, f) for k, f in (kinds or {"linear": linear, "boosted": boosted()}).items()}
        areas = {}
        for k, b in bases.items():
            for name in learners:
                got = LEARNERS[name](b, test)
                areas[k, name] = uplift.uplift_auc(got, target, "uplift", treatment, mode).first().auc
    finally:
        x.unpersist()
    return Found(max(areas, key=areas.get), areas, bases)
