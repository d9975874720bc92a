"""Graphs of models in levels: a level's features are the predictions of the level before, and with skip also the columns.

Nested training takes each outer fold's rows out of everything that its predictions come from: the whole graph is grown on
the other rows, with folds of their own inside, and predicts the rows that it has not seen. Without nesting all levels
share the outer folds, so that a level's training rows carry predictions of models that knew the fold's targets.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from ..functions import metrics as M
from ..operators import blend, boosting, models
from ..operators.boosting import Params
from .pipelines import nested_folds


@dataclass(frozen=True)
class Task:
    """What a graph is trained for."""

    name: str
    target: str
    key: str
    classes: int = 2


@dataclass(frozen=True)
class Boost:
    """A node of boosted trees, stopped on each fold."""

    params: Params = Params(rounds=20, rate=0.2, depth=4, patience=5)
    loss: str | losses.Loss | None = None
    categorical: tuple[str, ...] = ()

    def fit(self, df: DataFrame, features: list[str], task: Task, fold: str, n: int, name: str):
        cats = tuple(c for c in self.categorical if c in features)
        return boosting.boost(df, features, task.target, losses.of(task.name, self.loss, task.classes), self.params, n, name, task.key, fold=fold, categorical=cats)


@dataclass(frozen=True)
class Linear:
    """A node of a linear path over the numeric features; missing numbers count as 0."""

    path: tuple[float, ...] = (1e-2, 1.0)
    l1: bool = False

    def fit(self, df: DataFrame, features: list[str], task: Task, fold: str, n: int, name: str):
        kinds = {f: df.schema[f].dataType.typeName() for f in features}
        numbers = [f for f in features if kinds[f] not in ("string", "date", "timestamp", "array")]
        filled = [f"_lin__{f}" for f in numbers]
        put = lambda d: d.withColumns({g: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(0.0)) for f, g in zip(numbers, filled)})
        m, out, _ = models.linear_path(put(df), filled, task.target, task.name, n, name, self.l1, self.path, n_classes=task.classes, fold=fold)
        return _Prepared(m, put, filled), out.drop(*filled)


@dataclass
class _Prepared:
    model: models.Fitted
    put: Callable[[DataFrame], DataFrame]
    made: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(self.put(df)).drop(*self.made)


@dataclass
class Graph:
    """fit_predict gives out-of-fold predictions, predict those of new rows (the mean of the outer folds' graphs if nested).

    levels: lists of nodes; the last level's predictions are averaged. inner: folds inside each outer fold's rest. Outer folds
    are jobs of their own, parallel at a time.
    """

    levels: list[list[object]]
    skip: bool = True
    nested: bool = True
    inner: int = 3
    parallel: int = 2
    chains: list[list[list[object]]] = field(default_factory=list, init=False)

    def fit_predict(self, df: DataFrame, features: list[str], task: Task, n_folds: int, fold: str = "fold", name: str = "prediction") -> DataFrame:
        self.task, self.features, self.name = task, features, name
        if not self.nested:
            chain, out = self._chain(df, fold, n_folds)
            self.chains = [chain]
            return self._last(out, df.columns)
        held = nested_folds(df, task.key, fold, self.inner, "_inner").persist(StorageLevel.MEMORY_AND_DISK)

        def one(k: int):
            chain, _ = self._chain(held.where(F.col(fold) != k), "_inner", self.inner)
            return chain, self._last(self._apply(held.where(F.col(fold) == k), chain), df.columns)

        with ThreadPoolExecutor(self.parallel) as pool:
            done = list(pool.map(one, range(n_folds)))
        self.chains, self._held = [c for c, _ in done], held
        return reduce(DataFrame.unionByName, [out for _, out in done])

    def release(self) -> None:
        """Let go of the training table, once the out-of-fold predictions have been read."""
        if self.nested:
            self._held.unpersist()

    def predict(self, df: DataFrame) -> DataFrame:
        names = []
        x = df
        for i, chain in enumerate(self.chains):
            x = self._last(self._apply(x, chain), x.columns).withColumnRenamed(self.name, f"_chain{i}")
            names.append(f"_chain{i}")
        return x.withColumn(self.name, self._mean(names)).drop(*names)

    def _chain(self, df: DataFrame, fold: str, n: int) -> tuple[list[list[object]], DataFrame]:
        """(fitted nodes of each level, df with the out-of-fold predictions of all levels)."""
        chain, features = [], self.features
        for i, level in enumerate(self.levels):
            fitted = []
            for j, node in enumerate(level):
                m, df = node.fit(df, features, self.task, fold, n, f"_p{i}_{j}")
                fitted.append(m)
            chain.append(fitted)
            df, features = self._inputs(df, i)
        return chain, df

    def _apply(self, df: DataFrame, chain: list[list[object]]) -> DataFrame:
        for i, level in enumerate(chain):
            for m in level:
                df = m.predict(df)
            df, _ = self._inputs(df, i)
        return df

    def _inputs(self, df: DataFrame, i: int) -> tuple[DataFrame, list[str]]:
        """df with a level's predictions as columns that the next level can read, and the features of the next level."""
        names = [f"_p{i}_{j}" for j in range(len(self.levels[i]))]
        if self.task.name == "multiclass":
            df = df.withColumns({f"{p}_{k}": F.col(p)[k] for p in names for k in range(self.task.classes)})
            flat = [f"{p}_{k}" for p in names for k in range(self.task.classes)]
        else:
            flat = names
        return df, flat + (self.features if self.skip else [])

    def _mean(self, names: list[str]):
        ones = [1.0] * len(names)
        return blend.class_blend(self.task.classes)(names, ones) if self.task.name == "multiclass" else blend.weighted_blend(names, ones)

    def _last(self, df: DataFrame, columns: list[str]) -> DataFrame:
        names = [f"_p{len(self.levels) - 1}_{j}" for j in range(len(self.levels[-1]))]
        return df.withColumn(self.name, self._mean(names)).select(*[F.col(f"`{c}`") for c in columns if c != "_inner"], self.name)


def utilise(df: DataFrame, features: list[str], task: Task, n_folds: int, graphs: list[Graph], seconds: float, fold: str = "fold") -> tuple[list[Graph], list[float], DataFrame]:
    """(graphs that the time allowed, one at least; their weights in the outer blend; key, target, their predictions and prediction)."""
    timer = models.Timer(seconds, mode=2)
    done: list[Graph] = []
    out = df.select(task.key, task.target, fold)
    for i, g in enumerate(graphs):
        if done and timer.out():
            break
        before = timer.left()
        got = g.fit_predict(df, features, task, n_folds, fold, f"graph_{i}")
        out = out.join(got.select(task.key, f"graph_{i}"), task.key, "left")
        done.append(g)
        timer.runs.append(0.0 if seconds == float("inf") else before - timer.left())
    names = [g.name for g in done]
    y = F.col(task.target).cast("double")
    loss = {"reg": M.mse, "binary": M.logloss, "multiclass": M.crossent_of}[task.name]
    mixed = blend.class_blend(task.classes) if task.name == "multiclass" else blend.weighted_blend
    weights = blend.optimise_weights(out, names, lambda p: loss(y, p), -1, blended=mixed) if len(names) > 1 else [1.0]
    return done, weights, out.withColumn("prediction", mixed(names, weights))
