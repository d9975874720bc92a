"""Models over Spark ML: linear paths and boosted trees with out-of-fold predictions, tuning and importance."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from ..functions.scalar import hash_unit
from ..plans.folds import splits
from ..sources.shared import hold
from . import newton

#: Inverse regularisation strengths of the linear paths (fixed values).
L2_PATH = (1e-5, 5e-5, 1e-4, 5e-4, 1e-3, 5e-3, 1e-2, 5e-2, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1e3, 5e3, 1e4, 5e4, 1e5)
L1_PATH = (1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0, 1e3, 1e4, 1e5)

#: What a search over strengths or parameters makes smallest.
LOSSES = {"reg": METRICS["reg"]["mse"], "binary": METRICS["binary"]["logloss"], "multiclass": METRICS["multiclass"]["crossent"]}


@dataclass
class Timer:
    """A time budget: mode 0 never stops, 1 stops when the budget is gone, 2 when the next task likely would not fit."""

    seconds: float = float("inf")
    mode: int = 1
    start: float = field(default_factory=time.monotonic)
    runs: list[float] = field(default_factory=list)

    def left(self) -> float:
        return self.seconds - (time.monotonic() - self.start)

    def out(self) -> bool:
        if self.mode == 0:
            return False
        mean = sum(self.runs) / len(self.runs) if self.runs else 0.0
        return self.left() <= (mean if self.mode == 2 else 0.0)


def _assemble(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")


def linear(task: str, reg: float, l1: bool = False, weight: str | None = None):
    common = {"featuresCol": "_features", "labelCol": "_y", "predictionCol": "_p", "regParam": reg, "elasticNetParam": float(l1), "standardization": False, "maxIter": 100}
    if weight:
        common["weightCol"] = weight
    return LinearRegression(**common) if task == "reg" else LogisticRegression(**common, probabilityCol="_prob", rawPredictionCol="_raw")


def trees(task: str, depth: int = 5, rounds: int = 20, rate: float = 0.1, seed: int = 42, n_classes: int = 2):
    common = {"featuresCol": "_features", "labelCol": "_y", "predictionCol": "_p", "maxDepth": depth, "seed": seed}
    if task == "reg":
        return GBTRegressor(**common, maxIter=rounds, stepSize=rate)
    if task == "binary" and n_classes == 2:
        return GBTClassifier(**common, maxIter=rounds, stepSize=rate).setRawPredictionCol("_raw").setProbabilityCol("_prob")
    return RandomForestClassifier(**common, numTrees=rounds, rawPredictionCol="_raw", probabilityCol="_prob")


@dataclass
class Fitted:
    """Fold models; a prediction is the mean of theirs."""

    models: list[PipelineModel | newton.Weights]
    task: str
    name: str
    n_classes: int = 1

    def _one(self, df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
        if isinstance(model, newton.Weights):
            return df.withColumn(name, model.column())
        out = model.transform(df)
        if self.task == "multiclass":
            p = vector_to_array("_prob")  # a fold without the last classes has a shorter vector
            got = {name: F.array(*[F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(self.n_classes)])}
        elif self.task == "binary":
            got = {name: vector_to_array("_prob")[1]}
        else:
            got = {name: F.col("_p")}
        return out.withColumns(got).drop("_features", "_raw", "_prob", "_p", "_y", *[c for c in out.columns if c.startswith("_hot__")])

    def predict(self, df: DataFrame) -> DataFrame:
        names = [f"_fold{i}" for i in range(len(self.models))]
        for m, n in zip(self.models, names):
            df = self._one(df, m, n)
        if self.task == "multiclass":
            mean = F.array(*[sum((F.col(n)[k] for n in names), F.lit(0.0)) / len(names) for k in range(self.n_classes)])
        else:
            mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        return df.withColumn(self.name, mean).drop(*names)

    def importance(self, features: list[str]) -> dict[str, float]:
        """Mean over the folds of trees' gains or of linear weights' sizes."""
        total = dict.fromkeys(features, 0.0)
        for m in self.models:
            last = m.stages[-1]
            v = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
            for f, x in zip(features, v.toArray()):
                total[f] += abs(float(x)) / len(self.models)
        return total


def fit_folds(df: DataFrame, features: list[str], target: str, task: str, estimator, n_folds: int, name: str, fold: str = "fold", parallel: int = 2, timer: Timer | None = None, n_classes: int = 1, stages: list | None = None, stored: bool = False) -> tuple[Fitted, DataFrame]:
    """(models, df with out-of-fold predictions). Folds are independent Spark jobs, a few of them at a time.

    The first fold is always trained; rows of folds that time did not allow have a null prediction. stages: what makes the
    feature vector, by default an assembler of the features. stored: df is a stored table; any other is made once for all
    passes of all folds (a join in it would send its small side to the driver with each of them).
    """
    y = df.withColumn("_y", F.col(target).cast("double"))
    if not stored:
        y = y.persist(StorageLevel.MEMORY_AND_DISK)
    pipe = Pipeline(stages=[*(stages or [_assemble(features)]), estimator])

    def run(part):
        k, train, valid = part
        if k and timer is not None and timer.out():
            return None
        began = time.monotonic()
        model = pipe.fit(train)
        if timer is not None:
            timer.runs.append(time.monotonic() - began)
        return model, valid

    try:
        with ThreadPoolExecutor(parallel) as pool:
            done = list(pool.map(run, splits(y, n_folds, fold)))
    finally:
        if not stored:
            y.unpersist()
    fitted = Fitted([d[0] for d in done if d], task, name, n_classes)
    parts = [fitted._one(d[1], d[0], name) for d in done if d]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    missed = [k for k, d in enumerate(done) if d is None]
    if missed:
        out = out.unionByName(df.where(F.col(fold).isin(missed)).withColumn(name, F.lit(None).cast(out.schema[name].dataType)))
    return fitted, out


def linear_path(df: DataFrame, features: list[str], target: str, task: str, n_folds: int, name: str, l1: bool = False, path: tuple[float, ...] | None = None, patience: int = 2, timer: Timer | None = None, n_classes: int = 1, stages: list | None = None, fold: str = "fold") -> tuple[Fitted, DataFrame, float]:
    """The best strength of a path from strong to weak regularisation, stopping after patience strengths without gain.

    Strength C means a penalty of 1/(2 n C) for the log loss and sd(y)/(4 n C) for squared error. Squared penalties of few
    features are fitted by Newton's method, all folds in the same passes.
    """
    if not l1 and stages is None and max(1, n_classes if task == "multiclass" else 1) * (len(features) + 1) <= newton.DENSE:
        return _newton_path(df, features, target, task, n_folds, name, path or L2_PATH, patience, timer, n_classes, fold)
    df = hold(df)
    n = df.count()
    sd = df.agg(F.stddev_pop(F.col(target).cast("double")).alias("s")).first().s or 1.0 if task == "reg" else 1.0
    metric = LOSSES[task]
    best, bad = None, 0
    for c in path or (L1_PATH if l1 else L2_PATH):
        if best and timer is not None and timer.out():
            break
        reg = 1 / (n * c) if l1 and task != "reg" else 1 / (2 * n * c) if task != "reg" else sd / (4 * n * c)
        fitted, out = fit_folds(df, features, target, task, linear(task, reg, l1), n_folds, name, fold, n_classes=n_classes, stages=stages, stored=True)
        score = metric.of(out, target, name)
        if best is None or score > best[0]:
            best, bad = (score, fitted, out, c), 0
        else:
            bad += 1
            if bad >= patience:
                break
    return best[1], best[2], best[3]


def _newton_path(df: DataFrame, features: list[str], target: str, task: str, n_folds: int, name: str, path: tuple[float, ...], patience: int, timer: Timer | None, n_classes: int, fold: str) -> tuple[Fitted, DataFrame, float]:
    k = n_classes if task == "multiclass" else 1
    _, unit = newton.penalties(df, target, task, n_folds, fold)
    some = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
    x = F.array(*[F.col(f).cast("double") for f in features]) if features else F.array().cast("array<double>")
    table = some.select(F.col(target).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), x.alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    spec = newton.Spec(task, k, len(features), 0, unit, np.zeros((n_folds, k, 1 + len(features))))
    best, bad = None, 0
    try:
        for c in path:
            if best and timer is not None and timer.out():
                break
            began = time.monotonic()
            spec.penalty = unit / c
            newton.solve(table, spec)
            if timer is not None:
                timer.runs.append(time.monotonic() - began)
            fitted = Fitted([newton.Weights(features, t[:, 1:].copy(), t[:, 0].copy(), task) for t in spec.theta], task, name, n_classes)
            score = -newton.own_losses(table, spec)
            if best is None or score > best[0]:
                best, bad = (score, fitted, c), 0
            else:
                bad += 1
                if bad >= patience:
                    break
    finally:
        table.unpersist()
    return best[1], by_fold(df, best[1], fold), best[2]


def by_fold(df: DataFrame, fitted: Fitted, fold: str) -> DataFrame:
    """The rows of the folds with the prediction of their fold's model, in one scan; weights are columns or numbers."""
    p = None
    for i, m in enumerate(fitted.models):
        own = F.col(fold) == i
        p = F.when(own, m.column()) if p is None else p.when(own, m.column())
    return df.where(F.col(fold).isin(list(range(len(fitted.models))))).withColumn(fitted.name, p)


def text_oof(df: DataFrame, tokens: str, target: str, task: str, n_folds: int, name: str, slots: int = 1 << 16, strength: float = 0.1, steps: int = 30, fold: str = "fold", n_classes: int = 1) -> tuple[Fitted, DataFrame]:
    """(models, df with a text's score as an out-of-fold feature): a linear model of hashed token counts for each fold, fitted on
    the other folds. Vectors are sparse, weights are as many as slots, whatever the vocabulary."""
    hashing = HashingTF(inputCol=tokens, outputCol="_hot__text", numFeatures=slots)
    term = [IDF(inputCol="_hot__text", outputCol="_hot__idf"), Normalizer(inputCol="_hot__idf", outputCol="_features")]
    x = df.withColumn(tokens, F.coalesce(tokens, F.array().cast("array<string>")))
    x = hold(hashing.transform(x))  # each fold reads it several times; texts are made into tokens once
    n = x.count()
    fitted, out = fit_folds(x, [], target, task, linear(task, 1 / (2 * max(1, n) * strength)).setMaxIter(steps), n_folds, name, fold, n_classes=n_classes, stages=term, stored=True)
    fitted.models = [PipelineModel([hashing, *m.stages]) for m in fitted.models]
    return fitted, out


def tune(df: DataFrame, features: list[str], target: str, task: str, key: str, trials: int = 4, seed: int = 42, timer: Timer | None = None, n_classes: int = 1) -> dict:
    """Tree parameters by a seeded random search on a hash holdout, within a budget of trials and time."""
    import random

    rng = random.Random(seed)
    h = hash_unit(F.concat_ws(":", F.lit("tune"), F.col(key).cast("string")))
    y = df.withColumn("_y", F.col(target).cast("double"))
    train, valid = y.where(h >= 0.2), y.where(h < 0.2)
    metric = LOSSES[task]
    best = None
    for _ in range(trials):
        if best and timer is not None and timer.out():
            break
        params = {"depth": rng.randint(2, 6), "rounds": rng.choice([10, 20, 40]), "rate": 10 ** rng.uniform(-1.5, -0.5)}
        model = Pipeline(stages=[_assemble(features), trees(task, **params)]).fit(train)
        score = metric.of(Fitted([model], task, "_s", n_classes).predict(valid), target, "_s")
        if best is None or score > best[0]:
            best = score, params
    return best[1]


def permutation_importance(fitted: Fitted, df: DataFrame, features: list[str], target: str, key: str, metric) -> dict[str, float]:
    """Loss of score when a column's values are dealt out anew."""
    from .selection import permuted

    base = metric.of(fitted.predict(df), target, fitted.name)
    return {f: base - metric.of(fitted.predict(permuted(df, f, key)), target, fitted.name) for f in features}


def forward_selection(features: list[str], importance: dict[str, float], evaluate: Callable[[list[str]], float], group: int = 1, max_features: int | None = None) -> list[str]:
    """Features in groups by importance, each group kept if it makes the score better."""
    order = sorted(features, key=lambda f: (-importance.get(f, 0.0), f))
    kept: list[str] = []
    best = float("-inf")
    for i in range(0, len(order), group):
        cand = kept + order[i : i + group]
        if max_features and len(cand) > max_features:
            break
        s = evaluate(cand)
        if s > best:
            kept, best = cand, s
    return kept


def woe_table(df: DataFrame, column: str, target: str) -> DataFrame:
    """(value, n, woe, iv): weight of evidence ln(share of 1s / share of 0s) of each bin (half a row added), and its
    part of the information value."""
    from pyspark.sql import Window

    y = F.col(target).cast("double")
    by = df.groupBy(F.col(column).alias("value")).agg(F.sum(y).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy()
    b, g = (F.col("p") + 0.5) / F.sum("p").over(w), (F.col("n") - F.col("p") + 0.5) / F.sum(F.col("n") - F.col("p")).over(w)
    return by.select("value", "n", F.log(b / g).alias("woe"), ((b - g) * F.log(b / g)).alias("iv"))
