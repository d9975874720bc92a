"""Sparse additive linear models: a weight for each number and for each value of a category.

Models of one score are fitted by Newton's method (`newton`). Values of small categories are places of the sums on the driver; those of a
category with many values are kept and found on executors, as a table of (value, weight of each fold's model). Several such
categories are fitted in turn, each for the others' weights, until the loss stays. Models of several classes are Spark's:
codes become sparse vectors inside their stages, and their weights are a vector on the driver.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..sources.shared import hold
from . import categorical, models, newton
from .models import Fitted, Timer

#: Logits and probabilities are kept inside these bounds (fixed values).
LOGIT, PROBABILITY = 50.0, 0.001


@dataclass
class Codes:
    """code__x of each category: the rank of a value seen more than cutoff times, 0 for all others; missing is a value."""

    lookup: categorical.Lookup | None
    categories: list[str]
    sizes: dict[str, int]

    @staticmethod
    def fit(df: DataFrame, categories: list[str], cutoff: int = 0) -> Codes:
        if not categories:
            return Codes(None, [], {})
        lookup = categorical.label_encoder(df, categories, cutoff)
        lookup.prefix = "code"
        rows = lookup.table.groupBy("feature").agg(F.max("code").alias("n")).collect()
        found = {r.feature: r.n for r in rows}
        return Codes(lookup, categories, {c: found.get(c, 0) + 1 for c in categories})

    def apply(self, df: DataFrame) -> DataFrame:
        return self.lookup.apply(df) if self.lookup is not None else df

    def stages(self, numbers: list[str]) -> list:
        """Stages that put numbers and codes into one sparse vector."""
        hot = [f"_hot__{c}" for c in self.categories]
        first = [OneHotEncoder(inputCols=[f"code__{c}" for c in self.categories], outputCols=hot, dropLast=False, handleInvalid="keep")] if hot else []
        return [*first, VectorAssembler(inputCols=[*numbers, *hot], outputCol="_features", handleInvalid="keep")]


@dataclass
class Additive:
    """A fitted model. numbers are to be filled and scaled."""

    codes: Codes
    numbers: list[str]
    fitted: Fitted
    strength: float
    task: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        if isinstance(self.fitted.models[0], newton.Weights):
            x = looked_up(df, self.tables)
            return bounded(self.fitted.predict(x), self.fitted).drop(*[f"_w__{c}" for c in self.tables])
        out = bounded(self.fitted.predict(self.codes.apply(df)), self.fitted)
        return out.drop(*[f"code__{c}" for c in self.codes.categories])

    def weights(self, fold: int = 0) -> DataFrame:
        """(feature, value, weight) of one fold's model: numbers with the value null, values of categories (and <OTHER>), and the
        intercept. With several classes weight is an array."""
        last = self.fitted.models[fold].stages[-1]
        if isinstance(last, newton.Weights):
            return self._tables_weights(last, fold)
        spark = SparkSession.active()
        several = self.task == "multiclass"
        w = last.coefficientMatrix.toArray().T.tolist() if several else last.coefficients.toArray().tolist()
        rows = [(n, None, w[i]) for i, n in enumerate(self.numbers)] + [("<INTERCEPT>", None, last.interceptVector.toArray().tolist() if several else last.intercept)]
        coded, at = [], len(self.numbers)
        sizes = [s.categorySizes for s in self.fitted.models[fold].stages if hasattr(s, "categorySizes")]
        for c, n in zip(self.codes.categories, sizes[0] if sizes else []):
            coded += [(c, k, w[at + k]) for k in range(n)]
            at += n + 1  # the stage keeps a slot for codes that it has not seen
        kind = "array<double>" if several else "double"
        out = spark.createDataFrame(rows, f"feature string, value string, weight {kind}")
        if not coded:
            return out
        t = spark.createDataFrame(coded, f"feature string, code int, weight {kind}")
        t = t.join(self.codes.lookup.table.select("feature", "code", "value"), ["feature", "code"], "left")
        return out.unionByName(t.select("feature", F.when(F.col("code") == 0, "<OTHER>").otherwise(F.coalesce("value", F.lit("<NULL>"))).alias("value"), "weight"))

    def _tables_weights(self, model: newton.Weights, fold: int) -> DataFrame:
        rows = [(n, None, float(w)) for n, w in zip(self.numbers, model.coef[0])] + [("<INTERCEPT>", None, model.intercept)]
        rows += [(c[4:], "<OTHER>", other) for c, _, other in model.extra]
        out = SparkSession.active().createDataFrame(rows, "feature string, value string, weight double")
        for c, t in self.tables.items():
            value = F.when(F.col("g") == MISSING, "<NULL>").otherwise(F.expr("substring(g, 2)"))
            out = out.unionByName(t.where(F.col("g") != OTHER).select(F.lit(c).alias("feature"), value.alias("value"), F.col("w")[fold].alias("weight")))
        return out


#: Names of the values in tables of weights: = and the value, a missing value, all values seen too seldom.
MISSING, OTHER = "0", "1"


def _named(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(MISSING))


def looked_up(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """df with _w__x, the weights of a category's value in each model; null for values without any."""
    for c, t in tables.items():
        df = df.join(t.select(F.col("g").alias("_g"), F.col("w").alias(f"_w__{c}")), _named(c) == F.col("_g"), "left").drop("_g")
    return df


def bounded(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Probabilities kept off 0 and 1; those of several classes are brought back to a sum of 1."""
    p = F.col(fitted.name)
    if fitted.task == "binary":
        return df.withColumn(fitted.name, F.when(p.isNotNull(), clip(p, PROBABILITY, 1 - PROBABILITY)))
    if fitted.task == "multiclass":
        low = F.transform(p, lambda v: clip(v, PROBABILITY, 1 - PROBABILITY))
        total: Column = F.aggregate(low, F.lit(0.0), lambda a, v: a + v)
        return df.withColumn(fitted.name, F.transform(low, lambda v: v / total))
    return df


#: Values of a large category with more rows than this (and than a 200th of all) are places of the sums on the driver.
HEAVY = 100_000
#: Turns over several large categories, and the share of the loss that ends them.
TURNS, GAIN = 30, 1e-7


def fit(df: DataFrame, numbers: list[str], categories: list[str], target: str, task: str, n_folds: int, name: str, path: tuple[float, ...] | None = None, cutoff: int = 0,
        fold: str = "fold", timer: Timer | None = None, n_classes: int = 1) -> tuple[Additive, DataFrame]:
    """(model, df with out-of-fold predictions) of the best strength of a path, from strong to weak penalties."""
    if task != "multiclass" and len(numbers) < newton.DENSE // 2:
        return _fit_tables(df, numbers, categories, target, task, n_folds, name, path or models.L2_PATH, cutoff, fold, timer)
    codes = Codes.fit(df, categories, cutoff)
    x = codes.apply(df)
    fitted, out, strength = models.linear_path(x, numbers, target, task, n_folds, name, path=path, timer=timer, n_classes=n_classes, stages=codes.stages(numbers), fold=fold)
    return Additive(codes, numbers, fitted, strength, task), bounded(out, fitted).drop(*[f"code__{c}" for c in categories])


def _fit_tables(df: DataFrame, numbers: list[str], categories: list[str], target: str, task: str, n_folds: int, name: str, path: tuple[float, ...], cutoff: int, fold: str, timer: Timer | None, patience: int = 2) -> tuple[Additive, DataFrame]:
    n, unit = newton.penalties(df, target, task, n_folds, fold)
    x = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
    x = x.select(F.col(target).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in numbers]).cast("array<double>").alias("x"), *[_named(c).alias(f"_v{j}") for j, c in enumerate(categories)])
    seen: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}
    for j, c in enumerate(categories):
        counts = x.groupBy(F.col(f"_v{j}").alias("g")).agg(F.count("*").alias("n"))
        if cutoff:
            counts = counts.groupBy(F.when(F.col("n") > cutoff, F.col("g")).otherwise(F.lit(OTHER)).alias("g")).agg(F.sum("n").alias("n"))
        seen[c] = hold(counts)
        sizes[c] = seen[c].count()
        if cutoff:
            x = x.join(seen[c].select(F.col("g").alias("_g")), F.col(f"_v{j}") == F.col("_g"), "left").withColumn(f"_v{j}", F.coalesce("_g", F.lit(OTHER))).drop("_g")
    large: list[str] = []
    room = newton.DENSE // 2 - len(numbers)
    while sum(s for c, s in sizes.items() if c not in large) > room:
        large.append(max((c for c in categories if c not in large), key=lambda c: sizes[c]))
    heavy = {c: F.col("n") > max(HEAVY, n * len(large) // 200) for c in large}
    place: dict[tuple[str, str], int] = {}
    for j, c in enumerate(categories):
        own = [r.g for r in seen[c].where(heavy.get(c, F.lit(True))).select("g").orderBy("g").collect()]
        place |= {(c, g): len(place) + i for i, g in enumerate(own)}
        some = df.sparkSession.createDataFrame([(g, place[c, g]) for g in own], "_g string, _c int")
        x = x.join(F.broadcast(some) if c in large else some, F.col(f"_v{j}") == F.col("_g"), "left").withColumn(f"_c{j}", F.coalesce("_c", F.lit(-1))).drop("_g", "_c")
    x = x.withColumn("c", F.array(*[F.col(f"_c{j}") for j in range(len(categories))]).cast("array<int>"))
    at = {c: j for j, c in enumerate(categories)}
    keep = ["y", "fold", "x", "c", *[f"_v{at[c]}" for c in large], *[f"_c{at[c]}" for c in large]]
    x = x.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)

    def grouped(c: str | None, others: dict[str, DataFrame]) -> DataFrame:
        t = x
        if others:
            for o, w in others.items():
                t = t.join(w.select(F.col("g").alias("_g"), F.col("w").alias(f"_w{at[o]}")), F.col(f"_v{at[o]}") == F.col("_g"), "left").drop("_g")
            t = t.withColumn("offset", F.array(*[sum((F.coalesce(F.col(f"_w{at[o]}")[i], F.lit(0.0)) for o in others), F.lit(0.0)) for i in range(n_folds)]))
        t = t.withColumn("g", F.when(F.col(f"_c{at[c]}") < 0, F.col(f"_v{at[c]}")))
        spread = F.coalesce(F.xxhash64("g"), F.xxhash64("y", "x", "c"))  # heavy values are no group and lie anywhere
        t = t.select("y", "fold", "x", "c", "g", *(["offset"] if others else [])).repartition(spread).sortWithinPartitions("g")
        return t.persist(StorageLevel.MEMORY_AND_DISK)

    theta = np.zeros((n_folds, 1, 1 + len(numbers) + len(place)))
    spec = newton.Spec(task, 1, len(numbers), len(place), unit, theta, bool(large))
    table = grouped(large[0], {}) if len(large) == 1 else x
    best, bad = None, 0
    found: dict[str, DataFrame] = {}
    try:
        for strength in path:
            if best and timer is not None and timer.out():
                break
            began = time.monotonic()
            spec.penalty = unit / strength
            if len(large) < 2:
                newton.solve(table, spec)
                found = {c: hold(newton.group_weights(table, spec)) for c in large}
            else:
                last = float("inf")
                for _ in range(TURNS):
                    for c in large:
                        t = grouped(c, {o: w for o, w in found.items() if o != c})
                        total = newton.solve(t, spec)
                        found = found | {c: hold(newton.group_weights(t, spec))}
                        t.unpersist()
                    squares = [found[c].agg(*[F.sum(F.col("w")[i] * F.col("w")[i]) for i in range(n_folds)]).first() for c in large[:-1]]
                    total += sum(0.5 * p * (s or 0.0) for row in squares for p, s in zip(spec.penalty, row))
                    if last - total <= GAIN * abs(total):
                        break
                    last = total
            if timer is not None:
                timer.runs.append(time.monotonic() - began)
            model, out = _model(df, spec, numbers, categories, place, found, sizes, name, fold, strength)
            score = models.LOSSES[task].of(out, target, name)
            if best is None or score > best[0]:
                best, bad = (score, model, out), 0
            else:
                bad += 1
                if bad >= patience:
                    break
    finally:
        table.unpersist()
        x.unpersist()
    return best[1], best[2]


def _model(df: DataFrame, spec: newton.Spec, numbers: list[str], categories: list[str], place: dict, found: dict[str, DataFrame], sizes: dict[str, int], name: str, fold: str, strength: float) -> tuple[Additive, DataFrame]:
    spark, tables, other = df.sparkSession, {}, {}
    for c in categories:
        rows = [(g, spec.theta[:, 0, 1 + len(numbers) + i].tolist()) for (f, g), i in place.items() if f == c]
        small = spark.createDataFrame(rows, "g string, w array<double>")
        tables[c] = found[c].unionByName(small) if c in found else small
        rare = next((w for g, w in rows if g == OTHER), None)
        if rare is None and c in found:
            rare = next((r.w for r in found[c].where(F.col("g") == OTHER).collect()), None)
        other[c] = rare or [0.0] * len(spec.theta)
    made = [newton.Weights(numbers, t[:, 1 : 1 + len(numbers)].copy(), t[:, 0].copy(), spec.task, [(f"_w__{c}", i, other[c][i]) for c in categories], sum(sizes.values())) for i, t in enumerate(spec.theta)]
    fitted = Fitted(made, spec.task, name)
    out = bounded(models.by_fold(looked_up(df, tables), fitted, fold), fitted).drop(*[f"_w__{c}" for c in categories])
    return Additive(Codes(None, categories, {}), numbers, fitted, strength, spec.task, tables), out
