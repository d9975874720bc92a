"""Categorical encoders. All value counts of all columns come from one unpivot and one aggregate; lookups are joins, whose
size Spark knows at run time and broadcasts only below its threshold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHAS = (0.5, 1.0, 2.0, 5.0, 10.0, 50.0, 250.0, 1000.0)


def unpivoted(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(feature, value, *keep): a row for each row and column, values as text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("_p"), *keep).select("_p.feature", "_p.value", *keep)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n); null is a value."""
    return unpivoted(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))


@dataclass
class Lookup:
    """A fitted encoder: (feature, value, code...) rows, and how a row's value is looked up in them."""

    table: DataFrame
    columns: list[str]
    outputs: dict[str, tuple[str, object]]
    prefix: str

    def apply(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            codes = self.table.where(F.col("feature") == c).select(F.col("value").alias("_v"), *[F.col(k).alias(f"_{k}") for k in self.outputs])
            df = df.join(codes, F.col(c).cast("string").eqNullSafe(F.col("_v")), "left")
            names = {f"{self.prefix}__{c}" if len(self.outputs) == 1 else f"{name}__{c}": F.coalesce(F.col(f"_{k}"), F.lit(miss)) if miss is not None else F.col(f"_{k}") for k, (name, miss) in self.outputs.items()}
            df = df.withColumns(names).drop("_v", *[f"_{k}" for k in self.outputs])
        return df


def label_encoder(df: DataFrame, columns: list[str], cutoff: int = 5) -> Lookup:
    """le__x: 1..K by (count desc, value asc) of the values seen more than cutoff times; 0 for others."""
    w = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    t = value_counts(df, columns).where(F.col("n") > cutoff).withColumn("code", F.row_number().over(w))
    return Lookup(t, columns, {"code": ("le", 0)}, "le")


def freq_encoder(df: DataFrame, columns: list[str]) -> Lookup:
    """freq__x: how often the value was seen; 1 for values seen once or never."""
    t = value_counts(df, columns).where("n > 1").withColumn("code", F.col("n").cast("double"))
    return Lookup(t, columns, {"code": ("freq", 1.0)}, "freq")


def ordinal_encoder(df: DataFrame, columns: list[str], cutoff: int = 5) -> Lookup:
    """ord__x: rank of the value's text among those seen more than cutoff times, K + 1 for null, null for others."""
    seen = value_counts(df, columns).where(F.col("value").isNotNull() & (F.col("n") > cutoff))
    w = Window.partitionBy("feature").orderBy("value")
    ranks = seen.select("feature", "value", F.rank().over(w).cast("double").alias("code"))
    nulls = ranks.groupBy("feature").agg((F.max("code") + 1).alias("code")).select("feature", F.lit(None).cast("string").alias("value"), "code")
    return Lookup(ranks.unionByName(nulls), columns, {"code": ("ord", None)}, "ord")


@dataclass
class OneHot:
    """ohe_k__x for each whole number k from the smallest to the largest code; other codes are all 0."""

    ranges: dict[str, tuple[int, int]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> OneHot:
        row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        return OneHot({c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"ohe_{k}__{c}": F.coalesce((F.col(c) == k).cast("float"), F.lit(0.0).cast("float")) for c, (lo, hi) in self.ranges.items() for k in range(lo, hi + 1)})


def intersections(df: DataFrame, columns: list[str], depth: int = 2) -> tuple[DataFrame, list[str]]:
    """Columns (a__b): the values of each combination of 2..depth columns joined by `_`; and their names."""
    names = {f"({'__'.join(c)})": F.concat_ws("_", *[F.coalesce(F.col(x).cast("string"), F.lit("nan")) for x in c]) for k in range(2, depth + 1) for c in combinations(sorted(columns), k)}
    return df.withColumns(names), list(names)


@dataclass
class TargetEncoder:
    """Out-of-fold smoothed means: oof__x.

    cells: (feature, value, fold, code) with code = (sum + alpha * prior) / (count + alpha) over the other folds, prior
    the other folds' mean; full: (feature, value, code) over all rows for new data; alphas: the strength chosen for each
    feature by log loss (binary target) or squared error.
    """

    cells: DataFrame
    full: DataFrame
    prior: float
    columns: list[str]
    fold: str

    @staticmethod
    def fit(df: DataFrame, columns: list[str], target: str, fold: str, binary: bool = True, alphas: tuple[float, ...] = ALPHAS) -> TargetEncoder:
        x = unpivoted(df, columns, target, fold)
        y = F.col(target).cast("double")
        cell = x.groupBy("feature", "value", fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"), F.sum(y * y).alias("s2"))
        feature, value = Window.partitionBy("feature"), Window.partitionBy("feature", "value")
        per_fold = Window.partitionBy("feature", fold)
        cell = cell.select(
            "feature", "value", fold, "s", "n", "s2",
            (F.sum("s").over(value) - F.col("s")).alias("os"), (F.sum("n").over(value) - F.col("n")).alias("on"),
            ((F.sum("s").over(feature) - F.sum("s").over(per_fold)) / (F.sum("n").over(feature) - F.sum("n").over(per_fold))).alias("prior"),
        )
        grid = cell.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
        code = (F.col("os") + F.col("alpha") * F.col("prior")) / (F.col("on") + F.col("alpha"))
        grid = grid.withColumn("code", code)
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("code")))
        loss = -(F.col("s") * F.log(p) + (F.col("n") - F.col("s")) * F.log(F.lit(1.0) - p)) if binary else F.col("s2") - F.col("code") * F.col("s") * 2 + F.col("n") * F.col("code") * F.col("code")
        scored = grid.groupBy("feature", "alpha").agg(F.round(F.sum(loss), 6).alias("loss"))
        best = scored.groupBy("feature").agg(F.min(F.struct("loss", "alpha")).alias("b")).select("feature", F.col("b.alpha").alias("alpha"))
        cells = grid.join(best, ["feature", "alpha"]).select("feature", "value", fold, "alpha", "code")
        prior = df.agg(F.avg(y).alias("p")).first().p
        whole = x.groupBy("feature", "value").agg(F.sum(y).alias("s"), F.count(y).alias("n")).join(best, "feature")
        full = whole.select("feature", "value", "alpha", ((F.col("s") + F.col("alpha") * F.lit(prior)) / (F.col("n") + F.col("alpha"))).alias("code"))
        return TargetEncoder(cells, full, prior, columns, fold)

    def apply_train(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            t = self.cells.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col(self.fold).alias("_f"), F.col("code").alias(f"oof__{c}"))
            df = df.join(t, F.col(c).cast("string").eqNullSafe(F.col("_v")) & (F.col(self.fold) == F.col("_f")), "left").drop("_v", "_f")
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        """New rows: codes over all training rows; unseen values get the prior."""
        return Lookup(self.full, self.columns, {"code": ("oof", self.prior)}, "oof").apply(df)


@dataclass
class MulticlassTargetEncoder:
    """Out-of-fold class shares of several columns' values: oof_0__x, oof_1__x, ...

    cells: (feature, value, fold, alpha, code_0, ...) of `multiclass_target_encoder`; full: (feature, value, code_0, ...)
    over all rows with the same alpha, for new data; priors: the classes' shares, which unseen values get.
    """

    cells: DataFrame
    full: DataFrame
    priors: list[float]
    columns: list[str]
    fold: str

    @staticmethod
    def fit(df: DataFrame, columns: list[str], target: str, fold: str, classes: list, alphas: tuple[float, ...] = ALPHAS) -> MulticlassTargetEncoder:
        k = range(len(classes))
        hits = [F.sum((F.col(target) == F.lit(c)).cast("double")).alias(f"s{i}") for i, c in zip(k, classes)]
        row = df.agg(*hits, F.count(target).alias("n")).first()
        priors = [(row[f"s{i}"] or 0.0) / max(row.n, 1) for i in k]
        cells = None
        for c in columns:
            t = multiclass_target_encoder(df, c, target, fold, classes, alphas).withColumn("feature", F.lit(c))
            cells = t if cells is None else cells.unionByName(t)
        best = cells.groupBy("feature").agg(F.max("alpha").alias("alpha"))
        whole = unpivoted(df, columns, target).groupBy("feature", "value").agg(*hits, F.count(target).alias("n")).join(best, "feature")
        codes = [((F.col(f"s{i}") + F.col("alpha") * F.lit(p)) / (F.col("n") + F.col("alpha"))).alias(f"code_{i}") for i, p in zip(k, priors)]
        return MulticlassTargetEncoder(cells, whole.select("feature", "value", *codes), priors, columns, fold)

    def _outputs(self) -> dict[str, tuple[str, object]]:
        return {f"code_{i}": (f"oof_{i}", p) for i, p in enumerate(self.priors)}

    def apply_train(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            codes = [F.col(k).alias(f"{name}__{c}") for k, (name, _) in self._outputs().items()]
            t = self.cells.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col(self.fold).alias("_f"), *codes)
            df = df.join(t, F.col(c).cast("string").eqNullSafe(F.col("_v")) & (F.col(self.fold) == F.col("_f")), "left").drop("_v", "_f")
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        """New rows: codes over all training rows; unseen values get the classes' shares."""
        return Lookup(self.full, self.columns, self._outputs(), "oof").apply(df)


def multiclass_target_encoder(df: DataFrame, column: str, target: str, fold: str, classes: list, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(value, fold, alpha, code_0..): out-of-fold class shares of a column's values, adding up to 1.

    Each class share is smoothed towards the other folds' share; alpha is chosen by the log loss of the true class.
    """
    y = F.col(target)
    k = range(len(classes))
    cell = df.groupBy(F.col(column).cast("string").alias("value"), fold).agg(*[F.sum((y == F.lit(c)).cast("double")).alias(f"s{i}") for i, c in zip(k, classes)], F.count(y).alias("n"))
    value, every, per_fold = Window.partitionBy("value"), Window.partitionBy(), Window.partitionBy(fold)
    other: Callable = lambda c, w: F.sum(c).over(w) - F.col(c)
    rest: Callable = lambda c: F.sum(c).over(every) - F.sum(c).over(per_fold)
    cell = cell.select("value", fold, "n", *[f"s{i}" for i in k], *[other(f"s{i}", value).alias(f"o{i}") for i in k], other("n", value).alias("on"), *[(rest(f"s{i}") / rest("n")).alias(f"p{i}") for i in k])
    grid = cell.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    raw = [(F.col(f"o{i}") + F.col("alpha") * F.col(f"p{i}")) / (F.col("on") + F.col("alpha")) for i in k]
    total = sum(raw[1:], raw[0])
    grid = grid.withColumns({f"code_{i}": r / total for i, r in zip(k, raw)})
    loss = sum((-F.col(f"s{i}") * F.log(F.greatest(F.lit(1e-15), F.col(f"code_{i}"))) for i in k), F.lit(0.0))
    best = grid.groupBy("alpha").agg(F.round(F.sum(loss), 6).alias("loss")).agg(F.min(F.struct("loss", "alpha")).alias("b")).select(F.col("b.alpha").alias("alpha"))
    return grid.join(best, "alpha").select("value", fold, "alpha", *[f"code_{i}" for i in k])
