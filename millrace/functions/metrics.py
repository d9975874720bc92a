"""Task metrics as aggregates. Simple ones are aggregate columns (any number of them in one pass); rank metrics group by
score first, so that ties count half and the running sums go over distinct scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .running import numbered, running
from .scalar import clip


def _mean(e: Column, w: Column | None) -> Column:
    return F.avg(e) if w is None else F.sum(e * w) / F.sum(w)


def mse(t, p, w=None):
    return _mean((t - p) * (t - p), w)


def mae(t, p, w=None):
    return _mean(F.abs(t - p), w)


def r2(t, p, w=None):
    """1 - residual / total sum of squares."""
    if w is None:
        return F.lit(1.0) - F.sum((t - p) * (t - p)) / (F.sum(t * t) - F.sum(t) * F.sum(t) / F.count(t))
    return F.lit(1.0) - F.sum(w * (t - p) * (t - p)) / (F.sum(w * t * t) - F.sum(w * t) * F.sum(w * t) / F.sum(w))


def rmsle(t, p, w=None):
    return F.sqrt(_mean((F.log1p(p) - F.log1p(t)) * (F.log1p(p) - F.log1p(t)), w))


def mape(t, p, w=None):
    return _mean(F.try_divide(F.abs(t - p), F.abs(t)), w)


def huber(t, p, w=None, a: float = 0.9):
    e = F.abs(p - t)
    return _mean(F.when(e < a, e * e * 0.5).otherwise(e * a - F.lit(a * a * 0.5)), w)


def fair(t, p, w=None, c: float = 0.9):
    x = F.abs(p - t) / F.lit(c)
    return _mean(F.lit(c * c) * (x - F.log(x + 1)), w)


def quantile(t, p, w=None, q: float = 0.9):
    """Errors above weigh q, below 1 - q (the other way round than the pinball loss)."""
    e = p - t
    return _mean(F.when(e > 0, F.lit(q)).otherwise(F.lit(1 - q)) * F.abs(e), w)


def logloss(t, p, w=None, eps: float = 1e-7):
    q = clip(p, eps, 1 - eps)
    return _mean(-(t * F.log(q) + (F.lit(1.0) - t) * F.log(F.lit(1.0) - q)), w)


def accuracy(t, p, w=None):
    """Of a probability cut at 0.5 (more than)."""
    return _mean(((p > 0.5).cast("double") == t.cast("double")).cast("double"), w)


def crossentropy(t: Column, ps: list[Column], w=None, eps: float = 1e-7):
    """t is the class number, ps the classes' probabilities."""
    hit = F.element_at(F.array(*ps), t.cast("int") + 1)
    return _mean(-F.log(clip(hit, eps, 1 - eps)), w)


def best_class(ps: list[Column]) -> Column:
    """The first class with the greatest probability."""
    a = F.array(*ps)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def auc(df: DataFrame, target: str, score: str, *groups: str) -> DataFrame:
    """(groups, auc): the share of pairs of a 1 and a 0 that the score orders rightly, ties half."""
    by = df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.sum(F.col(target).cast("double")).alias("pos"), F.count("*").alias("n"))
    by = by.withColumn("neg", F.col("n") - F.col("pos"))
    by = running(by, score, ["neg"], *groups)
    hits = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") * 0.5)) / (F.sum("pos") * F.sum("neg"))
    return by.groupBy(*groups).agg(hits.alias("auc"))


def gini(df: DataFrame, target: str, score: str, key: str) -> DataFrame:
    """(gini): normalised Gini of the score, equal scores ordered by key."""
    x = df.where(F.col(score).isNotNull()).select(F.col(target).cast("double").alias("y"), F.col(score).alias("s"), F.col(key).alias("k"))
    by = running(x.groupBy("y").agg(F.count("*").alias("n")), "y", ["n"])  # equal targets may stand in any order
    total, rows = F.sum("y"), F.count("*")
    got = numbered(x, "i", "s", "k").agg((F.sum(F.col("y") * F.col("i")) / total).alias("at"), rows.alias("rows"))
    ends = F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)  # the mean place of the rows with this target
    best = by.agg((F.sum(F.col("y") * F.col("n") * ends) / F.sum(F.col("y") * F.col("n"))).alias("best"))
    half = (F.col("rows") + 1) / F.lit(2.0)
    return got.crossJoin(best).select(((half - F.col("at")) / (half - F.col("best"))).alias("gini"))


def auc_ovr(df: DataFrame, target: str, scores: list[str]) -> DataFrame:
    """(auc): mean over the classes of the AUC of each class against the others."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("class"), (F.col(target) == i).cast("int").alias("y"), F.col(s).alias("p")) for i, s in enumerate(scores)]))
    x = df.select(each.alias("_x")).select("_x.*")
    return auc(x, "y", "p", "class").agg(F.avg("auc").alias("auc"))


def auc_mu(df: DataFrame, target: str, scores: list[str]) -> DataFrame:
    """(auc): mean over the pairs of classes i < j of the AUC of p_j - p_i among the rows of the two classes."""
    k = range(len(scores))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(target) == j).cast("int").alias("y"), (F.col(scores[j]) - F.col(scores[i])).alias("p"), F.col(target).isin(i, j).alias("ok")) for i in k for j in k if i < j]
    x = df.select(F.explode(F.array(*pairs)).alias("_x")).select("_x.*").where("ok")
    return auc(x, "y", "p", "i", "j").agg(F.avg("auc").alias("auc"))


def confusion(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """(y, yhat, n, share): counts, and their share of the true class."""
    x = df.groupBy(F.col(target).alias("y"), F.col(predicted).alias("yhat")).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def f1(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """(f1_micro, f1_macro, f1_weighted) over all classes that occur; a class without hits has 0."""
    both = F.explode(F.array(F.struct(F.col(target).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    x = df.select(both.alias("_x"), (F.col(target) == F.col(predicted)).cast("int").alias("hit")).select("_x.*", "hit")
    by = x.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.col("hit") * F.col("t")).alias("tp"))
    by = by.withColumn("f", F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("t") + F.col("p")), F.lit(0.0)))
    return by.agg((F.sum("tp") / F.sum("t")).alias("f1_micro"), F.avg("f").alias("f1_macro"), (F.sum(F.col("f") * F.col("t")) / F.sum("t")).alias("f1_weighted"))


@dataclass(frozen=True)
class Metric:
    """An aggregate over target and prediction columns; sign turns it so that more is better."""

    name: str
    column: Callable
    sign: int

    def of(self, df: DataFrame, target: str, prediction: str, drop_missing: bool = True) -> float:
        p = F.col(prediction)
        several = isinstance(df.schema[prediction].dataType, ArrayType)
        missing = F.exists(p, lambda v: v.isNull() | F.isnan(v)) if several else F.isnan(p)
        x = df.where(p.isNotNull() & ~missing) if drop_missing else df
        if self.name == "auc":
            v = auc(x, target, prediction).first()
            return float("nan") if v is None or v.auc is None else v.auc
        v = x.agg(self.column(F.col(target).cast("double"), F.col(prediction)).alias("v")).first().v
        return float("nan") if v is None else self.sign * v


def crossent_of(t: Column, p: Column, eps: float = 1e-15) -> Column:
    """Cross-entropy of class numbers under an array with a probability for each class."""
    return crossent_hit(F.element_at(p, t.cast("int") + 1), eps)


def crossent_hit(hit: Column, eps: float = 1e-15) -> Column:
    """Cross-entropy by the probabilities of the rows' own classes."""
    return _mean(-F.log(clip(hit, eps, 1 - eps)), None)


def accuracy_of(t: Column, p: Column) -> Column:
    """Share of the rows whose first class with the greatest probability is the true one."""
    return _mean((F.array_position(p, F.array_max(p)) - 1 == t).cast("double"), None)


METRICS = {
    "multiclass": {"crossent": Metric("crossent", crossent_of, -1), "accuracy": Metric("accuracy", accuracy_of, 1)},
    "binary": {"auc": Metric("auc", None, 1), "logloss": Metric("logloss", logloss, -1), "accuracy": Metric("accuracy", accuracy, 1)},
    "reg": {
        "mse": Metric("mse", mse, -1), "mae": Metric("mae", mae, -1), "r2": Metric("r2", r2, 1), "rmsle": Metric("rmsle", rmsle, -1),
        "fair": Metric("fair", fair, -1), "huber": Metric("huber", huber, -1), "quantile": Metric("quantile", quantile, -1), "mape": Metric("mape", mape, -1),
    },
}


def better(metric: Callable[[float, float], float]) -> int:
    """1 if a metric (of target and prediction numbers) is greater for a good prediction than for a bad one, else -1."""
    return 1 if metric(1.0, 0.9) > metric(1.0, 0.1) else -1
