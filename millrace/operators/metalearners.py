"""Uplift meta-learners over any pair of fit functions: each returns df with a column uplift."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Fitted, _assemble, linear


def _fit(df: DataFrame, features: list[str], target: str, task: str, name: str, weight: str | None = None) -> Fitted:
    y = df.withColumn("_y", F.col(target).cast("double"))
    return Fitted([Pipeline(stages=[_assemble(features), linear(task, 1e-4, weight=weight)]).fit(y)], task, name)


def s_learner(train: DataFrame, df: DataFrame, features: list[str], target: str, treatment: str, task: str = "binary") -> DataFrame:
    """One model with the treatment (and its products with the features) as features, scored at 1 and at 0."""
    crossed = [f"_x_{f}" for f in features]
    cross = lambda d: d.withColumns({c: F.col(f) * F.col(treatment) for c, f in zip(crossed, features)})
    m = _fit(cross(train), [*features, treatment, *crossed], target, task, "_s")
    out = df.withColumn("_t", F.col(treatment))
    for arm in (0, 1):
        m.name = f"_s{arm}"
        out = m.predict(cross(out.withColumn(treatment, F.lit(arm)))).drop(*crossed)
    return out.withColumn(treatment, F.col("_t")).withColumn("uplift", F.col("_s1") - F.col("_s0")).drop("_t", "_s0", "_s1")


def t_learner(train: DataFrame, df: DataFrame, features: list[str], target: str, treatment: str, task: str = "binary") -> DataFrame:
    """A model for each arm; the difference of their predictions."""
    out = df
    for arm in (0, 1):
        out = _fit(train.where(F.col(treatment) == arm), features, target, task, f"_m{arm}").predict(out)
    return out.withColumn("uplift", F.col("_m1") - F.col("_m0")).drop("_m0", "_m1")


def t2_learner(train: DataFrame, df: DataFrame, features: list[str], target: str, treatment: str, task: str = "binary", key: str | None = None, n: int = 3) -> DataFrame:
    """A model for each arm that sees both arms: the other arm is always in training with its treatment as a feature, the
    own arm in folds by key; the folds' models are averaged."""
    from ..functions.scalar import hash_fold

    out = df.withColumn("_t", F.col(treatment))
    names = []
    for arm in (0, 1):
        for k in range(n if key else 1):
            part = train.where((F.col(treatment) != arm) | (hash_fold(F.col(key), n) != k)) if key else train
            names.append((arm, f"_m{arm}_{k}"))
            m = _fit(part, [*features, treatment], target, task, names[-1][1])
            out = m.predict(out.withColumn(treatment, F.lit(arm)))
    mean = lambda arm: sum((F.col(n) for a, n in names if a == arm), F.lit(0.0)) / sum(a == arm for a, _ in names)
    out = out.withColumn("uplift", mean(1) - mean(0)).withColumn(treatment, F.col("_t"))
    return out.drop("_t", *[n for _, n in names])


def td_learner(train: DataFrame, df: DataFrame, features: list[str], target: str, treatment: str, task: str = "binary") -> DataFrame:
    """The smaller arm's model also sees the prediction of the larger arm's."""
    rate = train.agg(F.avg(F.col(treatment).cast("double")).alias("r")).first().r
    first = 1 if rate > 0.5 else 0
    a = _fit(train.where(F.col(treatment) == first), features, target, task, "_a")
    b = _fit(a.predict(train.where(F.col(treatment) != first)), [*features, "_a"], target, task, "_b")
    out = b.predict(a.predict(df))
    diff = F.col("_b") - F.col("_a") if first == 0 else F.col("_a") - F.col("_b")
    return out.withColumn("uplift", diff).drop("_a", "_b")


def x_learner(train: DataFrame, df: DataFrame, features: list[str], target: str, treatment: str, task: str = "binary") -> DataFrame:
    """Outcome models of both arms, models of the imputed effects, weighted by the propensity to be treated."""
    p = _fit(train, features, treatment, "binary", "_p1")
    m = [_fit(train.where(F.col(treatment) == arm), features, target, task, f"_m{arm}") for arm in (0, 1)]
    y = F.col(target).cast("double")
    d1 = m[0].predict(train.where(F.col(treatment) == 1)).withColumn("_d", y - F.col("_m0"))
    d0 = m[1].predict(train.where(F.col(treatment) == 0)).withColumn("_d", F.col("_m1") - y)
    e1, e0 = _fit(d1, features, "_d", "reg", "_e1"), _fit(d0, features, "_d", "reg", "_e0")
    out = e0.predict(e1.predict(p.predict(df)))
    return out.withColumn("uplift", F.col("_p1") * F.col("_e0") + (F.lit(1.0) - F.col("_p1")) * F.col("_e1")).drop("_p1", "_e0", "_e1")


def r_learner(train: DataFrame, df: DataFrame, features: list[str], target: str, treatment: str, task: str = "binary") -> DataFrame:
    """Residual outcome over residual treatment, weighted by the square of the latter."""
    p, m = _fit(train, features, treatment, "binary", "_p1"), _fit(train, features, target, task, "_m")
    x = m.predict(p.predict(train))
    r = F.col(treatment).cast("double") - F.col("_p1") + 1e-5
    x = x.withColumns({"_d": (F.col(target).cast("double") - F.col("_m")) / r, "_w": r * r}).drop("_p1", "_m")
    e = _fit(x, features, "_d", "reg", "uplift", weight="_w")
    return e.predict(df)


LEARNERS = {"s": s_learner, "t": t_learner, "t2": t2_learner, "td": td_learner, "x": x_learner, "r": r_learner}


def auto_uplift(df: DataFrame, features: list[str], target: str, treatment: str, key: str, names: tuple[str, ...] = ("s", "t", "x")) -> tuple[str, dict[str, float]]:
    """The learner with the best adjusted Qini area on a hash holdout, and all of their areas."""
    from ..plans.folds import holdout
    from .uplift import uplift_auc

    h = holdout(df, key)
    train, test = h.where(~F.col("holdout")), h.where(F.col("holdout"))
    got = {n: uplift_auc(LEARNERS[n](train, test, features, target, treatment), target, "uplift", treatment).first().auc for n in names}
    return max(got, key=got.get), got
