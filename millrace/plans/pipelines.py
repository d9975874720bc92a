"""Feature pipelines by role, scorecards, nested folds, and loops over configurations within a time budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash24, log_odds
from ..operators import categorical, dates, models, numeric
from ..operators.selection import drop_correlated, raw_name
from ..sources.shared import Workspace
from .automl import TabularAutoML
from .reader import Role


def columns_by_role(roles: dict[str, Role], name: str, **options) -> list[str]:
    """Sorted columns of a role whose options have the given values."""
    return sorted(c for c, r in roles.items() if r.name == name and all(r.options.get(k) == v for k, v in options.items()))


@dataclass
class Steps:
    """Fitted steps in a row; each maps a DataFrame to one with more columns. names: the features they make."""

    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def add(self, step: Callable[[DataFrame], DataFrame], names: list[str]) -> Steps:
        self.steps.append(step)
        self.names += names
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s(df)
        return df


def _times(times: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumns({f"time__{c}": dates.time_to_num(F.col(c)) for c in times})


def simple_features(df: DataFrame, roles: dict[str, Role]) -> Steps:
    """Categories as ordinals, times as days, numbers as they are."""
    nums, cats, times = (columns_by_role(roles, r) for r in ("numeric", "category", "datetime"))
    out = Steps().add(lambda d: d, nums)
    if times:
        out.add(_times(times), [f"time__{c}" for c in times])
    if cats:
        out.add(categorical.ordinal_encoder(df, cats).apply, [f"ord__{c}" for c in cats])
    return out


def advanced_features(df: DataFrame, roles: dict[str, Role], target: str, fold: str, binary: bool = True, oof_above: int = 10, crossed: int = 4, train: bool = True) -> Steps:
    """Numbers, date differences and seasons, counts, label codes of small and out-of-fold means of large categories, and
    out-of-fold means of the pairs of the first ``crossed`` categories by number of values.

    With train, apply is for the training rows (it needs their folds), else for new rows.
    """
    nums, cats, times = (columns_by_role(roles, r) for r in ("numeric", "category", "datetime"))
    out = Steps().add(lambda d: d, nums)
    if times:
        out.add(_times(times), [f"time__{c}" for c in times])
        pairs = [(a, b) for a, b in combinations(times, 2)]
        out.add(lambda d: d.withColumns({f"basediff_{a}__{b}": (dates.micros(F.col(b)) - dates.micros(F.col(a))) / F.lit(86_400e6) for a, b in pairs}), [f"basediff_{a}__{b}" for a, b in pairs])
        for c in times:
            out.add(lambda d, c=c: dates.seasons(d, c, ("m", "wd", "hour")), [f"season_{p}__{c}" for p in ("m", "wd", "hour")])
    if cats:
        row = df.agg(*[F.count_distinct(c).alias(c) for c in cats]).first()
        out.add(categorical.freq_encoder(df, cats).apply, [f"freq__{c}" for c in cats])
        small = [c for c in cats if row[c] <= oof_above]
        large = [c for c in cats if row[c] > oof_above]
        if small:
            out.add(categorical.label_encoder(df, small).apply, [f"le__{c}" for c in small])
        top = sorted(cats, key=lambda c: (-row[c], c))[:crossed]
        x, both = categorical.intersections(df, top) if len(top) > 1 else (df, [])
        if both:
            out.add(lambda d: categorical.intersections(d, top)[0], [])
        if large or both:
            enc = categorical.TargetEncoder.fit(x, large + both, target, fold, binary)
            out.add(enc.apply_train if train else enc.apply, [f"oof__{c}" for c in large + both])
    return out


def linear_features(df: DataFrame, roles: dict[str, Role], one_hot_up_to: int = 20) -> Steps:
    """Flags, medians and scales of numbers, log-odds of probabilities (numeric role with option prob), one-hot codes of
    categories with few values and counts of the others."""
    nums, cats, times = (columns_by_role(roles, r) for r in ("numeric", "category", "datetime"))
    probs = [c for c in nums if roles[c].options.get("prob")]
    nums = [c for c in nums if c not in probs]
    out = Steps()
    if probs:
        out.add(lambda d: numeric.to_log_odds(d, probs), [f"logodds__{c}" for c in probs])
    if times:
        out.add(_times(times), [])
    every = nums + [f"time__{c}" for c in times]
    if every:
        x = _times(times)(df) if times else df
        flags, fill = numeric.NanFlags.fit(x, every), numeric.FillMedian.fit(x, every)
        scale = numeric.StandardScaler.fit(fill.apply(x), list(f"fillnamed__{c}" for c in every))
        out.add(flags.apply, [f"nanflg__{c}" for c in flags.columns]).add(fill.apply, []).add(scale.apply, [f"scaler__{c}" for c in scale.stats])
    if cats:
        row = df.agg(*[F.count_distinct(c).alias(c) for c in cats]).first()
        few, many = [c for c in cats if row[c] <= one_hot_up_to], [c for c in cats if row[c] > one_hot_up_to]
        if few:
            le = categorical.label_encoder(df, few)
            hot = categorical.OneHot.fit(le.apply(df), [f"le__{c}" for c in few])
            out.add(le.apply, []).add(hot.apply, [f"ohe_{k}__{c}" for c, (lo, hi) in hot.ranges.items() for k in range(lo, hi + 1)])
        if many:
            out.add(categorical.freq_encoder(df, many).apply, [f"freq__{c}" for c in many])
    return out


@dataclass
class Scorecard:
    """Binned features as weights of evidence, those that tell little or double others left out, and an L1 logistic model."""

    bins: numeric.QuantileBinning
    tables: dict[str, dict]
    kept: list[str]
    model: models.Fitted | None = None

    @staticmethod
    def fit(df: DataFrame, numbers: list[str], categories: list[str], target: str, bins: int = 5, least_iv: float = 0.0, limit: float = 0.9, strength: float = 1e-3) -> Scorecard:
        made = Workspace(df.sparkSession)  # each statistic is a pass: a join in df would send its small side to the driver each time
        df = made.keep(df.select(*dict.fromkeys([*numbers, *categories, target])))
        q = numeric.QuantileBinning.fit(df, numbers, bins)
        x = q.apply(df)
        names = [f"qntl__{c}" for c in numbers] + categories
        tables, iv = {}, {}
        for c in names:
            rows = models.woe_table(x, c, target).collect()  # a row for each bin
            tables[c] = {r.value: r.woe for r in rows}
            iv[c] = sum(r.iv for r in rows)
        card = Scorecard(q, tables, [c for c in names if iv[c] > least_iv])
        coded = card.codes(df)
        card.kept = [c.removeprefix("woe__") for c in drop_correlated(coded, [f"woe__{c}" for c in card.kept], {f"woe__{c}": v for c, v in iv.items()}, limit)]
        est = models.linear("binary", strength, l1=True)
        y = coded.withColumn("_y", F.col(target).cast("double"))
        card.model = models.Fitted([Pipeline(stages=[models._assemble([f"woe__{c}" for c in card.kept]), est]).fit(y)], "binary", "score")
        made.clear()
        return card

    def codes(self, df: DataFrame) -> DataFrame:
        """woe__x of each kept feature; unseen values have 0."""
        x = self.bins.apply(df)

        def code(c: str):
            out = F.lit(0.0)
            for v, w in self.tables[c].items():
                out = F.when(F.col(c).eqNullSafe(F.lit(v)), F.lit(float(w))).otherwise(out)
            return out

        return x.withColumns({f"woe__{c}": code(c) for c in self.kept})

    def apply(self, df: DataFrame) -> DataFrame:
        return self.model.predict(self.codes(df))


def nested_folds(df: DataFrame, key: str, outer: str = "fold", n: int = 3, name: str = "inner") -> DataFrame:
    """Folds inside folds: independent of the outer ones, by a hash of the key with the outer fold."""
    return df.withColumn(name, (hash24(F.concat_ws(":", F.lit("inner"), F.col(outer).cast("string"), F.col(key).cast("string"))) % n).cast("int"))


#: Configurations that a time budget is spent on, one after the other.
CONFIGS = ({"algorithms": ("linear",)}, {"algorithms": ("trees",)}, {"algorithms": ("linear", "trees")})


def run_configs(df: DataFrame, target: str, key: str, task: str, seconds: float, configs=CONFIGS, n_folds: int = 2) -> tuple[list[TabularAutoML], list[DataFrame]]:
    """Models and out-of-fold predictions of as many configurations as the time allows, one at least."""
    timer = models.Timer(seconds, mode=2)
    done, preds = [], []
    for c in configs:
        if done and timer.out():
            break
        before = timer.left()
        m = TabularAutoML(task, n_folds=n_folds, seconds=max(0.0, timer.left()), **c)
        preds.append(m.fit_predict(df, target, key))
        done.append(m)
        timer.runs.append(before - timer.left() if seconds != float("inf") else 0.0)
    return done, preds


def stack_inputs(preds: list[DataFrame], key: str) -> DataFrame:
    """One table of the predictions of a level's models, as log-odds features of the next level."""
    out = None
    for i, p in enumerate(preds):
        x = p.select(key, log_odds(F.col("prediction")).alias(f"level1_{i}"))
        out = x if out is None else out.join(x, key)
    return out


def best_of(df: DataFrame, candidates: dict[str, Callable[[DataFrame], Steps]], criterion: Callable[[DataFrame, list[str]], float]) -> tuple[str, Steps]:
    """The candidate whose features score best: each fits on df, criterion takes the table and the features' names."""
    fitted = {k: f(df) for k, f in candidates.items()}
    score = {k: criterion(s.apply(df), s.names) for k, s in fitted.items()}
    best = max(fitted, key=lambda k: (score[k], k))
    return best, fitted[best]


def with_roles(df: DataFrame, roles: dict[str, Role]) -> DataFrame:
    """df whose columns carry their role and its options as metadata; data are untouched."""
    return df.select(*[F.col(c).alias(c, metadata={"role": roles[c].name, **roles[c].options}) if c in roles else F.col(c) for c in df.columns])
