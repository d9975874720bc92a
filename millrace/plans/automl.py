"""The default product: read, make features, train linear and tree models out of fold, blend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from ..functions import metrics as M
from ..operators import additive, blend, boosting, categorical, dates, models, numeric, texts
from ..sources.shared import hold
from .folds import kfold, stratified_kfold
from .reader import Role, guess_roles, profile, usable
from .selectors import Problem, Selector
from .tuning import tune_boosting


@dataclass
class Features:
    """Fitted features of a table: medians, flags and scales of numbers, target means and counts of categories, dates as numbers."""

    numbers: list[str]
    categories: list[str]
    times: list[str]
    flags: numeric.NanFlags
    fill: numeric.FillMedian
    scale: numeric.StandardScaler
    means: categorical.TargetEncoder | categorical.MulticlassTargetEncoder | None
    counts: categorical.Lookup | None

    @staticmethod
    def fit(df: DataFrame, roles: dict[str, Role], target: str, task: str, fold: str = "fold", n_classes: int = 2) -> Features:
        by = lambda n: [c for c, r in roles.items() if r.name == n and c != target]
        numbers, categories, times = by("numeric"), by("category"), by("datetime")
        nums = numbers + [f"time__{c}" for c in times]
        x = df.withColumns({f"time__{c}": dates.time_to_num(F.col(c)) for c in times})
        fill = numeric.FillMedian.fit(x, nums) if nums else numeric.FillMedian({})
        filled = fill.apply(x)
        scale = numeric.StandardScaler.fit(filled, [f"fillnamed__{c}" for c in nums]) if nums else numeric.StandardScaler({})
        means = None
        if categories and task == "multiclass":
            means = categorical.MulticlassTargetEncoder.fit(df, categories, target, fold, list(range(n_classes)))
        elif categories:
            means = categorical.TargetEncoder.fit(df, categories, target, fold, task == "binary")
        counts = categorical.freq_encoder(df, categories) if categories else None
        if means is not None:  # small tables that a join of each category reads; lazy ones would count all rows for each of them
            means.cells, means.full, counts.table = hold(means.cells), hold(means.full), hold(counts.table)
        return Features(numbers, categories, times, numeric.NanFlags.fit(df, numbers) if numbers else numeric.NanFlags([]), fill, scale, means, counts)

    def apply(self, df: DataFrame, train: bool = False) -> DataFrame:
        x = df.withColumns({f"time__{c}": dates.time_to_num(F.col(c)) for c in self.times})
        x = self.scale.apply(self.fill.apply(self.flags.apply(x)))
        if self.means is not None:
            x = self.counts.apply(self.means.apply_train(x) if train else self.means.apply(x))
        return x

    @property
    def oof(self) -> list[str]:
        """Prefixes of the target means: one, or one for each class."""
        return [f"oof_{i}" for i in range(len(self.means.priors))] if isinstance(self.means, categorical.MulticlassTargetEncoder) else ["oof"]

    @property
    def names(self) -> list[str]:
        return [f"nanflg__{c}" for c in self.flags.columns] + [f"scaler__{c}" for c in self.scale.stats] + [f"{p}__{c}" for p in (*self.oof, "freq") for c in self.categories]


@dataclass
class TabularAutoML:
    """fit_predict gives out-of-fold predictions of the blend, predict those of new rows.

    With the task multiclass, targets are of any type, classes holds them in order, rows without a target are left out of
    training and of the result, and a prediction is an array with the probability of each class.

    algorithms: linear (encoded features), additive (a weight for each value of a category), trees (Spark's boosting; with
    several classes the same as boost), boost (histogram boosting on the raw columns, stopped on each fold). selector
    chooses columns before any of them is trained; with tuning, so many trials on a holdout set boost's parameters.
    Columns of the role text become features text__x: out-of-fold scores of a hashed linear text model (one for each class).
    loss: of the boosted models, a name or an object of functions.losses.
    """

    task: str
    n_folds: int = 3
    seconds: float = float("inf")
    algorithms: tuple[str, ...] = ("linear", "trees")
    selector: Selector | None = None
    tuning: int = 0
    boosting: boosting.Params = boosting.Params(rounds=20, rate=0.2, depth=4, patience=5)
    loss: str | losses.Loss | None = None

    def fit_predict(self, df: DataFrame, target: str, key: str, roles: dict[str, str] | None = None) -> DataFrame:
        timer = models.Timer(self.seconds)
        guessed = guess_roles(df.drop(target, key), roles)
        names = [c for c, r in guessed.items() if r.name != "drop"]
        ok = {r.feature for r in usable(profile(df, names)).where("ok").collect()}
        self.roles = {c: r for c, r in guessed.items() if c in ok}
        several = self.task == "multiclass"
        if several:
            self.classes = sorted(r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().collect())
            df = df.where(F.col(target).isNotNull()).withColumn("_class", (F.array_position(F.array(*map(F.lit, self.classes)), F.col(target)) - 1).cast("int"))
        k, label = (len(self.classes), "_class") if several else (1, target)
        if self.selector is not None:
            raw, columns = self._raw(df)
            self.selector.fit(raw, columns, Problem(label, self.task, key, k, tuple(self._categories()), params=self.boosting))
            self.roles = {c: r for c, r in self.roles.items() if c in self.selector.selected or f"time__{c}" in self.selector.selected}
        x = kfold(df, key, self.n_folds) if self.task == "reg" else stratified_kfold(df, key, target, self.n_folds)
        x = self._texts(hold(x), label, k)  # each statistic of the features is a pass over the numbered rows, none numbers them again
        x = hold(x) if self.text_models else x
        self.features = Features.fit(x, self.roles, label, self.task, n_classes=k)
        # every fold, strength and pass of a solver reads the features; lost or evicted blocks are computed anew
        x = kept = self.features.apply(x, train=True).persist(StorageLevel.MEMORY_AND_DISK)
        self.models = []
        for a in self.algorithms:
            if self.models and timer.out():
                break
            m, x = self._train(a, x, label, key, k, timer)
            self.models.append(m)
        y = F.col(label).cast("double")
        loss = {"reg": M.mse, "binary": M.logloss, "multiclass": M.crossent_of}[self.task]
        self.blended = blend.class_blend(k) if several else blend.weighted_blend
        preds = [m.fitted.name if isinstance(m, additive.Additive) else m.name for m in self.models]
        hit, extra = [], []
        if several and len(preds) > 1:
            own, mixed = blend.hits(preds, label)
            hit = [f"_hit{i}" for i in range(len(own))]
            extra = [*[c.alias(h) for c, h in zip(own, hit)], mixed.alias("_mixed")]
        x = hold(x.select(key, *dict.fromkeys((target, label)), *preds, *extra))  # each step of the blend reads the predictions
        if len(preds) == 1:
            self.weights = [1.0]
        elif hit and x.where("_mixed").isEmpty():  # one probability of each model is all that the loss needs of a row
            self.weights = blend.optimise_weights(x, hit, M.crossent_hit, -1, rounds=1)
        else:
            self.weights = blend.optimise_weights(x, preds, lambda p: loss(y, p), -1, rounds=1, blended=self.blended)
        self.names, self._kept = preds, kept
        return x.withColumn("prediction", self.blended(preds, self.weights)).select(key, target, *preds, "prediction")

    def _texts(self, x: DataFrame, label: str, k: int) -> DataFrame:
        """x with the features of its text columns, which count as numbers from here on."""
        self.text_models = {}
        for c in [c for c, r in self.roles.items() if r.name == "text"]:
            tokens = x.withColumn(f"_tokens__{c}", texts.tokens_en(F.col(c)))
            m, out = models.text_oof(tokens, f"_tokens__{c}", label, self.task, self.n_folds, f"text__{c}", n_classes=k)
            self.text_models[c] = m
            x, names = self._flat(out.drop(f"_tokens__{c}"), f"text__{c}", k)
            self.roles |= {n: Role("numeric") for n in names}
        return x

    def _flat(self, x: DataFrame, name: str, k: int) -> tuple[DataFrame, list[str]]:
        if self.task != "multiclass":
            return x, [name]
        names = [f"{name}_{i}" for i in range(k)]
        return x.withColumns({n: F.col(name)[i] for i, n in enumerate(names)}).drop(name), names

    def release(self) -> None:
        """Let go of the training features, once the out-of-fold predictions have been read."""
        self._kept.unpersist()

    def _categories(self) -> list[str]:
        return [c for c, r in self.roles.items() if r.name == "category"]

    def _raw(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """df and the columns that boosting and selectors read: numbers, categories, times as numbers."""
        times = [c for c, r in self.roles.items() if r.name == "datetime"]
        x = df.withColumns({f"time__{c}": dates.time_to_num(F.col(c)) for c in times})
        return x, [c for c, r in self.roles.items() if r.name in ("numeric", "category")] + [f"time__{c}" for c in times]

    def _train(self, algorithm: str, x: DataFrame, label: str, key: str, k: int, timer: models.Timer):
        """(model, x with its out-of-fold predictions)."""
        if algorithm == "linear":
            return models.linear_path(x, self.features.names, label, self.task, self.n_folds, "pred_linear", path=(1e-3, 1e-1, 10.0), timer=timer, n_classes=k)[:2]
        if algorithm == "additive":
            numbers = [f for f in self.features.names if f.startswith(("nanflg__", "scaler__"))]
            return additive.fit(x, numbers, self._categories(), label, self.task, self.n_folds, "pred_additive", (1e-3, 1e-1, 10.0), timer=timer, n_classes=k)
        if algorithm == "boost" or self.task == "multiclass":
            x, columns = self._raw(x)
            cats, loss = tuple(self._categories()), losses.of(self.task, self.loss, k)
            if self.tuning:
                self.boosting, self.search = tune_boosting(x, columns, label, loss, self.boosting, key, self.tuning, timer=timer, categorical=cats)
            return boosting.boost(x, columns, label, loss, self.boosting, self.n_folds, "pred_boost", key, out_of_time=timer.out, categorical=cats)
        return models.fit_folds(x, self.features.names, label, self.task, models.trees(self.task, rounds=10), self.n_folds, "pred_trees", timer=timer, n_classes=k, stored=True)

    def predict(self, df: DataFrame) -> DataFrame:
        x = df
        for c, m in self.text_models.items():
            x = m.predict(x.withColumn(f"_tokens__{c}", texts.tokens_en(F.col(c)))).drop(f"_tokens__{c}")
            x, _ = self._flat(x, m.name, m.n_classes)
        x = self._raw(self.features.apply(x))[0]
        for m in self.models:
            x = m.predict(x)
        return x.withColumn("prediction", self.blended(self.names, self.weights)).select(*df.columns, "prediction")


def partial_dependence(model: TabularAutoML, df: DataFrame, column: str, values: list) -> DataFrame:
    """(value, mean prediction) with the column set to each value in all rows."""
    parts = [model.predict(df.withColumn(column, F.lit(v).cast(df.schema[column].dataType))).agg(F.lit(str(v)).alias("value"), F.avg("prediction").alias("mean")) for v in values]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explain_text(df: DataFrame, text: str, key: str, score, samples: int = 200, seed: int = 1, width: float = 25.0) -> DataFrame:
    """(key, token, weight): how the score of a text moves without a token, by kernel-weighted differences over texts
    with random tokens left out. score maps a DataFrame with the text column to one with a column score."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "))
    s = df.select(key, words.alias("_w")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    off = F.transform("_w", lambda w: (F.pmod(F.xxhash64(F.lit(seed), F.col("_s"), w), F.lit(2)) == 0) & (F.col("_s") > 0))
    s = s.withColumn("_off", off)
    s = s.withColumn(text, F.array_join(F.filter(F.zip_with("_w", "_off", lambda w, o: F.when(~o, w)), lambda w: w.isNotNull()), " "))
    got = score(s)
    share = F.size(F.filter("_off", lambda o: o)) / F.greatest(F.lit(1), F.size("_off"))
    near = F.exp(-F.pow((F.lit(1.0) - F.sqrt(F.lit(1.0) - share)) * 100 / F.lit(width), 2))
    x = got.select(key, F.explode(F.arrays_zip("_w", "_off")).alias("t"), F.col("score"), near.alias("k"))
    mean = lambda o: F.try_divide(F.sum(F.when(F.col("t._off") == o, F.col("score") * F.col("k"))), F.sum(F.when(F.col("t._off") == o, F.col("k"))))
    return x.groupBy(key, F.col("t._w").alias("token")).agg((mean(False) - mean(True)).alias("weight"))
