"""Selectors: objects that choose columns inside a plan. They are fitted on a holdout that a hash of the key picks, score
features by a boosted model, and sum the scores of derived features to the raw columns that they come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import losses
from ..functions.metrics import METRICS
from ..functions.scalar import hash_unit
from ..operators import boosting, selection
from ..operators.boosting import Booster, Params
from ..operators.models import forward_selection, permutation_importance


@dataclass(frozen=True)
class Problem:
    """What selectors have to know of a task. derive makes features from columns (Steps of the pipelines), none: the columns."""

    target: str
    task: str
    key: str
    classes: int = 2
    categorical: tuple[str, ...] = ()
    derive: Callable | None = None
    params: Params = Params(rounds=20, rate=0.2, depth=4, patience=5)
    share: float = 0.2

    def split(self, df: DataFrame) -> DataFrame:
        """df with _hold: 0 for the holdout, 1 for the rest."""
        h = hash_unit(F.concat_ws(":", F.lit("select"), F.col(self.key).cast("string")))
        return df.withColumn("_hold", F.when(h < self.share, 0).otherwise(1))

    def features(self, df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
        if self.derive is None:
            return df, columns
        steps = self.derive(df, columns)
        return steps.apply(df), steps.names

    def model(self, df: DataFrame, columns: list[str]) -> tuple[Booster, DataFrame, list[str]]:
        """A model on the columns' features, the table that it was fitted on (with _hold), the features."""
        x, names = self.features(self.split(df), columns)
        loss = losses.of(self.task, classes=self.classes)
        cats = tuple(c for c in self.categorical if c in names)
        b, _ = boosting.boost(x, names, self.target, loss, self.params, 1, "_pred", self.key, fold="_hold", categorical=cats)
        return b, x, names


def to_raw(importance: dict[str, float], columns: list[str]) -> dict[str, float]:
    """Scores of features summed to the columns that their names end in; columns without features score 0."""
    out = dict.fromkeys(columns, 0.0)
    for f, v in importance.items():
        c = selection.raw_name(f, columns)
        if c is not None:
            out[c] += v
    return out


@dataclass
class Selector:
    """All columns. Subclasses choose: ``_choose`` returns the ones to keep and sets importance if it knows it."""

    selected: list[str] | None = field(default=None, init=False)
    columns: list[str] | None = field(default=None, init=False)
    importance: dict[str, float] | None = field(default=None, init=False)

    def fit(self, df: DataFrame, columns: list[str], problem: Problem) -> Selector:
        kept = set(self._choose(df, columns, problem))
        self.columns, self.selected = list(columns), [c for c in columns if c in kept]
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """df without the columns that were not chosen."""
        return df.drop(*self.dropped)

    @property
    def dropped(self) -> list[str]:
        if self.selected is None:
            raise ValueError("the selector has not been fitted")
        return [c for c in self.columns if c not in self.selected]

    def _choose(self, df: DataFrame, columns: list[str], problem: Problem) -> list[str]:
        return columns


@dataclass
class Predefined(Selector):
    """The named columns, as far as there are such."""

    names: list[str] = field(default_factory=list)

    def _choose(self, df, columns, problem):
        return [c for c in columns if c in self.names]


@dataclass
class Cutoff(Selector):
    """Columns whose importance is above least; the best one if none is. by: gain of splits, or permutation."""

    least: float = 0.0
    by: str = "gain"

    def _choose(self, df, columns, problem):
        self.importance = importances(df, columns, problem, self.by)
        kept = [c for c in columns if self.importance[c] > self.least]
        return kept or sorted(columns, key=lambda c: (-self.importance[c], c))[:1]


@dataclass
class HighCorrelation(Selector):
    """Of numeric columns that correlate above the limit the most important stays (by gain), constants go."""

    limit: float = 0.98

    def _choose(self, df, columns, problem):
        numbers = [c for c in columns if c not in problem.categorical and df.schema[c].dataType.typeName() not in ("string", "date", "timestamp", "boolean")]
        self.importance = importances(df, columns, problem, "gain") if len(numbers) > 1 else None
        kept = set(selection.drop_correlated(df, numbers, self.importance, self.limit)) if numbers else set()
        return [c for c in columns if c not in numbers or c in kept]


@dataclass
class Forward(Selector):
    """Columns by permutation importance, group at a time, each group kept if the holdout's loss falls."""

    group: int = 1
    most: int | None = None
    by: str = "permutation"

    def _choose(self, df, columns, problem):
        self.importance = importances(df, columns, problem, self.by)

        def score(some: list[str]) -> float:
            b, _, _ = problem.model(df, some)
            return -b.history[0][b.best[0]]

        return forward_selection(columns, self.importance, score, self.group, self.most)


@dataclass
class Composed(Selector):
    """Selectors in a row, each on what the one before kept. Importance is that of the last one that knows it."""

    parts: list[Selector] = field(default_factory=list)

    def _choose(self, df, columns, problem):
        for p in self.parts:
            columns = p.fit(df, columns, problem).selected
            self.importance = p.importance or self.importance
        return columns


def importances(df: DataFrame, columns: list[str], problem: Problem, by: str) -> dict[str, float]:
    """Importance of each column for a model that a holdout stopped: gains, or what the holdout's score loses when a feature's
    values are dealt out anew."""
    b, x, names = problem.model(df, columns)
    if by == "gain":
        return to_raw(b.importance(names), columns)
    metric = METRICS[problem.task][{"reg": "mse", "binary": "logloss", "multiclass": "crossent"}[problem.task]]
    held = x.where(F.col("_hold") == 0).where(F.col(problem.target).isNotNull())
    return to_raw(permutation_importance(b, held, names, problem.target, problem.key, metric), columns)


#: Selectors by the preset's modes: none, cut off by importance, forward selection.
MODES: dict[int, Callable[[], Selector]] = {0: Selector, 1: Cutoff, 2: lambda: Composed([Cutoff(), Forward()])}
