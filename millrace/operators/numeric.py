"""Numeric features: missing flags, median fill, infinities, log-odds, scaling, quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import percentiles
from ..functions.scalar import known, log_odds, missing


@dataclass
class NanFlags:
    """nanflg__x = 1 where x is missing, for the columns whose share of missing values is above the rate."""

    columns: list[str]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], rate: float = 0.005) -> NanFlags:
        row = df.agg(*[F.avg(missing(F.col(c)).cast("double")).alias(c) for c in columns]).first()
        return NanFlags([c for c in columns if row[c] is not None and row[c] > rate])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"nanflg__{c}": missing(F.col(c)).cast("float") for c in self.columns})


@dataclass
class FillMedian:
    """fillnamed__x: the exact median where x is missing, 0 for a column without values."""

    medians: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> FillMedian:
        found = percentiles(df, {c: known(F.col(c)) for c in columns}, [0.5])
        return FillMedian({c: 0.0 if found[c][0] is None else found[c][0] for c in columns})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"fillnamed__{c}": F.coalesce(known(F.col(c)), F.lit(m)) for c, m in self.medians.items()})


def fill_inf(df: DataFrame, columns: list[str]) -> DataFrame:
    """fillinf__x: null where x is infinite."""
    return df.withColumns({f"fillinf__{c}": F.when(F.abs(F.col(c).cast("double")) != F.lit(float("inf")), F.col(c).cast("double")) for c in columns})


def to_log_odds(df: DataFrame, columns: list[str]) -> DataFrame:
    """logodds__x: log(p / (1 - p)) of p clipped to [1e-7, 1 - 1e-7]."""
    return df.withColumns({f"logodds__{c}": log_odds(F.col(c)) for c in columns})


@dataclass
class StandardScaler:
    """scaler__x = (x - mean) / population deviation; a deviation of 0 or none counts as 1."""

    stats: dict[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> StandardScaler:
        exprs = [f(known(F.col(c))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = df.agg(*exprs).first()
        return StandardScaler({c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"scaler__{c}": (known(F.col(c)) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


@dataclass
class QuantileBinning:
    """qntl__x: 0 where x is missing, else 1 + number of inner quantiles below x (equal quantiles count once)."""

    edges: dict[str, list[float]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], bins: int = 10) -> QuantileBinning:
        found = percentiles(df, {c: known(F.col(c)) for c in columns}, [i / bins for i in range(1, bins)])
        return QuantileBinning({c: sorted({e for e in found[c] if e is not None}) for c in columns})

    def apply(self, df: DataFrame) -> DataFrame:
        def bin_of(c: str, edges: list[float]):
            x = known(F.col(c))
            below = sum(((x > F.lit(e)).cast("int") for e in edges), F.lit(0))
            return F.when(x.isNull(), F.lit(0)).otherwise(F.lit(1) + below)

        return df.withColumns({f"qntl__{c}": bin_of(c, e) for c, e in self.edges.items()})
