"""Local surrogates of text models: a ridge regression of the score on which tokens of a text are there."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def perturbed(df: DataFrame, text: str, key: str, samples: int, seed: int) -> DataFrame:
    """(key, _s, _w, _off, text): so many versions of each text with random distinct tokens left out; version 0 is whole."""
    words = F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    s = df.select(key, words.alias("_w")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    off = F.transform("_w", lambda w: (F.pmod(F.xxhash64(F.lit(seed), F.col("_s"), w), F.lit(2)) == 0) & (F.col("_s") > 0))
    s = s.withColumn("_off", off)
    return s.withColumn(text, F.array_join(F.filter(F.zip_with("_w", "_off", lambda w, o: F.when(~o, w)), lambda w: w.isNotNull()), " "))


def ridge(x: np.ndarray, y: np.ndarray, k: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the ridge regression with row weights k; the intercept is not penalised.

    Solved by tokens or by samples, whichever are fewer, so that a long text costs its length times the samples squared.
    """
    w = k / k.sum()
    mx, my = w @ x, w @ y
    root = np.sqrt(k)[:, None]
    a, b = (x - mx) * root, (y - my) * root[:, 0]
    if a.shape[1] <= a.shape[0]:
        coef = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ b)
    else:
        coef = a.T @ np.linalg.solve(a @ a.T + alpha * np.eye(len(a)), b)
    return coef, float(my - mx @ coef)


def surrogate(df: DataFrame, text: str, key: str, score: Callable[[DataFrame], DataFrame], samples: int = 200, alpha: float = 1.0, width: float = 25.0, top: int | None = 10, seed: int = 1) -> DataFrame:
    """(key, token, weight, intercept, r2) of the top tokens by size of weight (None: all) of each text.

    score maps a table with the text column to one with a column score. Versions weigh exp(-(d / width)^2), d being 100
    times the cosine distance of a version's tokens from the whole text's. r2 is the surrogate's on the versions. Keys are
    to be distinct; a text without tokens has no rows, null scores count as 0.
    """
    got = score(perturbed(df, text, key, samples, seed)).select(key, "_s", "_w", F.transform("_off", lambda o: (~o).cast("tinyint")).alias("_on"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("_y"))
    kind = df.schema[key].dataType.simpleString()

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_s")
        words = list(g["_w"].iloc[0])
        x, y = np.stack(g["_on"].to_list()).astype(float), g["_y"].to_numpy()
        near = 1 - np.sqrt(x.mean(axis=1))
        k = np.exp(-((100 * near / width) ** 2))
        coef, at = ridge(x, y, k, alpha)
        rest, whole = (k * (y - x @ coef - at) ** 2).sum(), (k * (y - (k @ y) / k.sum()) ** 2).sum()
        best = np.argsort(-np.abs(coef), kind="stable")[:top]
        return pd.DataFrame({key: [g[key].iloc[0]] * len(best), "token": pd.Series([words[i] for i in best], dtype=object), "weight": coef[best], "intercept": at, "r2": 1 - rest / whole if whole > 0 else 0.0})

    return got.where(F.size("_w") > 0).groupBy(key).applyInPandas(solve, f"{key} {kind}, token string, weight double, intercept double, r2 double")
