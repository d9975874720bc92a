"""Scalar expressions: keyed determinism, null handling, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash24(key: Column) -> Column:
    """The first 24 bits of md5 of a key's text: the same in every engine, so folds and samples can be rebuilt anywhere."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long")


def hash_fold(key: Column, n: int) -> Column:
    """A fold number by key; rows of one key share it (K-fold on a row key, group K-fold on a group key)."""
    return (hash24(key) % n).cast("int")


def hash_unit(key: Column) -> Column:
    """A number in [0, 1) by key."""
    return hash24(key) / F.lit(16777216.0)


def missing(c: Column) -> Column:
    """Null or not a number."""
    return c.isNull() | F.isnan(c.cast("double"))


def known(c: Column) -> Column:
    """The number as double, null where it is missing: aggregates then skip it."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def log_odds(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs) if len(xs) > 1 else xs[0]
    e = [F.exp(x - top) for x in xs]
    total = sum(e[1:], e[0])
    return [v / total for v in e]


def inverse_softmax(ps: list[Column], eps: float = 1e-7) -> list[Column]:
    """Centred log-probabilities."""
    logs = [F.log(clip(p, eps, 1 - eps)) for p in ps]
    mean = sum(logs[1:], logs[0]) / len(logs)
    return [x - mean for x in logs]
