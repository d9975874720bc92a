"""Uplift metrics: sums by distinct score, then running sums over the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import neighbours, percentiles, running

MODES = ("qini", "cum_gain", "adj_qini")


def perfect_score(y: Column, treatment: Column) -> Column:
    """The ideal order for a binary target: treated responders 2, untreated others 1, treated others 0, untreated responders -1."""
    return F.when(treatment == 1, F.when(y == 1, 2).otherwise(0)).otherwise(F.when(y == 1, -1).otherwise(1))


SUMS = ("n", "nt", "yt", "yc")


def _sums(df: DataFrame, y: str, score: str, treatment: str) -> DataFrame:
    """For each distinct score s, downwards: rows n, treated nt, responses of the treated yt and of the others yc, with what
    came before (before_n ...) and the whole (all_n ...)."""
    t = F.col(treatment).cast("double")
    yy = F.col(y).cast("double")
    by = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(t).alias("nt"), F.sum(yy * t).alias("yt"), F.sum(yy * (F.lit(1.0) - t)).alias("yc"))
    return running(by, "s", list(SUMS), descending=True)


def _point(n: Column, nt: Column, yt: Column, yc: Column, mode: str) -> tuple[Column, Column]:
    """(share, value) of a curve where so much has been summed up."""
    allt, rest, allc = F.col("all_nt"), n - nt, F.col("all_n") - F.col("all_nt")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    value = {
        "qini": ratio(yt, allt) - ratio(yc, allc),
        "cum_gain": (ratio(yt, nt) - ratio(yc, rest)) * n / F.col("all_n"),
        "adj_qini": ratio(yt - yc * ratio(nt, rest), allt),
    }[mode]
    return n / F.col("all_n"), value


def _ends(mode: str) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The curve's points before and after a score."""
    before = [F.col(f"before_{k}") for k in SUMS]
    return _point(*before, mode), _point(*[b + F.col(k) for b, k in zip(before, SUMS)], mode)


def curve(df: DataFrame, y: str, score: str, treatment: str, mode: str = "adj_qini") -> DataFrame:
    """(share, value): at the start and after each distinct score, downwards."""
    share, value = _ends(mode)[1]
    points = _sums(df, y, score, treatment).select(share.alias("share"), value.alias("value"))
    return points.unionByName(df.sparkSession.range(1).select(F.lit(0.0).alias("share"), F.lit(0.0).alias("value")))


def curve_areas(df: DataFrame, y: str, score: str, treatment: str, modes: tuple[str, ...] = MODES) -> DataFrame:
    """A column for each mode: trapezoids under its curve. All come from one table of running sums: the point before a row is
    made of the sums before it."""
    parts = []
    for m in modes:
        (x0, v0), (x1, v1) = _ends(m)
        parts.append(F.coalesce(F.sum((x1 - x0) * (v1 + v0) / 2), F.lit(0.0)).alias(m))
    return _sums(df, y, score, treatment).agg(*parts)


def area(points: DataFrame) -> DataFrame:
    """(auc): trapezoids under a curve."""
    x = neighbours(points.select("share", "value"), "share", ["share", "value"])
    return x.agg(F.coalesce(F.sum((F.col("share") - F.col("last_share")) * (F.col("value") + F.col("last_value")) / 2), F.lit(0.0)).alias("auc"))


def uplift_auc(df: DataFrame, y: str, score: str, treatment: str, mode: str = "adj_qini", normed: bool = False) -> DataFrame:
    """(auc), normed: 0 for random and 1 for the ideal order."""
    got = curve_areas(df, y, score, treatment, (mode,)).select(F.col(mode).alias("auc"))
    if not normed:
        return got
    lo = base_area(df, y, treatment)
    ideal = df.withColumn("_ideal", perfect_score(F.col(y), F.col(treatment)))
    hi = curve_areas(ideal, y, "_ideal", treatment, (mode,)).select(F.col(mode).alias("hi"))
    return got.crossJoin(lo).crossJoin(hi).select(((F.col("auc") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("auc"))


def base_area(df: DataFrame, y: str, treatment: str) -> DataFrame:
    """(lo): the area of the straight line to the whole difference of the arms."""
    mean = lambda arm: F.avg(F.when(F.col(treatment) == arm, F.col(y).cast("double")))
    return df.agg(((mean(1) - mean(0)) / 2).alias("lo"))


def _top(df: DataFrame, score: str, top: float) -> DataFrame:
    (cut,) = percentiles(df, {score: F.col(score)}, [(100 - top) / 100])[score]
    return df.withColumn("_top", F.col(score) > F.lit(cut).cast("double"))


def uplift_at_top(df: DataFrame, y: str, score: str, treatment: str, top: float = 30) -> DataFrame:
    """(score): difference of the arms' mean targets among the scores above the percentile."""
    x = _top(df, score, top)
    mean = lambda arm: F.coalesce(F.avg(F.when(F.col("_top") & (F.col(treatment) == arm), F.col(y).cast("double"))), F.lit(0.0))
    return x.agg((mean(1) - mean(0)).alias("score"))


def total_score(df: DataFrame, y: str, score: str, treatment: str, top: float = 30) -> DataFrame:
    """(score): value of treating those above the percentile and not the others."""
    x = _top(df, score, top)
    rate = F.avg(F.col(treatment).cast("double"))
    inside = F.avg(F.when(F.col("_top") & (F.col(treatment) == 1), F.col(y).cast("double")))
    outside = F.avg(F.when(~F.col("_top") & (F.col(treatment) == 0), F.col(y).cast("double")))
    return x.agg((outside * (F.lit(1.0) - rate) + inside * rate).alias("score"))
