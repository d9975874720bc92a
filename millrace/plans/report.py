"""Tables of a model report: nothing is drawn, every table is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import percentiles, running
from ..functions.scalar import log_odds
from .reader import equal_bins

_UP = (Window.unboundedPreceding, 0)


def score_bins(df: DataFrame, target: str, score: str, key: str, n: int = 20) -> DataFrame:
    """(bin, n, mean_target, min, mean and max score) of equal bins by descending score."""
    s = F.col(score)
    return equal_bins(df, score, key, n).groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("mean_target"), F.min(s).alias("min_score"), F.avg(s).alias("mean_score"), F.max(s).alias("max_score"))


def score_quartiles(df: DataFrame, score: str, key: str, n: int = 20) -> DataFrame:
    """(bin, q1, median, q3) of the score."""
    q = F.percentile(F.col(score), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return equal_bins(df, score, key, n).groupBy("bin").agg(q.alias("q")).select("bin", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def f1_cutoffs(df: DataFrame, target: str, score: str, step: float = 0.01, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(cutoff, precision, recall, f1) of predicting 1 above each cutoff of a grid."""
    k = F.greatest(F.lit(round(lo / step)), F.least(F.lit(round(hi / step)), F.ceil(F.round(F.col(score) / step, 9)).cast("int")))
    by = df.groupBy(k.alias("k")).agg(F.sum(F.col(target).cast("double")).alias("pos"), F.count("*").alias("n"))
    w, whole = Window.orderBy("k").rowsBetween(*_UP), Window.partitionBy()
    x = by.select("k", (F.sum("pos").over(whole) - F.sum("pos").over(w)).alias("tp"), F.sum("pos").over(w).alias("fn"), (F.sum(F.col("n") - F.col("pos")).over(whole) - F.sum(F.col("n") - F.col("pos")).over(w)).alias("fp"))
    pr, rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    x = x.select((F.col("k") * step).alias("cutoff"), pr.alias("precision"), rec.alias("recall"))
    return x.withColumn("f1", F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def best_cutoff(cutoffs: DataFrame) -> DataFrame:
    """(f1, cutoff): the best F1 and the mean of the cutoffs that reach it."""
    top = cutoffs.agg(F.max("f1").alias("_top"))
    return cutoffs.crossJoin(top).where("f1 = _top").agg(F.max("f1").alias("f1"), F.avg("cutoff").alias("cutoff"))


def ranked(df: DataFrame, target: str, score: str) -> DataFrame:
    """(score, hits, tp, fp, pos, neg): the 1s of each distinct score, counts at and above it, and of all rows."""
    by = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(target).cast("double")).alias("p"), F.count("*").alias("n"))
    by = running(by.select("score", "p", (F.col("n") - F.col("p")).alias("q")), "score", ["p", "q"], descending=True)
    return by.select("score", F.col("p").alias("hits"), (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_q") + F.col("q")).alias("fp"), F.col("all_p").alias("pos"), F.col("all_q").alias("neg"))


def roc_points(df: DataFrame, target: str, score: str) -> DataFrame:
    return ranked(df, target, score).select("score", (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"))


def pr_points(df: DataFrame, target: str, score: str) -> DataFrame:
    return ranked(df, target, score).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))


def average_precision(df: DataFrame, target: str, score: str) -> DataFrame:
    """(ap): precision summed over the steps of recall."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return ranked(df, target, score).agg(F.sum(precision * F.col("hits") / F.col("pos")).alias("ap"))


def threshold_counts(df: DataFrame, target: str, score: str, at: float) -> DataFrame:
    """(tp, fp, fn, tn) of predicting 1 above a threshold."""
    y, p = F.col(target) == 1, F.col(score) > at
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def histogram(df: DataFrame, column: str, bins: int, *groups: str) -> DataFrame:
    """(groups, bin, n): equal bins from the least to the greatest value, which is in the last one."""
    lim = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).otherwise(F.lit(0))
    x = df.where(F.col(column).isNotNull()).crossJoin(lim).withColumn("bin", F.least(F.lit(bins - 1), at).cast("int"))
    return x.groupBy(*groups, "bin").agg(F.count("*").alias("n"))


def logit_histogram(df: DataFrame, target: str, score: str, bins: int = 50) -> DataFrame:
    return histogram(df.select(F.col(target).alias("y"), log_odds(F.col(score)).alias("_l")), "_l", bins, "y")


def regression_line(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """(slope, intercept, r2) of target on prediction."""
    y, x = F.col(target), F.col(prediction)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def numeric_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, nan_rate, min, q25, mean, median, q75, max, std)."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")).select("p.*")
    found = percentiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    q = df.sparkSession.createDataFrame([(c, *v) for c, v in found.items()], "feature string, q25 double, median double, q75 double")
    by = x.groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.col("v").isNull().cast("double")).alias("nan_rate"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"))
    return by.join(q, "feature").select("feature", "n", "nan_rate", "min", "q25", "mean", "median", "q75", "max", "std")


def datetime_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, nan_rate, first, last)."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("timestamp_ntz").alias("v")) for c in columns])).alias("p")).select("p.*")
    return x.groupBy("feature").agg(F.avg(F.col("v").isNull().cast("double")).alias("nan_rate"), F.min("v").alias("first"), F.max("v").alias("last"))


def category_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, nan_rate, n_unique, top, top_share): the most frequent value, ties by value."""
    from ..operators.categorical import value_counts

    v = value_counts(df, columns)
    there = F.col("value").isNotNull()
    best = F.max(F.when(there, F.struct(F.col("n")))).alias("b")
    by = v.groupBy("feature").agg(F.sum("n").alias("all"), F.sum(there.cast("long")).alias("n_unique"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("nulls"), best)
    top = v.where(there).join(by, "feature").where("n = b.n").groupBy("feature").agg(F.min("value").alias("top"))
    return by.join(top, "feature", "left").select("feature", (F.col("nulls") / F.col("all")).alias("nan_rate"), "n_unique", "top", (F.col("b.n") / F.col("all")).alias("top_share"))


def text_lengths(df: DataFrame, text: str, bins: int = 20) -> DataFrame:
    """(kind, bin, n): histograms of texts' characters and of their tokens between spaces."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = histogram(df.select(F.length(t).alias("v")), "v", bins).withColumn("kind", F.lit("chars"))
    toks = histogram(df.select(F.size(F.split(t, " ")).alias("v")), "v", bins).withColumn("kind", F.lit("tokens"))
    return chars.unionByName(toks).select("kind", "bin", "n")


def partial_dependence_counts(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    return histogram(df, column, bins)


def render(title: str, tables: dict[str, DataFrame], rows: int = 1000) -> str:
    """An HTML page of a report's tables (bins, curves, profiles: a bounded number of rows each)."""
    from html import escape

    parts = [f"<html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, t in tables.items():
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in t.columns)}</tr>")
        parts += [f"<tr>{''.join(f'<td>{escape(str(v))}</td>' for v in r)}</tr>" for r in t.limit(rows).collect()]
        parts.append("</table>")
    return "".join(parts) + "</body></html>"
