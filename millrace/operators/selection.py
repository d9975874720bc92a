"""Feature selection and decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import known


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair a < b, by one aggregate; r is null where a column is constant."""
    cols = sorted(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    rows = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(known(F.col(a)), known(F.col(b))).alias("r")) for a, b in pairs]).alias("x"))
    return rows.select(F.explode("x").alias("x")).select("x.*")


def drop_correlated(df: DataFrame, columns: list[str], importance: dict[str, float] | None = None, limit: float = 0.98) -> list[str]:
    """Columns to keep: no constants, and of each pair with |r| above the limit the more important (then first) one."""
    row = df.agg(*[F.stddev_pop(known(F.col(c))).alias(c) for c in columns]).first()
    alive = [c for c in columns if row[c]]
    if len(alive) < 2:
        return alive
    rank = sorted(alive, key=lambda c: (-(importance or {}).get(c, 0.0), alive.index(c)))
    tied = {(r.a, r.b) for r in correlations(df, alive).where(F.abs("r") > limit).collect()}
    kept: list[str] = []
    for c in rank:
        if not any((min(c, k), max(c, k)) in tied for k in kept):
            kept.append(c)
    return [c for c in columns if c in kept]


def raw_importance(importance: DataFrame, raw: list[str]) -> DataFrame:
    """(feature, importance): derived features (prefix__name) summed by the longest raw name that they end in."""
    names = F.array(*[F.lit(r) for r in sorted(raw, key=len, reverse=True)])
    own = F.get(F.filter(names, lambda r: (F.col("feature") == r) | F.col("feature").endswith(F.concat(F.lit("__"), r))), F.lit(0))
    return importance.groupBy(own.alias("feature")).agg(F.sum("importance").alias("importance"))


def raw_name(feature: str, raw: list[str]) -> str | None:
    """The longest raw column that a derived feature's name ends in."""
    return max((r for r in raw if feature == r or feature.endswith("__" + r)), key=len, default=None)


def cutoff(importance: DataFrame, least: float = 0.0) -> list[str]:
    """Features above the cutoff, or the best one if there are none."""
    rows = importance.orderBy(F.desc("importance"), "feature").collect()
    return [r.feature for r in rows if r.importance > least] or [r.feature for r in rows[:1]]


def permuted(df: DataFrame, column: str, key: str, seed: int = 42, buckets: int = 256) -> DataFrame:
    """df with the column's values dealt out anew: each row takes the value of the row before it in a hash order.

    The order is by (hash bucket, hash); a bucket's first row takes the last value of the bucket before, so that no task
    has to order all rows.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    x = df.withColumns({"_h": h, "_b": F.pmod(F.conv(F.substring(h, 1, 6), 16, 10).cast("int"), F.lit(buckets))})
    last = x.groupBy("_b").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct("_h", key)).alias("_last"))
    w = Window.orderBy("_b")
    final = last.agg(F.max_by("_last", "_b").alias("_end"))
    last = last.withColumn("_prev", F.lag("_last").over(w)).crossJoin(final).select("_b", F.coalesce("_prev", "_end").alias("_prev"))
    inside = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy("_b").orderBy("_h", key))
    return x.join(last, "_b").withColumn(column, F.coalesce(inside, F.col("_prev"))["v"]).drop("_h", "_b", "_prev")


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and sums of products of a vector column's dimensions: d * (d + 1) numbers, whatever the rows.

    Each task multiplies its own rows and returns one row for each dimension; these are added up by a groupBy.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t, g = 0, None, None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                n, t, g = n + len(x), (x.sum(axis=0) if t is None else t + x.sum(axis=0)), (x.T @ x if g is None else g + x.T @ x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int32()), pa.array([n] * len(t), pa.int64()), pa.array(t), pa.array(list(g), pa.list_(pa.float64()))], names=["i", "n", "t", "g"])

    x = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    parts = x.mapInArrow(work, "i int, n long, t double, g array<double>").select("i", "n", "t", F.posexplode("g").alias("j", "s"))
    rows = parts.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    i, j, s, t, n = (rows.column(c).to_numpy() for c in ("i", "j", "s", "t", "n"))
    d = int(i.max()) + 1
    g, sums = np.zeros((d, d)), np.zeros(d)
    g[i, j] = s
    sums[i] = t
    return int(n[0]), sums, g


def project(df: DataFrame, vector: str, key: str, k: int, centred: bool = True) -> DataFrame:
    """(key, pca_0.. or svd_0..): the vectors on their first k principal or singular directions.

    Centred vectors give principal components, others a truncated singular value decomposition. A direction's sign is
    that of its largest coordinate.
    """
    n, t, g = gram(df, vector)
    mean = t / max(n, 1) if centred else np.zeros_like(t)
    cov = g - n * np.outer(mean, mean)
    val, vec = np.linalg.eigh(cov) if n else (np.zeros(0), np.zeros((0, 0)))
    top = vec[:, np.argsort(-val)[: min(k, max(1, len(val) - 1))]]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), range(top.shape[1])]) if n else top
    v = F.col(vector).cast("array<double>")
    dot = lambda w: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - F.lit(float(mean @ w))
    return df.select(key, *[dot(top[:, i]).alias(f"{'pca' if centred else 'svd'}_{i}") for i in range(top.shape[1])])
