"""Centroid clustering: plain Lloyd rounds over integer vectors.

Each component becomes floor(scale * x), so that distances, sums and means are exact whatever the partitioning. The
centroids (k vectors) are broadcast; a task compares its vectors with each of them in NumPy and returns one row of
component sums for each cluster, and these rows are added up by a groupBy. Nothing but k rows reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, tune

#: Scaled components saturate here, so that a squared distance of up to 64 of them stays below 2**63.
LARGEST = 1 << 27
_LONG = (1 << 63) - 1


def whole(vector: Column, dim: int) -> Column:
    """Whether an array of doubles has exactly dim components, none of them null or non-finite."""
    return (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def scaled(vectors: pd.Series, scale: float, largest: int) -> np.ndarray:
    """A row of integers floor(scale * x) for each vector."""
    x = np.floor(scale * np.stack(vectors.to_list()).astype(np.float64))
    return np.clip(x, -largest, largest).astype(np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of q; of equally near ones the lowest number."""
    d = np.empty((len(q), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        gap = q - c
        d[:, j] = np.einsum("ij,ij->i", gap, gap)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(q)), at]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors that are null, of another length than dim, or hold a null or non-finite component take no part and have no
    row. The centroids start as the k vectors whose sha256 of ``seed:vec_id`` is smallest (a null id counts as an empty
    one; equal hashes go by id, then by components); with fewer vectors there are fewer centroids, with none the result
    is empty. A centroid becomes the floor of its vectors' mean, one without vectors stays. Repeated rows are vectors of
    their own, equal vectors tie and go to the lowest number. Scaled components saturate at 2**27 (less for more than 64
    of them), inertias at 2**63 - 1. Other columns don't matter, whatever their names.
    """
    tune(df.sparkSession)
    largest = min(LARGEST, int((_LONG / dim) ** 0.5) // 2)
    d = df.select(column(vec_id).alias("vec_id"), column(embedding).cast("array<double>").alias("vector"))
    d = d.where(whole(F.col("vector"), dim))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = d.orderBy(h, F.asc_nulls_last("vec_id"), "vector").limit(k).select("vector").collect()
    out = "vec_id " + df.schema[vec_id].dataType.simpleString() + ", cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return df.sparkSession.createDataFrame([], out)
    centroids = scaled(pd.Series([np.array(r.vector) for r in first]), scale, largest)
    for _ in range(rounds):
        centroids = _moved(d, centroids, scale, largest)
    inertia = _inertia(d, centroids, scale, largest)
    total = min(sum(inertia.values()), _LONG)
    inertia = {j: min(n, _LONG) for j, n in inertia.items()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, far = nearest(scaled(b["vector"], scale, largest), shared.value)
                yield pd.DataFrame({
                    "vec_id": b["vec_id"], "cluster": at.astype(np.int32), "distance": far, "cluster_inertia": [inertia[j] for j in at.tolist()],
                    "inertia": total, "centroid_sha256": [digests[j] for j in at.tolist()],
                })

    return d.mapInPandas(assign, out)


def _moved(d: DataFrame, centroids: np.ndarray, scale: float, largest: int) -> np.ndarray:
    """The centroids after one round: a pass over the vectors, k rows of sums from each task, k rows to the driver."""
    shared = d.sparkSession.sparkContext.broadcast(centroids)
    names = [f"s{i}" for i in range(centroids.shape[1])]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            if len(b):
                q = scaled(b["vector"], scale, largest)
                at, _ = nearest(q, c)
                np.add.at(total, at, q)
                n += np.bincount(at, minlength=len(c))
        got = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": got.astype(np.int32), "n": n[got], **{s: total[got, i] for i, s in enumerate(names)}})

    rows = d.mapInPandas(sums, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    moved = centroids.copy()
    for r in rows.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        moved[r["cluster"]] = [r[s] // r["n"] for s in names]
    shared.destroy()
    return moved


def _inertia(d: DataFrame, centroids: np.ndarray, scale: float, largest: int) -> dict[int, int]:
    """The sum of squared distances of each cluster that has vectors."""
    shared = d.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = {}
        for b in batches:
            if len(b):
                at, far = nearest(scaled(b["vector"], scale, largest), shared.value)
                for j in np.unique(at).tolist():
                    of = far[at == j]
                    total[j] = total.get(j, 0) + (int(of.sum()) if of.max() < 1 << 53 else sum(of.tolist()))
        yield pd.DataFrame({"cluster": np.array(list(total), np.int32), "inertia": pd.Series([Decimal(v) for v in total.values()], dtype=object)})

    rows = d.mapInPandas(sums, "cluster int, inertia decimal(38,0)").groupBy("cluster").agg(F.sum("inertia").alias("inertia")).collect()
    shared.destroy()
    return {r["cluster"]: int(r["inertia"]) for r in rows}
