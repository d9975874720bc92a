"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Text is a sequence of word and punctuation tokens; its unigrams and bigrams (a token that repeats the one before is a
bigram of its own) are hashed into buckets. The raw model holds the bucket shares of all documents, the target model
those of the documents that are labelled good. A document's log weight is the sum of its n-grams' log ratios; adding a
Gumbel number drawn from a hash of its id and taking the k largest samples k documents without replacement in
proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices, tune, words
from .decontaminate import KEEP

BUCKETS = 1 << 14
#: Bound on the labelled rows that the target model is fitted on.
MAX_TARGET = 20_000
_MARKS = ~KEEP
_MARKS[[32, *range(9, 14)]] = False
_REPEAT = np.uint64(0x51ED270B35AB79C3)


def ngram_buckets(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bucket of each unigram and bigram) of every text."""
    for lo, hi in slices(col):
        part = col.slice(lo, hi - lo)
        a, b = words(part, KEEP), words(part, _MARKS)
        h, row, at = (np.concatenate(x) for x in zip(a, b))
        order = np.argsort(at, kind="stable")
        h, row = h[order], row[order]
        two = mix(h[:-1] * np.uint64(0xB5297A4D2C1B5E8B) + h[1:])
        two[h[:-1] == h[1:]] = _REPEAT
        same = row[:-1] == row[1:]
        bounds = np.searchsorted(row, np.arange(hi - lo + 1))
        one = (h >> np.uint64(50)).astype(np.int64)
        pair = (two >> np.uint64(50)).astype(np.int64)
        for i in range(hi - lo):
            x, y = bounds[i], bounds[i + 1]
            yield lo + i, np.concatenate([one[x:y], pair[x : max(x, y - 1)][same[x : max(x, y - 1)]]])


def fit(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", max_target: int = MAX_TARGET) -> np.ndarray:
    """Log ratio of target and raw bucket shares (add-one smoothed). target: ids of good documents, thinned to the bound."""
    tune(docs.sparkSession)
    ids = target.select(F.col(doc_id).alias("id")).where("id is not null").distinct()
    share = min(1.0, max_target / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + (share == 1.0))).withColumn("good", F.lit(1))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    d = texts.join(F.broadcast(ids), "id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False)
            for i, k in ngram_buckets(b.column(0)):
                n = np.bincount(k, minlength=BUCKETS) if len(k) > 2000 else None
                for y in (0, 1) if good[i] else (0,):
                    if n is not None:
                        total[y] += n
                    else:
                        np.add.at(total[y], k, 1)
        got = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[0][got]), pa.array(total[1][got])], names=["bucket", "raw", "good"])

    rows = d.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[rows["bucket"]] += rows["raw"]
    good[rows["bucket"]] += rows["good"]
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def gumbel(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel number from a hash of the id: reruns draw the same."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, log_weight and n_grams of every row; log_weight is null for texts without n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("struct<log_weight:double,n_grams:long>")
    def w(s: pd.Series) -> pd.DataFrame:
        r = shared.value
        out, n = np.full(len(s), np.nan), np.zeros(len(s), np.int64)
        for i, k in ngram_buckets(pa.array([t if isinstance(t, str) else None for t in s], pa.string())):
            n[i] = len(k)
            if len(k):
                out[i] = r[k].sum()
        return pd.DataFrame({"log_weight": pd.Series(out).astype(object).where(n > 0, None), "n_grams": n})

    return docs.select(*keep, w(F.col(text)).alias("_w")).select(*keep, "_w.log_weight", "_w.n_grams")


def largest(df: DataFrame, key: str, k: int, bins: int = 1024, small: int = 5000) -> DataFrame:
    """The k rows with the largest key, ties by a hash of the row: the cut is found by counting ever finer bins, not by a global sort."""
    d = df.where(F.col(key).isNotNull()).withColumn("_tie", F.xxhash64(*df.columns))
    if k <= 0:
        return df.limit(0)
    lo, hi, n = d.agg(F.min(key), F.max(key), F.count("*")).first()
    if n <= k:
        return df.where(F.col(key).isNotNull())
    above = 0
    inside = (F.col(key) >= lo) & (F.col(key) <= hi)
    for _ in range(40):
        if n <= small or not lo < hi:
            break
        width = (hi - lo) / bins
        if width <= 0:
            break
        b = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        got = sorted(d.where(inside).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), key=lambda r: -r.b)
        for r in got:
            if above + r.n > k:
                break
            above += r.n
        else:
            return d.where(F.col(key) >= got[-1].lo).drop("_tie")
        lo, hi, n = r.lo, r.hi, r.n
        inside = (F.col(key) >= F.lit(lo)) & (F.col(key) <= F.lit(hi))
    rest = d.where(inside).orderBy(F.desc(key), "_tie").limit(k - above)
    return d.where(F.col(key) > F.lit(hi)).unionByName(rest).drop("_tie")


def resample(docs: DataFrame, target: DataFrame, share: float = 0.85, seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, log_weight, n_grams, key) of a sample of share of the rows with n-grams.

    Null, empty and wordless texts are never sampled. Repeated rows draw the same number and are rows of their own.
    """
    ratio = fit(docs, target, doc_id, text)
    w = weigh(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ratio)
    w = materialize(w.where("log_weight is not null").withColumn("key", F.col("log_weight") + gumbel(F.coalesce("doc_id", F.lit(-1)), seed)))
    return largest(w, "key", int(share * w.count()))
