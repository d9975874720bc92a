"""Cross-validation folds as columns, decided by keys alone: row order, partitions and reruns do not change them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running
from ..functions.scalar import hash24, hash_fold


def kfold(df: DataFrame, key: str, n: int = 5, name: str = "fold") -> DataFrame:
    return df.withColumn(name, hash_fold(F.col(key), n))


def group_kfold(df: DataFrame, group: str, n: int = 5, name: str = "fold") -> DataFrame:
    """Rows of a group share their fold."""
    return df.withColumn(name, hash_fold(F.col(group), n))


def stratified_kfold(df: DataFrame, key: str, target: str, n: int = 5, name: str = "fold", buckets: int = 64) -> DataFrame:
    """Each class is dealt out evenly in md5 order of the key.

    The running number inside a class is that inside a md5 bucket plus the rows of the buckets before, so that a class
    with nearly all rows is numbered by many tasks.
    """
    h = F.md5(F.col(key).cast("string"))
    x = df.withColumns({"_h": h, "_b": hash24(F.col(key)) / F.lit((1 << 24) // buckets)}).withColumn("_b", F.floor("_b"))
    before = x.groupBy(F.col(target).alias("_t"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_t").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_t", "_c", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    x = x.join(before, F.col(target).eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_c")))
    i = F.row_number().over(Window.partitionBy(target, "_b").orderBy("_h", key)) - 1 + F.col("_before")
    return x.withColumn(name, (i % n).cast("int")).drop("_h", "_b", "_t", "_c", "_before")


def holdout(df: DataFrame, key: str, share: float = 0.2, name: str = "holdout") -> DataFrame:
    return df.withColumn(name, (hash24(F.col(key)) < F.lit(int(share * (1 << 24)))))


def time_folds(df: DataFrame, time: str, dates: list, name: str = "fold") -> DataFrame:
    """Number of the given dates before the row's time; later rows have higher folds."""
    return df.withColumn(name, sum(((F.col(time) > F.lit(d)).cast("int") for d in dates), F.lit(0)))


def time_parts(df: DataFrame, time: str, key: str, n: int = 5, name: str = "fold") -> DataFrame:
    """n parts of equal size in time order (ties by key); the first parts take the rows left over.

    Rows are counted by time first; only rows of a time that a boundary cuts are numbered one by one.
    """
    per = df.groupBy(F.col(time).alias("_t")).agg(F.count("*").alias("_n"))
    per = running(per, "_t", ["_n"]).select("_t", F.col("before__n").alias("_before"))
    total = df.count()
    x = df.join(per, F.col(time).eqNullSafe(F.col("_t")))
    i = F.col("_before") + F.row_number().over(Window.partitionBy(time).orderBy(key)) - 1
    size, more = divmod(total, n)
    cut = more * (size + 1)
    part = F.when(i < cut, F.floor(i / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((i - cut) / F.lit(max(size, 1))))
    return x.withColumn(name, part.cast("int")).drop("_t", "_before")


def uplift_folds(df: DataFrame, key: str, treatment: str, arm: int, n: int = 5, name: str = "fold") -> DataFrame:
    """-1 (always in training) for one arm, a fold for the other."""
    return df.withColumn(name, F.when(F.col(treatment) == arm, F.lit(-1)).otherwise(hash_fold(F.col(key), n)))


def splits(df: DataFrame, n: int, name: str = "fold") -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(k, train, valid) for each fold."""
    for k in range(n):
        yield k, df.where(F.col(name) != k), df.where(F.col(name) == k)


def time_splits(df: DataFrame, n: int, name: str = "fold") -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(k, earlier rows, rows of fold k) for k from 1."""
    for k in range(1, n):
        yield k, df.where(F.col(name) < k), df.where(F.col(name) == k)


def custom_splits(df: DataFrame, key: str, pairs: list[tuple[DataFrame, DataFrame]]) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(k, train, valid) by tables of keys."""
    for k, (a, b) in enumerate(pairs):
        yield k, df.join(a.select(key), key, "left_semi"), df.join(b.select(key), key, "left_semi")


def choose(df: DataFrame, n: int | None = None, valid: DataFrame | None = None, custom=None, key: str = "id") -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """A fixed holdout if there is one, else custom splits, else folds, else the table against itself."""
    if valid is not None:
        return iter([(0, df, valid)])
    if custom is not None:
        return custom_splits(df, key, custom)
    if n:
        return splits(df, n)
    return iter([(0, df, df)])


def class_order(df: DataFrame, target: str) -> DataFrame:
    """(value, n, class): class numbers of target values, most frequent first, ties by value."""
    x = df.groupBy(F.col(target).alias("value")).agg(F.count("*").alias("n"))
    return x.withColumn("class", F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1)


