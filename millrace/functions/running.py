"""Running sums and neighbours over a whole ordered table, without one task that holds it.

The table is written once (callers group it by the order column first, so that it is small), then dealt into ranges of the
order column by approximate quantiles (a few hundred numbers on the driver). A sum is that of the ranges before plus the running sum inside the range; any bounds give the same result, they
only decide how evenly the ranges are filled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Workspace, hold

RANGES = 200


def _range(df: DataFrame, order: str, bounds: list) -> Column:
    """How many of the bounds are smaller, found by halving; 0 for null. Plain comparisons: Spark fails on a join by a
    key that holds a lambda over a column of the other side's source."""
    at = [F.lit(b).cast(df.schema[order].dataType) for b in dict.fromkeys(bounds)]

    def among(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col(order) > at[mid], among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(at))


def _quantiles(order: str) -> Column:
    return F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 10 * RANGES)


def running(df: DataFrame, order: str, names: list[str], *groups: str, descending: bool = False) -> DataFrame:
    """df with before_x, the sum of x over the rows before (0 for the first), and all_x, its sum over the group.

    The order column is to be distinct inside a group; null comes first, or last if descending.
    """
    df = hold(df)
    bounds = df.agg(_quantiles(order)).first()[0] or []
    x = df.withColumn("_range", _range(df, order, bounds))
    turn = F.desc if descending else F.asc
    keys = [f"_group{i}" for i in range(len(groups))]
    sums = x.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col("_range").alias("_at")).agg(*[F.sum(n).alias(f"_sum_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy(turn("_at")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(*keys, "_at", *[zero(F.sum(f"_sum_{n}").over(earlier)).alias(f"_from_{n}") for n in names], *[F.sum(f"_sum_{n}").over(whole).alias(f"all_{n}") for n in names])
    same = F.col("_range") == F.col("_at")
    for g, k in zip(groups, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    inside = Window.partitionBy(*groups, "_range").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(sums, same).withColumns({f"before_{n}": F.col(f"_from_{n}") + zero(F.sum(n).over(inside)) for n in names})
    return x.drop("_range", "_at", *keys, *[f"_from_{n}" for n in names])


def percentiles(df: DataFrame, columns: dict[str, Column], at: list[float]) -> dict[str, list[float | None]]:
    """Exact percentiles of each column's values that are not null, between two values in proportion; null without any.

    Values are counted and written once, the counts are summed by ranges of values, and only ranges that hold a value asked
    for are put in order: no task holds all values, the driver sees the ranges' sums and the values asked for.
    """
    out: dict[str, list[float | None]] = {}
    made = Workspace(df.sparkSession)
    for name, c in columns.items():
        by = made.keep(df.select(c.cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n")))
        x = by.withColumn("_range", _range(by, "x", by.agg(_quantiles("x")).first()[0] or []))
        ends, total = [], 0
        for r in sorted(x.groupBy("_range").agg(F.sum("n").alias("n")).collect(), key=lambda r: r[0]):
            ends.append((r[0], total, total + r.n))
            total += r.n
        if not total:
            out[name] = [None] * len(at)
            continue
        places = [p * (total - 1) for p in at]
        asked = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
        got: dict[int, float] = {}
        within = [(r, lo, [k for k in asked if lo <= k < hi]) for r, lo, hi in ends]
        some = {r: (lo, ks) for r, lo, ks in within if ks}
        upto = F.sum("n").over(Window.partitionBy("_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        start = F.element_at(F.create_map(*[F.lit(v) for r, (lo, _) in some.items() for v in (r, lo)]), F.col("_range")).cast("long")
        ordered = x.where(F.col("_range").isin(list(some))).select("x", "n", (start + upto).alias("end"))
        hit = F.filter(F.array(*[F.lit(k).cast("long") for k in asked]), lambda k: (k >= F.col("end") - F.col("n")) & (k < F.col("end")))
        got = {r.k: r.x for r in ordered.select("x", F.explode(hit).alias("k")).collect()}
        out[name] = [got[lo] if got[lo] == got[hi] else (hi - p) * got[lo] + (p - lo) * got[hi] for p, lo, hi in ((p, math.floor(p), math.ceil(p)) for p in places)]
    made.clear()
    return out


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the running number (from 1) of each row in an order: rows are dealt into ranges of all of its columns, so that
    ties are spread as well, and written; a number is that inside the range plus the rows of the ranges before."""
    x = hold(df.repartitionByRange(RANGES, *order).withColumn("_part", F.spark_partition_id()))
    before = x.groupBy(F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    before = before.select("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = x.join(before, F.col("_part") == F.col("_at"))
    return x.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_at", "_before")


def neighbours(df: DataFrame, order: str, names: list[str]) -> DataFrame:
    """df with last_x, x of the row before in the order (null for the first). Ties are taken in the order of names."""
    df = hold(df)
    bounds = df.agg(_quantiles(order)).first()[0] or []
    x = df.withColumn("_range", _range(df, order, bounds))
    w = Window.partitionBy("_range").orderBy(order, *names)
    last = x.groupBy(F.col("_range").alias("_at")).agg(F.max(F.struct(order, *[F.col(n).alias(f"_n{i}") for i, n in enumerate(names)])).alias("_last"))
    last = last.select("_at", F.lag("_last").over(Window.orderBy("_at")).alias("_last"))
    x = x.join(last, F.col("_range") == F.col("_at"))
    first = F.row_number().over(w) == 1
    x = x.withColumns({f"last_{n}": F.when(first, F.col("_last")[f"_n{i}"]).otherwise(F.lag(n).over(w)) for i, n in enumerate(names)})
    return x.drop("_range", "_at", "_last")
