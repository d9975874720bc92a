"""Date features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "2020-01-01 00:00:00"
UNITS = {"D": 86_400e6, "h": 3_600e6, "m": 60e6, "s": 1e6, "W": 604_800e6}
PARTS = {
    "y": F.year, "m": F.month, "d": F.dayofmonth, "wd": F.weekday, "hour": F.hour, "min": F.minute, "sec": F.second,
    "ms": lambda c: F.pmod(micros(c), F.lit(1_000_000)).cast("int"), "ns": lambda c: F.when(c.isNotNull(), F.lit(0)),
}


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def time_to_num(c: Column) -> Column:
    """Days since 2020-01-01."""
    return (micros(c) - micros(F.lit(EPOCH).cast("timestamp"))) / F.lit(86_400e6)


def base_diffs(df: DataFrame, bases: list[str], others: list[str], unit: str = "D") -> DataFrame:
    """basediff_base__other = (other - base) in units, for each pair of columns."""
    return df.withColumns({f"basediff_{b}__{o}": (micros(F.col(o)) - micros(F.col(b))) / F.lit(UNITS[unit]) for b in bases for o in others if b != o})


def seasons(df: DataFrame, column: str, parts: tuple[str, ...] = ("y", "m", "d", "wd", "hour"), holidays: DataFrame | None = None) -> DataFrame:
    """season_p__x for each part (Monday is 0, ms are microseconds of the second); season_hol__x by a (day) table."""
    out = df.withColumns({f"season_{p}__{column}": PARTS[p](F.col(column)) for p in parts})
    if holidays is not None:
        h = holidays.select(F.col("day").cast("date").alias("_day"), F.lit(1).alias("_hol")).distinct()
        out = out.join(h, F.to_date(column) == F.col("_day"), "left").withColumn(f"season_hol__{column}", F.coalesce("_hol", F.lit(0))).drop("_day", "_hol")
    return out


def change_datetime(c: Column, part: str, value: int) -> Column:
    """The time with another year, month or weekday; days beyond the month's end fall on its last day."""
    t = c.cast("timestamp")
    clock = t - F.date_trunc("day", t)
    if part == "weekday":
        return F.date_trunc("day", t) + F.make_interval(days=F.lit(value) - F.weekday(t)) + clock
    y, m = (F.lit(value), F.month(t)) if part == "year" else (F.year(t), F.lit(value))
    first = F.make_date(y, m, F.lit(1))
    day = F.date_add(first, F.least(F.dayofmonth(t), F.dayofmonth(F.last_day(first))) - 1)
    return day.cast("timestamp") + clock
