"""Fits make their input once, however many passes they take over it."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.operators import models
from millrace.plans import pipelines


def counted(spark):
    """A table of 400 rows, and a counter of how often a row of it was made."""
    made = spark.sparkContext.accumulator(0)

    def value(i):
        made.add(1)
        return float(i * 37 % 101)

    x = spark.range(400).withColumn("a", F.udf(value, DoubleType())("id"))
    return x.withColumns({"y": (F.col("id") * 13 % 7 < 3).cast("int"), "c": (F.col("id") % 4).cast("string"), "fold": (F.col("id") % 3).cast("int")}), made


def test_folds_make_their_rows_once(spark):
    x, made = counted(spark)
    _, out = models.fit_folds(x, ["a"], "y", "reg", models.trees("reg", 2, 2), 3, "p", parallel=1)
    assert made.value == 400
    assert out.where("p is not null").count() == 400


def test_a_scorecard_makes_its_rows_once(spark):
    x, made = counted(spark)
    card = pipelines.Scorecard.fit(x, ["a"], ["c"], "y")
    assert made.value == 400
    assert card.apply(x).where("score is not null").count() == 400
