"""Percentiles and running numbers without one task that holds all rows."""

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.functions.running import numbered, percentiles


def test_percentiles_and_numbers_are_exact(spark):
    v = np.round(np.random.default_rng(1).normal(size=5000), 2)
    x = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)] + [(9000, None)], "k long, a double")
    at = [0.0, 0.1, 0.333, 0.5, 1.0]
    got = percentiles(x, {"a": F.col("a"), "none": F.lit(None).cast("double")}, at)
    assert np.allclose(got["a"], np.quantile(v, at)) and got["none"] == [None] * 5
    r = numbered(x.where("a is not null"), "i", "a", "k").orderBy("i").collect()
    assert [q.i for q in r] == list(range(1, 5001)) and [(q.a, q.k) for q in r] == sorted((q.a, q.k) for q in r)


def test_gini_numbers_no_rows_in_one_task(spark):
    x = spark.createDataFrame([(i, float(i % 7), i % 3 % 2) for i in range(500)], "k long, s double, y int")
    plan = M.gini(x, "y", "s", "k")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(s#" not in plan
    rows = sorted((i % 7, i) for i in range(500))
    y = np.array([i % 3 % 2 for _, i in rows], float)
    part = lambda y: (y * (500 - np.arange(500))).sum() / y.sum() - 501 / 2
    assert abs(M.gini(x, "y", "s", "k").first().gini - part(y) / part(np.sort(y))) < 1e-9
