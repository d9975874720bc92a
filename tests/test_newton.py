"""Linear and additive models that all folds fit in the same passes."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from millrace.operators import additive, models, newton


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    a, b, k = r.normal(size=900), r.normal(size=900), r.integers(0, 40, 900)
    y = (a - 0.5 * b + (k % 5 - 2) * 0.6 + r.normal(size=900) > 0).astype(int)
    made = [(i, float(a[i]), float(b[i]), f"v{k[i]}", f"u{k[i] % 7}", int(y[i]), i % 3) for i in range(900)]
    return spark.createDataFrame(made, "id long, a double, b double, k string, u string, y int, fold int").persist()


def test_linear_folds_share_few_passes_and_equal_sparks(spark, rows):
    spark.sparkContext.setJobGroup("newton", "linear")
    fitted, out, c = models.linear_path(rows, ["a", "b"], "y", "binary", 3, "p", path=(0.1, 1.0))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("newton"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60, jobs
    assert out.count() == 900
    x = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(rows.where("fold != 1"))
    lr = LogisticRegression(featuresCol="f", labelCol="y", regParam=1 / (1800 * c), standardization=False, tol=1e-10).fit(x)
    assert np.allclose(fitted.models[1].coef[0], lr.coefficients.toArray(), atol=1e-4) and abs(fitted.models[1].intercept - lr.intercept) < 1e-4


def test_softmax_equals_sparks(rows):
    three = rows.withColumn("c", (F.col("y") + (F.col("a") > 1).cast("int")).cast("int"))
    fitted, out, _ = models.linear_path(three, ["a", "b"], "c", "multiclass", 3, "p", path=(1.0,), n_classes=3)
    x = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(three.where("fold != 0"))
    lr = LogisticRegression(featuresCol="f", labelCol="c", regParam=1 / 1800, standardization=False, tol=1e-10, maxIter=300).fit(x)
    assert np.allclose(fitted.models[0].coef, lr.coefficientMatrix.toArray(), atol=5e-3)
    assert out.where(F.abs(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0


@pytest.mark.parametrize("room", [6, 30])
def test_large_categories_stay_off_the_driver(monkeypatch, rows, room):
    """Weights of values that the driver doesn't hold equal those of one dense fit; with little room both categories are large."""
    whole, want = additive.fit(rows, ["a"], ["k", "u"], "y", "binary", 3, "p", path=(1.0,))
    monkeypatch.setattr(newton, "DENSE", room)
    part, got = additive.fit(rows, ["a"], ["k", "u"], "y", "binary", 3, "p", path=(1.0,))
    assert whole.fitted.models[0].coef.shape == part.fitted.models[0].coef.shape == (1, 1)
    w, g = ({(r.feature, r.value): r.weight for r in m.weights(1).collect()} for m in (whole, part))
    assert w.keys() == g.keys() and len(w) == 2 + 40 + 7 + 2 and max(abs(w[k] - g[k]) for k in w) < 2e-2
    p = want.select("id", F.col("p").alias("q")).join(got.select("id", "p"), "id")
    assert p.count() == 900 and p.where("abs(p - q) > 5e-3").count() == 0
