"""How many passes over the rows a fit takes."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import models, newton
from millrace.plans import automl


def test_newton_needs_few_passes_beside_a_column_of_a_large_scale(spark, monkeypatch):
    r = np.random.default_rng(5)
    a, y = r.normal(size=600), r.integers(0, 3, 600)
    rows = [(float(a[i]), 3e6 * float(r.random()), int(y[i]), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y int, fold int").persist()
    passes = []
    plain = newton._pass
    monkeypatch.setattr(newton, "_pass", lambda *x: (passes.append(plain(*x)), passes[-1])[1])
    models.linear_path(df, ["a", "b"], "y", "multiclass", 2, "p", path=(1.0,), n_classes=3)
    assert len(passes) < 15, len(passes)


def test_automl_numbers_the_rows_of_its_folds_once(spark, monkeypatch):
    kept = []
    plain = automl.hold
    monkeypatch.setattr(automl, "hold", lambda df: (kept.append(df.columns), plain(df))[1])
    df = spark.range(240).select("id", (F.col("id") * 7 % 13).cast("double").alias("a"), F.concat(F.lit("k"), F.col("id") % 4).alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    out = automl.TabularAutoML("binary", n_folds=2, algorithms=("linear",)).fit_predict(df, "y", "id")
    assert "fold" in kept[0] and kept[-1] == ["id", "y", "pred_linear"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and out.where("prediction between 0 and 1").count() == 240
