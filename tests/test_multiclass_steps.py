"""What the multiclass loop computes for each row: own classes for the blend, own folds for the linear path, training rows for trees."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import losses
from millrace.functions import metrics as M
from millrace.operators import blend, boosting, models, newton


def test_weights_by_the_hits_equal_those_by_the_arrays(spark):
    r = np.random.default_rng(4)
    p = r.dirichlet([1, 1, 1], (2, 400))
    y = [int(r.choice(3, p=p[0, i] / p[0, i].sum())) for i in range(400)]
    rows = [(y[i], p[0, i].tolist(), None if i % 9 == 0 else p[1, i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, a array<double>, b array<double>").persist()
    own, mixed = blend.hits(["a", "b"], "y")
    x = df.select(own[0].alias("ha"), own[1].alias("hb"), mixed.alias("m"))
    assert x.where("m").isEmpty() and x.where("hb is null").count() == 45
    arrays = blend.optimise_weights(df, ["a", "b"], lambda q: M.crossent_of(F.col("y"), q), -1, rounds=1, blended=blend.class_blend(3))
    assert blend.optimise_weights(x, ["ha", "hb"], M.crossent_hit, -1, rounds=1) == pytest.approx(arrays)
    odd = spark.createDataFrame([(0, [0.5, float("nan"), 0.5], [1.0, 0.0, 0.0])], df.schema)
    assert odd.select(mixed).first()[0]


@pytest.mark.parametrize("task,k", [("reg", 1), ("binary", 1), ("multiclass", 3)])
def test_own_losses_equal_the_metric_of_the_predictions(spark, task, k):
    r = np.random.default_rng(6)
    rows = [(float(r.normal()), float(r.integers(0, max(2, k))), int(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, y double, fold int")
    t = r.normal(size=(2, k, 2))
    fitted = models.Fitted([newton.Weights(["a"], w[:, 1:], w[:, 0], task) for w in t], task, "p", k)
    table = df.select("y", "fold", F.array("a").alias("x"))
    got = newton.own_losses(table, newton.Spec(task, k, 1, 0, np.zeros(2), t))
    assert got == pytest.approx(-models.LOSSES[task].of(models.by_fold(df, fitted, "fold"), "y", "p"))


def test_trees_are_applied_to_training_rows_only_below_the_first_level(monkeypatch):
    n, walked = 90, []
    plain = boosting.Tree.nodes
    monkeypatch.setattr(boosting.Tree, "nodes", lambda t, codes: (walked.append(len(codes)), plain(t, codes))[1])
    tree = lambda: boosting.Tree.empty(2, 3)
    fit = boosting._Fit(losses.crossentropy(3), boosting.Params(depth=2), [3], 3, [[[tree()] * 3] * 3], np.zeros((3, 3)))
    fold = np.arange(n) % 3
    rb = pa.RecordBatch.from_arrays([pa.array(fold * 1.0), pa.array(np.ones(n)), pa.array(fold.astype(np.int32)), boosting._packed(np.ones((n, 1), np.int16))], names=["y", "w", "fold", "codes"])

    class Table:
        def mapInArrow(self, work, schema):  # noqa: N802
            list(work([rb]))
            raise StopIteration

    with pytest.raises(StopIteration):
        boosting._histogram(Table(), fit, [[tree()] * 3] * 3, 1, [0])
    assert set(walked) == {60}
