"""What boosting stores, and the nodes of rows."""

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import losses
from millrace.operators import boosting


def test_boosting_stores_rows_as_bytes_and_no_scores_before_the_first_refresh(spark, monkeypatch):
    seen = []
    plain = boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda table, *rest: (seen.append(dict(table.dtypes)), plain(table, *rest))[1])
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("y"), (F.col("id") % 3).alias("fold"))
    _, out = boosting.boost(df, ["a"], "y", losses.logloss(), boosting.Params(rounds=3, depth=1, patience=0), 3, "p", "id")
    assert seen[0]["codes"] == "binary" and "score" not in seen[0] and "uid" not in seen[0]
    assert seen[-1]["score"] == "binary"
    assert out.where("p between 0 and 1").count() == 300


def test_nodes_equal_a_walk_row_by_row():
    r = np.random.default_rng(3)
    t = boosting.Tree.empty(3, 9)
    t.feature[[0, 1, 2, 4, 5]] = [2, 0, 1, 2, 0]
    t.left[:] = r.random(t.left.shape) < 0.5
    codes = r.integers(0, 9, (200, 3))

    def walk(row):
        at = 0
        while t.feature[at] >= 0:
            at = 2 * at + 2 - int(t.left[at, row[t.feature[at]]])
        return at

    assert t.nodes(codes).tolist() == [walk(c) for c in codes]
