"""Histogram boosting against a plain NumPy version that tries every split of every node by itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import losses
from millrace.operators import boosting
from millrace.operators.boosting import Params


def rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = None if i % 11 == 0 else float(rng.integers(0, 40))
        b = float("nan") if i % 17 == 0 else float(rng.normal())
        c = None if i % 13 == 0 else str(rng.choice(["red", "green", "blue", "black", "white"], p=[0.4, 0.3, 0.15, 0.1, 0.05]))
        y = (a or 7) / 4 + (b if b == b else 2) * 2 + {"red": 3.0, "green": -2.0}.get(c, 0.5) + float(rng.normal()) / 3
        out.append((i, a, b, c, y, int(y > 4), int(np.digitize(y, [2, 6])), float(1 + i % 3), i % 3))
    return out


SCHEMA = "id long, a double, b double, c string, y double, bin int, cls int, w double, fold int"
FEATURES = ["a", "b", "c"]


def plain_boost(codes, ordered, y, w, fold, loss, p, n_folds, rounds, start):
    """Out-of-fold raw scores after a number of rounds, all rows at once."""
    k = loss.classes
    out = np.zeros((len(y), k))
    w = w * loss.weight(y) if loss.weight else w
    for i in range(n_folds):
        s = np.tile(start[i], (len(y), 1)).astype(float)
        train = fold != i
        for _ in range(rounds):
            g, h = loss.grad(y, s if k > 1 else s[:, 0])
            g, h = g.reshape(len(y), k), h.reshape(len(y), k)
            step = np.zeros_like(s)
            for j in range(k):
                for m, t in plain_tree(codes, np.where(train, g[:, j] * w, 0), np.where(train, h[:, j] * w, 0), train, ordered, p):
                    if loss.quantile is not None:
                        r = np.sort((y - s[:, 0])[m])
                        order = np.argsort((y - s[:, 0])[m], kind="stable")
                        cum = np.cumsum(w[m][order])
                        v = r[min(int(np.searchsorted(cum, loss.quantile * cum[-1] - 1e-9)), len(r) - 1)]
                    else:
                        G, H = (g[:, j] * w)[m].sum(), (h[:, j] * w)[m].sum()
                        v = -np.sign(G) * max(abs(G) - p.alpha, 0) / (H + p.ridge) if H + p.ridge > 0 else 0.0
                    step[t, j] = p.rate * v
            s = s + step
        out[fold == i] = s[fold == i]
    return out


def plain_tree(codes, g, h, train, ordered, p):
    """Leaves as (training rows, all rows)."""
    live, done = [(train, np.ones(len(codes), bool))], []
    worth = lambda m: max(abs(g[m].sum()) - p.alpha, 0) ** 2 / (h[m].sum() + p.ridge) if h[m].sum() + p.ridge > 0 else 0.0
    for _ in range(p.depth):
        nxt = []
        for m, t in live:
            best = (1e-12, None)
            for j in range(codes.shape[1]):
                col = codes[:, j]
                if ordered[j]:
                    sides = [((col >= 1) & (col <= k)) | ((col == 0) & miss) for miss in ([False, True] if (m & (col == 0)).any() else [False]) for k in range(1, col.max() + 1)]
                else:
                    seen = sorted(set(col[m]), key=lambda v: (g[m & (col == v)].sum() / (h[m & (col == v)].sum() + p.smooth), v))
                    sides = [np.isin(col, seen[: k + 1]) for k in range(len(seen))]
                for side in sides:
                    left, right = m & side, m & ~side
                    if min(left.sum(), right.sum()) < p.least_rows or min(h[left].sum(), h[right].sum()) < p.least_curvature:
                        continue
                    gain = worth(left) + worth(right) - worth(m)
                    if gain > best[0] + 1e-9:
                        best = gain, side
            if best[1] is None:
                done.append((m, t))
            else:
                nxt += [(m & best[1], t & best[1]), (m & ~best[1], t & ~best[1])]
        live = nxt
    return done + live


CASES = [("mse", "y", {}), ("mae", "y", {}), ("quantile", "y", {"q": 0.8}), ("huber", "y", {"a": 1.5}), ("fair", "y", {}), ("mape", "y", {}), ("logloss", "bin", {}), ("crossentropy", "cls", {})]


@pytest.mark.parametrize("name,target,params", CASES)
def test_boosting_equals_a_plain_version(spark, name, target, params):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    loss = losses.of("reg", name, 3, **params)
    p = Params(rounds=4, rate=0.3, depth=3, leaves=64, least_rows=10, bins=12, patience=100, ridge=0.5, alpha=0.1)
    booster, out = boosting.boost(df, FEATURES, target, loss, p, 3, "pred", "id", weight="w")
    booster.best = [4] * 3
    col = {c: [r[i] for r in data] for i, c in enumerate(SCHEMA.replace(",", "").split()[::2])}
    codes = booster.bins.codes([pa.array(col["a"], pa.float64()), pa.array(col["b"], pa.float64()), pa.array(col["c"], pa.string())]).astype(int)
    y = np.array(col[target], float)
    want = plain_boost(codes, [True, True, False], y, np.array(col["w"]), np.array(col["fold"]), loss, p, 3, 4, booster.start)
    got = np.zeros_like(want)
    for i in range(3):
        rows_of = np.array(col["fold"]) == i
        got[rows_of] = booster.raw(codes[rows_of], i, 4)
    assert np.abs(got - want).max() < 1e-4 if loss.quantile else np.abs(got - want).max() < 1e-8
    by_id = {r.id: r.pred for r in boosting.out_of_fold(booster, df).collect()}
    linked = booster._linked(want)
    assert np.allclose(np.array([by_id[i] for i in col["id"]]), linked, atol=1e-4)
    assert out.count() == len(data) and set(df.columns) < set(out.columns)


def test_early_stopping_refreshed_scores_and_importance(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("noise", F.rand(3))
    p = Params(rounds=25, rate=0.8, depth=3, least_rows=5, bins=16, patience=2)
    booster, out = boosting.boost(df, [*FEATURES, "noise"], "y", losses.mse(), p, 2 + 1, "pred", "id")
    for best, trees, history in zip(booster.best, booster.trees, booster.history):
        assert best == int(np.argmin(history)) and len(trees) < 25 and len(history) == len(trees) + 1 and len(trees) - best <= 2
    # the loss of the chosen round, counted from the predictions
    per = {r.fold: r.e for r in out.groupBy("fold").agg(F.avg((F.col("y") - F.col("pred")) ** 2).alias("e")).collect()}
    assert all(abs(per[i] - booster.history[i][booster.best[i]]) < 1e-9 for i in range(3))
    gain = booster.importance()
    assert gain["noise"] < min(gain[f] for f in FEATURES)


def test_one_holdout_sampling_and_unseen_values(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    held = df.withColumn("fold", (F.col("id") % 5 == 0).cast("int") * -1 + 1)  # 0 is the holdout
    booster, _ = boosting.boost(held, FEATURES, "y", losses.mae(), Params(rounds=8, depth=3, rate=0.5, columns=0.7, rows=0.7, patience=3, bins=16), 1, "pred", "id")
    assert len(booster.trees) == 1 and booster.history[0][booster.best[0]] < booster.history[0][0]
    new = spark.createDataFrame([(1, None, None, None), (2, 1e9, -1e9, "never seen"), (3, float("nan"), 0.0, "red")], "id long, a double, b double, c string")
    assert all(np.isfinite(r.pred) for r in booster.predict(new).collect())


def test_missing_targets_weights_of_zero_and_a_custom_loss(spark):
    data = [(*r[:4], None if r[0] % 7 == 0 else r[4], *r[5:7], 0.0 if r[0] % 5 == 0 else 1.0, r[8]) for r in rows()]
    df = spark.createDataFrame(data, SCHEMA)
    fourth = losses.Loss("fourth", lambda y, s: (4 * (s - y) ** 3, 12 * (s - y) ** 2 + 1e-6), lambda y, s: (s - y) ** 4)
    booster, out = boosting.boost(df, FEATURES, "y", fourth, Params(rounds=6, depth=2, rate=0.5), 3, "pred", "id", weight="w")
    assert all(h[b] < h[0] for h, b in zip(booster.history, booster.best))
    assert out.where("y is null and pred is null").count() == 0 and out.count() == len(data)


def test_no_rows_and_constant_features(spark):
    none = spark.createDataFrame([], SCHEMA)
    booster, out = boosting.boost(none, FEATURES, "y", losses.mse(), Params(rounds=2), 2, "pred", "id")
    assert out.count() == 0
    flat = spark.createDataFrame([(i, 1.0, None, "x", float(i % 4), 0, 0, 1.0, i % 2) for i in range(80)], SCHEMA)
    for loss in (losses.mse(), losses.mae()):
        _, out = boosting.boost(flat, FEATURES, "y", loss, Params(rounds=2), 2, "pred", "id")
        assert out.where("pred is null or isnan(pred)").count() == 0
