"""Selectors, the Parzen tuner, sparse additive models and the loop that uses them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from millrace.functions import losses
from millrace.operators import additive, boosting, models
from millrace.plans import automl, selectors, tuning


def surface(v: dict) -> float:
    kind = {"a": 0.0, "b": 0.3, "c": 1.0}[v["kind"]]
    return (math.log10(v["rate"]) + 2) ** 2 + (v["x"] - 0.3) ** 2 * 4 + ((v["n"] - 40) / 60) ** 2 + kind


SPACE = {"rate": tuning.log(1e-5, 1.0), "x": tuning.uniform(-1, 2), "n": tuning.integer(1, 100), "kind": tuning.choice("a", "b", "c")}


def test_parzen_beats_random_search_for_equal_trials():
    parzen, rand = [], []
    for seed in range(20):
        parzen.append(tuning.minimise(surface, SPACE, 60, seed=seed).loss)
        rand.append(tuning.minimise(surface, SPACE, 60, seed=seed, startup=60).loss)
    assert np.mean(parzen) < 0.5 * np.mean(rand) and np.median(parzen) < np.median(rand)


def test_search_in_parallel_within_its_bounds_and_time():
    s = tuning.minimise(surface, SPACE, 40, parallel=4, seed=3)
    assert len(s.trials) == 40 and s.loss == min(t for _, t in s.trials) and surface(s.best) == s.loss
    assert all(1 <= p["n"] <= 100 and isinstance(p["n"], int) and 1e-5 <= p["rate"] <= 1 and -1 <= p["x"] <= 2 for p, _ in s.trials)
    assert len(tuning.minimise(surface, SPACE, 40, timer=models.Timer(0.0)).trials) == 1
    odd = tuning.minimise(lambda v: math.nan if v["x"] < 0.5 else v["x"], {"x": tuning.uniform(0, 1)}, 30)
    assert odd.loss >= 0.5


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        a, b, c = rng.normal(size=3).tolist()
        k = str(rng.choice(list("pqrs")))
        y = int(a + {"p": 2.0, "q": -2.0}.get(k, 0.0) + rng.normal() / 2 > 0)
        rows.append((i, a, 2 * a + 1, b, c, 1.0, k if i % 19 else None, y, i % 3))
    return spark.createDataFrame(rows, "id long, a double, a2 double, b double, c double, flat double, k string, y int, fold int").cache()


PROBLEM = selectors.Problem("y", "binary", "id", params=boosting.Params(rounds=6, rate=0.4, depth=3, patience=3))
COLUMNS = ["a", "a2", "b", "c", "flat", "k"]


def test_selectors_keep_what_tells_something(table):
    fit = lambda s: s.fit(table, COLUMNS, PROBLEM).selected
    assert fit(selectors.Selector()) == COLUMNS
    assert fit(selectors.Predefined(["k", "b", "absent"])) == ["b", "k"]
    assert len({"a", "a2"} & set(fit(selectors.HighCorrelation()))) == 1 and "flat" not in fit(selectors.HighCorrelation())
    cut = selectors.Cutoff(by="permutation", least=0.02)
    got = fit(cut)
    assert "k" in got and {"a", "a2"} & set(got) and not {"b", "c", "flat"} & set(got) and cut.dropped == [c for c in COLUMNS if c not in got]
    assert fit(selectors.Cutoff(least=1e9)) == [max(COLUMNS, key=lambda c: cut.importance[c])] or len(fit(selectors.Cutoff(least=1e9))) == 1
    both = selectors.Composed([selectors.HighCorrelation(), selectors.Forward(by="gain")])
    kept = fit(both)
    assert "k" in kept and len({"a", "a2"} & set(kept)) == 1 and "flat" not in kept and both.importance["k"] > 0
    assert set(both.apply(table).columns) == set(table.columns) - set(both.dropped)
    with pytest.raises(ValueError):
        selectors.Cutoff().dropped  # noqa: B018


def test_importance_of_derived_features_goes_to_their_columns(table):
    from millrace.plans.pipelines import Steps

    derive = lambda d, cols: Steps([lambda x: x.withColumns({"sq__a": F.col("a") * F.col("a"), "neg__a": -F.col("a")})], ["sq__a", "neg__a", "b"])
    p = selectors.Problem("y", "binary", "id", params=PROBLEM.params, derive=derive)
    s = selectors.Cutoff().fit(table, ["a", "b"], p)
    b, _, _ = p.model(table, ["a", "b"])
    gain = b.importance()
    assert abs(s.importance["a"] - gain["sq__a"] - gain["neg__a"]) < 1e-9 and s.selected[0] == "a"


def test_additive_weights_equal_a_dense_fit(spark, table):
    m, out = additive.fit(table, ["a", "b"], ["k"], "y", "binary", 3, "p", path=(1.0,))
    w = {(r.feature, r.value): r.weight for r in m.weights(0).collect()}
    names = sorted({v for f, v in w if f == "k"})
    assert names == ["<NULL>", "<OTHER>", "p", "q", "r", "s"]
    dense = table.where("fold != 0").withColumns({f"d_{v}": (F.coalesce("k", F.lit("<NULL>")) == v).cast("double") for v in names})
    x = VectorAssembler(inputCols=["a", "b", *[f"d_{v}" for v in names]], outputCol="f").transform(dense)
    lr = LogisticRegression(featuresCol="f", labelCol="y", regParam=1 / (2 * table.count()), standardization=False, maxIter=100, tol=1e-9).fit(x)
    want = dict(zip([("a", None), ("b", None), *[("k", v) for v in names]], lr.coefficients.toArray()))
    assert all(abs(w[k] - v) < 5e-3 for k, v in want.items()) and abs(w["<INTERCEPT>", None] - lr.intercept) < 5e-3
    assert out.where("p < 0.001 or p > 0.999 or p is null").count() == 0 and out.count() == 600
    new = spark.createDataFrame([(1, 0.0, 0.0, "never"), (2, 100.0, 0.0, None)], "id long, a double, b double, k string")
    got = [r.p for r in m.predict(new).orderBy("id").collect()]
    assert 0 < got[0] < 1 and got[1] == 0.999


def test_additive_model_of_many_values_and_of_several_classes(spark):
    n = 100_000
    x = spark.range(2 * n).select("id", (F.col("id") % n).alias("c"), (F.pmod(F.xxhash64(F.col("id") % n), F.lit(2))).cast("int").alias("y"), (F.col("id") >= n).cast("int").alias("fold"))
    m, out = additive.fit(x, [], ["c"], "y", "binary", 2, "p", path=(1.0,))
    assert m.fitted.models[0].stages[-1].numFeatures >= n and len(x.columns) == 4
    # the other fold holds each value once more, so its weight tells the target
    assert out.where((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0
    few = spark.range(300).select("id", F.concat(F.lit("v"), F.col("id") % 5).alias("c"), (F.col("id") % 5 % 3).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    m, out = additive.fit(few, [], ["c"], "y", "multiclass", 2, "p", path=(10.0,), n_classes=3)
    assert out.where(F.array_position("p", F.array_max("p")) - 1 != F.col("y")).count() == 0
    assert all(len(r.weight) == 3 for r in m.weights().collect())


def test_the_loop_selects_tunes_and_boosts(table):
    m = automl.TabularAutoML("binary", n_folds=2, algorithms=("additive", "boost"), selector=selectors.Cutoff(by="permutation", least=0.01), tuning=3, boosting=PROBLEM.params)
    x = table.drop("fold")
    out = m.fit_predict(x, "y", "id", {"k": "category"})
    assert "k" in m.roles and "c" not in m.roles and len(m.search.trials) == 3 and out.count() == 600
    r = out.agg(F.avg(((F.col("prediction") > 0.5).cast("int") == F.col("y")).cast("int")).alias("v")).first()
    assert r.v > 0.85
    assert m.predict(x.limit(5)).where("prediction between 0 and 1").count() == 5
    m.release()


def test_the_loop_takes_other_losses(table):
    m = automl.TabularAutoML("reg", n_folds=2, algorithms=("boost",), boosting=PROBLEM.params, loss=losses.quantile(0.9))
    out = m.fit_predict(table.select("id", "a", "b", "k"), "a", "id", {"k": "category", "b": "numeric"})
    share = out.agg(F.avg((F.col("a") < F.col("prediction")).cast("int")).alias("s")).first().s
    assert 0.8 < share < 0.97


def flipped(table):
    """The table with the targets of fold 0 turned around."""
    return table.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))


def test_no_prediction_of_nested_levels_saw_its_target(table):
    from millrace.plans import levels

    task = levels.Task("binary", "y", "id")
    p = boosting.Params(rounds=3, rate=0.5, depth=2, patience=2)
    of = lambda nested, t: {r.id: (r.fold, r.prediction) for r in levels.Graph([[levels.Boost(p), levels.Linear()], [levels.Boost(p)]], nested=nested, inner=2).fit_predict(t, ["a", "b", "k"], task, 3).collect()}
    a, b = of(True, table), of(True, flipped(table))
    assert len(a) == 600 and all(0 < v < 1 for _, v in a.values())
    assert all(a[i] == b[i] for i in a if a[i][0] == 0) and any(a[i] != b[i] for i in a if a[i][0] != 0)
    c, d = of(False, table), of(False, flipped(table))
    assert any(c[i] != d[i] for i in c if c[i][0] == 0)  # shared folds: what nesting is for


def test_levels_predict_new_rows_and_blend_within_time(spark, table):
    from millrace.plans import levels

    task = levels.Task("multiclass", "cls", "id", 3)
    x = table.withColumn("cls", F.when(F.col("a") > 0.5, 2).when(F.col("a") > -0.5, 1).otherwise(0))
    p = boosting.Params(rounds=3, rate=0.5, depth=2, patience=2)
    g = levels.Graph([[levels.Boost(p)], [levels.Boost(p)]], nested=False, skip=False)
    out = g.fit_predict(x, ["a", "b"], task, 3)
    assert out.where(F.array_position("prediction", F.array_max("prediction")) - 1 == F.col("cls")).count() > 540
    assert g.predict(x.select("id", "a", "b").limit(3)).where(F.abs(F.aggregate("prediction", F.lit(0.0), lambda s, v: s + v) - 1) < 1e-9).count() == 3
    done, w, mixed = levels.utilise(table, ["a", "b"], levels.Task("binary", "y", "id"), 3, [levels.Graph([[levels.Boost(p)]], nested=False), levels.Graph([[levels.Linear()]], nested=False)], 1e9)
    assert len(done) == 2 and abs(sum(w) - 1) < 1e-9 and mixed.where("prediction is null").count() == 0
    done, w, _ = levels.utilise(table, ["a"], levels.Task("binary", "y", "id"), 3, [levels.Graph([[levels.Linear()]], nested=False)] * 2, 0.0)
    assert len(done) == 1 and w == [1.0]


def test_blend_weights_are_near_the_best(spark):
    from millrace.operators import blend

    rng = np.random.default_rng(5)
    y = rng.normal(size=500)
    a, b = y + rng.normal(size=500), y + rng.normal(size=500) / 2
    df = spark.createDataFrame([(float(t), float(u), float(v)) for t, u, v in zip(y, a, b)], "y double, a double, b double")
    w = blend.optimise_weights(df, ["a", "b"], lambda p: F.avg((F.col("y") - p) * (F.col("y") - p)), -1)
    best = ((b - y) @ (b - a)) / ((b - a) @ (b - a))
    assert abs(w[0] - best) < 1e-3


def test_text_feature_of_a_fold_equals_a_model_without_it(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, [str(w) for w in rng.choice(words, 12)] if i % 20 else None, i % 3) for i in range(240)]
    rows = [(i, t, int("w1" in (t or []) or "w2" in (t or [])), f) for i, t, f in rows]
    df = spark.createDataFrame(rows, "id long, t array<string>, y int, fold int")
    _, out = models.text_oof(df, "t", "y", "binary", 3, "p", slots=1 << 12, steps=100)
    assert out.count() == 240 and out.where("p is null").count() == 0
    other = df.where("fold != 1")
    est = models.linear("binary", 1 / (2 * 240 * 0.1))
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    put = lambda d: d.withColumns({"t": F.coalesce("t", F.array().cast("array<string>")), "_y": F.col("y").cast("double")})
    m = Pipeline(stages=[HashingTF(inputCol="t", outputCol="h", numFeatures=1 << 12), IDF(inputCol="h", outputCol="i"), Normalizer(inputCol="i", outputCol="_features"), est]).fit(put(other))
    want = {r.id: r.p for r in m.transform(put(df.where("fold = 1"))).select("id", vector_to_array("_prob")[1].alias("p")).collect()}
    got = {r.id: r.p for r in out.where("fold = 1").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_surrogate_equals_plain_ridge(spark):
    from millrace.plans import explain

    df = spark.createDataFrame([(1, "good film with a bad end"), (2, ""), (3, None), (4, " ".join(f"t{i}" for i in range(300)))], "id long, text string")
    score = lambda t: t.withColumn("score", F.when(F.col("text").contains("good"), 1.0).otherwise(0.2) - F.when(F.col("text").contains("bad"), 0.5).otherwise(0.0))
    got = explain.surrogate(df, "text", "id", score, samples=60, top=None).collect()
    rows = explain.perturbed(df.where("id in (1, 4)"), "text", "id", 60, 1)
    for key, n in ((1, 6), (4, 300)):
        some = score(rows.where(F.col("id") == key)).orderBy("_s").collect()
        x, y = np.array([[0.0 if o else 1.0 for o in r._off] for r in some]), np.array([r.score for r in some])
        k = np.exp(-((100 * (1 - np.sqrt(x.mean(axis=1))) / 25) ** 2))
        full = np.hstack([x, np.ones((len(x), 1))])
        pen = np.eye(n + 1)
        pen[n, n] = 0
        want = np.linalg.solve(full.T @ (full * k[:, None]) + pen, full.T @ (k * y))
        mine = {r.token: r.weight for r in got if r.id == key}
        assert len(mine) == n and all(abs(mine[w] - v) < 1e-6 for w, v in zip(some[0]._w, want))
    best = {r.token: r.weight for r in explain.surrogate(df, "text", "id", score, samples=60, top=2).where("id = 1").collect()}
    assert set(best) == {"good", "bad"} and best["good"] > 0 > best["bad"]
    assert {r.id for r in got} == {1, 4}


def test_supervised_bins_tell_at_least_what_quantile_bins_tell(spark):
    from millrace.operators import binning, numeric

    rng = np.random.default_rng(7)
    x = rng.normal(size=3000)
    y = ((np.abs(x) > 1) ^ (rng.random(3000) < 0.2)).astype(int)
    df = spark.createDataFrame([(float(v) if i % 30 else None, int(t), float(i % 3)) for i, (v, t) in enumerate(zip(x, y))], "x double, y int, z double")
    fitted = binning.SupervisedBins.fit(df, ["x", "z"], "y")
    iv = lambda d, c: sum(r.iv for r in models.woe_table(d, c, "y").collect())
    ours, plain = fitted.apply(df), numeric.QuantileBinning.fit(df, ["x"], 5).apply(df)
    assert iv(ours, "sbin__x") > iv(plain, "qntl__x") and len(fitted.cuts["x"]) <= 4
    assert ours.where("x is null and sbin__x != 0").count() == 0
    # exact on a few fine bins: every way to cut them
    from itertools import combinations

    pos, neg = rng.integers(0, 30, 9).astype(float), rng.integers(1, 30, 9).astype(float)
    worth = lambda cut: binning.information(*(np.add.reduceat(v, [0, *cut]) for v in (pos, neg))).sum() if all(s.sum() >= 0.1 * (pos + neg).sum() for s in np.split(pos + neg, cut)) else -1
    best = max((list(c) for k in range(4) for c in combinations(range(1, 9), k)), key=worth)
    assert abs(worth(binning.best_cuts(pos, neg, 4, 0.1)) - worth(best)) < 1e-12


def test_roles_cast_what_they_can_and_the_loop_reads_texts(spark):
    from millrace.plans import reader

    df = spark.createDataFrame([(1, "2.5", "03/01/2020", 1.0, True), (2, "x", "99/99/2020", None, None), (3, None, None, float("nan"), False)], "id long, n string, t string, d double, b boolean")
    roles = {"n": reader.Role("numeric"), "t": reader.Role("datetime", {"format": "dd/MM/yyyy"}), "d": reader.Role("datetime", {"unit": "D"}), "b": reader.Role("numeric"), "absent": reader.Role("numeric")}
    got = [(r.n, r.t and r.t.day, r.b) for r in reader.cast_roles(df, roles).orderBy("id").collect()]
    assert got == [(2.5, 3, 1.0), (None, None, None), (None, None, 0.0)]
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(str(w) for w in rng.choice(["red", "green", "blue", "white"], 6)), float(rng.normal())) for i in range(200)]
    x = spark.createDataFrame([(i, t if i % 17 else None, v, int("red" in t)) for i, t, v in rows], "id long, t string, v double, y int")
    m = automl.TabularAutoML("binary", n_folds=2, algorithms=("boost",), boosting=boosting.Params(rounds=5, rate=0.5, depth=2, patience=3, least_rows=5))
    out = m.fit_predict(x, "y", "id", {"t": "text"})
    assert out.count() == 200 and m.predict(x.limit(9)).where("prediction between 0 and 1").count() == 9
    r = out.join(x.select("id", "t"), "id").where("t is not null").agg(F.avg(((F.col("prediction") > 0.5).cast("int") == F.col("y")).cast("int")).alias("v")).first()
    assert r.v > 0.9


def test_uplift_search_fits_each_base_once_and_finds_the_effect(spark):
    from millrace.plans import uplift_search

    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        a, w = float(rng.normal()), int(rng.random() < 0.4)
        rows.append((i, a, w, int(rng.random() < 0.3 + (0.5 if w and a > 0 else 0.0))))
    df = spark.createDataFrame(rows, "id long, a double, w int, y int").cache()
    kinds = {"linear": uplift_search.linear, "boosted": uplift_search.boosted(boosting.Params(rounds=4, rate=0.5, depth=2, patience=3))}
    found = uplift_search.search(df, ["a"], "y", "w", "id", kinds=kinds)
    assert len(found.areas) == 8 and found.fits == 16 and all(set(b.known) == {"outcome", "outcome0", "outcome1", "propensity", "effect0", "effect1", "residual", "dependent"} for b in found.bases.values())
    assert found.areas[found.best] == max(found.areas.values())
    out = found.predict(df)
    mean = {r.s: r.m for r in out.groupBy((F.col("a") > 0).alias("s")).agg(F.avg("uplift").alias("m")).collect()}
    assert mean[True] > 0.25 and abs(mean[False]) < 0.2 and set(out.columns) == {*df.columns, "uplift"}
