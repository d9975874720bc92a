"""Operators beyond what the SQL comparison covers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.operators import blend, models, numeric, selection, texts, uplift
from millrace.plans import folds, pipelines, reader, report
from millrace.sources.tables import count_lines, read_table, write_table
from millrace.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def xs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), int(a + b + rng.normal() > 0), i % 3) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    return spark.createDataFrame(rows, "id long, a double, b double, y int, g int").cache()


def test_sources(spark, xs, tmp_path):
    for kind in ("parquet", "json", "orc"):
        write_table(xs, f"{tmp_path}/x.{kind}", kind)
        assert read_table(spark, f"{tmp_path}/x.{kind}").count() == 400
    xs.toPandas().to_csv(f"{tmp_path}/x.csv", index=False)
    assert read_table(spark, f"{tmp_path}/x.csv").count() == count_lines(spark, f"{tmp_path}/x.csv") == 400
    xs.toPandas().to_feather(f"{tmp_path}/x.feather")
    assert read_table(spark, f"{tmp_path}/x.feather").columns == xs.columns
    assert read_table(spark, {"a": [1, 2], "b": ["x", None]}).count() == 2
    assert read_table(spark, np.zeros((3, 2))).columns == ["f0", "f1"]
    xs.createOrReplaceTempView("xs")
    assert read_table(spark, "select * from xs where g = 1").count() == 133
    with pytest.raises(ValueError):
        read_table(spark, "x.unknown")


def test_constant_and_empty_columns(spark):
    d = spark.createDataFrame([(1, None, 5.0), (2, float("nan"), 5.0)], "id long, x double, c double")
    assert numeric.FillMedian.fit(d, ["x"]).medians == {"x": 0.0}
    assert [r["scaler__c"] for r in numeric.StandardScaler.fit(d, ["c"]).apply(d).collect()] == [0.0, 0.0]
    assert [r["qntl__x"] for r in numeric.QuantileBinning.fit(d, ["x"]).apply(d).collect()] == [0, 0]
    assert numeric.NanFlags.fit(d, ["x", "c"]).columns == ["x"]


def test_linear_models_find_the_signal(xs):
    x = folds.kfold(xs, "id", 3)
    fitted, out, _ = models.linear_path(x, ["a", "b"], "y", "binary", 3, "p", path=(0.01, 1.0))
    assert out.count() == 400 and M.auc(out, "y", "p").first().auc > 0.8
    assert set(fitted.importance(["a", "b"])) == {"a", "b"}
    imp = models.permutation_importance(fitted, xs.withColumn("z", F.lit(0.0)), ["a", "z"], "y", "id", M.METRICS["binary"]["auc"])
    assert imp["a"] > 0.05 and abs(imp["z"]) < 1e-9


def test_timer_stops_folds(xs):
    timer = models.Timer(0.0)
    x = folds.kfold(xs, "id", 3)
    fitted, out = models.fit_folds(x, ["a"], "y", "binary", models.linear("binary", 0.1), 3, "p", timer=timer)
    assert len(fitted.models) == 1 and out.count() == 400 and out.where("p is null").count() == x.where("fold > 0").count()


def test_weights_prefer_the_better_model(xs):
    x = xs.withColumns({"good": F.lit(0.9) * F.col("y") + 0.05, "bad": F.lit(1.0) - (F.lit(0.9) * F.col("y") + 0.05)})
    w = blend.optimise_weights(x, ["good", "bad"], lambda p: M.logloss(F.col("y"), p), -1, rounds=2)
    assert w == [1.0, 0.0]
    assert blend.shifted([0.5, 0.5], 0, 0.98) == [1.0, 0.0]


def test_folds_are_keyed_and_balanced(xs):
    a = folds.stratified_kfold(xs, "id", "y", 4)
    b = folds.stratified_kfold(xs.repartition(7), "id", "y", 4)
    assert sorted(map(tuple, a.select("id", "fold").collect())) == sorted(map(tuple, b.select("id", "fold").collect()))
    n = [r["count"] for r in a.groupBy("y", "fold").count().where("y = 1").collect()]
    assert max(n) - min(n) <= 1
    for _, train, valid in folds.splits(folds.group_kfold(xs, "g", 2), 2):
        assert train.select("g").distinct().intersect(valid.select("g").distinct()).count() == 0
    for _, train, valid in folds.time_splits(folds.time_parts(xs, "a", "id", 3), 3):
        assert train.agg(F.max("a")).first()[0] <= valid.agg(F.min("a")).first()[0]


def test_roles(spark):
    d = spark.createDataFrame([(1, "a", 2.0, None)], "id long, s string, x double, t timestamp")
    assert {k: r.name for k, r in reader.guess_roles(d, {"id": "drop"}).items()} == {"id": "drop", "s": "category", "x": "numeric", "t": "datetime"}


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 2
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    for centred in (True, False):
        got = np.array([list(r)[1:] for r in selection.project(d, "v", "id", 2, centred).orderBy("id").collect()])
        base = x - x.mean(axis=0) if centred else x
        u, s, vt = np.linalg.svd(base, full_matrices=False)
        want = base @ vt[:2].T
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_permutation_keeps_the_values(xs):
    p = selection.permuted(xs.select("id", "a"), "a", "id")
    before, after = ({r.id: r.a for r in d.collect()} for d in (xs, p))
    assert sorted(before.values()) == sorted(after.values()) and sum(before[k] == after[k] for k in before) < 5


def test_constant_score_uplift(xs):
    d = xs.withColumns({"s": F.lit(1.0), "w": (F.col("id") % 2).cast("int")})
    points = sorted(tuple(r) for r in uplift.curve(d, "y", "s", "w", "qini").collect())
    assert points[0] == (0.0, 0.0) and points[1][0] == 1.0 and len(points) == 2


def test_russian_tokens(spark):
    d = spark.createDataFrame([("Ёжик не идёт в лес 123 МГУ",)], "t string")
    assert d.select(texts.tokens_ru(F.col("t")).alias("k")).first().k == ["ежик", "неидет", "лес", "МГУ"]


def test_stream_scoring(spark, xs, tmp_path):
    xs.write.parquet(f"{tmp_path}/in")
    scale = numeric.StandardScaler.fit(xs, ["a"])
    stream = spark.readStream.schema(xs.schema).parquet(f"{tmp_path}/in")
    q = score_stream(stream, scale.apply, f"{tmp_path}/out", f"{tmp_path}/check")
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 400


def test_best_features_and_report(xs):
    roles = {"a": reader.Role("numeric"), "b": reader.Role("numeric", {"prob": True})}
    x = xs.withColumn("b", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("b"))))
    made = pipelines.linear_features(x, roles)
    assert made.names == ["logodds__b", "scaler__fillnamed__a"]
    name, steps = pipelines.best_of(x, {"plain": lambda d: pipelines.simple_features(d, roles), "linear": lambda d: pipelines.linear_features(d, roles)}, lambda d, names: float(len([n for n in names if "__" in n])))
    assert name == "linear" and steps.apply(x).count() == 400
    assert pipelines.with_roles(x, roles).schema["b"].metadata == {"role": "numeric", "prob": True}
    assert pipelines.raw_name("oof__x__y", ["y", "x__y"]) == "x__y"
    page = report.render("Model <1>", {"bins": report.score_bins(x, "y", "b", "id", 5)})
    assert "Model &lt;1&gt;" in page and page.count("<tr>") == 6


def test_configs_stack(xs):
    done, preds = pipelines.run_configs(xs, "y", "id", "binary", 0.0, configs=({"algorithms": ("linear",)}, {"algorithms": ("linear",)}))
    assert len(done) == 1
    assert pipelines.stack_inputs(preds, "id").columns == ["id", "level1_0"]
    assert done[0].predict(xs).count() == 400


def test_tfidf_svd_equals_numpy(spark):
    import random

    from millrace.operators import texts

    rng = random.Random(4)
    rows = [(i, [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(30)]) for i in range(300)] + [(900, [])]
    d = spark.createDataFrame(rows, "id long, toks array<string>")
    w = texts.tfidf(d, "id", "toks", texts.document_frequencies(d, "toks")).collect()
    names = sorted({r.token for r in w})
    m = np.zeros((301, len(names)))
    for r in w:
        m[min(r.id, 300), names.index(r.token)] = r.weight
    out = texts.tfidf_svd(d, "id", "toks").orderBy("id").collect()
    got = np.array([list(r)[1:] for r in out])
    k = got.shape[1]
    assert k == min(100, len(names) - 1) and not got[300].any()
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:k], atol=1e-6)
    assert np.allclose(np.abs(got[:, :3]), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_text_and_vector_queries_do_the_whole_job(spark):
    from millrace import catalogue

    at = "/root/testdata/sf0.001"
    dims = len(spark.read.parquet(f"{at}/embeddings.parquet").first().embedding)
    assert len(catalogue.QUERIES["svd"](spark, at).columns) == 1 + min(100, dims - 1)
    assert len(catalogue.QUERIES["pca"](spark, at).columns) == 1 + min(500, dims - 1)
    voc = catalogue.QUERIES["document_frequencies"](spark, at).count()
    assert catalogue.QUERIES["tfidf_whole"](spark, at).select("token").distinct().count() == voc > 1000


def test_multiclass_automl(spark):
    from millrace.operators.categorical import MulticlassTargetEncoder
    from millrace.plans.automl import TabularAutoML

    rows = [(i, "abc"[i % 3], float(i % 3 * 10 + i % 7), None if i % 11 == 0 else "xyz"[(i + i // 50) % 3]) for i in range(240)]
    df = spark.createDataFrame([*rows, (240, None, 1.0, "x")], "id int, kind string, size double, colour string")
    model = TabularAutoML("multiclass", n_folds=2)
    out = model.fit_predict(df, "kind", "id").toPandas()
    assert model.classes == ["a", "b", "c"] and len(out) == 240  # the row without a target is left out
    p = np.array(out["prediction"].tolist())
    assert np.allclose(p.sum(axis=1), 1) and (np.array(model.classes)[p.argmax(axis=1)] == out["kind"]).mean() > 0.95
    new = spark.createDataFrame([(1, 2.0, "x"), (2, 22.0, "unseen"), (3, None, None)], "id int, size double, colour string")
    got = {r.id: r.prediction for r in model.predict(new).collect()}
    assert np.argmax(got[1]) == 0 and np.argmax(got[2]) == 2 and abs(sum(got[3]) - 1) < 1e-9

    x = spark.createDataFrame([(0, "u", 0), (0, "u", 1), (1, "u", 2), (2, "v", 0), (2, "v", 3)], "y int, c string, fold int").withColumn("fold", F.col("fold") % 2)
    enc = MulticlassTargetEncoder.fit(x, ["c"], "y", "fold", [0, 1, 2])
    got = enc.apply(x.select("c").distinct().union(spark.createDataFrame([("w",)], "c string"))).toPandas().set_index("c")
    assert np.allclose(got.sum(axis=1), 1) and np.allclose(got.loc["w"], [0.4, 0.2, 0.4])
    assert got.loc["u", "oof_0__c"] > got.loc["v", "oof_0__c"]
    assert np.allclose(enc.apply_train(x).select("oof_0__c", "oof_1__c", "oof_2__c").toPandas().sum(axis=1), 1)


def test_running_sums_and_neighbours(spark):
    from millrace.functions.running import neighbours, running

    rng = np.random.default_rng(4)
    rows = [(g, float(v), int(n)) for g in "ab" for v, n in zip(rng.permutation(700) - 300 * (g == "b"), rng.integers(0, 9, 700))] + [("a", None, 5), ("b", float("inf"), 2)]
    x = spark.createDataFrame(rows, "g string, s double, n int")
    for down in (False, True):
        got = running(x, "s", ["n"], "g", descending=down).toPandas()
        for _, part in got.groupby("g"):
            part = part.sort_values("s", ascending=not down, na_position="last" if down else "first")
            assert (part["before_n"].to_numpy() == np.r_[0, part["n"].cumsum().to_numpy()[:-1]]).all() and (part["all_n"] == part["n"].sum()).all()
    assert running(x.where("false"), "s", ["n"]).count() == 0
    pair = neighbours(x.where("g = 'a' and s is not null").select("s", "n"), "s", ["s", "n"]).toPandas().sort_values("s")
    assert np.isnan(pair["last_s"].iloc[0]) and (pair["last_s"].to_numpy()[1:] == pair["s"].to_numpy()[:-1]).all()
    assert (pair["last_n"].to_numpy()[1:] == pair["n"].to_numpy()[:-1]).all()
