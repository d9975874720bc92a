"""tf-idf rows of the SVD are made in tasks, and letters are told from gaps as before."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import texts


def test_rows_of_the_svd_are_not_shuffled(spark, monkeypatch):
    kept = []
    plain = texts.hold
    monkeypatch.setattr(texts, "hold", lambda df: (kept.append(df), plain(df))[1])
    d = spark.createDataFrame([(i, [f"t{i % 7}", "a", f"u{i % 3}"] if i % 5 else []) for i in range(60)], "id long, toks array<string>")
    out = texts.tfidf_svd(d, "id", "toks", k=5, min_df=1)
    plan = kept[-1]._jdf.queryExecution().executedPlan().toString()
    assert "i" in kept[-1].columns and "Exchange" not in plan and "Join" not in plan
    assert out.count() == 60 and out.where("id % 5 = 0 and svd_0 != 0").isEmpty()
    twice = texts.tfidf_svd(d.unionByName(d.where("id = 7")), "id", "toks", k=5, min_df=1)
    assert twice.count() == 61


def test_gram_products_equal_numpy_for_frequent_and_rare_tokens(spark, monkeypatch):
    monkeypatch.setattr(texts, "DENSE", 6)
    r = np.random.default_rng(8)
    m = np.where(r.random((80, 25)) < 0.3, r.normal(size=(80, 25)), 0.0)
    rows = spark.createDataFrame([(np.flatnonzero(x).tolist(), x[x != 0].tolist()) for x in m], "i array<int>, w array<double>")
    for b in (1, 4):
        v = r.normal(size=(25, b))
        assert np.allclose(texts._gram_times(rows, v), m.T @ (m @ v))


def test_gaps_are_those_of_the_plain_class(spark):
    code = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    chars = spark.range(1, 0xD800).select(F.concat(F.lit("a"), code, F.lit("b")).alias("c"))
    assert "p{Alnum}" in texts.GAPS
    assert chars.where(F.regexp_replace("c", texts.GAPS, " ") != F.regexp_replace("c", "[^A-Za-zА-Яа-я0-9]+", " ")).isEmpty()
