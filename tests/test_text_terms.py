"""Terms are counted in tasks: tf-idf of single keys moves no rows."""

from millrace.operators import texts


def test_tfidf_of_single_keys_is_not_shuffled_and_equals_that_of_joined_counts(spark, monkeypatch):
    x = spark.createDataFrame([(i, [f"w{i % 3}", "a", "a", f"w{i % 5}"] if i % 4 else []) for i in range(40)], "id long, toks array<string>")
    voc, got = texts.fit_tfidf(x, "id", "toks", min_df=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    fast = {(r.id, r.token): round(r.weight, 9) for r in got.collect()}
    monkeypatch.setattr(texts, "SENT", 0)
    assert fast == {(r.id, r.token): round(r.weight, 9) for r in texts.tfidf(x, "id", "toks", voc).collect()}
    # rows of one key are one document
    twice = x.unionByName(x)
    assert {(r.id, r.token): round(r.weight, 9) for r in texts.fit_tfidf(twice, "id", "toks", min_df=2)[1].collect()}.keys() == fast.keys()
