"""Small tables of the n-gram join: few shuffles, pairs of equal rows once."""

from pyspark.sql import functions as F

from millrace.llm import ngram_join


def test_verified_pairs_come_once_and_with_few_shuffles(spark):
    words = [f"w{i}" for i in range(60)]
    other = " ".join(words[:-1] + ["z"])
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, other), (2, other), (3, "q r s t u v")], "doc_id long, text string")
    prof = ngram_join.profiles(docs, "doc_id", "text", 5, 80)
    named = prof.groupBy("key").agg(F.min("doc_id").alias("node"), F.min("place").alias("place")).select("node", "place", "key")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = ngram_join.verify(pairs, docs, named, 5, 80, 1024)
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
