"""tf-idf directions take few passes over the rows."""

import random

from millrace.operators import texts


def test_svd_takes_few_jobs(spark):
    rng = random.Random(5)
    rows = [(i, [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(30)]) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, toks array<string>")
    sc = spark.sparkContext
    sc.setJobGroup("svd", "svd")
    try:
        texts.tfidf_svd(d, "id", "toks", k=20, min_df=1)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("svd")) < 60
