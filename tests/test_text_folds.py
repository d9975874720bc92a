"""The text model of each fold reads hashed tokens that were made once."""

from pyspark.sql import functions as F

from millrace.operators import models


def test_texts_are_made_into_tokens_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def toks(i):
        seen.add(1)
        return None if i == 0 else ["good" if i % 2 else "bad", f"w{i % 5}"]

    df = spark.range(60).select("id", toks(F.col("id")).alias("t"), (F.col("id") % 2).cast("int").alias("y"), (F.floor(F.col("id") / 2) % 3).cast("int").alias("fold"))
    fitted, out = models.text_oof(df, "t", "y", "binary", 3, "p")
    got = {r.id: r.p for r in out.select("id", "p").collect()}
    assert seen.value == 60 and len(got) == 60
    assert min(p for i, p in got.items() if i % 2) > max(p for i, p in got.items() if i and i % 2 == 0)
    assert "_hot__text" not in out.columns
    again = fitted.predict(df.where("id > 0")).select("id", "p").collect()
    assert all((r.p > 0.5) == bool(r.id % 2) for r in again)
