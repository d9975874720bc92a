"""Reading tables of every supported kind into a DataFrame, and writing results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, data: Any, **options) -> DataFrame:
    """A DataFrame from: a DataFrame; a pandas frame; a dict of equally long columns; a 2-d array (columns f0..);
    a path ending in .parquet, .orc, .json, .csv or .feather; ("jdbc", url, query); or SQL text beginning with select."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, dict):
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(data))
    if isinstance(data, tuple) and data and data[0] == "jdbc":
        return spark.read.format("jdbc").option("url", data[1]).option("query", data[2]).options(**options).load()
    if isinstance(data, str):
        kind = data.rstrip("/").rsplit(".", 1)[-1].lower()
        if data.lstrip()[:6].lower() == "select":
            return spark.sql(data)
        if kind in ("parquet", "orc", "json"):
            return spark.read.options(**options).format(kind).load(data)
        if kind == "csv":
            return spark.read.options(**({"header": True, "inferSchema": "schema" not in options} | options)).csv(data, schema=options.get("schema"))
        if kind == "feather":
            import pyarrow.feather

            return spark.createDataFrame(pyarrow.feather.read_table(data))
        raise ValueError(f"no reader for {data!r}")
    if hasattr(data, "ndim"):
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(data, columns=[f"f{i}" for i in range(data.shape[1])]) if data.ndim == 2 and not hasattr(data, "columns") else data)
    raise TypeError(f"no reader for {type(data).__name__}")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster has cores: for costly work per row over a table of a few files, whose
    splits would keep most cores idle. A table of many splits stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def count_lines(spark: SparkSession, path: str, header: bool = True) -> int:
    """Lines of a text file that aren't blank, without the header."""
    return spark.read.text(path).where(F.trim("value") != "").count() - int(header)


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with batch: numbers of runs of size rows in the order of key.

    Rows are counted by range buckets of the key first: the running number of a row is its number inside its bucket plus
    the rows of the buckets before, so that no single task numbers all rows.
    """
    n = 64
    lim = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if lim.lo is None:
        return df.withColumn("batch", F.lit(None).cast("long"))
    width = max(1.0, (lim.hi - lim.lo + 1) / n)
    x = df.withColumn("_b", F.floor((F.col(key) - F.lit(lim.lo)) / F.lit(width)))
    before = x.groupBy(F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    before = before.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = x.join(before, F.col("_b").eqNullSafe(F.col("_c")))
    i = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return x.withColumn("batch", F.floor(i / size)).drop("_b", "_c", "_before")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).format(kind)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
