"""Tables of a running computation in the folder that the cluster shares: lineage ends there, lost executors lose nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a local master can share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables that are deleted together when what they were made for is done (or one by one)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path = f"{shared_dir(self.spark)}/millrace/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, newest: int = 0) -> None:
        """Delete all tables but for the newest ones."""
        gone = self.paths[: len(self.paths) - newest]
        self.paths = self.paths[len(gone) :]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Tables that lazy results may still read.
_held: dict[int, Workspace] = {}


def hold(df: DataFrame) -> DataFrame:
    """df, written once for results that read it several times and are not computed yet; deleted when the process ends."""
    at = _held.setdefault(id(df.sparkSession.sparkContext), Workspace(df.sparkSession))
    return at.keep(df)


def _clear() -> None:
    for w in _held.values():
        if w.spark.sparkContext._jsc is not None:  # a stopped session can't delete any more
            w.clear()


atexit.register(_clear)
