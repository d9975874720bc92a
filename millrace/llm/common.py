"""Shared parts: shared-folder tables, whole-text numpy tokenising, components of a link graph."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Rows in an Arrow batch; with documents of 100 KB a batch stays near 50 MB.
BATCH_ROWS = 500
#: Bytes of text that the numpy code looks at together (one longer text is taken alone).
SLICE_BYTES = 1 << 21
MASK64 = (1 << 64) - 1


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python operators of this package receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a temporary one of this machine, which only a
    local master can share; on any other it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables in the shared folder that lazy results may still read; deleted at the end of the process, or by release.
_made: list[tuple[SparkSession, str]] = []


def _write(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and lost executors lose nothing. The table
    stays until the process ends, as lazy results may read it, or until release."""
    path, out = _write(df)
    _made.append((df.sparkSession, path))
    return out


def made() -> frozenset[str]:
    """The tables of materialize that there are: what others made before a run begins."""
    return frozenset(path for _, path in _made)


def release(newest: int = 0, but: frozenset[str] = frozenset()) -> None:
    """Delete the tables of materialize but for the newest ones and the named ones."""
    gone = [t for t in _made[: len(_made) - newest] if t[1] not in but]
    _made[:] = [t for t in _made if t not in gone]
    for spark, path in gone:
        if spark.sparkContext._jsc is not None:  # a stopped session can't delete any more
            _delete(spark, path)


atexit.register(release)


def release_shuffles(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of finished jobs. They do so once the driver has collected its garbage, which
    a driver with little to do puts off while many small shuffles fill the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables in the shared folder that are deleted together when what they were made for is done."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """materialize, to be deleted by clear."""
        path, out = _write(df)
        self.paths.append((df.sparkSession, path))
        return out

    def clear(self) -> None:
        for spark, path in self.paths:
            _delete(spark, path)
        self.paths = []


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none of the columns has them (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def column(name: str) -> Column:
    """A column by its very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_keys(df: DataFrame) -> list[Column]:
    """Two longs: 128 bits of hash over all columns of a row. Equal rows have equal keys."""
    every = []
    for f in df.schema.fields:
        c = column(f.name)
        every += [F.map_entries(c) if isinstance(f.dataType, MapType) else c, c.isNull()]  # hashes pass over nulls
    return [F.xxhash64(F.lit(i), *every) for i in (0, 1)]


def slices(batch_col: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array holding at most SLICE_BYTES bytes each, one row at least."""
    off = offsets(batch_col)
    lo = 0
    while lo < len(batch_col):
        hi = int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(batch_col))
        yield lo, hi
        lo = hi


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string array; a null has the length 0."""
    lens = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lens)])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in a row, and each text's offset among them. Nulls are empty."""
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    col = col.cast(pa.large_string())
    raw = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[raw[0] : raw[-1]] if body is not None and raw[-1] > raw[0] else np.zeros(0, np.uint8)
    return data, raw - raw[0]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _table(20240607)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _pow.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES), base, np.uint64)
        out[0] = 1
        have = _pow[kind] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def words(col: pa.Array, keep: np.ndarray | None = None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document row, byte start) of every maximal run of word bytes.

    Words are runs of bytes other than space and 0x09-0x0D, or, with keep, runs of bytes that keep marks.
    A-Z count as a-z. Hashes have 64 bits; a word never runs over the end of its text.
    """
    data, off = utf8(col)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    inside = keep[data] if keep is not None else ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = begins[1:] - 1
    last[ends] = inside[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("up", _BASE, n), out=total[1:])
    h = (total[stop] - total[start]) * _powers("down", _INV, n)[start]
    h = mix(h + (stop - start).astype(np.uint64) * _ODD)
    return h, np.searchsorted(off, start, side="right") - 1, start


def shingles(h: np.ndarray, row: np.ndarray, rows: int, n: int) -> Iterator[np.ndarray]:
    """For each of the rows texts, the sorted distinct hashes of its n-word shingles; a shorter text is one shingle."""
    k = np.uint64(0xA24BAED4963EE407)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    m = len(h) - n + 1
    win = np.zeros(0, np.uint64)
    if m > 0:
        win = h[:m].copy()
        for i in range(1, n):
            win = win * k + h[i : i + m]
        win = mix(win)
    for r in range(rows):
        lo, hi = bounds[r], bounds[r + 1]
        if hi - lo >= n:
            yield np.unique(win[lo : hi - n + 1])
        elif hi > lo:
            x = (int(hi - lo) * 0x9FB21C651E98DF25) & MASK64
            for v in h[lo:hi]:
                x = (x * int(k) + int(v)) & MASK64
            yield mix(np.array([x], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _is_stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    return e.groupBy("u").count().where("count > 1").isEmpty() and e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = materialize, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each node of an undirected graph of longs: root is the smallest node id it can reach.

    Alternating large-star and small-star rounds; each half round's edges go to the shared folder
    (by keep). Minima are
    aggregated map-side and joined back, so that a node with very many links is no task's burden.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = keep(e)
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    while not _is_stars(e):
        sym = e.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select(F.col("e.u").alias("x"), F.col("e.v").alias("y"))
        low = sym.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = keep(sym.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")))  # read twice; equal rows go below
        j = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = j.select(F.explode(F.array(pair("u", "m"), F.when(F.col("v") > F.col("m"), pair("v", "m")))).alias("e")).where("e is not null").select("e.*").distinct()
        e = keep(small)
        release_shuffles(e.sparkSession)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(roots)
