"""Token counts through a digest cache.

A text's count is stored under the sha256 of its normal form and the digest of the tokenizer's version. Counting joins
the texts' digests with the stored ones, encodes one text of each digest that is missing, and appends the new counts.
Texts themselves are only shuffled where a digest may stand in several rows or in the cache; a fixed-size bitmap of
digests tells which.

The normal form may only undo what the tokenizer undoes itself. For a tokenizer that drops white space (``spaces``), runs
of space, tab and line ends become one space, and those at the ends go; where it lower-cases (``lower``), A-Z count as
a-z in texts of ASCII characters without "<" (no combining mark and no special token can depend on their case). For any
other tokenizer a text is its own normal form. Under ``spaces`` a text's count is also the sum of its words', and a task
encodes each distinct word once.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, _made, column, materialize, shared_dir, tune
from .ngram_join import flagged, marks

#: Characters of a long text that are split into words at a time.
PIECE = 1 << 18
#: Words whose counts a task remembers.
MEMO = 1 << 20
#: Part of all rows from which on a digest is hot; fewer than 1 / HOT digests can be.
HOT = 1 / 2000
CACHE = "content string, n_tokens long, tokenizer string"


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file (``tokenizers`` for .json, ``sentencepiece`` for .model) and what it is known to undo."""

    path: str
    spaces: bool = False
    lower: bool = False

    def load(self) -> bytes:
        with open(self.path, "rb") as f:
            return f.read()

    def version(self, body: bytes) -> str:
        """Digest of the vocabulary, the library that reads it, and the normal form."""
        if self.path.endswith(".model"):
            import sentencepiece as library
        else:
            import tokenizers as library
        return hashlib.sha256(f"{library.__name__} {library.__version__} {self.spaces} {self.lower} ".encode() + hashlib.sha256(body).digest()).hexdigest()

    def normal(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        if self.spaces:
            text = F.regexp_replace(F.regexp_replace(text, r"[ \t\n\r]+", " "), r"^ | \z", "")
        if self.lower:
            text = F.when(text.rlike(r"^[\x00-;=-\x7F]*\z"), F.lower(text)).otherwise(text)
        return text


class Words(dict):
    """Counts of words already met, for a tokenizer that drops white space: no token and no merge crosses it. Forgets all when full."""

    def learn(self, words: list[str], many: Callable[[list[str]], list[int]]) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > MEMO:
            self.clear()
            new = list(set(words))
        self.update(zip(new, many(new)))


class Counter:
    """The library's own encoder of a vocabulary, without begin, end or other added tokens, truncation and padding."""

    def __init__(self, path: str, body: bytes, spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark decides how many tasks run
        self.words = Words() if spaces else None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=body)
            self.many = lambda texts: [len(i) for i in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer as Library

            model = Library.from_str(body.decode())
            model.no_truncation()
            model.no_padding()
            self.many = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.words is None:
            return self.many([text])[0]
        total, lo = 0, 0
        while lo < len(text):  # a long text in pieces cut at white space
            hi = lo + PIECE
            while hi < len(text) and text[hi - 1] not in " \t\n\r":
                hi += 1
            words = text[lo:hi].replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
            self.words.learn(words, self.many)
            total += sum(map(self.words.__getitem__, words))
            lo = hi
        return total


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) that a cache holds for a tokenizer version; a cache that doesn't exist is empty."""
    try:
        got = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        got = spark.createDataFrame([], CACHE)
    one = got.where(F.col("tokenizer") == version)  # a folder for each version: others aren't read
    return one.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have added one text


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs.

    cache: a folder that all executors share, of Parquet files (content, n_tokens) in a folder for each tokenizer version; it
    is made if it doesn't exist, and new counts are appended in one commit, so that a job that fails adds none. Without
    one, a new cache is used that is deleted when the process ends. Null texts are empty ones: no bytes, no tokens.
    Repeated rows, rows of equal or null ids and equal texts each have a row; an equal text is encoded once. Texts of any
    length are counted whole. An empty table gives an empty result; other columns don't matter, whatever their names.
    """
    tune(docs.sparkSession)
    spark, body = docs.sparkSession, tokenizer.load()
    version = tokenizer.version(body)
    if cache is None:
        cache = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
        _made.append((spark, cache))
    have = stored(spark, cache, version)
    made = Scratch()
    whole = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    digest = F.sha2(tokenizer.normal(F.col("text")), 256)
    rows = materialize(whole.select("doc_id", digest.alias("content"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    copies = made.keep(rows.groupBy("content").agg(F.count("*").alias("copies")))
    missing = made.keep(copies.join(have, "content", "left_anti"))
    n = rows.count()
    known = copies.join(have, "content", "left_semi").select("content")
    if not missing.isEmpty():
        often = marks(known.unionAll(missing.where("copies > 1").select("content")), "content")
        near = flagged(whole.select("text", digest.alias("content")), "content", made.keep(often), "often")
        alone = near.where("not often").select("content", "text")
        some = near.where("often").select("content", "text").dropDuplicates(["content"]).join(missing.select("content"), "content", "left_semi")
        new = _encoded(alone.unionAll(some), tokenizer, body).withColumn("tokenizer", F.lit(version))
        new.write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stored(spark, cache, version)
    hot = made.keep(copies.where(F.col("copies") > max(1.0, HOT * n)).select("content", F.lit(True).alias("hot")))
    counts = counts.join(F.broadcast(hot), "content", "left")
    x = rows.join(F.broadcast(hot), "content", "left")  # fewer than 1 / HOT digests
    out = x.where("hot is null").select("doc_id", "content", "n_bytes").join(counts.where("hot is null").select("content", "n_tokens"), "content")
    out = out.unionByName(x.where("hot").select("doc_id", "content", "n_bytes").join(F.broadcast(counts.where("hot").select("content", "n_tokens")), "content"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _encoded(texts: DataFrame, tokenizer: Tokenizer, body: bytes) -> DataFrame:
    """(content, n_tokens) of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(body)
    path, spaces = tokenizer.path, tokenizer.spaces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, shared.value, spaces)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return texts.mapInArrow(run, "content string, n_tokens long")
