"""From raw documents to packed training rows: toxic ones out, one of each near-duplicate group, no benchmark leaks,
sources mixed to their target weights in training order, token ids packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, ngram_join, packing, queries, toxicity
from millrace.llm.common import column, fresh, made, materialize, release, row_keys


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. Null and empty texts stay; other columns may have any name."""
    (name,) = fresh(docs.columns, "_score")
    model = queries.toxic_model(spark, docs, sf_dir)
    return toxicity.score(docs, model, name=name).where(column(name) < 0.5).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: of the smallest doc_id (nulls last), and of its rows the smallest text.

    Rows are told apart by 128 bits of hash over all of their columns, not by doc_id; of rows that are equal in every
    column one stays. Documents without words are no copies of each other and stay.
    """
    both = fresh(docs.columns, "_k1", "_k2")
    keyed = docs.withColumns(dict(zip(both, row_keys(docs))))
    named = keyed.select("doc_id", "text", *[column(k).alias(c) for k, c in zip(both, ("k1", "k2"))])
    linked = ngram_join.groups(named, carry=("k1", "k2")).where("group is not null")
    rows = linked.groupBy("group", "doc_id", "k1", "k2").agg(F.count("*").alias("n"))
    ids = rows.groupBy("group", F.col("doc_id").isNull().alias("none"), "doc_id").agg(F.min(F.struct("k1", "k2", "n")).alias("k"), F.count("*").alias("keys"))
    first = materialize(ids.groupBy("group").agg(F.min(F.struct("none", "doc_id", "keys", "k")).alias("f")).select("group", "f.doc_id", "f.keys", "f.k.*"))
    stay = first.select("group", "k1", "k2", "n")
    tied = first.where("keys > 1").select("group", F.col("doc_id").alias("id"))
    if not tied.isEmpty():  # texts under one id: only here do texts count
        some = rows.join(tied, "group").where(F.col("doc_id").eqNullSafe(F.col("id"))).select("group", "k1", "k2", "n")
        least = named.select("text", "k1", "k2").join(some, ["k1", "k2"]).groupBy("group").agg(F.min(F.struct("text", "k1", "k2", "n")).alias("f"))
        stay = materialize(first.where("keys = 1").select("group", "k1", "k2", "n").unionByName(least.select("group", "f.k1", "f.k2", "f.n")))
    gone = materialize(rows.select("k1", "k2").join(stay, ["k1", "k2"], "left_anti"))
    (bit,) = fresh(keyed.columns, "_marked")
    near = ngram_join.flagged(keyed, both[0], materialize(ngram_join.marks(gone, "k1")), bit)  # most rows aren't shuffled
    kept = near.where(~column(bit)).unionByName(near.where(column(bit)).join(gone.toDF(*both), both, "left_anti").select(*map(column, near.columns))).drop(bit)
    again = materialize(stay.where("n > 1").select("k1", "k2").toDF(*both))
    if not again.isEmpty():
        kept = kept.join(again, both, "left_anti").unionByName(kept.join(again, both, "left_semi").dropDuplicates(both))
    return kept.drop(*both)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay."""
    return decontaminate.remove_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix reads a document, in training order. Documents without words are never read."""
    return mixing.training_order(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows in training order, which is the order of the rows in docs' files."""
    order = packing.file_order(docs)
    return packing.pack(docs.select("doc_id", "text", order.alias("position")), position="position")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("token output", pack_tokens),
]

#: Learned scores, alignment and byte-pair encoding can't be put in SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's documents are written to the shared folder and reread, and
    what the stage before wrote in this run is deleted then; tables that other results read stay."""
    before = made()
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            release(newest=1, but=before)
    return docs
