"""Centroid clustering, target resampling and token counts against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import lloyd, queries, target_sampling, token_counts

from .test_operators import DOCS, corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) / 8 + (i % 5) / 4).astype(np.float32).tolist(), i % 5) for i in range(150)]
    rows += [(200 + i, rows[3][1], 1) for i in range(40)] + [rows[5], rows[5]]  # copies and repeated rows
    bad = list(rows[7][1])
    rows += [(300, None, 0), (301, [], 0), (302, rows[1][1][:63], 0), (303, rows[1][1] + [0.0], 0), (304, [math.nan] + bad[1:], 0), (305, [math.inf] + bad[1:], 0), (306, [None] + bad[1:], 0)]
    return rows + [(None, rows[9][1], None), (307, [0.0] * 64, 0), (-4, [-1.0] * 64, 0)]


def plain_lloyd(rows, k=16, rounds=3, limit=1 << 27):
    kept = [(i, [max(-limit, min(limit, math.floor(64 * float(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    c = [q for _, q in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[0] is None, r[0] or 0, r[1]))[:k]]
    near = lambda q: min((sum((x - y) ** 2 for x, y in zip(q, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(c)):
            mine = [q for (_, q), a in zip(kept, of) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *near(q)[::-1]) for i, q in kept]
    each = Counter()
    for _, j, d in got:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), sha(",".join(map(str, c[j])))) for i, j, d in got), key=str)


def clustered(df, **kw):
    return sorted((tuple(r) for r in lloyd.cluster(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_lloyd_equals_brute_force_whatever_the_partitions(spark):
    rows = vectors()
    want = plain_lloyd(rows)
    for parts in (1, 7):
        d = spark.createDataFrame(rows, VECTORS).repartition(parts).withColumns({"cluster": F.lit("x"), "vector": F.lit(1), "distance": F.lit(None)})
        assert clustered(d) == want


def test_lloyd_of_few_none_and_huge_vectors(spark):
    assert clustered(spark.createDataFrame([], VECTORS)) == []
    assert clustered(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], VECTORS)) == []
    rows = [(1, [0.5] * 64, 0), (2, [0.5] * 64, 0), (3, [-0.51] * 64, 0)]
    assert clustered(spark.createDataFrame(rows, VECTORS)) == plain_lloyd(rows)
    rows = [(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0), (3, [1.0] * 64, 0)]
    assert clustered(spark.createDataFrame(rows, VECTORS), k=1) == plain_lloyd(rows, k=1)


def test_lloyd_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op11_centroid_clustering(spark, d).collect()), key=str) == plain_lloyd(rows)


def buckets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)), len(w)


def plain_resample(rows, target, percent=5, least=20):
    docs = [(i, *buckets(t)) for i, t in rows]
    s, t = sum((b for _, b, _ in docs), Counter()), sum((buckets(x)[0] for x in target), Counter())
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for i, b, n in docs:
        w = sum(c * gain[k] for k, c in b.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, b.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def sampled(docs, target, **kw):
    return sorted((tuple(r) for r in target_sampling.resample(docs, target, **kw).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_target_resampling_equals_brute_force(spark, monkeypatch):
    rows = corpus() + [(600 + i, "same words again and again " * 5, "en", "s1", 1) for i in range(60)] + [(700, "Ünï cödé 漢字 " + "x" * 200 + " b9", "en", "s", 1), (701, "a", "en", "s", 1), (702, "word " * 3000, "en", "s", 1)]
    bench = [("foo bar same words", 1), (None, 2), ("", 3), (rows[0][1], 4)]
    d = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"weight": F.lit("x"), "block": F.lit(1), "id": F.lit(2)})
    target = spark.createDataFrame(bench, "text string, id long")
    want = lambda **kw: plain_resample([(r[0], r[1]) for r in rows], [b[0] for b in bench], **kw)
    assert sampled(d, target) == want()
    monkeypatch.setattr(target_sampling, "SALT_BLOCKS", 1)
    assert sampled(d, target, percent=60, least_words=1) == want(percent=60, least=1)


def test_target_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame(corpus()[:30], DOCS)
    assert sampled(none, some) == [] and sampled(none, none) == []
    assert sampled(some, none) == plain_resample([(r[0], r[1]) for r in corpus()[:30]], [])


def test_checksums_of_spans_and_of_long_texts(monkeypatch):
    rng = random.Random(5)
    texts = [None, "", "q" * 64 + " " + "r" * 65 + " s", *(" ".join(rng.choice(["foo", "Bar", "é", "q-r", "x" * 70]) for _ in range(rng.randrange(60))) for _ in range(40)), "y" * 500, "zz " * 300]
    whole = [buckets(t) for t in texts]
    for size in (target_sampling.SLICE_BYTES, 37):  # 37: each text in many pieces
        monkeypatch.setattr(target_sampling, "SLICE_BYTES", size)
        for t, (b, n) in zip(texts, whole):
            table, words = target_sampling._counted(pa.array([t], pa.string()))
            assert {int(i): int(table[i, 0]) for i in np.flatnonzero(table)} == dict(b) and words[0] == n


WORDS = token_counts.Tokenizer(public_tokenizers.path("word_bpe_49k.json"), spaces=True, lower=True)
TEXTS = [
    None, "", " ", "\n\t", "Hello World", "hello  world\n", "<|endoftext|>", "a<|ENDOFTEXT|>b", "a <|startoftext|>b", "J̌ ǰ", "İ ́x", "İstanbul Straße", "don't we'll 12345 !?…",
    "漢字 かな", "x y z", "\x1c\x0b\x0c \x85 q", "é é", "👍🏽 ok", "Hello World", "HELLO WORLD", "w " * 50_000, "z" * 3000, "﻿bom", "tab\tTAB",
]


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(m.encode(t or "", num_threads=1))
    from tokenizers import Tokenizer

    m = Tokenizer.from_file(path)
    m.no_truncation()
    m.no_padding()
    return lambda t: len(m.encode(t or "", add_special_tokens=False).ids)


def counted(df, tokenizer, **kw):
    return sorted((tuple(r) for r in token_counts.count_tokens(df, tokenizer, **kw).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)


@pytest.mark.parametrize("tokenizer", [WORDS, token_counts.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")), token_counts.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))])
def test_token_counts_equal_the_library(spark, tokenizer, tmp_path):
    count = library(tokenizer.path)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("aA J̌́ \n\t<|>é.'s1 ") for _ in range(rng.randrange(80))) for _ in range(300)] + ["copy of copies"] * 50
    rows = [(i if i % 9 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(1, "other text, same id", "en", "s", 0)] * 2
    want = sorted(((i, len((t or "").encode()), count(t), count(t) > 2048) for i, t, *_ in rows), key=str)
    d = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"content": F.lit("x"), "n_tokens": F.lit(1), "hot": F.lit(2)})
    cache = f"file://{tmp_path}/cache"
    assert counted(d, tokenizer, cache=cache) == want
    stored = spark.read.parquet(cache)
    n, distinct = stored.count(), stored.select("content").distinct().count()
    assert n == distinct < len(set(texts)) + 1
    assert counted(d, tokenizer, cache=cache) == want and spark.read.parquet(cache).count() == n  # all hits: nothing is added
    more = d.unionByName(spark.createDataFrame([(9000, "a text that is new", "en", "s", 0)] * 3, DOCS), allowMissingColumns=True)
    assert len(counted(more, tokenizer, cache=cache)) == len(want) + 3 and spark.read.parquet(cache).count() == n + 1


def test_token_counts_come_from_the_cache(spark, tmp_path):
    """A stored count is used, one of another tokenizer version isn't; two entries of one text count once."""
    d = spark.createDataFrame([(1, "Hello   World", "en", "s", 0), (2, "hello world", "en", "s", 0)], DOCS)
    cache = f"file://{tmp_path}/cache"
    content = hashlib.sha256(b"hello world").hexdigest()
    version = WORDS.version(WORDS.load())
    spark.createDataFrame([(content, 77, "other")], token_counts.CACHE).write.partitionBy("tokenizer").parquet(cache)
    assert [r[2] for r in counted(d, WORDS, cache=cache)] == [2, 2]
    spark.createDataFrame([(content, 2, version)], token_counts.CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert [r[2] for r in counted(d, WORDS, cache=cache)] == [2, 2]
    cache = f"file://{tmp_path}/planted"
    spark.createDataFrame([(content, 77, version)], token_counts.CACHE).write.partitionBy("tokenizer").parquet(cache)
    assert [r[2] for r in counted(d, WORDS, cache=cache)] == [77, 77]


def test_words_are_forgotten_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    monkeypatch.setattr(token_counts, "PIECE", 10)
    c = token_counts.Counter(WORDS.path, WORDS.load(), True)
    text = "one two three four five six " * 4
    assert c.count(text) == library(WORDS.path)(text) and len(c.words) <= 6


def test_token_counts_of_an_empty_table_and_of_the_query(spark):
    assert counted(spark.createDataFrame([], DOCS), WORDS) == []
    d = "/root/testdata/sf0.001"
    count = library(WORDS.path)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 2048) for r in rows), key=str)
    assert sorted(map(tuple, queries.op13_token_counts(spark, d).collect()), key=str) == want
