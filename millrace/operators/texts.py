"""Text features: tokenisers, document frequencies, tf-idf, word-vector averages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import hold
from .selection import gram

#: English function words (fixed values).
STOPWORDS_EN = "a an and are as at be but by for from had has have he her his i in is it its of on or she that the their they this to was we were will with you".split()


#: Everything but letters and digits: [^A-Za-zА-Яа-я0-9]+ in two classes, as Java tries each class in turn on each character.
GAPS = r"[^\p{Alnum}А-я]+"


def concat_texts(columns: list[str]) -> Column:
    """Text columns joined by [SEP], null as empty."""
    return F.concat_ws(" [SEP] ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def tokens_en(text: Column, stopwords: list[str] | None = None) -> Column:
    """Array of tokens: everything but letters and digits is a gap, numbers alone and stop words are left out."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " ")
    bare = F.regexp_replace(flat, r"\b\d+\b", " ")  # spaces beside spaces make empty words, which go
    words = F.array_remove(F.split(F.lower(bare), " "), "")
    return F.filter(words, lambda w: ~w.isin(stopwords)) if stopwords else words


def tokens_ru(text: Column, stopwords: list[str] | None = None) -> Column:
    """Array of tokens: ё is е; words of digits or one letter are left out, abbreviations (up to 5 letters, more than one
    capital) keep their case, and the negations не and ни join the next word."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "ё", "е"), "Ё", "Е"), GAPS, " "))
    words = F.split(flat, " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]"))
    cased = F.transform(kept, lambda w: F.when((F.length(w) <= 5) & (F.length(F.regexp_replace(w, "[^A-ZА-Я]", "")) > 1), w).otherwise(F.lower(w)))
    fused = F.regexp_replace(F.array_join(cased, " "), r"\b(не|ни) ", "$1")
    out = F.filter(F.split(fused, " "), lambda w: w != "")
    return F.filter(out, lambda w: ~w.isin(stopwords)) if stopwords else out


def document_frequencies(df: DataFrame, tokens: str, min_df: int = 5, max_df: float = 1.0, top: int | None = 30_000) -> DataFrame:
    """(token, df, idf) of the vocabulary: the most frequent tokens within the bounds; idf = log((1 + N) / (1 + df)) + 1."""
    each = word_counts(df, tokens).select("token", "df")
    return _vocabulary(each, df.count(), min_df, max_df, top)


def _vocabulary(each: DataFrame, n: int, min_df: int, max_df: float, top: int | None) -> DataFrame:
    kept = each.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if top is not None:
        kept = kept.orderBy(F.desc("df"), "token").limit(top)
    return kept.withColumn("idf", F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1)


def term_counts(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, token, tf): how often a text holds a token."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def _terms(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, count, tokens by code) of the different tokens of each row of a batch."""
    words = pc.list_flatten(b.column(at)).dictionary_encode(null_encoding="encode")
    n = max(1, len(words.dictionary))
    row = pc.list_parent_indices(b.column(at)).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // n, pairs % n, tf, words.dictionary


def word_counts(df: DataFrame, tokens: str) -> DataFrame:
    """(token, n, df): occurrences, and rows that hold the token; batches are counted in tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, code, tf, words = _terms(b, 0)
            n, rows = np.bincount(code, tf, len(words)).astype(np.int64), np.bincount(code, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(rows.astype(np.int64))], names=["token", "n", "df"])

    return df.select(tokens).mapInArrow(work, "token string, n long, df long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def row_terms(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, token, tf) of each row, counted in tasks; rows of one key are not put together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, tf, words = _terms(b, 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), words.take(pa.array(code)), pa.array(tf.astype(np.int64))], names=[key, "token", "tf"])

    return df.select(key, tokens).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, token string, tf long")


#: Vocabularies up to this are sent to all tasks, which then weigh rows by themselves.
SENT = 50_000


def tfidf(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """(key, token, weight): term counts times idf, each document scaled to the length 1.

    With a vocabulary that fits into tasks and a row for each key nothing is shuffled; else counts are joined.
    """
    known = vocabulary.select("token", "idf").where("token is not null").limit(SENT + 1).toArrow()
    if known.num_rows > SENT or not df.groupBy(key).count().where("count > 1").isEmpty():
        return _weighted(term_counts(df, key, tokens), key, vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((known.column("token").combine_chunks(), known.column("idf").to_numpy()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = shared.value
        for b in batches:
            row, code, tf, words = _terms(b, 1)
            place = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False)[code]
            row, tf, place = (x[place >= 0] for x in (row, tf, place))
            w = tf * idf[place]
            w = w / np.sqrt(np.bincount(row, w * w, b.num_rows))[row]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(place)), pa.array(w)], names=[key, "token", "weight"])

    return df.select(key, tokens).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, token string, weight double")


def _weight_rows(df: DataFrame, key: str, tokens: str, names: list[str], idf: np.ndarray) -> DataFrame:
    """(key, i, w): each row's places in the vocabulary and their tf-idf weights, as two lists; made in tasks, nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), idf))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        for b in batches:
            row, code, tf, words = _terms(b, 1)
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)[code]
            row, tf, place = (x[place >= 0] for x in (row, tf, place))
            order = np.lexsort((place, row))
            row, tf, place = row[order], tf[order], place[order]
            w = tf * idf[place]
            w = w / np.sqrt(np.bincount(row, w * w, b.num_rows))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=[key, "i", "w"])

    return df.select(key, tokens).mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, i array<int>, w array<double>")


def _weighted(counts: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    raw = counts.join(vocabulary, "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "token", (F.col("w") / norm).alias("weight"))


def fit_tfidf(df: DataFrame, key: str, tokens: str, min_df: int = 5, max_df: float = 1.0, top: int | None = 30_000) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, tfidf of df by it); documents are told apart by key."""
    several = df.groupBy(key).count().where("count > 1").select(key)
    if not several.isEmpty():
        counts = hold(term_counts(df, key, tokens))
        voc = _vocabulary(counts.groupBy("token").agg(F.count("*").alias("df")), df.select(key).count(), min_df, max_df, top)
        return voc, _weighted(counts, key, voc)
    voc = hold(document_frequencies(df, tokens, min_df, max_df, top))
    return voc, tfidf(df, key, tokens, voc)


def word_weights(df: DataFrame, tokens: str, kind: str = "sif", a: float = 1e-3) -> DataFrame:
    """(token, n, df, weight): idf weights log1p((N + 1) / (df + 1)) or smooth inverse frequencies a / (a + n / all)."""
    words = hold(word_counts(df, tokens))
    if kind == "idf":
        return words.withColumn("weight", F.log1p(F.lit(df.count() + 1.0) / (F.col("df") + 1)))
    total = words.agg(F.sum("n").alias("t")).first().t or 1
    return words.withColumn("weight", F.lit(a) / (F.lit(a) + F.col("n") / F.lit(total)))


#: Vectors up to this length are added up as columns of one row for each key.
WIDE = 64


def average_vectors(df: DataFrame, key: str, tokens: str, vectors: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(key, dim, value): weighted mean of word vectors, vectors and weights given as (token, vector) and (token, weight)."""
    words = vectors.select("token", "vector")
    words = words.join(weights.select("token", "weight"), "token") if weights is not None else words.withColumn("weight", F.lit(1.0))
    dims = words.agg(F.max(F.size("vector")).alias("n")).first().n or 0
    x = row_terms(df, key, tokens).join(words, "token").withColumn("weight", F.col("weight") * F.col("tf"))
    if dims > WIDE:
        x = x.select(key, "weight", F.posexplode("vector").alias("dim", "v"))
        return x.groupBy(key, "dim").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("value"))
    at = lambda i: F.get("vector", F.lit(i))
    sums = [F.sum(at(i) * F.col("weight")).alias(f"_s{i}") for i in range(dims)] + [F.sum(F.when(F.size("vector") > i, F.col("weight"))).alias(f"_w{i}") for i in range(dims)]
    if not sums:
        return x.select(key, F.lit(0).alias("dim"), F.lit(None).cast("double").alias("value")).where("false")
    means = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"_w{i}").isNotNull().alias("some"), (F.col(f"_s{i}") / F.col(f"_w{i}")).alias("value")) for i in range(dims)])
    return x.groupBy(key).agg(*sums).select(key, F.explode(means).alias("m")).where("m.some").select(key, "m.dim", "m.value")


def pool(vectors: DataFrame, key: str, how: str) -> DataFrame:
    """(key, dim, value) of (key, pos, vector) rows: the first vector, or max, sum or mean over positions."""
    if how == "cls":
        x = vectors.groupBy(key).agg(F.min_by("vector", "pos").alias("vector"))
        return x.select(key, F.posexplode("vector").alias("dim", "value"))
    x = vectors.select(key, F.posexplode("vector").alias("dim", "v"))
    return x.groupBy(key, "dim").agg({"max": F.max, "sum": F.sum, "avg": F.avg}[how]("v").alias("value"))


#: Vectors that a pass multiplies together, tokens whose sums are added up together, and weights that a task looks at together.
BLOCK, SLAB, ENTRIES = 24, 1_000, 1 << 17
#: The first tokens (the most frequent), whose weights are multiplied as a dense matrix.
DENSE = 1_000


def _flat(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts of rows, tokens, weights) of the rows with tokens, in slices; the columns are lists i and w."""
    ends, i, w = b.column("i").offsets.to_numpy().astype(np.int64), *(b.column(c).flatten().to_numpy() for c in ("i", "w"))
    ends = ends - ends[0]
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + ENTRIES, side="right")) - 1)
        part = slice(ends[lo], ends[hi])
        starts = np.unique(ends[lo:hi][ends[lo:hi] < ends[lo + 1 : hi + 1]]) - ends[lo]
        if len(starts):
            yield starts, i[part], w[part]
        lo = hi


def _gram_times(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """The Gram matrix of sparse rows (i, w) times x: tasks multiply their rows, slabs of tokens are added up in tasks."""
    used = x.shape[1]
    x = np.pad(x, ((0, 0), (0, used % 2)))
    n, b = x.shape
    shared = rows.sparkSession.sparkContext.broadcast(x)
    schema = pa.schema([("slab", pa.int32()), ("v", pa.binary())])

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], schema=schema)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out, d = shared.value, np.zeros((n, b)), min(n, DENSE)
        for batch in batches:
            for starts, i, w in _flat(batch):
                ends = np.append(starts[1:], len(i))
                y = np.array([w[lo:hi] @ v.take(i[lo:hi], axis=0) for lo, hi in zip(starts.tolist(), ends.tolist())])
                row, often = np.repeat(np.arange(len(starts)), ends - starts), i < d
                dense = np.zeros((len(starts), d))
                dense[row[often], i[often]] = w[often]
                out[:d] += dense.T @ y
                rest = np.flatnonzero(~often)
                if len(rest):
                    rest = rest[np.argsort(i[rest].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]  # short numbers are sorted faster
                    first = np.flatnonzero(np.diff(i[rest], prepend=-1))
                    part = y.take(row[rest], axis=0)
                    part *= w[rest][:, None]
                    out[i[rest][first]] += np.add.reduceat(part.view(np.complex128), first, axis=0).view(np.float64)  # two columns at a time
        yield from emit({k: out[k * SLAB : (k + 1) * SLAB] for k in range(-(-n // SLAB))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(v.as_buffer(), np.float64)
        yield from emit(sums)

    kind = "slab int, v binary"
    got = rows.select("i", "w").mapInArrow(times, kind).repartition("slab").mapInArrow(add, kind).toArrow()
    shared.destroy()
    out = np.zeros((n, b))
    for k, v in zip(got.column("slab").to_pylist(), got.column("v").to_pylist()):
        out[k * SLAB : (k + 1) * SLAB] = np.frombuffer(v).reshape(-1, b)
    return out[:, :used]


def _directions(rows: DataFrame, n: int, k: int, tol: float = 1e-10) -> np.ndarray:
    """The first k right singular directions of sparse rows over n tokens, as columns: block Lanczos with all of its basis
    kept orthogonal, until the directions' residuals are below tol of their squared singular values."""
    rng = np.random.default_rng(7)
    basis, h = np.zeros((n, 0)), np.zeros((0, 0))
    new = np.linalg.qr(rng.standard_normal((n, min(BLOCK, n))))[0]
    while True:
        m, b = basis.shape[1], new.shape[1]
        basis = np.hstack([basis, new])
        rest = _gram_times(rows, new)
        h = np.pad(h, ((0, b), (0, b)))
        for _ in range(2):
            part = basis.T @ rest
            h[:, m:] += part
            rest -= basis @ part
        h[m:, :m] = h[:m, m:].T
        val, vec = np.linalg.eigh((h + h.T) / 2)
        val, vec = val[::-1][:k], vec[:, ::-1][:, :k]
        u, size, turn = np.linalg.svd(rest, full_matrices=False)
        error = np.linalg.norm((size[:, None] * turn) @ vec[m:], axis=0)
        if m + b >= n or (len(val) == k and (error <= tol * np.maximum(val, 1e-4 * val[0])).all()) or val[0] <= 0:
            there = val > max(val[0], 0) * 1e-18
            return basis @ vec[:, there]
        b = min(b, n - m - b)
        new = np.where(size[:b] > 1e-13 * val[0], u[:, :b], rng.standard_normal((n, b)))  # nothing left there: any other direction
        for _ in range(2):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]


def tfidf_svd(df: DataFrame, key: str, tokens: str, top: int = 30_000, k: int = 100, min_df: int = 5) -> DataFrame:
    """(key, svd_0..): tf-idf vectors of the most frequent tokens on their first k singular directions (one less than there
    are tokens at most).

    Documents stay sparse and are stored once; blocks of vectors are multiplied with their Gram matrix on executors, and the driver
    holds top numbers for each of the vectors, some hundreds.
    """
    sc = df.sparkSession.sparkContext
    df = hold(df.select(key, tokens))  # texts are made into tokens once
    alone = top <= SENT and df.groupBy(key).count().where("count > 1").isEmpty()
    if alone:
        voc, weights = document_frequencies(df, tokens, min_df, top=top).where("token is not null"), None
    else:
        voc, weights = fit_tfidf(df, key, tokens, min_df, top=top)
    found = voc.orderBy(F.desc("df"), "token").select("token", "idf").toArrow()
    names = found.column("token").to_pylist()
    if not names:
        return df.select(key)
    n, k = len(names), max(1, min(k, len(names) - 1))
    if alone:
        rows = _weight_rows(df, key, tokens, names, found.column("idf").to_numpy())
    else:
        place = df.sparkSession.createDataFrame(list(zip(names, range(n))), "token string, i int")
        w = weights.join(place, "token")
        rows = w.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "weight"))).alias("s"))
        rows = rows.select(key, F.col("s.i").alias("i"), F.col("s.weight").alias("w"))
    rows = hold(rows)
    dirs = _directions(rows, n, k)
    dirs = np.pad(dirs, ((0, 0), (0, k - dirs.shape[1])))  # directions without any weight
    dirs = dirs * np.sign(dirs[np.abs(dirs).argmax(axis=0), range(k)])
    shared = sc.broadcast(dirs)

    def onto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(1).offsets.to_numpy()
            i, x = (b.column(c).flatten().to_numpy() for c in (1, 2))
            parts = [x[lo - ends[0] : hi - ends[0]] @ shared.value[i[lo - ends[0] : hi - ends[0]]] for lo, hi in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.float64()))], names=[key, "p"])

    got = rows.select(key, "i", "w").mapInArrow(onto, f"{key} {df.schema[key].dataType.simpleString()}, p array<double>")
    got = got if alone else df.select(key).join(got, key, "left")
    return got.select(key, *[F.coalesce(F.col("p")[j], F.lit(0.0)).alias(f"svd_{j}") for j in range(k)])


def random_projection(df: DataFrame, key: str, tokens: str, dims: int = 16, how: str = "max", seed: int = 7) -> DataFrame:
    """(key, dim, value): tokens as seeded random vectors in [-1, 1], pooled over the text by max, sum or avg."""
    if how in ("max", "sum", "avg") and dims <= WIDE:  # each different token of a text once, one row for each text
        v = [F.pmod(F.xxhash64("token", F.lit(i), F.lit(seed)), F.lit(2001)) / F.lit(1000.0) - F.lit(1.0) for i in range(dims)]
        add = {"max": F.max, "sum": lambda c: F.sum(c * F.col("tf")), "avg": lambda c: F.sum(c * F.col("tf")) / F.sum("tf")}[how]
        x = row_terms(df, key, tokens).groupBy(key).agg(*[add(c).alias(f"_v{i}") for i, c in enumerate(v)])
        return x.select(key, F.posexplode(F.array(*[F.col(f"_v{i}") for i in range(dims)])).alias("dim", "value"))
    x = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.pmod(F.xxhash64("token", i, F.lit(seed)), F.lit(2001)) / F.lit(1000.0) - F.lit(1.0))
    return pool(x.select(key, "pos", vec.alias("vector")), key, how)


def without_first_direction(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): vectors less their part along the first singular direction of all of them."""
    n, _, g = gram(vectors, vector)
    if not n:
        return vectors.select(key, vector)
    val, vec = np.linalg.eigh(g)
    d = F.array(*[F.lit(float(x)) for x in vec[:, val.argmax()]])
    v = F.col(vector).cast("array<double>")
    dot = F.aggregate(F.zip_with(v, d, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, dot.alias("_s"), v.alias("_v")).select(key, F.zip_with("_v", F.transform(d, lambda x: x * F.col("_s")), lambda a, b: a - b).alias(vector))
