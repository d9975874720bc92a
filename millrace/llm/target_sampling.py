"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

Features are all runs of one to three words, hashed into buckets by crc32. Documents are inverted in blocks: a row holds
the posting lists (document, count) of one group of buckets in one block. The counts of each bucket in both corpora
meet in the bucket's partition and give its gain. Postings are shuffled by bucket group (salted by block, so that no
bucket is one task's burden), meet their group's gains there, and leave as contributions, one for each document and
group; a document's contributions are summed by a second shuffle. Gumbel numbers from a hash of the id are added, and
the highest scores are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, column, materialize, slices, tune, utf8

BUCKETS = 10_000
#: Bucket groups: the number of contributions that a document sends.
GROUPS = 16
WIDTH = BUCKETS // GROUPS
#: Documents in a block: a posting names its document by one byte.
BLOCK = 256
#: Blocks whose postings of one group make a key of the shuffle.
SALT_BLOCKS = 64
#: Drawn rows are numbered by ranges of their scores: about so many rows in one, so many ranges at most.
RANGE_ROWS = 500
RANGES = 1_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_table() -> np.ndarray:
    """What a byte does to the register of the checksum (reflected polynomial 0xEDB88320, a fixed value)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_STEP = _byte_table()
#: Tables that advance a checksum over 2**i zero bytes, by each of its four bytes.
_ZEROS: list[np.ndarray] = []


def _advance(crc: np.ndarray, tab: np.ndarray) -> np.ndarray:
    return tab[0][crc & 255] ^ tab[1][(crc >> 8) & 255] ^ tab[2][(crc >> 16) & 255] ^ tab[3][crc >> 24]


def joined(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two strings put together, from those of both and the second's size in bytes (checksums are linear)."""
    for i in range(int(size.max()).bit_length() if len(size) else 0):
        if i == len(_ZEROS):
            one = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
            _ZEROS.append(_advance(_ZEROS[-1][:], _ZEROS[-1]) if i else _STEP[one & 255] ^ (one >> np.uint32(8)))
        a = np.where((size >> i) & 1, _advance(a, _ZEROS[i]), a)
    return a ^ b


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each span of data, all spans one byte further at a time; long ones by themselves."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-np.minimum(size, 65), kind="stable")
    long = int(np.searchsorted(-size[order], -64, side="left")) if len(size) else 0
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    order = order[long:]
    at, left = start[order], size[order]
    reg = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))
        reg[:n] = _STEP[(reg[:n] ^ data[at[:n] + j]) & 255] ^ (reg[:n] >> np.uint32(8))
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size) of every word; no word runs over the end of its text."""
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = inside[begins]
    last[begins[1:] - 1] = inside[begins[1:] - 1]
    start = np.flatnonzero(first)
    return np.searchsorted(off, start, side="right") - 1, start, np.flatnonzero(last) + 1 - start


def _features(data: np.ndarray, off: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature and the text of each word. Features that end in the first known words don't count."""
    row, start, size = _spans(data, off)
    crc = checksums(data, start, size)
    space = np.uint32(zlib.crc32(b" "))
    one = np.ones(1, np.int64)
    rows, found = [row[known:]], [crc[known:]]
    run = crc
    for n in (1, 2):
        run = joined(joined(run[:-1], space, one), crc[n:], size[n:]) if len(run) > 1 else run[:0]
        same = row[: max(0, len(row) - n)] == row[n:]
        same[: max(0, known - n)] = False
        rows.append(row[n:][same])
        found.append(run[same])
    return np.concatenate(rows), np.concatenate(found) % np.uint32(BUCKETS), row[known:]


def _pieces(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces cut between words, each behind the two words before it: (piece, number of these words)."""
    lo, before, known = 0, data[:0], 0
    while lo < len(data):
        hi = lo + SLICE_BYTES
        while hi < len(data) and _WORD[data[hi - 1]]:  # a word ends before hi or the text does
            gap = np.flatnonzero(~_WORD[data[hi : hi + SLICE_BYTES]])
            hi += int(gap[0]) + 1 if len(gap) else SLICE_BYTES
        piece = np.concatenate([before, data[lo:hi]])
        yield piece, known
        _, start, size = _spans(piece, np.array([0, len(piece)]))
        known = min(2, len(start))
        gap = np.full(1, 32, np.uint8)
        before = np.concatenate([x for i in range(len(start) - known, len(start)) for x in (piece[start[i] : start[i] + size[i]], gap)] or [data[:0]])
        lo = hi


def _counted(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(count of each bucket (rows) in each of the texts (columns), words of each text) of at most BLOCK texts."""
    data, off = utf8(col)
    data = _LOWER[data]
    n = len(col)
    if len(data) <= 2 * SLICE_BYTES:
        parts: Iterator = iter([(data, off, 0)])
    else:  # one long text alone
        parts = ((p, np.array([0, len(p)]), known) for p, known in _pieces(data))
    total, words = np.zeros(BUCKETS * n, np.int64), np.zeros(n, np.int64)
    for piece, ends, known in parts:
        row, bucket, word_row = _features(piece, ends, known)
        total += np.bincount(bucket.astype(np.int64) * n + row, minlength=BUCKETS * n)
        words += np.bincount(word_row, minlength=n)
    return total.reshape(BUCKETS, n), words


_SCHEMA = pa.schema([
    ("block", pa.int64()), ("part", pa.int32()), ("totals", pa.list_(pa.int64())), ("lengths", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())),
])
_SQL = "block long, part int, totals array<long>, lengths binary, docs binary, counts binary, ids array<long>, words array<long>"


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted blocks. For each block and bucket group (part): totals of its buckets, and their posting lists one after the
    other (lengths: uint32, docs and counts: uint8; larger counts take several postings). Part -1 lists the block's ids and words."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi in slices(b.column(1)):
                for at in range(lo, hi, BLOCK):
                    some = b.slice(at, min(BLOCK, hi - at))
                    yield _inverted(block, some)
                    block += 1

    d = docs.select(column(doc_id).cast("long").alias("id"), column(text).alias("text"))
    return d.mapInArrow(run, _SQL)


def _inverted(block: int, some: pa.RecordBatch) -> pa.RecordBatch:
    table, words = _counted(some.column(1))
    bucket, doc = np.nonzero(table)
    count = table[bucket, doc]
    more = (count + 254) // 255
    if len(more) and more.max() > 1:
        ends = np.cumsum(more)
        last = count - (more - 1) * 255
        bucket, doc, count = np.repeat(bucket, more), np.repeat(doc, more), np.full(int(ends[-1]), 255)
        count[ends - 1] = last
    totals = table.sum(axis=1)
    bounds = np.searchsorted(bucket, np.arange(0, BUCKETS + 1, WIDTH))
    lengths = np.bincount(bucket, minlength=BUCKETS).astype("<u4")
    doc, count = doc.astype(np.uint8), count.astype(np.uint8)
    parts = range(GROUPS)
    cut = [slice(bounds[g], bounds[g + 1]) for g in parts]
    none = [None] * GROUPS
    columns = [
        [block] * (GROUPS + 1), [*parts, -1], [*(totals[g * WIDTH : (g + 1) * WIDTH] for g in parts), None], [*(lengths[g * WIDTH : (g + 1) * WIDTH].tobytes() for g in parts), None],
        [*(doc[c].tobytes() for c in cut), None], [*(count[c].tobytes() for c in cut), None], [*none, some.column(0).to_pylist()], [*none, words],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _totals(inverted: DataFrame, name: str) -> DataFrame:
    """(bucket, count) over a corpus, added up before the shuffle."""
    one = inverted.where("part >= 0").select("part", F.posexplode("totals").alias("i", "n"))
    return one.groupBy((F.col("part") * WIDTH + F.col("i")).alias("bucket")).agg(F.sum("n").alias(name))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """(part, gains of its buckets in order): the counts of a bucket in both corpora meet in its partition."""
    both = _totals(raw, "s").join(_totals(target, "t"), "bucket", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    all_s, all_t = (_totals(c, "n").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in (raw, target))
    big = lambda c: F.col(c).cast("double") + F.lit(1.0)
    ratio = big("t") * F.lit(float(all_s + BUCKETS)) / (big("s") * F.lit(float(all_t + BUCKETS)))
    one = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    listed = F.array_sort(F.collect_list(F.struct("bucket", "gain")))  # WIDTH of them
    return one.groupBy(F.floor(F.col("bucket") / WIDTH).cast("int").alias("part")).agg(F.transform(listed, lambda x: x["gain"]).alias("gains"))


def _contributions(met: DataFrame) -> DataFrame:
    """(block, contribution of a bucket group to each of the block's documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, sums = [], []
            for block, lengths, docs, counts, gain in zip(*(b.column(i) for i in range(5))):
                doc = np.frombuffer(docs.as_py(), np.uint8)
                n = np.frombuffer(counts.as_py(), np.uint8).astype(np.int64)
                g = np.repeat(gain.values.to_numpy(), np.frombuffer(lengths.as_py(), "<u4"))
                total = np.zeros(BLOCK, np.int64)
                np.add.at(total, doc, n * g)
                blocks.append(block.as_py())
                sums.append(total[: int(doc.max()) + 1 if len(doc) else 0])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["block", "sums"])

    return met.select("block", "lengths", "docs", "counts", "gains").mapInArrow(run, "block long, sums array<long>")


def weigh(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, and block and doc, a row's own name) of every row of docs: weight is the sum of
    its features' gains. Null, empty and wordless texts have no features and the weight 0; repeated rows, also of equal
    or null ids, are rows of their own."""
    made = Scratch()
    raw = made.keep(postings(docs, doc_id, text))
    per = gains(raw, postings(target.select(F.lit(None).cast("long").alias("id"), column(text).alias("text")), "id", "text"))
    salts = max(1, raw.where("part = -1").count() // SALT_BLOCKS)
    salt = lambda: F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")
    per = per.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).hint("shuffle_hash")
    met = raw.where("part >= 0").select("part", salt(), "block", "lengths", "docs", "counts").join(per, ["part", "salt"])
    sums = _contributions(met).select("block", F.posexplode("sums").alias("doc", "c"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"))
    rows = raw.where("part = -1").select("block", F.posexplode(F.arrays_zip("ids", "words")).alias("doc", "r")).select("block", "doc", F.lit(0).cast("long").alias("c"), "r.ids", "r.words")
    every = sums.unionAll(rows).groupBy("block", "doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("c").alias("weight"))
    every = every.withColumn("n_features", F.greatest(3 * F.col("n_words") - 3, F.least("n_words", F.lit(1))).cast("long"))
    out = materialize(every)
    made.clear()
    return out


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number g from the first 32 bits of sha256 of ``seed:doc_id`` (a null id counts as empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null for those that aren't drawn.

    Of the N rows with at least least_words words, the floor(percent N / 100) highest scores are drawn; ties go to the
    smaller doc_id (null last), then to fewer features; rows equal in all of these are drawn in any order. Null and
    empty texts have no features, weight 0 and the score of their Gumbel number. Rows of one id draw the same number. An
    empty table gives an empty result, an empty target makes all gains depend on docs alone. Other columns don't matter.
    """
    w = weigh(docs, target, doc_id, text).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    cand = w.where(F.col("n_words") >= least_words)
    n, cuts = cand.agg(F.count("*"), F.percentile_approx("score", [1 - percent / 100 - x for x in (0.002, 0.05) if x < 1 - percent / 100] + [0.0], 10_000)).first()
    k = percent * n // 100
    enough = cand.agg(*[F.count_if(F.col("score") >= c) for c in cuts]).first() if k else []
    cut = next((c for c, m in zip(cuts or [], enough) if m >= k), None)
    some = cand.where(F.col("score") >= cut) if cut is not None else cand.where("false")
    some = some.select("block", "doc", "doc_id", "n_features", "score")
    ranges = max(1, min(RANGES, k // RANGE_ROWS))
    bounds = some.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)] or [0.5], 10 * RANGES)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b > F.col("score"))) if bounds else F.lit(0)
    some = some.withColumn("range", above)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    starts = some.groupBy("range").agg(F.count("*").alias("m")).select("range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "block", "doc")
    rank = (F.col("start") + F.row_number().over(inside)).alias("rank")
    drawn = some.join(F.broadcast(starts), "range").select("block", "doc", rank).where(F.col("rank") <= k)
    return w.join(drawn, ["block", "doc"], "left").select("doc_id", "n_features", "weight", "score", "rank")
