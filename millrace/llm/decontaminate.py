"""Benchmark decontamination: n-gram seeds, a bound by shared words, then Smith-Waterman alignment.

Every n-gram of the benchmark items is a seed, however many documents hold it: a document is compared with every item that
it shares a seed with. An alignment matches a word of the item once at most, so an item whose words are not in the document
(then: in the window) in a share of the threshold can't reach it; stock phrases fetch few candidates past that, and nothing
that could pass is left out. The windows of the document around the seeds are aligned with the item, word by word with
gaps, so that paraphrased and edited copies score as well as exact ones. The score is the best local alignment as a share
of the item's own.

The benchmark goes to the tasks in blocks of at most ``block_words`` words, whatever its size; documents are read as they
lie, once a block, and never shuffled. A passage that very many documents hold costs an alignment for each of them and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mix, slices, tune, words

#: Places of windows that are aligned together: bounds the memory of an alignment, whatever the item's length.
CELLS = 1 << 18
#: Word bytes: ASCII letters and digits, and all of other scripts; punctuation and case do not count.
KEEP = np.zeros(256, bool)
KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
_TABLE = 20


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a word hash sequence."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E6C63D0876A9A47) + h[i : i + m]
    return mix(out + np.uint64(n))


@dataclass
class Items:
    """A block of benchmark items; seeds sorted by hash, each with its item and offset, for each length in use."""

    ids: list[int | None]
    texts: list[np.ndarray]
    n: int

    def __post_init__(self) -> None:
        seeds = []
        for i, h in enumerate(self.texts):
            k = min(self.n, len(h))
            seeds += [(k, g, i, at) for at, g in enumerate(grams(h, k).tolist())] if k else []
        self.lengths = sorted({s[0] for s in seeds})
        seeds.sort(key=lambda s: s[1])
        self.hash = np.array([s[1] for s in seeds], np.uint64)
        self.item, self.at = np.array([s[2] for s in seeds], np.int64), np.array([s[3] for s in seeds], np.int64)
        self.size = np.array([len(h) for h in self.texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.words = np.concatenate([*self.texts, np.zeros(0, np.uint64)])
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[(self.hash >> np.uint64(64 - _TABLE)).astype(np.int64)] = True

    def able(self, items: np.ndarray, h: np.ndarray, threshold: float) -> np.ndarray:
        """Those of the items that have enough words in h to reach the threshold; each word matches once at most."""
        n = self.size[items]
        first = np.cumsum(n) - n
        w = self.words[np.repeat(self.begin[items] - first, n) + np.arange(n.sum())]
        own = np.unique(h)
        there = own[np.minimum(np.searchsorted(own, w), len(own) - 1)] == w
        return items[np.add.reduceat(there, first, dtype=np.int64) >= threshold * n - 1e-9]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first seed with that hash, position in h) of every n-gram of h that is a seed."""
        found, where = [], []
        for k in self.lengths:
            g = grams(h, k)
            p = np.flatnonzero(self.table[(g >> np.uint64(64 - _TABLE)).astype(np.int64)])
            s = np.searchsorted(self.hash, g[p])
            ok = (s < len(self.hash)) & (self.hash[np.minimum(s, len(self.hash) - 1)] == g[p])
            found.append(s[ok])
            where.append(p[ok])
        return (np.concatenate(found), np.concatenate(where)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(item: np.ndarray, windows: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """(score, first, last word) of the best local alignment of the item with each window; linear gap costs.

    Rows go over the item's words and hold all windows and all their places at once; a running maximum puts gaps in.
    """
    width = max(map(len, windows))
    x = np.zeros((len(windows), width), np.uint64)
    for i, w in enumerate(windows):
        x[i, : len(w)] = w
    real = np.arange(width)[None, :] < np.array([len(w) for w in windows])[:, None]
    ramp = -GAP * np.arange(width)
    h, origin = np.zeros(x.shape), np.tile(np.arange(width), (len(windows), 1))
    best, first, last = np.zeros(len(windows)), np.zeros(len(windows), int), np.zeros(len(windows), int)
    own = np.arange(width)
    for word in item:
        diag = np.zeros_like(h)
        diag[:, 1:] = h[:, :-1]
        start = np.tile(own, (len(windows), 1))
        start[:, 1:] = np.where(h[:, :-1] > 0, origin[:, :-1], own[1:])
        cand = diag + np.where((x == word) & real, MATCH, MISMATCH)
        up = h + GAP
        take = up > cand
        cand, start = np.where(take, up, cand), np.where(take, origin, start)
        lifted = np.maximum(cand, 0) + ramp
        run = np.maximum.accumulate(lifted, axis=1)
        src = np.maximum.accumulate(np.where(lifted >= run, own, 0), axis=1)
        h = run - ramp
        origin = np.take_along_axis(start, src, axis=1)
        h[h <= 0] = 0
        top = h.argmax(axis=1)
        val = h[np.arange(len(windows)), top]
        better = val > best
        best[better], last[better] = val[better], top[better]
        first[better] = origin[np.arange(len(windows)), top][better]
    return [(float(b / (MATCH * len(item))), int(f), int(t)) for b, f, t in zip(best, first, last)]


def _windows(at: np.ndarray, seed_at: np.ndarray, length: int, n_words: int) -> list[tuple[int, int]]:
    """Ranges of a document that may hold an item: around where its seeds say that it begins, overlapping ones joined."""
    begin = np.sort(at - seed_at)
    slack = max(5, length // 2)
    out: list[tuple[int, int]] = []
    for b in begin.tolist():
        lo, hi = max(0, b - slack), min(n_words, b + length + slack)
        if out and lo <= out[-1][1] and hi - out[-1][0] <= 6 * length + 4 * slack:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def benchmark_blocks(bench: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, one at a time on the driver. Null and wordless texts are left out."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for r in bench.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t) // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               n: int = 3, threshold: float = 0.4, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, n_items) of every contaminated document, its best item each.

    score: the best alignment's share of the item's full score, threshold at least. Ties go to the smallest item_id.
    Items of under n words are seeds as a whole. Null and empty texts hold nothing; null doc_ids stay. Rows repeat as
    they do in docs. Without benchmark items the result is empty.
    """
    tune(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    for c, kind in BEST:
        d = d.withColumn(c, F.lit(None).cast(kind))
    blocks = benchmark_blocks(bench, item_id, item_text, block_words)
    block = next(blocks, None)
    while block is not None:
        block, now = next(blocks, None), block
        d = _block_leaks(d, now, n, threshold, last=block is None)
    return d.where("score is not null").drop("text")


def _prepare(d: DataFrame, block: list[tuple[int | None, str]], n: int):
    """A broadcast of the block's items with their seeds."""
    h, row, _ = words(pa.array([t for _, t in block]), KEEP)
    bounds = np.searchsorted(row, np.arange(len(block) + 1))
    return d.sparkSession.sparkContext.broadcast(Items([i for i, _ in block], [h[lo:hi] for lo, hi in zip(bounds, bounds[1:])], n))


def best_items(it: Items, col: pa.Array, threshold: float) -> dict[int, tuple[int | None, float, int, int, int]]:
    """For each contaminated row of a string array its best item, score, first and last word, and its number of items."""
    work: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for r, h in _texts(col):
        seed, at = it.hits(h)
        if not len(seed):
            continue
        # a hash that several items hold stands in a row of the seeds
        span = np.searchsorted(it.hash, it.hash[seed], side="right") - seed
        more = np.repeat(seed, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        at = np.repeat(at, span)
        for i in it.able(np.unique(it.item[more]), h, threshold).tolist():
            own = it.item[more] == i
            for lo, hi in _windows(at[own], it.at[more[own]], len(it.texts[i]), len(h)):
                if len(it.able(np.array([i]), h[lo:hi], threshold)):
                    work.setdefault(i, []).append((r, lo, h[lo:hi]))
    best: dict[int, tuple] = {}
    count: dict[int, set[int]] = {}
    for i, jobs in work.items():
        jobs.sort(key=lambda j: len(j[2]))
        k = 0
        while k < len(jobs):  # sorted by length: the last of a part is its widest
            stop = k + 1
            while stop < min(len(jobs), k + 64) and (stop + 1 - k) * len(jobs[stop][2]) <= CELLS:
                stop += 1
            part, k = jobs[k:stop], stop
            for (r, lo, _), (s, f, t) in zip(part, align(it.texts[i], [j[2] for j in part])):
                if s >= threshold:
                    count.setdefault(r, set()).add(i)
                    item = it.ids[i]
                    rank = (-s, item is None, item or 0, lo + f)
                    if r not in best or rank < best[r][0]:
                        best[r] = (rank, item, s, lo + f, lo + t)
    return {r: (*b[1:], len(count[r])) for r, b in sorted(best.items())}


#: What is known of a document so far while it passes the blocks.
BEST = (("item_id", "long"), ("score", "double"), ("first_word", "int"), ("last_word", "int"), ("n_items", "int"))


def _block_leaks(d: DataFrame, block: list[tuple[int | None, str]], n: int, threshold: float, last: bool) -> DataFrame:
    """d's rows with their best item so far and the number of items, this block's included; from the last one only rows with
    an item, without text."""
    ready = _prepare(d, block, n)
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((c, kinds[k]) for c, k in BEST)])

    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = best_items(ready.value, b.column(1), threshold)
            if found:
                cols = [c.to_pylist() for c in b.columns[2:]]
                for i, new in found.items():
                    old = [c[i] for c in cols]
                    rank = lambda x: (-x[1], x[0] is None, x[0] or 0)
                    best = list(new) if old[1] is None or rank(new) < rank(old) else old
                    best[4] = new[4] + (old[4] or 0)
                    for c, v in zip(cols, best):
                        c[i] = v
                b = pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, schema.field(k).type) for k, c in enumerate(cols, 2))], schema=schema)
            if last:
                b = b.filter(b.column(3).is_valid())
                b = pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string()), *b.columns[2:]], schema=schema)
            yield b

    return d.mapInArrow(leaks, "doc_id long, text string, " + ", ".join(f"{c} {k}" for c, k in BEST))


def _texts(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi in slices(col):
        h, row, _ = words(col.slice(lo, hi - lo), KEEP)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, h[bounds[i] : bounds[i + 1]]


def remove_leaks(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, threshold: float = 0.4, block_words: int = 2_000_000) -> DataFrame:
    """docs without the contaminated rows: find_leaks as a filter, row by row, without a join. Null texts stay."""
    tune(docs.sparkSession)
    d = docs.select(F.col(text).cast("string").alias("text"))
    out = docs
    for block in benchmark_blocks(bench, item_id, item_text, block_words):
        out = out.where(_clean(_prepare(d, block, n), threshold)(column(text).cast("string")))
    return out


def _clean(ready, threshold: float):
    @F.pandas_udf("boolean")
    def clean(s: pd.Series) -> pd.Series:
        found = best_items(ready.value, pa.array([t if isinstance(t, str) else None for t in s], pa.string()), threshold)
        return pd.Series([i not in found for i in range(len(s))], dtype=bool)

    return clean
