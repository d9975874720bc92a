"""Token ids in fixed-length rows: whole documents packed by best-fit decreasing.

Documents are encoded with a public byte-pair vocabulary, longer ones split losslessly into pieces of the row length.
Pieces of a window (a bounded number of tokens of one partition, in its order) are taken longest first; each goes to
the fullest row that still holds it, which a segment tree over the rows' free space finds. A row carries its padded id
matrix row, the cumulative segment lengths and the positions, which restart with every segment.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, tune

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = re.compile(r"\s\s")
ROW, WINDOW, EOS = 2048, 1 << 21, 50256
#: Tokens that are packed together where the order counts.
RUN = 64 * ROW


class Encoder:
    """Byte-pair ids of a text. Text between single spaces is encoded once and remembered (up to a bound)."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, remember: int = 400_000) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.core = tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, list[int]] = {}
        self.remember = remember

    def __call__(self, text: str) -> list[int]:
        # Where no white space follows white space, each space starts a token: the text falls into independent parts there.
        if _RUN.search(text):
            return self.core.encode_ordinary(text)
        known, out = self.known, []
        if len(known) > self.remember:
            known.clear()
        first, *rest = text.split(" ")
        out.extend(self.core.encode_ordinary(first))
        for w in rest:
            ids = known.get(w)
            if ids is None:
                ids = self.core.encode_ordinary(" " + w)
                if len(w) < 40:
                    known[w] = ids
            out.extend(ids)
        return out


class FreeSpace:
    """Rows by free space: a segment tree over 0..size whose nodes hold the number of rows below them."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free space of at least need, and that space; it leaves the tree."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.leaves
        row = self.rows[free].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return free, row


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Pieces of each row, by best-fit decreasing; equal lengths in their order."""
    rows: list[list[int]] = []
    free = FreeSpace(size)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = free.take(lengths[i])
        if got is None:
            rows.append([])
            got = size, len(rows) - 1
        rows[got[1]].append(i)
        free.put(got[0] - lengths[i], got[1])
    return rows


SCHEMA = "pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, rows array<long>, position long"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, window: int = WINDOW, eos: int = EOS, position: str | None = None, run: int = RUN) -> DataFrame:
    """Packed rows of all texts.

    input_ids: row little-endian uint16 ids (uint32 for vocabularies beyond 65,536), filled up with eos behind n_tokens.
    position_ids: as many, from 0 in each segment and 0 in the filling. cu_seqlens: 0 and each segment's end. doc_ids,
    rows and pieces: the document, the number of its row and the piece number of each segment. A row's number is its own
    within the result, also where rows repeat or have the same id or none. Every document ends with eos; putting a row's
    pieces together and taking eos off gives its ids again. Null and empty texts have no piece; null ids are kept.

    Without position nothing is shuffled: a partition packs its own documents, ``window`` tokens at a time. With position (a
    long column, nulls first) documents are range-sorted by it and packed in short runs of ``run`` tokens; a pack has the
    least position of its run, and packs come, and are numbered, in that order. The vocabulary (under 2 MB) is read on
    the driver.
    """
    tune(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    wide = np.dtype("<u2") if eos < 1 << 16 and ranks.value.count(b"\n") <= 1 << 16 else np.dtype("<u4")
    out = pa.schema([
        ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("rows", pa.list_(pa.int64())), ("position", pa.int64()),
    ])
    most = window if position is None else run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, base, made = Encoder(ranks.value), TaskContext.get().partitionId() << 36, 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        n, at, first = 0, base, None
        count = np.arange(row, dtype=wide)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, made
            packed = []
            for members in best_fit([len(x[3]) for x in held], row):
                ids, pos, cu = np.full(row, eos, wide), np.zeros(row, wide), [0]
                for i in members:
                    a = held[i][3]
                    ids[cu[-1] : cu[-1] + len(a)] = a
                    pos[cu[-1] : cu[-1] + len(a)] = count[: len(a)]
                    cu.append(cu[-1] + len(a))
                packed.append((base + made, cu[-1], ids.tobytes(), pos.tobytes(), cu, *([held[i][k] for i in members] for k in (0, 2, 1)), first))
                made += 1
                if len(packed) == 128:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*packed), out)], schema=out)
                    packed = []
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*packed), out)], schema=out)
            held, n = [], 0

        for b in batches:
            for doc, text, place in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text, at = text.as_py(), at + 1
                if not text:
                    continue
                ids = encode(text)
                ids.append(eos)
                a = np.array(ids, wide)
                first = first if held else place
                for k in range(0, len(a), row):
                    held.append((doc, at - 1, k // row, a[k : k + row]))
                    n += len(held[-1][3])
                    if n >= most:
                        yield from flush()
                        first = place
        yield from flush()

    d = docs.select(F.col("doc_id").cast("long"), "text", (F.lit(None) if position is None else column(position)).cast("long").alias("place"))
    if position is not None:
        d = d.repartitionByRange("place").sortWithinPartitions("place")
    return d.mapInArrow(work, SCHEMA)


def file_order(docs: DataFrame) -> Column:
    """A long that numbers the rows of a table read from Parquet files in the order in which a sorted write left them: by the
    number in the file's name, then by row. Spark itself reads files by size, not in that order."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return F.shiftleft(F.coalesce(number, F.lit(0)), 36) + F.col("_metadata.row_index")
