"""N-gram Jaccard join by a count-vector R-tree.

A text's set of n-word shingles is hashed into groups; the number of its shingles in each group is a point. For two sets
the sum of the smaller of their counts, group by group, bounds their overlap from above, and for boxes of points so does
the sum of the smaller upper corners. An R-tree over the points (packed by set size and the most varying groups) is
joined with itself top-down: pairs of boxes, then of points, whose bound is under the overlap that the similarity asks
for are dropped; the rest are verified on their exact shingle sets.

In one tree over all texts the bound can't separate large corpora: boxes of unrelated texts of one length overlap. So
points are first dealt into blocks that lose no pair: two sets with a Jaccard of t share one of the first
n - ceil(t n) + 1 shingles of any fixed order; the order here is by estimated document frequency, rarest first. There is
a tree in each block of two or more points, and blocks with the same members are joined once.

Equal sets are one point. Large groups of near copies are first drawn together: points with the same least shingle (under
one random order, then under another) meet in one task, in salted portions of at most ``chunk``, and each is paired with
the earlier point that it can overlap most; those without one meet again. Verified pairs make groups. Only blocks that
still hold different groups are joined by their trees, and only pairs across groups count: first a few of
each point, those with the most room; blocks with more come again once those have been verified, in the end with all. So every link is found or lies inside a group, and a
group of thousands of near copies costs time in proportion to its size. Two long texts with a common passage meet in
hundreds of blocks, but only one of them returns the pair: the first block that is among the FIRST lowest of both; texts
with no such block are paired wherever they meet. In a block beyond ``chunk`` points the largest
group is dealt out in portions and only the points outside of it are sent to all of them.

What moves: a block key and a number for each first shingle once, points (512 bytes) and lowest blocks (128 bytes) of those
that share one, and for a verified pair the text of the end with fewer pairs; the other end's text goes once to each ``chunk`` of its partners.
Shingles that very many texts hold are counted by partial sums, all others by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, components, fresh, materialize, mix, release_shuffles, shingles, slices, tune, words

SKETCH = 1 << 16
MARKED = 1 << 23
GROUPS = 512
LEAF = 16
#: Random orders whose least shingle draws sets together.
ORDERS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F))
#: Pairs that a block's join returns for each point in each round, those with the most room. A block with more of them comes
#: into the next round; the last round returns all that are left.
ROUNDS = (4, 16, None)
#: Lowest blocks of a point that tell which of two points' common blocks returns the pair.
FIRST = 16


def _sets(batch: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi in slices(batch):
        h, row, _ = words(batch.slice(lo, hi - lo))
        for i, s in enumerate(shingles(h, row, hi - lo, n)):
            yield lo + i, s


def frequency_sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Document frequencies of shingles, summed in SKETCH hash buckets over all texts: an upper estimate for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for _, s in _sets(b.column(0), n):
                k = (s >> np.uint64(48)).astype(np.int64)
                if len(k) > SKETCH // 16:
                    total += np.bincount(k, minlength=SKETCH)
                else:
                    np.add.at(total, k, 1)
        got = np.flatnonzero(total)
        for i in range(0, len(got), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(got[i : i + 8192]), pa.array(total[got[i : i + 8192]])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def group_counts(s: np.ndarray) -> np.ndarray:
    """The point of a set: shingles in each of the groups. A set with over 255 in a group is 255 everywhere: no bound."""
    n = np.bincount((mix(s) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return n.astype(np.uint8) if n.max() <= 255 else np.full(GROUPS, 255, np.uint8)


def profiles(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of every row: uid, doc_id, place (a hash of id and text), n_shingles, set key, the first shingles in frequency order
    (those in very frequent sketch buckets as hot, the others as head), point, least shingles, longs to carry. To be
    written before use, as uids hold for one evaluation."""
    import xxhash

    sketch = frequency_sketch(docs, text, n)
    weight = docs.sparkSession.sparkContext.broadcast(sketch)
    much = 8 * sketch.mean() + 2048
    longs = pa.list_(pa.int64())
    made = pa.schema([("n_shingles", pa.int64()), ("key", pa.string()), ("head", longs), ("hot", longs), ("point", pa.binary()), *((f"m{k}", pa.int64()) for k in range(len(ORDERS)))])
    full = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), *made, *((c, pa.int64()) for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for b in batches:
            out = []
            for _, s in _sets(b.column(2), n):
                if not len(s):
                    out.append((0, None, [], [], None, *[None] * len(ORDERS)))
                    continue
                k = len(s) - (percent * len(s) + 99) // 100 + 1
                of = w[(s >> np.uint64(48)).astype(np.int64)]
                order = np.lexsort((s, of))[:k]
                head, hot = s[order].view(np.int64), of[order] > much
                least = [int(mix(s ^ o).min().view(np.int64)) for o in ORDERS]
                out.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), head[~hot], head[hot], group_counts(s).tobytes(), *least))
            arrays = [pa.array(c, t.type) for c, t in zip(zip(*out), made)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), *arrays, *b.columns[3:]], schema=full)

    d = docs.select(F.col(doc_id).cast("long"), place(doc_id, text), F.col(text), *carry)
    kinds = ["doc_id long, place long, n_shingles long, key string, head array<long>, hot array<long>, point binary", *(f"m{k} long" for k in range(len(ORDERS))), *(f"{c} long" for c in carry)]
    return d.mapInArrow(run, ", ".join(kinds)).withColumn("uid", F.monotonically_increasing_id())


def place(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def marks(longs: DataFrame, name: str) -> DataFrame:
    """A bit for each of MARKED hash buckets that holds one of the longs, 64 in a row: at most MARKED / 64 rows (2 MB) however
    many longs there are, so that it can be broadcast."""
    k = F.pmod(F.xxhash64(name), F.lit(MARKED)).alias("k")
    return longs.select(k).groupBy(F.shiftright("k", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits"))


def flagged(df: DataFrame, name: str, bits: DataFrame, flag: str) -> DataFrame:
    """df with a boolean: whether the long may be among the marked ones (true for all that are, and for few others)."""
    k, w, b = fresh([*df.columns, flag], "_k", "_w", "_bits")
    x = df.withColumn(k, F.pmod(F.xxhash64(column(name)), F.lit(MARKED)))
    x = x.join(F.broadcast(bits.toDF(w, b)), F.shiftright(k, 6) == F.col(w), "left")
    return x.withColumn(flag, F.coalesce(F.expr(f"(shiftright({b}, cast({k} & 63 as int)) & 1) = 1"), F.lit(False))).drop(k, w, b)


def marked(df: DataFrame, name: str, bits: DataFrame) -> DataFrame:
    """The rows of df whose long may be among the marked ones."""
    return flagged(df, name, bits, "flag").where("flag").drop("flag")


def _need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of sets of sizes a and b whose Jaccard is percent / 100: 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


class Tree:
    """A two-level R-tree over count vectors, packed by size and the most varying coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        spread = np.argsort(-points.var(axis=0, dtype=np.float64), kind="stable")[:2]
        slab = max(LEAF, int(np.ceil(np.sqrt(len(points) / LEAF))) * LEAF)
        by_size = np.argsort(sizes, kind="stable")
        rank = np.empty(len(points), np.int64)
        rank[by_size] = np.arange(len(points))
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], rank // slab))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.open = (self.points == 255).all(axis=1)
        starts = np.arange(0, len(points), LEAF)
        self.starts = starts
        self.upper = np.maximum.reduceat(self.points, starts, axis=0)
        self.free = np.maximum.reduceat(self.open, starts)
        self.low, self.high = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)

    def leaf(self, i: int) -> slice:
        return slice(self.starts[i], min(self.starts[i] + LEAF, len(self.points)))


def tree_join(x: Tree, y: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in x and in y of the pairs whose bound allows the similarity, and the bound over what is needed, leaf pair
    by leaf pair."""
    same = x is y
    for i in range(len(x.starts)):
        bound = np.minimum(x.upper[i], y.upper).sum(axis=1, dtype=np.int64)
        fits = ((bound >= _need(x.low[i], y.low, percent)) | (x.free[i] & y.free)) & (100 * x.high[i] >= percent * y.low) & (100 * y.high >= percent * x.low[i])
        for j in np.flatnonzero(fits):
            if same and j < i:
                continue
            a, b = x.leaf(i), y.leaf(j)
            s, t = x.sizes[a][:, None], y.sizes[b][None, :]
            over, need = np.minimum(x.points[a][:, None, :], y.points[b][None, :, :]).sum(axis=2, dtype=np.int64), _need(s, t, percent)
            ok = ((over >= need) | (x.open[a][:, None] & y.open[b][None, :])) & (100 * np.minimum(s, t) >= percent * np.maximum(s, t))
            if same and i == j:
                ok = np.triu(ok, 1)
            p, q = np.nonzero(ok)
            if len(p):
                yield x.order[a][p], y.order[b][q], (over / need)[p, q]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Number of common elements of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) if len(y) else 0


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = overlap(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches in lists of equal first ``width`` columns."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if held and r[:width] != held[0][:width]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def lead(rows: list[tuple[int, int, bytes]], percent: int) -> list[tuple[int, int]]:
    """(node, earlier node that it can overlap most) for (node, size, point) rows; nodes that can link with no earlier one are
    left out."""
    out: list[tuple[int, int]] = []
    nodes: list[int] = []
    points, sizes = np.zeros((64, GROUPS), np.uint8), np.zeros(64, np.int64)
    for node, size, point in rows:
        p, k = np.frombuffer(point, np.uint8), len(nodes)
        if k:
            need = _need(sizes[:k], size, percent)
            room = np.where(100 * np.minimum(sizes[:k], size) >= percent * np.maximum(sizes[:k], size), np.minimum(points[:k], p).sum(axis=1, dtype=np.int64) / need, 0)
            best = int(room.argmax())
            if room[best] >= 1:
                out.append((node, nodes[best]))
                continue
        if k == len(points):
            points, sizes = np.concatenate([points, np.zeros_like(points)]), np.concatenate([sizes, np.zeros_like(sizes)])
        nodes.append(node)
        points[k], sizes[k] = p, size
    return out


def _drawn(shapes: DataFrame, percent: int, chunk: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of points with the same least shingle that may link: each point with one of another at most for each order."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 2):
            got = lead([r[2:] for r in rows], percent) if len(rows) > 1 else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], schema=schema)

    made: list[DataFrame] = []
    for k in range(len(ORDERS)):
        left, by = shapes, f"m{k}"
        for done in made:
            left = left.join(done.select(F.col("a").alias("node")), "node", "left_anti")
        while True:
            large = keep(left.groupBy(by).count().where(F.col("count") > chunk))
            n = large.agg(F.sum("count")).first()[0]
            x, salt = left, F.lit(0)
            if n:
                x = x.join(large, by, "left")
                salt = F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1))).cast("int")
            x = x.select(by, salt.alias("salt"), "node", "size", "point")
            got = keep(x.repartition(by, "salt").sortWithinPartitions(by, "salt", "node").mapInArrow(run, "a long, b long"))
            made.append(got)
            if not n:
                break
            left = keep(left.join(large.select(by), by, "left_semi").join(got.select(F.col("a").alias("node")), "node", "left_anti"))
            if 2 * left.count() > n:
                break  # few came together: the blocks do the rest
    return reduce(DataFrame.unionAll, made)


def _open(members: DataFrame, comp: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(block, cnt, top, most, node, comp) of the blocks that hold several groups; top is the one with the most points."""
    now = keep(members.join(comp.select(F.col("id").alias("node"), "root"), "node", "left").select("block", "node", F.coalesce("root", "node").alias("comp")))
    per = now.groupBy("block", "comp").agg(F.count("*").alias("n")).groupBy("block")
    per = per.agg(F.sum("n").alias("cnt"), F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("groups"))
    per = keep(per.where("groups > 1").select("block", "cnt", F.col("m.comp").alias("top"), F.col("m.n").alias("most")))
    return now.join(per, "block")


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(id, root) of both, roots of the first moved on by the second."""
    moved = first.alias("f").join(then.alias("t"), F.col("f.root") == F.col("t.id"), "left").select("f.id", F.coalesce("t.root", "f.root").alias("root"))
    return moved.unionByName(then.join(first.select("id"), "id", "left_anti"))


def candidates(blocks: DataFrame, percent: int, chunk: int, each: int | None) -> DataFrame:
    """Pairs (a, b) of nodes of different groups, from (block, cnt, top, most, node, comp, size, point, first) rows; each: so
    many for each point and block. (block, null) for a block that has more."""
    whole, out = F.col("cnt") <= chunk, F.col("comp") != F.col("top")
    n_out, n_top = (F.ceil(c / chunk).cast("int") for c in (F.col("cnt") - F.col("most"), F.col("most")))
    spread = lambda k: F.pmod(F.xxhash64("node"), k.cast("long")).cast("int")
    own = F.when(whole, F.lit(0)).when(out, spread(n_out)).otherwise(n_out + spread(n_top))
    others = F.when(whole, F.array(F.lit(0))).when(out, F.sequence(F.lit(0), n_out + n_top - 1)).otherwise(F.sequence(F.lit(0), n_out - 1))
    x = blocks.withColumn("own", own).withColumn("other", F.explode(others))
    x = x.select("block", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "comp", "size", "point", "first")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, 3):
            side, node, comp, size = (np.array([r[i] for r in rows], np.int64) for i in range(3, 7))
            if len(np.unique(comp)) < 2:
                continue
            point = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), GROUPS)
            first = np.frombuffer(b"".join(r[8].ljust(8 * FIRST, b"\0") for r in rows), ">i8").reshape(len(rows), FIRST)
            p, q, more = _across(rows[0][0], comp, size, point, first, side, percent, each)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(f(node[p], node[q])) for f in (np.minimum, np.maximum)], schema=schema)
            if more:
                yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([None], pa.int64())], schema=schema)

    dealt = x.repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def lowest(members: DataFrame) -> DataFrame:
    """(node, first) of (block, node) rows: the FIRST lowest blocks of each node as bytes."""
    longs = F.slice(F.sort_array(F.collect_list("block")), 1, FIRST)
    return members.groupBy("node").agg(F.unhex(F.array_join(F.transform(longs, lambda b: F.lpad(F.hex(b), 16, "0")), "")).alias("first"))


def _owned(block: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the block is the one that returns a pair, for the lowest blocks of its ends (0: none). Of all common blocks the
    lowest is among the lowest of both ends if any common one is."""
    common = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x != 0)
    return ~common.any(axis=1) | (np.where(common, x, np.iinfo(np.int64).max).min(axis=1) == block)


def _across(
    block: int, comp: np.ndarray, size: np.ndarray, point: np.ndarray, first: np.ndarray, side: np.ndarray, percent: int, each: int | None
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of rows of different groups that survive the tree join and are this block's: within side 0, or between the sides 0
    and 1. Whether there are more."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a = Tree(point[left], size[left])
    b, other = (Tree(point[right], size[right]), right) if len(right) else (a, left)
    ps, qs, rooms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for p, q, room in tree_join(a, b, percent):
        p, q = left[p], other[q]
        differ = comp[p] != comp[q]
        differ[differ] = _owned(block, first[p[differ]], first[q[differ]])
        ps.append(p[differ]), qs.append(q[differ]), rooms.append(room[differ])
    p, q, room = np.concatenate(ps), np.concatenate(qs), np.concatenate(rooms)
    if each is not None and len(p):
        point_of, pair = np.concatenate([p, q]), np.tile(np.arange(len(p)), 2)
        order = np.lexsort((-room[pair], point_of))
        first = np.searchsorted(point_of[order], np.arange(len(comp)))
        rank = np.arange(len(order)) - first[point_of[order]]
        best = np.unique(pair[order][rank < each])
        return p[best], q[best], len(best) < len(p)
    return p, q, False


def verify(pairs: DataFrame, docs: DataFrame, named: DataFrame, n: int, percent: int, chunk: int, keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """The pairs (different ones) whose exact shingle sets have the similarity. named: (node, place, key).

    A pair goes to its end with more pairs, at most ``chunk`` pairs to a task's group; the texts of a group's centre and
    of its partners meet there and are made into sets again. Other texts are left out by marks before any shuffle.
    """
    import xxhash

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    ends = keep(ends.join(named.select("node", "place", "key"), "node"))
    x = pairs.select("a", "b")
    for c in ("a", "b"):
        x = x.join(ends.select(F.col("node").alias(c), F.struct("n", "node", "place", "key").alias(f"_{c}")), c)
    x = x.select(F.greatest("_a", "_b").alias("c"), F.least("_a", "_b").alias("p"))  # by number of pairs, then node
    salt = F.pmod(F.xxhash64("p.node"), F.ceil(F.col("c.n") / chunk))
    x = keep(x.select(F.col("c.node").alias("centre"), salt.alias("salt"), "p.node", "p.place", "p.key", F.col("c.place").alias("c_place"), F.col("c.key").alias("c_key")))
    centres = x.select("centre", "salt", F.col("centre").alias("node"), F.col("c_place").alias("place"), F.col("c_key").alias("key")).distinct()
    rows = x.select("centre", "salt", "node", "place", "key").unionAll(centres)
    texts = marked(docs.select(place().alias("place"), "text"), "place", marks(ends, "place"))
    both = texts.join(rows, "place").select("centre", "salt", (F.col("node") == F.col("centre")).alias("own"), "node", "key", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, done = None, None, set()
        for batch in batches:
            found = []
            head = list(zip(*(c.to_pylist() for c in batch.columns[:5])))
            for i, s in _sets(batch.column(5), n):
                group, own, node, key = head[i][:2], *head[i][2:]
                if group != at:
                    at, centre, done = group, None, set()
                if node in done or xxhash.xxh3_128_hexdigest(s.tobytes()) != key:
                    continue  # an equal row, or another text of one hash
                if own:
                    centre = s
                elif centre is not None and linked(s, centre, percent):
                    done.add(node)
                    found.append((min(node, group[0]), max(node, group[0])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return both.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.desc("own")).mapInArrow(run, "a long, b long")


def _blocks(prof: DataFrame, reps: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(block, node) of the first shingles that two or more points hold; of blocks with the same members, one. A few rows that
    are no representatives can be among the nodes."""
    own = keep(marks(reps, "node"))
    heads = lambda c: marked(prof.select(F.col("uid").alias("node"), c), "node", own).select(F.explode(c).alias("block"), "node")
    of = [F.count("*").alias("cnt"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("s")]
    per = heads("head").repartition("block").groupBy("block").agg(*of).unionAll(heads("hot").groupBy("block").agg(*of))
    one = keep(per.where("cnt > 1").groupBy("cnt", "lo", "hi", "s").agg(F.min("block").alias("block")))
    two = one.where("cnt = 2").select("block", F.explode(F.array("lo", "hi")).alias("node"))
    more = one.where("cnt > 2").select("block")
    bits = keep(marks(more, "block"))
    rest = marked(heads("head").unionAll(heads("hot")), "block", bits).join(more, "block")  # a semi join would be moved below the marks
    return two.unionAll(rest.select("block", "node"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, chunk: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row.

    Two rows link where 100 * |A and B| >= percent * |A or B| for their sets of n-word shingles (a shorter text is one
    shingle; words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased). component_id is the smallest
    doc_id reachable by links, itself included; class_id the smallest doc_id with the very same set. Null and wordless
    texts have no shingle and link with nothing: their component is their own id. A null doc_id is never the smallest
    unless all are null. Rows of one doc_id are separate texts. An empty table gives an empty result.
    """
    return groups(docs, doc_id, text, n, percent, chunk).drop("group")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, chunk: int = 1024, carry: tuple[str, ...] = ()) -> DataFrame:
    """join, with the long columns to carry of each row and the column group: a number of the row's component, null
    without shingles. Components that hold rows of one doc_id can have the same component_id, never the same group.
    Columns to carry may have any names but those of the result."""
    tune(docs.sparkSession)
    scratch = Scratch()
    try:
        return materialize(_join(docs, doc_id, text, n, percent, chunk, carry, scratch))
    finally:
        scratch.clear()


def _join(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, chunk: int, carry: tuple[str, ...], scratch: Scratch) -> DataFrame:
    keep = scratch.keep
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carry)
    prof = keep(profiles(docs, "doc_id", "text", n, percent, carry))
    rows = prof.select("uid", "doc_id", "n_shingles", "key", *carry)
    reps = keep(prof.where("key is not null").groupBy("key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("class_id"), F.min_by("place", "uid").alias("place")))
    members = keep(_blocks(prof, reps, keep))
    some = keep(reps.select("node", "place", "key").join(members.select("node").distinct(), "node", "left_semi"))
    least = [f"m{k}" for k in range(len(ORDERS))]
    release_shuffles(docs.sparkSession)
    shapes = keep(prof.select(F.col("uid").alias("node"), F.col("n_shingles").alias("size"), "point", *least).join(some.select("node"), "node", "left_semi").join(lowest(members), "node"))
    tried = keep(_drawn(shapes, percent, chunk, keep).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release_shuffles(docs.sparkSession)
    comp = keep(components(keep(verify(tried, docs, some, n, percent, chunk, keep)), keep).where("id <> root"))
    for each in ROUNDS:
        now = keep(_open(members, comp, keep))
        if now.isEmpty():
            break
        found = keep(candidates(now.join(shapes, "node"), percent, chunk, each))
        members = now.join(found.where("b is null").select(F.col("a").alias("block")).distinct(), "block", "left_semi").select("block", "node")
        release_shuffles(docs.sparkSession)
        pairs = keep(found.where("b is not null").join(tried, ["a", "b"], "left_anti").distinct())
        if pairs.isEmpty():
            continue
        tried = tried.unionAll(pairs)
        good = keep(verify(pairs, docs, some, n, percent, chunk, keep))
        release_shuffles(docs.sparkSession)
        if not good.isEmpty():
            root = lambda c, r: comp.select(F.col("id").alias(c), F.col("root").alias(r))
            across = good.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left")
            edges = across.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            comp = keep(_composed(comp, components(edges, keep).where("id <> root")))
    named = reps.join(comp.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(low, "root").select("key", "class_id", "component_id", F.col("root").alias("group"))
    out = rows.join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), *carry, "group")
