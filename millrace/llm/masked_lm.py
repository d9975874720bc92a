"""Masked pseudo-likelihood of texts under a small bidirectional window network.

Words are hashed into 65,536 buckets whose counts are taken over all documents. A network trained in numpy sees the two buckets
on each side of a masked word (embeddings, one tanh layer) and predicts the word's own bucket: the buckets are the leaves of a
Huffman tree of their counts, each inner node tells by a logistic score whether a word lies on its right, and the product
along a bucket's path is its exact conditional probability. Every bucket has a path and an embedding of its own. A document's
score is the sum of the log-probabilities of all of its words.

Every word of every document is masked once in training. Training is parallel: each task goes over its own documents from the same start, and the
models are averaged, each node and embedding by the words that have moved it; what is gathered grows with the number of partitions, that is with
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices, tune, words
from .decontaminate import KEEP

BUCKETS = 1 << 16
#: The id beside a text's ends, and that of places without a word.
EDGE = BUCKETS
SIDE, EMB, HIDDEN = 2, 12, 24
#: Nodes with most words, which a batch looks at together; the others are looked up word by word.
TOP = 63
#: Words that lie together in a text and in a batch, a batch's words and those that are shuffled together.
RUN, BATCH, RATE = 64, 1024, 0.15
HELD = 16 * 512
#: Words that are scored together.
PIECE = 1 << 16
SHAPES = {"emb": (BUCKETS + 1, EMB), "w": (2 * SIDE * EMB, HIDDEN), "b": (HIDDEN,), "out": (BUCKETS - 1, HIDDEN), "bias": (BUCKETS - 1,)}
#: Rows of a table of weights that tasks add up together.
SLAB = 1 << 10


@dataclass
class Vocabulary:
    """The paths: by level and bucket twice the node, and one more if the bucket lies on its right (-1: none). Nodes are numbered by their words,
    the first TOP have a table of their own. order: buckets from left to right; prior: each node's log odds of its right side."""

    top: np.ndarray
    rest: np.ndarray
    order: np.ndarray
    prior: np.ndarray


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """A Huffman tree of the buckets' counts (add-one smoothed)."""
    n = BUCKETS
    c = counts + 1.0
    leaves = np.lexsort((np.arange(n), c))
    weight, children, i, j = c[leaves].tolist(), [], 0, n
    for k in range(n, 2 * n - 1):  # the two lightest of leaves and nodes, each in order of weight
        pair = []
        for _ in range(2):
            if i < n and (j >= k or weight[i] <= weight[j]):
                pair.append(i)
                i += 1
            else:
                pair.append(j)
                j += 1
        children.append(pair)
        weight.append(weight[pair[0]] + weight[pair[1]])
    mass, kids = np.array(weight), np.array(children)
    up, right = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int64)
    up[kids.ravel()] = np.repeat(np.arange(n, 2 * n - 1), 2)
    right[kids[:, 1]] = 1
    name = np.full(2 * n - 1, -1)
    name[n + np.argsort(-mass[n:], kind="stable")] = np.arange(n - 1)
    at, levels = np.arange(n), []  # from the leaves to the root
    place, scale = np.zeros(n), np.zeros(n, np.int64)
    while (up[at] >= 0).any():
        there = up[at] >= 0
        levels.append(np.where(there, 2 * name[up[at]] + right[at], -1))
        place = np.where(there, (place + right[at]) / 2, place)
        scale += there
        at = np.where(there, up[at], at)
    codes = np.full((len(levels), n), -1, np.int32)  # from the root to the leaves: a node is on one level
    for k, level in enumerate(levels):
        there = np.flatnonzero(level >= 0)
        codes[scale[there] - 1 - k, leaves[there]] = level[there]
    order = np.empty(n, np.int32)
    order[leaves[np.argsort(place, kind="stable")]] = np.arange(n)
    prior = np.empty(n - 1, np.float32)
    prior[name[n:]] = np.log(mass[kids[:, 1]] / mass[kids[:, 0]])
    parts = [np.where((codes >= lo) & (codes < hi), codes, -1) for lo, hi in ((0, 2 * TOP), (2 * TOP, 2 * n))]
    return Vocabulary(*[np.ascontiguousarray(p[(p >= 0).any(axis=1)]) for p in parts], order, prior)


def _texts(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bucket of each word) of every text."""
    for lo, hi in slices(col):
        h, row, _ = words(col.slice(lo, hi - lo), KEEP)
        k = (h >> np.uint64(48)).astype(np.int32)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, k[bounds[i] : bounds[i + 1]]


def coded(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k): the buckets of each text's words as numbers of two bytes (none for null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [x.astype(np.uint16).tobytes() for _, x in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k, pa.binary())], names=["doc_id", "k"])

    tune(docs.sparkSession)
    key = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    return docs.select(key.alias("doc_id"), F.col(text).cast("string")).mapInArrow(work, "doc_id long, k binary")


def _buckets(col: pa.Array) -> Iterator[np.ndarray]:
    for v in col:
        yield np.frombuffer(v.as_buffer(), np.uint16).astype(np.int32)


def start(prior: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {k: (rng.standard_normal(SHAPES[k]) * 0.1).astype(np.float32) for k in ("emb", "w")}
    return out | {"b": np.zeros(HIDDEN, np.float32), "out": np.zeros(SHAPES["out"], np.float32), "bias": prior.copy()}


def stream(texts: list[np.ndarray]) -> np.ndarray:
    """The texts' buckets one after the other with edges between them, as whole runs: (runs, places of a run and SIDE on each side)."""
    gap = np.full(SIDE, EDGE, np.int32)
    flat = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
    runs = max(1, -(-(len(flat) - 2 * SIDE) // RUN))
    flat = np.concatenate([flat, np.full(runs * RUN + 2 * SIDE - len(flat), EDGE, np.int32)])
    return np.lib.stride_tricks.sliding_window_view(flat, RUN + 2 * SIDE)[::RUN]


#: Where the words beside a place lie in a run with its sides.
BESIDE = [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]


def hidden(p: dict[str, np.ndarray], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input and hidden layer of every place of the runs."""
    e = p["emb"].take(runs.ravel(), axis=0).reshape(*runs.shape, EMB)
    x = np.concatenate([e[:, j : j + RUN] for j in BESIDE], axis=2).reshape(-1, len(BESIDE) * EMB)
    return x, np.tanh(x @ p["w"] + p["b"])


def _entries(table: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, code) of the nodes on the words' paths, level by level."""
    t = table.take(y, axis=1)
    at = np.flatnonzero(t >= 0)
    word = np.arange(len(y), dtype=np.uint16 if len(y) < 1 << 16 else np.int32)  # short numbers are sorted faster
    return np.tile(word, len(t)).take(at), t.ravel().take(at)


def log_probs(p: dict[str, np.ndarray], voc: Vocabulary, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the runs with a word, log-probability of each)."""
    y = runs[:, SIDE : SIDE + RUN].ravel()
    at = np.flatnonzero(y != EDGE)
    by_leaf = np.argsort(voc.order.take(y[at]))  # words below a node lie together
    there = at[by_leaf]
    y, h = y[there], hidden(p, runs)[1].take(there, axis=0)
    row, code = _entries(voc.top, y)
    z = (h @ p["out"][:TOP].T + p["bias"][:TOP]).ravel().take(row.astype(np.int32) * TOP + (code >> 1))
    row2, code2 = _entries(voc.rest, y)
    node = code2 >> 1
    z2 = np.einsum("ij,ij->i", p["out"].take(node, axis=0), h.take(row2, axis=0)) + p["bias"].take(node)
    z = np.concatenate([np.where(code & 1, -z, z), np.where(code2 & 1, -z2, z2)])
    lost = np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))
    out = np.empty(len(y))
    out[by_leaf] = -np.bincount(np.concatenate([row, row2]), lost, len(y))
    return at, out


def _missed(z: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Derivatives of the mean loss by the nodes' scores."""
    return (1 / (1 + np.exp(-z)) - (code & 1).astype(np.float32)) / np.float32(n)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each first one to the next; two numbers are added at a time."""
    return np.add.reduceat(x.view(np.complex64), first, axis=0).view(np.float32)


class Training:
    """A model and what Adagrad knows of it: squares for each weight, of embeddings and nodes one mean for each; moves: words that have moved them."""

    def __init__(self, voc: Vocabulary, seed: int) -> None:
        self.voc, self.p = voc, start(voc.prior, seed)
        self.squares = {k: np.full(s[0] if k in ("emb", "out") else s, 1e-6, np.float32) for k, s in SHAPES.items()}
        self.moves = {k: np.zeros(SHAPES[k][0], np.int64) for k in ("emb", "out")}

    def _rows(self, name: str, rows: np.ndarray | slice, g: np.ndarray) -> None:
        s = self.squares[name][rows] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        self.squares[name][rows] = s
        g *= (RATE / (np.sqrt(s) + 1e-6))[:, None]
        self.p[name][rows] -= g

    def _each(self, name: str, at: np.ndarray | slice, g: np.ndarray) -> None:
        s = self.squares[name][at] + g * g
        self.squares[name][at] = s
        self.p[name][at] -= RATE * g / (np.sqrt(s) + 1e-6)

    def step(self, runs: np.ndarray) -> None:
        """An Adagrad step on a batch of runs."""
        p, voc = self.p, self.voc
        y = runs[:, SIDE : SIDE + RUN].ravel()
        at = np.flatnonzero(y != EDGE)
        at = at[np.argsort(voc.order.take(y[at]))]  # words below a node lie together
        y, n = y[at], len(at)
        if not n:
            return
        x, h = hidden(p, runs)
        # the first nodes: all words at once
        row, code = _entries(voc.top, y)
        cell, own = row.astype(np.int32) * TOP + (code >> 1), h.take(at, axis=0)
        z = (own @ p["out"][:TOP].T + p["bias"][:TOP]).ravel().take(cell)
        d = np.zeros(n * TOP, np.float32)
        d[cell] = _missed(z, code, n)
        d = d.reshape(n, TOP)
        dh = d @ p["out"][:TOP]
        top, top_bias = d.T @ own, d.sum(axis=0)
        self.moves["out"][:TOP] += np.bincount(code >> 1, minlength=TOP)
        # the others: those on each word's path
        row, code = _entries(voc.rest, y)
        node = code >> 1
        out, mine = p["out"].take(node, axis=0), own.take(row, axis=0)
        z = np.einsum("ij,ij->i", out, mine) + p["bias"].take(node)
        d = _missed(z, code, n)
        out *= d[:, None]
        mine *= d[:, None]
        if len(node):
            by_word = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.diff(row.take(by_word), prepend=-1))
            dh[row.take(by_word.take(first))] += _sums(out.take(by_word, axis=0), first)
        self._rows("out", slice(TOP), top)
        self._each("bias", slice(TOP), top_bias)
        if len(node):
            first = np.flatnonzero(np.diff(node, prepend=-1))
            self._rows("out", node[first], _sums(mine, first))
            self._each("bias", node[first], np.add.reduceat(d, first))
            self.moves["out"][node[first]] += np.diff(first, append=len(node))
        # input
        dh *= 1 - own * own
        back = np.zeros_like(h)
        back[at] = dh
        dx, g = (back @ p["w"].T).reshape(len(runs), RUN, -1), np.zeros((*runs.shape, EMB), np.float32)
        self._each("w", slice(None), x.T @ back)
        self._each("b", slice(None), dh.sum(axis=0))
        for i, j in enumerate(BESIDE):
            g[:, j : j + RUN] += dx[:, :, i * EMB : (i + 1) * EMB]
        key = np.sort(runs.ravel().astype(np.int64) * runs.size + np.arange(runs.size))
        first = np.flatnonzero(np.diff(key // runs.size, prepend=-1))
        used = key[first] // runs.size
        self._rows("emb", used, _sums(g.reshape(-1, EMB).take(key % runs.size, axis=0), first))
        self.moves["emb"][used] += np.diff(first, append=len(key))

    def learn(self, texts: list[np.ndarray], seed: int) -> int:
        """Steps over all words of the texts, runs in random order; the number of words."""
        runs = stream(texts)
        order = np.random.default_rng(seed).permutation(len(runs))
        for lo in range(0, len(runs), BATCH // RUN):
            self.step(runs[order[lo : lo + BATCH // RUN]])
        return sum(map(len, texts))


_PARTS = pa.schema([("slab", pa.int32()), ("at", pa.binary()), ("x", pa.binary()), ("n", pa.binary())])
_PARTS_SQL = "slab int, at binary, x binary, n binary"


def _part(slab: int, at: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    held = [at.astype(np.int32), x.astype(np.float32), n.astype(np.float64)]
    return pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in held]], schema=_PARTS)


def _tables(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The model as three tables: embeddings, nodes with their bias, one row of all others."""
    return {"emb": p["emb"], "out": np.hstack([p["out"], p["bias"][:, None]]), "net": np.concatenate([p["w"].ravel(), p["b"]])[None]}


def _averaged(parts: DataFrame, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The model p with each row that tasks have moved at the mean of theirs, by what has moved it; slabs of rows are added up in tasks."""
    width = [t.shape[1] for t in _tables(p).values()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for slab, *rest in zip(b.column(0).to_pylist(), *b.columns[1:]):
                at, x, n = (np.frombuffer(v.as_buffer(), t) for v, t in zip(rest, (np.int32, np.float32, np.float64)))
                w = width[slab >> 16]
                total, moved = sums.setdefault(slab, (np.zeros((SLAB, w)), np.zeros(SLAB)))
                total[at] += x.reshape(-1, w) * n[:, None]
                moved[at] += n
        for slab, (total, moved) in sums.items():
            at = np.flatnonzero(moved)
            yield _part(slab, at, total[at] / moved[at, None], moved[at])

    tables = list(_tables(p).values())
    got = parts.repartition("slab").mapInArrow(add, _PARTS_SQL).toArrow()
    for slab, at, x in zip(got.column("slab").to_pylist(), got.column("at").to_pylist(), got.column("x").to_pylist()):
        rows = (slab & 0xFFFF) * SLAB + np.frombuffer(at, np.int32)
        tables[slab >> 16][rows] = np.frombuffer(x, np.float32).reshape(len(rows), -1)
    emb, out, net = tables
    return {"emb": emb, "w": net[0, :-HIDDEN].reshape(SHAPES["w"]), "b": net[0, -HIDDEN:], "out": np.ascontiguousarray(out[:, :-1]), "bias": out[:, -1].copy()}


def train(docs: DataFrame, text: str = "text", seed: int = 3) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """Vocabulary and network of all documents. Null and wordless texts teach nothing; without any text both are flat."""
    made = Scratch()
    try:
        return fit(made.keep(coded(docs, None, text)), seed)
    finally:
        made.clear()


def fit(table: DataFrame, seed: int = 3) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """train on a coded table, which is read twice."""
    tune(table.sparkSession)
    sc = table.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(np.concatenate([np.zeros(0, np.int32), *_buckets(b.column(0))]), minlength=BUCKETS)
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[got])], names=["bucket", "n"])

    rows = table.select("k").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS)
    counts[rows["bucket"]] = rows["n"]
    voc = vocabulary(counts)
    shared = sc.broadcast(voc)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen, texts, held = Training(shared.value, seed), 0, [], 0
        for b in batches:
            for k in _buckets(b.column(0)):
                if len(k):
                    texts.append(k)
                    held += len(k)
                if held >= HELD:
                    seen += t.learn(texts, seed)
                    texts, held = [], 0
        if held:
            seen += t.learn(texts, seed)
        if seen:
            moves = [t.moves["emb"], t.moves["out"], np.array([seen])]
            for i, (table, n) in enumerate(zip(_tables(t.p).values(), moves)):
                for k in range(-(-len(n) // SLAB)):
                    at = np.flatnonzero(n[k * SLAB : (k + 1) * SLAB])
                    if len(at):
                        yield _part(i << 16 | k, at, table[k * SLAB + at], n[k * SLAB + at])

    return voc, _averaged(table.select("k").mapInArrow(learn, _PARTS_SQL), start(voc.prior, seed))


def score(docs: DataFrame, model: tuple[Vocabulary, dict[str, np.ndarray]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of every row; without words log_prob is 0 and its mean null."""
    return apply(coded(docs, doc_id, text), model)


def fit_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """score by a model of the same documents, whose texts are made into words once."""
    table = materialize(coded(docs, doc_id, text))
    return apply(table, fit(table))


def apply(table: DataFrame, model: tuple[Vocabulary, dict[str, np.ndarray]]) -> DataFrame:
    """score on a coded table."""
    tune(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64()), ("mean_log_prob", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, p = shared.value
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            texts, who, held = [], [], 0

            def flush() -> None:
                nonlocal texts, who, held
                if texts:
                    runs, owner = stream(texts), np.repeat(who, [len(t) for t in texts])
                    done = 0
                    for lo in range(0, len(runs), 32):
                        _, lp = log_probs(p, voc, runs[lo : lo + 32])  # in the order of the words
                        total[:] += np.bincount(owner[done : done + len(lp)], lp, len(total))
                        done += len(lp)
                texts, who, held = [], [], 0

            for i, k in enumerate(_buckets(b.column(1))):
                n[i] = len(k)
                if len(k):
                    texts.append(k)
                    who.append(i)
                    held += len(k)
                if held >= PIECE:
                    flush()
            flush()
            mean = pa.array([t / m if m else None for t, m in zip(total.tolist(), n.tolist())], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total), mean], schema=schema)

    return table.select("doc_id", "k").mapInArrow(run, "doc_id long, n_words long, log_prob double, mean_log_prob double")
