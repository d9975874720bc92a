"""Gradient boosting on histograms, for all folds at once.

Features are binned once (quantiles of numbers, the commonest categories, a bin for missing values) and the binned table is
written to the shared folder. A level of a round is one pass over it: each task adds up gradient, curvature and rows by
(model, class, node, feature, bin), a groupBy merges the tasks' sums, and the driver, which sees sums only, chooses the
splits. The fold models are grown side by side: a row of fold f counts in every model but f, and is validation for f, so
that k folds cost the passes of one. Raw scores are written with the table every few rounds (none before the first); the trees
since then are applied on the fly, so that passes depend on nothing but a durable table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.losses import Loss
from ..sources.shared import Workspace
from .categorical import value_counts

#: Sums that a task holds at a time; wider histograms take several passes.
CELLS = 1 << 23
#: Rounds whose trees are applied on the fly before the stored raw scores are written anew.
REFRESH = 8
#: Bins of a pass that looks for quantiles in leaves; two passes find them to 1 / STEPS**2 of the residuals' range.
STEPS = 2048


@dataclass(frozen=True)
class Params:
    """depth levels of splits; at most leaves of a tree (best gains first); alpha and ridge penalise leaf values."""

    rounds: int = 50
    rate: float = 0.1
    depth: int = 5
    leaves: int = 32
    least_rows: int = 20
    least_curvature: float = 1e-3
    least_gain: float = 0.0
    alpha: float = 0.0
    ridge: float = 0.0
    columns: float = 1.0
    rows: float = 1.0
    bins: int = 64
    categories: int = 254
    patience: int = 10
    smooth: float = 10.0
    seed: int = 42


def suggested(task: str, n: int) -> Params:
    """Parameters by the number of rows; a tree has as many levels as its leaves need."""
    # Fixed values: (rows up to, leaves for reg, leaves else, alpha for reg, alpha else).
    steps = [(5_000, 16, 16, 1.0, 1.0), (10_000, 24, 32, 0.5, 0.5), (20_000, 32, 64, 0.5, 0.2), (50_000, 32, 32, 0.5, 0.0), (100_000, 32, 64, 1.0, 1.0), (300_000, 64, 128, 1.0, 1.0), (math.inf, 128, 244, 1.0, 1.0)]
    # Fixed values: (rows up to, rate, rounds, patience).
    pace = [(10_000, 0.01, 3000, 200), (20_000, 0.02, 3000, 200), (100_000, 0.03, 1200, 200), (300_000, 0.04, 2000, 100), (math.inf, 0.05, 2000, 100)]
    step, (_, rate, rounds, patience) = (next(s for s in t if n <= s[0]) for t in (steps, pace))
    reg = task == "reg"
    leaves, part = (step[1] if reg else step[2]), (0.9 if reg else 0.7)
    return Params(rounds=rounds, rate=rate, patience=patience, leaves=leaves, depth=math.ceil(math.log2(leaves)) + 1, alpha=step[3] if reg else step[4], columns=part, rows=part, bins=255)


@dataclass
class Bins:
    """How columns become bin numbers: 0 is missing; numbers go by upper edges, categories by rank, the rest in the last bin."""

    features: list[str]
    edges: dict[str, np.ndarray]
    ranks: dict[str, list[str]]

    @staticmethod
    def fit(df: DataFrame, features: list[str], bins: int, categories: int, categorical: tuple[str, ...] = ()) -> Bins:
        text = [f for f in features if f in categorical or isinstance(df.schema[f].dataType, StringType)]
        numbers = [f for f in features if f not in text]
        edges: dict[str, np.ndarray] = {}
        if numbers:
            known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in numbers]
            at = [i / bins for i in range(1, bins)]
            row = df.agg(*[F.percentile_approx(k, at, 20 * bins).alias(f"q{i}") for i, k in enumerate(known)]).first()
            edges = {f: np.unique(np.array(row[i] or [], float)) for i, f in enumerate(numbers)}
        ranks = {}
        if text:
            by = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))
            top = value_counts(df, text).where(F.col("value").isNotNull()).withColumn("k", by).where(F.col("k") <= categories).collect()
            ranks = {f: [r.value for r in sorted((r for r in top if r.feature == f), key=lambda r: r.k)] for f in text}
        return Bins(features, edges, ranks)

    @property
    def sizes(self) -> list[int]:
        return [len(self.edges[f]) + 2 if f in self.edges else len(self.ranks[f]) + 2 for f in self.features]

    def columns(self, df: DataFrame) -> list:
        return [F.col(f).cast("string" if f in self.ranks else "double").alias(f"_f{i}") for i, f in enumerate(self.features)]

    def codes(self, columns: list[pa.Array]) -> np.ndarray:
        """(rows, features) of bin numbers."""
        out = np.zeros((len(columns[0]) if columns else 0, len(self.features)), np.int16)
        for j, (f, c) in enumerate(zip(self.features, columns)):
            if f in self.ranks:
                k = pc.index_in(c, value_set=pa.array(self.ranks[f], pa.string())).to_numpy(zero_copy_only=False).astype(float)
                out[:, j] = np.where(c.is_null().to_numpy(zero_copy_only=False), 0, np.where(np.isnan(k), len(self.ranks[f]) + 1, np.nan_to_num(k) + 1))
            else:
                x = pc.fill_null(c, np.nan).to_numpy(zero_copy_only=False)
                out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(self.edges[f], x, side="left") + 1)
        return out


@dataclass
class Tree:
    """A heap of nodes: children of i are 2i + 1 and 2i + 2. left says for each bin of the node's feature whether it goes left."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int, widest: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros((n, widest), bool), np.zeros(n), np.zeros(n))

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node (leaf, as far as the tree is grown) of each row."""
        at = np.zeros(len(codes), np.int64)
        split = np.flatnonzero(self.feature >= 0)
        if not len(split) or self.feature[0] < 0:
            return at
        n, widest = self.left.shape
        feature = np.maximum(self.feature, 0).astype(np.int64)
        step = np.repeat(np.arange(n), widest).reshape(n, widest)
        step[split] = 2 * split[:, None] + 2 - self.left[split]
        flat, step, start = codes.ravel(), step.ravel(), np.arange(len(codes)) * codes.shape[1]
        for _ in range(int(split[-1] + 1).bit_length()):  # levels with a split
            at = step.take(at * widest + flat.take(start + feature.take(at)))
        return at


@dataclass
class Booster:
    """Fold models that were grown together: trees[m][round][class]; best[m] is the number of rounds that counts."""

    bins: Bins
    loss: Loss
    start: np.ndarray
    trees: list[list[list[Tree]]]
    best: list[int]
    name: str
    history: list[list[float]] = field(default_factory=list)

    @property
    def models(self) -> list[list[list[Tree]]]:
        return self.trees

    def raw(self, codes: np.ndarray, m: int, rounds: int | None = None) -> np.ndarray:
        """(rows, classes) of raw scores of fold model m."""
        s = np.tile(self.start[m], (len(codes), 1))
        for group in self.trees[m][: self.best[m] if rounds is None else rounds]:
            for k, t in enumerate(group):
                s[:, k] += t.value[t.nodes(codes)]
        return s

    def _linked(self, s: np.ndarray) -> np.ndarray:
        return self.loss.link(s if self.loss.classes > 1 else s[:, 0])

    def predict(self, df: DataFrame) -> DataFrame:
        """df with the mean prediction of the fold models: a number, or an array with the probability of each class."""
        b, several = self, self.loss.classes > 1

        @F.arrow_udf("array<double>" if several else "double")
        def of(x: pa.Array) -> pa.Array:
            codes = b.bins.codes(x.flatten()).astype(np.int64)
            return _column(sum(b._linked(b.raw(codes, m)) for m in range(len(b.trees))) / len(b.trees))

        return df.withColumn(self.name, of(F.struct(*self.bins.columns(df))))

    def importance(self, features: list[str] | None = None) -> dict[str, float]:
        """Gains of the splits by feature, mean over the fold models."""
        total = dict.fromkeys(features or self.bins.features, 0.0)
        for m, rounds in enumerate(self.trees):
            for group in rounds[: self.best[m]]:
                for t in group:
                    for i in np.flatnonzero(t.feature >= 0).tolist():
                        f = self.bins.features[t.feature[i]]
                        total[f] = total.get(f, 0.0) + float(t.gain[i]) / len(self.trees)
        return total


def _hash01(uid: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) by key and salt."""
    h = (uid.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)) / float(1 << 53)


def _packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row of numbers."""
    if not len(x):
        return pa.array([], pa.binary())
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _unpacked(b: pa.Array, dtype: type) -> np.ndarray:
    """The numbers of a column of binary values, one after the other."""
    ends, values = b.buffers()[1:]
    if not len(b) or values is None:
        return np.zeros(0, dtype)
    at = np.frombuffer(ends, np.int32)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(values, np.uint8)[at[0] : at[-1]].view(dtype)


class _Batch:
    """A batch of the binned table; trees are applied to the rows and models that are asked for only."""

    def __init__(self, b: pa.RecordBatch, fit: _Fit) -> None:
        self.fit, n = fit, b.num_rows
        self.codes = _unpacked(b.column("codes"), np.int16).astype(np.int64).reshape(n, len(fit.sizes))
        self.y, self.w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
        self.fold = b.column("fold").to_numpy(zero_copy_only=False)
        self.uid = b.column("uid").to_numpy(zero_copy_only=False) if "uid" in b.schema.names else None
        self.stored = _unpacked(b.column("score"), np.float64).reshape(n, fit.n_models, fit.loss.classes) if "score" in b.schema.names else None

    def score(self, i: int, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(rows, classes) of raw scores of model i, the trees since the last refresh applied; codes: those of the rows."""
        s = self.stored[rows, i] if self.stored is not None else np.tile(self.fit.start[i], (len(rows), 1))
        for group in self.fit.pending:
            if group[i] is not None:
                for j, t in enumerate(group[i]):
                    s[:, j] += t.value.take(t.nodes(codes))
        return s

    def trains(self, i: int) -> np.ndarray:
        """Rows that model i is grown on in this round."""
        use = self.fold != i
        if self.fit.params.rows < 1:
            use = use & (_hash01(self.uid, self.fit.params.seed + 1_000_003 * self.fit.round) < self.fit.params.rows)
        return np.flatnonzero(use)


@dataclass
class _Fit:
    """What a task has to know of the state of training."""

    loss: Loss
    params: Params
    sizes: list[int]
    n_models: int
    pending: list[list[list[Tree] | None]]
    start: np.ndarray
    round: int = 0

    def gradients(self, b: _Batch, s: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = self.loss.grad(b.y[use], s if self.loss.classes > 1 else s[:, 0])
        w = b.w[use][:, None]
        return g.reshape(len(s), self.loss.classes) * w, h.reshape(len(s), self.loss.classes) * w


_SUMS = pa.schema([("model", pa.int32()), ("cls", pa.int32()), ("cell", pa.int64()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())])
_SUMS_SQL = "model int, cls int, cell long, g double, h double, n long"


def _histogram(table: DataFrame, fit: _Fit, live: list, level: int, columns: list[int]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums by (node of the level, cell of a feature's bin) for each (model, class): one pass. On the first level also each
    model's loss on its validation rows (cell -1: g loss, h weight) and the bounds of its residuals (cells -2 and -3)."""
    first, width = 2**level - 1, 2**level
    offset = np.concatenate([[0], np.cumsum([fit.sizes[j] for j in columns])])
    cells = int(offset[-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = fit.n_models, fit.loss.classes
        acc = np.zeros((m, k, 3, width * cells))
        loss, bound = np.zeros((m, 2)), np.tile([np.inf, -np.inf], (m, 1))
        for rb in batches:
            b = _Batch(rb, fit)
            for i in range(m):
                use = b.trains(i)
                if level == 0:
                    score = b.score(i, np.arange(len(b.y)), b.codes)
                    out = b.fold == i
                    s = score[out]
                    loss[i] += (fit.loss.value(b.y[out], s if k > 1 else s[:, 0]) * b.w[out]).sum(), b.w[out].sum()
                    if k == 1 and len(b.y):
                        r = b.y - score[:, 0]
                        bound[i] = min(bound[i, 0], r.min()), max(bound[i, 1], r.max())
                if live[i] is None:
                    continue
                codes = b.codes.take(use, axis=0)
                g, h = fit.gradients(b, score.take(use, axis=0) if level == 0 else b.score(i, use, codes), use)
                mine = np.ascontiguousarray((codes[:, columns] + offset[:-1]).T)
                for j in range(k):
                    node = live[i][j].nodes(codes) - first
                    open_, some, x, y = node >= 0, mine, g[:, j], h[:, j]
                    if not open_.all():
                        node, some, x, y = node[open_], mine[:, open_], x[open_], y[open_]
                    base = node * cells
                    for c in range(len(columns)):  # a column's cells are its own
                        cell = base + some[c]
                        acc[i, j, 0] += np.bincount(cell, x, width * cells)
                        acc[i, j, 1] += np.bincount(cell, y, width * cells)
                        acc[i, j, 2] += np.bincount(cell, minlength=width * cells)
        for i in range(m):
            if level == 0:
                yield _rows(i, 0, np.array([-1, -2, -3]), np.array([loss[i, 0], bound[i, 0], bound[i, 1]]), np.array([loss[i, 1], 0, 0]), np.zeros(3, np.int64))
            for j in range(k):
                got = np.flatnonzero(acc[i, j, 2])
                if len(got):
                    yield _rows(i, j, got, *acc[i, j, :2, got].T, acc[i, j, 2, got].astype(np.int64))

    sums = table.mapInArrow(work, _SUMS_SQL).groupBy("model", "cls", "cell")
    pick = F.when(F.col("cell") == -2, F.min("g")).when(F.col("cell") == -3, F.max("g")).otherwise(F.sum("g"))
    rows = sums.agg(pick.alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    col = {c: rows.column(c).to_numpy() for c in rows.column_names}
    out = {}
    for i in range(fit.n_models):
        for j in range(fit.loss.classes):
            mine = (col["model"] == i) & (col["cls"] == j)
            low = mine & (col["cell"] < 0)
            dense = np.zeros((3, width * cells))
            mine &= col["cell"] >= 0
            for v, c in enumerate("ghn"):
                dense[v, col["cell"][mine]] = col[c][mine]
            side = {int(c): (g, h) for c, g, h in zip(col["cell"][low], col["g"][low], col["h"][low])}
            out[i, j] = dense.reshape(3, width, cells), offset, side
    return out


def _rows(i: int, j: int, cell: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    k = len(cell)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.array(np.full(k, j, np.int32)), pa.array(cell.astype(np.int64)), pa.array(np.ascontiguousarray(g)), pa.array(np.ascontiguousarray(h)), pa.array(n)], schema=_SUMS)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _worth(g, h, p: Params):
    return np.where(h + p.ridge > 0, _shrunk(g, p.alpha) ** 2 / np.maximum(h + p.ridge, 1e-300), 0.0)


def _leaf(g, h, p: Params):
    return np.where(h + p.ridge > 0, -_shrunk(g, p.alpha) / np.maximum(h + p.ridge, 1e-300), 0.0)


def best_split(sums: np.ndarray, ordered: bool, p: Params) -> tuple[float, np.ndarray | None]:
    """(gain, which bins go left) of the best split of one feature's bins (g, h, n rows; bin 0 is missing).

    Numbers split by order, missing values on either side; categories are put in order of g / (h + smooth) first.
    """
    g, h, n = sums
    whole = _worth(g.sum(), h.sum(), p)
    best, found = 0.0, None
    order = np.arange(1, len(g))
    if not ordered:
        seen = np.flatnonzero(n > 0)
        order = seen[np.argsort(g[seen] / (h[seen] + p.smooth), kind="stable")]
    for none_left in (False, True) if ordered and n[0] > 0 else (False,):
        extra = sums[:, 0] if ordered and none_left else np.zeros(3)
        left = np.cumsum(sums[:, order], axis=1) + extra[:, None]
        right = sums.sum(axis=1)[:, None] - left
        ok = (np.minimum(left[2], right[2]) >= p.least_rows) & (np.minimum(left[1], right[1]) >= p.least_curvature)
        gain = np.where(ok, _worth(left[0], left[1], p) + _worth(right[0], right[1], p) - whole, -np.inf)
        if len(gain) and gain.max() > max(best, p.least_gain) + 1e-12:
            at = int(gain.argmax())
            best, found = float(gain[at]), np.zeros(len(g), bool)
            found[order[: at + 1]] = True
            found[0] = none_left if ordered else found[0]
    return best, found


def _grow(tree: Tree, level: int, sums: list[tuple[np.ndarray, np.ndarray, list[int]]], bins: Bins, p: Params, leaves: int) -> int:
    """Split the level's nodes, best gains first, while the tree has at most p.leaves leaves; the number of leaves then."""
    first, found = 2**level - 1, []
    for node in range(2**level):
        best = (0.0, None, None)
        for dense, offset, columns in sums:
            for i, j in enumerate(columns):
                part = dense[:, node, offset[i] : offset[i + 1]]
                if part[2].sum() < 2 * p.least_rows:
                    break
                gain, left = best_split(part, bins.features[j] in bins.edges, p)
                if left is not None and gain > best[0] + 1e-12:
                    best = gain, (j, left), part
        if best[1] is not None:
            found.append((best[0], node, *best[1], best[2]))
    for gain, node, j, left, part in sorted(found, key=lambda x: (-x[0], x[1])):
        if leaves >= p.leaves:
            break
        at = first + node
        tree.feature[at], tree.gain[at] = j, gain
        tree.left[at, : len(left)] = left
        for child, side in ((2 * at + 1, left), (2 * at + 2, ~left)):
            tree.value[child] = float(_leaf(part[0, side].sum(), part[1, side].sum(), p))
        leaves += 1
    return leaves


def _quantiles(table: DataFrame, fit: _Fit, trees: list, bounds: list[tuple[float, float]]) -> None:
    """Set leaf values to the loss's quantile of the leaf's residuals: two passes of weighted counts, one finer than the other."""
    m = fit.n_models
    of = {(i, int(v)): bounds[i] for i in range(m) if trees[i] is not None for v in np.flatnonzero(trees[i][0].feature[(np.arange(len(trees[i][0].feature)) - 1) // 2] >= 0) if v and trees[i][0].feature[v] < 0}
    of |= {(i, 0): bounds[i] for i in range(m) if trees[i] is not None and trees[i][0].feature[0] < 0}
    tops = [hi for _, hi in bounds]
    below = dict.fromkeys(of, 0.0)
    whole: dict = {}
    for turn in range(2):

        def work(batches: Iterator[pa.RecordBatch], of: dict = dict(of)) -> Iterator[pa.RecordBatch]:
            acc = {k: np.zeros(STEPS + 1) for k in of}
            for rb in batches:
                b = _Batch(rb, fit)
                rest: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                for i in {i for i, _ in of}:
                    use = b.trains(i)
                    codes = b.codes.take(use, axis=0)
                    rest[i] = use, trees[i][0].nodes(codes), b.y[use] - b.score(i, use, codes)[:, 0]
                for (i, leaf), (lo, hi) in of.items():
                    there = rest[i][1] == leaf
                    use, r = rest[i][0][there], rest[i][2][there]
                    inside = (r >= lo) & ((r < hi) | (hi >= tops[i]))
                    at = np.zeros(int(inside.sum()), np.int64) if hi <= lo else np.minimum(((r[inside] - lo) / (hi - lo) * STEPS).astype(np.int64), STEPS - 1)
                    acc[i, leaf][:STEPS] += np.bincount(at, b.w[use][inside], STEPS)
                    acc[i, leaf][STEPS] += b.w[use].sum()
            for (i, leaf), a in acc.items():
                got = np.flatnonzero(a)
                yield _rows(i, leaf, got, a[got], np.zeros(len(got)), np.zeros(len(got), np.int64))

        rows = table.mapInArrow(work, _SUMS_SQL).groupBy("model", "cls", "cell").agg(F.sum("g").alias("g")).toArrow()
        hist = {k: np.zeros(STEPS + 1) for k in of}
        for i, leaf, cell, g in zip(*(rows.column(c).to_pylist() for c in ("model", "cls", "cell", "g"))):
            hist[i, leaf][cell] = g
        for key, (lo, hi) in of.items():
            whole.setdefault(key, hist[key][STEPS])
            need = fit.loss.quantile * whole[key]
            run = below[key] + np.cumsum(hist[key][:STEPS])
            at = min(int(np.searchsorted(run, need - 1e-9 * max(1.0, need))), STEPS - 1)
            below[key] = run[at - 1] if at else below[key]
            of[key] = lo + (hi - lo) * at / STEPS, lo + (hi - lo) * (at + 1) / STEPS
    for (i, leaf), (lo, hi) in of.items():
        trees[i][0].value[leaf] = (lo + hi) / 2


def _starts(table: DataFrame, loss: Loss, n_models: int) -> np.ndarray:
    """Raw scores before any tree, of each model by its own training rows."""
    use = lambda i: F.col("fold") != i
    y, w = F.col("y"), F.col("w")
    if loss.start == "quantile":
        cols = [F.percentile_approx(F.when(use(i), y), loss.quantile, 100_000) for i in range(n_models)]
        return np.array([[v or 0.0] for v in table.agg(*cols).first()])
    if loss.start == "prior":
        k = loss.classes
        row = table.agg(*[F.sum(F.when(use(i) & (y == c), w).otherwise(0.0)) for i in range(n_models) for c in range(k)]).first()
        share = np.maximum(np.array([v or 0.0 for v in row]).reshape(n_models, k), 1e-9)
        return np.log(share / share.sum(axis=1, keepdims=True))
    row = table.agg(*[F.sum(F.when(use(i), w * y)) / F.sum(F.when(use(i), w)) for i in range(n_models)]).first()
    mean = np.array([v or 0.0 for v in row])
    if loss.start == "logit":
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        mean = np.log(mean / (1 - mean))
    return mean[:, None]


def boost(df: DataFrame, features: list[str], target: str, loss: Loss, params: Params, n_folds: int, name: str, key: str, fold: str = "fold",
          weight: str | None = None, out_of_time: Callable[[], bool] | None = None, categorical: tuple[str, ...] = ()) -> tuple[Booster, DataFrame]:
    """(booster, df with out-of-fold predictions). Rows of fold f (0 to n_folds - 1) are predicted by the model grown on the others.

    With n_folds 1, rows of fold 0 are for validation and all others for training. Rows without a target or of no fold have
    no part in training; rows without a target are predicted all the same. Text columns and those named categorical are
    categories, missing values of either kind have a bin of their own. A model stops at the round with the least loss on
    its own fold, after params.patience rounds without a better one (0: all rounds are kept); out_of_time() may end
    training earlier.
    """
    spark = df.sparkSession
    made = Workspace(spark)
    some = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
    bins = Bins.fit(some, features, params.bins, params.categories, categorical)
    y = F.col(target).cast("double")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    uid = F.xxhash64(F.col(key).cast("string")) if params.rows < 1 else F.lit(0).cast("long")  # read by the draw of rows only
    rows = some.select(uid.alias("uid"), y.alias("y"), w.alias("w"), F.col(fold).cast("int").alias("fold"), *bins.columns(df))
    table = made.keep(_binned(rows, bins, loss))
    start = _starts(table, loss, n_folds)
    table = table if params.rows < 1 else table.drop("uid")
    k, widest = loss.classes, max(bins.sizes, default=1)
    trees: list[list[list[Tree]]] = [[] for _ in range(n_folds)]
    fit = _Fit(loss, params, bins.sizes, n_folds, [], start)
    history: list[list[float]] = [[] for _ in range(n_folds)]
    rng = np.random.default_rng(params.seed)
    stopped = [False] * n_folds
    for r in range(params.rounds + 1):
        chosen = sorted(rng.choice(len(features), max(1, round(params.columns * len(features))), replace=False).tolist()) if features else []
        per = max(1, CELLS // max(1, n_folds * k * 3 * 2 ** (params.depth - 1) * widest))
        parts = [chosen[i : i + per] for i in range(0, len(chosen), per)]
        fit.round = r
        last = r == params.rounds or (r > 0 and out_of_time is not None and out_of_time())
        live: list[list[Tree] | None] = [None if last or stopped[i] else [Tree.empty(params.depth, widest) for _ in range(k)] for i in range(n_folds)]
        leaves = {(i, j): 1 for i in range(n_folds) for j in range(k)}
        bounds: list[tuple[float, float]] = []
        for level in range(params.depth):
            got = [(_histogram(table, fit, live, level, part), part) for part in parts[: 1 if last else None]]
            if level == 0:
                for i in range(n_folds):
                    side = got[0][0][i, 0][2]
                    lo, hi = (float(side[c][0]) if c in side else 0.0 for c in (-2, -3))
                    bounds.append((lo, hi) if lo <= hi else (0.0, 0.0))
                    if not stopped[i]:
                        history[i].append(float(side[-1][0] / side[-1][1]) if -1 in side and side[-1][1] > 0 else math.nan)
                        since = len(history[i]) - 1 - int(np.nanargmin(history[i])) if not np.isnan(history[i]).all() else 0
                        if params.patience and since >= params.patience:
                            stopped[i], live[i] = True, None
                if last or all(stopped):
                    break
            before = dict(leaves)
            for i in range(n_folds):
                if live[i] is not None:
                    for j in range(k):
                        sums = [(h[i, j][0], h[i, j][1], part) for h, part in got]
                        if level == 0:  # a tree without a split is one leaf
                            g, c = sums[0][0][:2, 0, : sums[0][1][1]].sum(axis=1)
                            live[i][j].value[0] = float(_leaf(g, c, params))
                        leaves[i, j] = _grow(live[i][j], level, sums, bins, params, leaves[i, j])
            if leaves == before:
                break
        if last or all(stopped):
            break
        if loss.quantile is not None:
            _quantiles(table, fit, live, bounds)
        for i in range(n_folds):
            if live[i] is not None:
                for t in live[i]:
                    t.value *= params.rate
                trees[i].append(live[i])
        fit.pending.append(live)
        if len(fit.pending) >= REFRESH:
            table = made.keep(_refreshed(table, fit))
            made.clear(newest=1)
            fit.pending = []
    best = [int(np.nanargmin(h)) if params.patience and len(h) and not np.isnan(h).all() else len(t) for h, t in zip(history, trees)]
    made.clear()
    booster = Booster(bins, loss, start, trees, best, name, history)
    return booster, out_of_fold(booster, df, fold)


def _column(x: np.ndarray) -> pa.Array:
    """Predictions as a column: numbers, or arrays of a number for each class."""
    if x.ndim == 1:
        return pa.array(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _binned(rows: DataFrame, bins: Bins, loss: Loss) -> DataFrame:
    schema = pa.schema([("uid", pa.int64()), ("y", pa.float64()), ("w", pa.float64()), ("fold", pa.int32()), ("codes", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            w = b.column(2).to_numpy(zero_copy_only=False)
            w = w * loss.weight(y) if loss.weight is not None else w
            codes = bins.codes(b.columns[4:])
            codes = codes if len(bins.features) else np.zeros((b.num_rows, 0), np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(loss.forward(y)), pa.array(w), b.column(3), _packed(codes)], schema=schema)

    return rows.mapInArrow(work, "uid long, y double, w double, fold int, codes binary")


def _refreshed(table: DataFrame, fit: _Fit) -> DataFrame:
    """The table with the pending trees added to its raw scores."""
    names = [c for c in table.columns if c != "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            b, every = _Batch(rb, fit), np.arange(rb.num_rows)
            s = np.hstack([b.score(i, every, b.codes) for i in range(fit.n_models)])
            yield pa.RecordBatch.from_arrays([*map(rb.column, names), _packed(s)], names=[*names, "score"])

    return table.mapInArrow(work, table.select(names).schema.add("score", "binary"))


def out_of_fold(booster: Booster, df: DataFrame, fold: str = "fold") -> DataFrame:
    """df with each row's prediction by the model of its own fold; rows of no such fold get the mean of all models."""
    b, several, m = booster, booster.loss.classes > 1, len(booster.trees)

    @F.arrow_udf("array<double>" if several else "double")
    def of(f: pa.Array, x: pa.Array) -> pa.Array:
        codes = b.bins.codes(x.flatten()).astype(np.int64)
        folds = pc.fill_null(f, -1).to_numpy(zero_copy_only=False)
        out = np.zeros((len(folds), b.loss.classes) if several else len(folds))
        for k in np.unique(folds).tolist():
            rows = np.flatnonzero(folds == k)
            own = [k] if 0 <= k < m else range(m)
            out[rows] = sum(b._linked(b.raw(codes[rows], i)) for i in own) / len(own)
        return _column(out)

    return df.withColumn(booster.name, of(F.col(fold).cast("int"), F.struct(*booster.bins.columns(df))))
