"""Linear models with squared penalties by Newton's method, for all folds in the same passes.

A pass over the rows adds up, in tasks, loss, gradient and curvature of each fold's model; a groupBy merges the tasks' sums
and the driver, which sees them only, solves for the next weights. A category of many values takes no room in these sums:
its rows lie together, so that a task finds the best weights of its values for given other weights by itself (one number
each) and adds the curvature that is left when they follow (the Schur complement). Their weights never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of a model that are solved for on the driver at most; curvature sums are half as many as their square.
DENSE = 256
#: Rows that a task takes together (and the rest of their last group); passes of a fit and of a group's own fit at most.
ROWS, PASSES, INNER = 1 << 14, 40, 60


@dataclass
class Weights:
    """One fold's model. extra: array columns that hold weights of each row's category values by model, and those of others."""

    features: list[str]
    coef: np.ndarray
    bias: np.ndarray
    task: str
    extra: list[tuple[str, int, float]] = field(default_factory=list)
    values: int = 0

    @property
    def stages(self) -> list[Weights]:
        return [self]

    @property
    def numFeatures(self) -> int:  # noqa: N802  as Spark's models name it
        return len(self.features) + self.values

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(np.abs(self.coef).mean(axis=0) if len(self.coef) > 1 else self.coef[0])

    @property
    def coefficientMatrix(self) -> DenseMatrix:  # noqa: N802
        return DenseMatrix(*self.coef.shape, self.coef.ravel(order="F").tolist())

    @property
    def intercept(self) -> float:
        return float(self.bias[0])

    @property
    def interceptVector(self) -> DenseVector:  # noqa: N802
        return DenseVector(self.bias)

    def column(self) -> Column:
        """The prediction: a number, the probability of 1, or an array of the classes' probabilities; NaN where a feature is missing."""
        nan = F.lit(float("nan"))
        x = [F.coalesce(F.col(f).cast("double"), nan) for f in self.features]
        raw = [sum((v * F.lit(float(w)) for v, w in zip(x, ws)), F.lit(float(b))) for ws, b in zip(self.coef, self.bias)]
        raw = [sum((F.coalesce(F.col(c)[m], F.lit(other)) for c, m, other in self.extra), r) for r in raw]
        if self.task == "reg":
            return raw[0]
        if self.task == "binary":
            return F.lit(1.0) / (F.exp(-raw[0]) + 1)
        shares = lambda odds: F.transform(odds, lambda v: F.lit(1.0) / F.aggregate(odds, F.lit(0.0), lambda a, u: a + F.exp(u - v)))
        return F.transform(F.array(F.array(*raw)), shares)[0]  # the outer lambda's variable: sums are made once a row, not for each pair of classes


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * s))


def _parts(s: np.ndarray, y: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss of each row by its raw score."""
    if task == "reg":
        return s - y, np.ones(len(s))
    p = _sigmoid(s)
    return p - y, p * (1 - p)


def _loss(s: np.ndarray, y: np.ndarray, task: str) -> np.ndarray:
    return 0.5 * (s - y) ** 2 if task == "reg" else np.logaddexp(0, s) - y * s


def _own(base: np.ndarray, y: np.ndarray, use: np.ndarray, group: np.ndarray, n: int, free: np.ndarray, task: str, penalty: float) -> np.ndarray:
    """The best weight of each group for the other weights' scores; 0 for those that are not free."""
    w = np.zeros(n)
    for _ in range(INNER):
        g, h = _parts(base + w[group], y, task)
        g = np.bincount(group, g * use, n) + penalty * w
        step = np.where(free, g / (np.bincount(group, h * use, n) + penalty), 0.0)
        w -= step if task == "reg" else np.clip(step, -2, 2)
        if not len(step) or np.abs(step).max() < 1e-10:
            break
    return w


@dataclass
class Spec:
    """What tasks have to know: numbers, one-hot places, classes, and by model the penalties and weights (classes, places)."""

    task: str
    k: int
    numbers: int
    places: int
    penalty: np.ndarray
    theta: np.ndarray
    grouped: bool = False

    @property
    def width(self) -> int:
        return 1 + self.numbers + self.places


def _chunks(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[tuple]:
    """(y, fold, matrix, offset by model or None, group of each row, first rows of groups, names of groups) of whole groups."""
    held: list[pa.RecordBatch] = []

    def made(t: pa.Table) -> tuple:
        n = t.num_rows
        flat = lambda c, dtype: pc.list_flatten(t.column(c).combine_chunks()).to_numpy(zero_copy_only=False).astype(dtype)
        x = np.zeros((n, spec.width))
        x[:, 0] = 1
        if spec.numbers:
            x[:, 1 : 1 + spec.numbers] = flat("x", float).reshape(n, spec.numbers)
        if spec.places:
            at = flat("c", np.int64).reshape(n, -1)
            for j in range(at.shape[1]):
                there = at[:, j] >= 0
                x[np.flatnonzero(there), 1 + spec.numbers + at[there, j]] = 1
        offset = flat("offset", float).reshape(n, -1) if "offset" in t.column_names else None
        first, names = np.zeros(min(n, 1), np.int64), None
        if spec.grouped:
            g = t.column("g").combine_chunks()
            first = np.concatenate([first, _changes(g)])
            names = g.take(pa.array(first))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        return t.column("y").to_numpy(), t.column("fold").to_numpy(), x, offset, group, first, names

    def cut() -> Iterator[tuple]:
        nonlocal held
        t = pa.Table.from_batches(held).combine_chunks()
        end = t.num_rows
        if spec.grouped and t.column("g")[end - 1].is_valid:  # rows without a name come first and are no group
            last = _changes(t.column("g").combine_chunks())
            end = int(last[-1]) if len(last) else 0
        if end:
            yield made(t.slice(0, end))
        held = t.slice(end).combine_chunks().to_batches() if end < t.num_rows else []

    waiting = ROWS
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= waiting:
            yield from cut()
            waiting = max(ROWS, 2 * sum(h.num_rows for h in held))
    if held:
        yield made(pa.Table.from_batches(held).combine_chunks())


def _changes(g: pa.Array) -> np.ndarray:
    """Rows whose name differs from that of the row before; missing is a name."""
    a, b = g.slice(1), g.slice(0, max(0, len(g) - 1))
    same = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.and_(a.is_null(), b.is_null()), pc.equal(a, b))
    return np.flatnonzero(~same.to_numpy(zero_copy_only=False).astype(bool)) + 1


_CELLS = pa.schema([("model", pa.int32()), ("cell", pa.int64()), ("v", pa.float64())])


def _pass(table: DataFrame, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradient, curvature) of each model, without the penalties of the weights on the driver."""
    q = spec.k * spec.width
    upper = np.triu_indices(q)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(spec.theta)
        loss, grad, curve = np.zeros(m), np.zeros((m, q)), np.zeros((m, q, q))
        for y, fold, x, offset, group, first, names in _chunks(batches, spec):
            for i in range(m):
                use = (fold != i).astype(float)
                base = x @ spec.theta[i].T + (0 if offset is None else offset[:, [i]])
                if spec.k > 1:
                    z = base - base.max(axis=1, keepdims=True)
                    lp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
                    p, yi = np.exp(lp), y.astype(np.int64)
                    loss[i] -= (lp[np.arange(len(y)), yi] * use).sum()
                    d = p.copy()
                    d[np.arange(len(y)), yi] -= 1
                    grad[i] += ((d * use[:, None]).T @ x).ravel()
                    for a in range(spec.k):
                        for b in range(spec.k):
                            h = p[:, a] * ((a == b) - p[:, b]) * use
                            curve[i, a * spec.width : (a + 1) * spec.width, b * spec.width : (b + 1) * spec.width] += x.T @ (x * h[:, None])
                    continue
                s = base[:, 0]
                if spec.grouped:
                    free = names.is_valid().to_numpy(zero_copy_only=False).astype(bool)
                    w = _own(s, y, use, group, len(first), free, spec.task, spec.penalty[i])
                    s = s + w[group]
                    loss[i] += 0.5 * spec.penalty[i] * (w * w).sum()
                g, h = _parts(s, y, spec.task)
                loss[i] += (_loss(s, y, spec.task) * use).sum()
                grad[i] += x.T @ (g * use)
                hx = x * (h * use)[:, None]
                curve[i] += x.T @ hx
                if spec.grouped:
                    d = np.add.reduceat(h * use, first) + spec.penalty[i]
                    b = np.add.reduceat(hx, first, axis=0) * free[:, None] / np.sqrt(d)[:, None]
                    curve[i] -= b.T @ b
        for i in range(m):
            v = np.concatenate([[loss[i]], grad[i], curve[i][upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(np.arange(len(v))), pa.array(v)], schema=_CELLS)

    got = table.mapInArrow(work, "model int, cell long, v double").groupBy("model", "cell").agg(F.sum("v").alias("v")).toArrow()
    all_ = np.zeros((len(spec.theta), 1 + q + len(upper[0])))
    all_[got.column("model").to_numpy(), got.column("cell").to_numpy()] = got.column("v").to_numpy()
    curve = np.zeros((len(spec.theta), q, q))
    for i, c in enumerate(curve):
        c[upper] = all_[i, 1 + q :]
        c.T[upper] = all_[i, 1 + q :]
    return all_[:, 0], all_[:, 1 : 1 + q], curve


def solve(table: DataFrame, spec: Spec) -> float:
    """Set spec.theta to the least penalised loss of each model; the sum of those losses. table: (y, fold, x, c) rows, with g
    (sorted in partitions, a group in one) if spec is grouped, and offset, scores by model that stay as they are."""
    m, k, width = spec.theta.shape
    held = np.ones((k, width))
    held[:, 0] = 0
    held = held.ravel()
    last, total = np.full(m, np.inf), 0.0
    before = spec.theta.copy()
    for _ in range(PASSES):
        loss, grad, curve = _pass(table, spec)
        moved = 0.0
        for i in range(m):
            t = spec.theta[i].ravel()
            loss[i] += 0.5 * spec.penalty[i] * (held * t * t).sum()
            if not np.isfinite(loss[i]) or loss[i] > last[i] + 1e-9 * max(1.0, abs(last[i])):  # too far: half the way
                spec.theta[i] = (spec.theta[i] + before[i]) / 2
                moved = max(moved, float(np.abs(spec.theta[i] - before[i]).max()))
                continue
            last[i] = loss[i]
            g = grad[i] + spec.penalty[i] * held * t
            h = curve[i] + np.diag(spec.penalty[i] * held)
            # intercepts are free. In units of each place's own curvature: with one of a large scale, the others would hardly move
            d = np.sqrt(np.maximum(np.diag(h), 1e-9))
            step = np.linalg.solve(h / np.outer(d, d) + 1e-11 * np.eye(len(h)), g / d) / d
            size = np.abs(step).max()
            step *= min(1.0, 20 / size) if size > 20 and spec.task != "reg" else 1.0
            before[i] = spec.theta[i]
            spec.theta[i] = (t - step).reshape(k, width)
            moved = max(moved, float(abs(step @ g)) / max(1.0, abs(loss[i])))
        total = float(last.sum())
        if moved < 1e-12:
            break
    if k > 1:
        spec.theta[:, :, 0] -= spec.theta[:, :, 0].mean(axis=1, keepdims=True)
    return total


def own_losses(table: DataFrame, spec: Spec) -> float:
    """Mean loss of the rows by the model of their own fold, those with a missing feature left out: squared error, log loss or cross-entropy."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for y, fold, x, *_ in _chunks(batches, spec):
            for i, t in enumerate(spec.theta):
                mine = fold == i
                s, yi = x[mine] @ t.T, y[mine]
                if spec.k > 1:
                    s = s - s.max(axis=1, keepdims=True)
                    p = np.exp(s[np.arange(len(yi)), yi.astype(np.int64)]) / np.exp(s).sum(axis=1)
                    each = -np.log(np.clip(p, 1e-15, 1 - 1e-15))
                elif spec.task == "binary":
                    p = np.clip(_sigmoid(s[:, 0]), 1e-7, 1 - 1e-7)
                    each = -(yi * np.log(p) + (1 - yi) * np.log(1 - p))
                else:
                    each = (yi - s[:, 0]) ** 2
                there = ~np.isnan(each)
                total, n = total + float(each[there].sum()), n + int(there.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["v", "n"])

    row = table.mapInArrow(work, "v double, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    return row.v / row.n if row.n else float("nan")


def group_weights(table: DataFrame, spec: Spec) -> DataFrame:
    """(g, w): the weight of each group's value in each model."""
    schema = pa.schema([("g", pa.string()), ("w", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, fold, x, offset, group, first, names in _chunks(batches, spec):
            free = names.is_valid().to_numpy(zero_copy_only=False).astype(bool)
            ws = [_own(x @ spec.theta[i, 0] + (0 if offset is None else offset[:, i]), y, (fold != i).astype(float), group, len(first), free, spec.task, spec.penalty[i]) for i in range(len(spec.theta))]
            at = np.flatnonzero(free)
            ends = np.arange(len(at) + 1, dtype=np.int32) * len(ws)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(ws).T[at].ravel()))], schema=schema)

    return table.mapInArrow(work, "g string, w array<double>")


def penalties(df: DataFrame, target: str, task: str, n_folds: int, fold: str) -> tuple[int, np.ndarray]:
    """(rows, penalty of each fold's model at the strength 1): 1/(2C) for the log loss, 1/(4C) for squared error, in the
    sum over all rows; a fold's share of them for its model."""
    y = F.col(target).cast("double")
    rows = df.groupBy(F.col(fold).alias("f")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("s2")).collect()
    sums = np.array([[r.n, r.s or 0.0, r.s2 or 0.0] for r in rows]).reshape(-1, 3)
    n = sums[:, 0].sum()
    mine = np.array([sums[[r.f is not None and r.f != i for r in rows]].sum(axis=0) for i in range(n_folds)]).reshape(n_folds, 3)
    if task != "reg":
        return int(n), mine[:, 0] / (2 * max(n, 1))
    sd = np.sqrt(max(sums[:, 2].sum() / max(n, 1) - (sums[:, 1].sum() / max(n, 1)) ** 2, 0)) or 1.0
    own = np.sqrt(np.maximum((mine[:, 2] - mine[:, 1] ** 2 / np.maximum(mine[:, 0], 1)) / np.maximum(mine[:, 0] - 1, 1), 0))
    return int(n), mine[:, 0] * sd / (4 * max(n, 1)) / np.where(own > 0, own, 1.0)
