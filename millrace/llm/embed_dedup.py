"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them.

Cells: centroids are fitted on a bounded hash sample of the distinct vectors; every vector lives in the cell of its
nearest centroid. Two vectors of different cells i and j whose difference has the length l lie at distances from the
cells' boundary that add up to that difference's part along c_i - c_j. That part is at most l, and in standard deviation l
times the root of the share that the direction c_i - c_j has in the variance around centroids: measured on the sample,
as the larger of the share over all cells and of one over the number of dimensions that a cell's own vectors fill. So
a vector is also sent as a guest to each cell whose boundary is within half of ``sigmas`` such deviations, or of l if
that is less (l taken at the threshold): then at least one of the two meets the other, for certain where vectors fill
few dimensions (up to sigmas squared). Near pairs may differ along other directions than their cells spread (all by one
shift, say). So the differences of near pairs are measured too: PROBES vectors, picked by hash, are compared with all
others, and the margin of two cells is at least what the found differences need across that boundary.
Pairs that meet twice count in the lower cell.

Dense groups: vectors within half of the threshold's angle of their centroid (the cell's core) are all linked with each
other, and with nothing beyond one and a half times that angle. They are counted, not compared, so that a cell that
holds a third of all vectors costs time in proportion to its size. Everything else is compared by matrix products of
chunks of at most ``chunk`` vectors; a chunk pair returns link counts and the links of a spanning forest, never all
pairs. Equal vectors are one point with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, tune


#: Vectors that are compared with all others to see how near pairs differ; each adds one difference at most.
PROBES = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """k unit centroids of the unit rows of x. A centroid without rows takes the row that its own serves worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, best = np.zeros(len(x), np.int64), np.zeros(len(x))
        for lo in range(0, len(x), 4096):
            s = x[lo : lo + 4096] @ c.T
            near[lo : lo + 4096] = s.argmax(axis=1)
            best[lo : lo + 4096] = s.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        worst = iter(np.argsort(best, kind="stable"))
        for i in np.flatnonzero((size < 1e-9) | (np.bincount(near, minlength=len(c)) == 0)):
            total[i] = x[next(worst)]
            size[i] = np.linalg.norm(total[i])
        c = total / size[:, None]
    return c


def _unit(raw: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), np.float64) for v in raw]


def _points(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """uid, vec_id, key and unit vector (doubles) of each row; key is null for vectors that link with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.string()), ("unit", pa.binary()), ("dim", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keys, units, dims = [], [], []
            for v in b.column(1):
                a = v.values
                x = None
                if a is not None and len(a) and not a.null_count:
                    x = a.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    scale = np.abs(x).max()
                    x = None if not np.isfinite(scale) or scale == 0 else x
                if x is None:
                    keys.append(None), units.append(None), dims.append(None)
                    continue
                keys.append(xxhash.xxh3_128_hexdigest(x.tobytes()))
                x = x / scale
                units.append((x / np.linalg.norm(x)).tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], schema=schema)

    d = df.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>"))
    got = d.mapInArrow(run, "vec_id long, key string, unit binary, dim int")
    return materialize(got.withColumn("uid", F.monotonically_increasing_id()))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, cell_rows: int = 512,
                    max_cells: int = 4096, sample_rows: int = 20_000, sigmas: float = 3.0, chunk: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links: cosine >= threshold in double precision between vectors of one length. Vectors that are null, empty, zero or
    hold a null or a non-finite component link with nothing. Equal vectors link with each other. component_id: the
    smallest vec_id reachable, kept: vec_id = component_id (null ids come last and are kept only if alone in their
    component). The sample bounds what centroids are fitted on; all vectors are assigned and compared.
    """
    tune(df.sparkSession)
    spark = df.sparkSession
    pts = _points(df, vec_id, embedding)
    classes = materialize(pts.where("key is not null").groupBy("key").agg(F.min("uid").alias("node"), F.min("vec_id").alias("low"), F.count("*").alias("m")))
    n = classes.count()
    one = pts.join(classes.select(F.col("node").alias("uid"), "m"), "uid").select(F.col("uid").alias("node"), "m", "dim", "unit", "key")
    cells = _fit(one, n, cell_rows, max_cells, sample_rows)
    steps = _steps(one, n, threshold)
    cells = {dim: (*c, steps.get(dim, np.zeros((0, dim)))) for dim, c in cells.items()}
    shared = spark.sparkContext.broadcast(cells)
    placed = materialize(_place(one, shared, threshold, sigmas))
    found = materialize(_compare(placed, shared, threshold, chunk))
    core = placed.where("core and home = cell")
    ring = core.groupBy("cell").agg(F.sum("m").alias("all"), F.min("node").alias("b"))
    inside = core.join(ring, "cell").select("node", (F.col("all") - F.col("m")).alias("n"), "b")
    links = found.where("b is null").select(F.col("a").alias("node"), "n").unionAll(inside.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("b is not null").select("a", "b").unionAll(inside.select(F.col("node").alias("a"), "b"))
    comp = components(edges)
    named = classes.join(comp.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").join(links, "node", "left")
    named = named.select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = pts.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def spread(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariance of the rows of x around their cell's mean as shares of the whole variance, and for each cell one over the
    number of dimensions that its rows fill (0 where there are too few rows to tell). The mean is inside the sphere, the
    centroid on it: around the centroid, what all rows of a cell share would count as spread along it."""
    near = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
    mean = np.zeros_like(c)
    np.add.at(mean, near, x)
    rest = x - (mean / np.maximum(np.bincount(near, minlength=len(c)), 1)[:, None])[near]
    cov = rest.T @ rest
    few = np.zeros(len(c))
    for i in range(len(c)):
        r = rest[near == i]
        m = len(r)
        if m >= 32:
            g = r @ r.T if m < r.shape[1] else r.T @ r
            few[i] = max(0.0, (g * g).sum() / max(np.trace(g) ** 2, 1e-300) - 1 / (m - 1))
    return cov / max(np.trace(cov), 1e-300), few


def _steps(one: DataFrame, n: int, threshold: float) -> dict[int, np.ndarray]:
    """For each vector length, unit differences of near pairs, one for each probe that has a near vector."""
    if n < 2:
        return {}
    share = min(1.0, 2 * PROBES / n)
    some = one.where(F.conv(F.substring("key", 9, 8), 16, 10).cast("long") < F.lit(int(share * (1 << 32)) + (share == 1.0)))
    rows = some.select("dim", "node", "unit", "key").orderBy(F.reverse("key")).limit(PROBES).collect()
    probes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in rows}:
        mine = [r for r in rows if r.dim == dim]
        probes[dim] = np.array([r.node for r in mine]), np.stack([np.frombuffer(r.unit, np.float64) for r in mine])
    shared = one.sparkSession.sparkContext.broadcast(probes)
    schema = pa.schema([("probe", pa.int64()), ("dim", pa.int32()), ("turn", pa.int64()), ("step", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int, bytes]] = {}
        for b in batches:
            node, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim in np.unique(dims).tolist():
                if dim not in shared.value:
                    continue
                at = np.flatnonzero(dims == dim)
                x = np.stack(_unit(b.column(2).take(pa.array(at))))
                ids, p = shared.value[dim]
                near = (x @ p.T >= threshold) & (node[at][:, None] != ids)
                turn = (node[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
                for j in np.flatnonzero(near.any(axis=0)).tolist():  # one near vector a probe, by hash
                    i = min(np.flatnonzero(near[:, j]).tolist(), key=lambda r: turn[r])
                    d = x[i] - p[j]
                    size = np.linalg.norm(d)
                    if size > 1e-6 and (int(ids[j]) not in best or int(turn[i]) < best[int(ids[j])][1]):
                        best[int(ids[j])] = dim, int(turn[i]), (d / size).tobytes()
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best)), *(pa.array([v[k] for v in best.values()], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)

    found = one.select("node", "dim", "unit").mapInArrow(run, "probe long, dim int, turn long, step binary")
    out: dict[int, list[np.ndarray]] = {}
    for r in found.groupBy("probe", "dim").agg(F.min_by("step", "turn").alias("step")).collect():  # at most PROBES rows
        out.setdefault(r.dim, []).append(np.frombuffer(r.step, np.float64))
    return {dim: np.stack(v) for dim, v in out.items()}


def margins(c: np.ndarray, cov: np.ndarray, few: np.ndarray, threshold: float, sigmas: float, steps: np.ndarray | None = None) -> np.ndarray:
    """For each pair of cells how much nearer its own centroid than the other's a vector may be to be sent there too."""
    q = c @ cov @ c.T
    gap2 = np.maximum(2 - 2 * (c @ c.T), 0)
    share = np.maximum(np.diag(q)[:, None] - 2 * q + np.diag(q)[None, :], 0) / np.maximum(gap2, 1e-12)
    share = np.maximum(share, np.maximum(few[:, None], few[None, :]))
    across = sigmas * np.sqrt(share) * np.sqrt(gap2)
    for p in (c @ steps.T).T if steps is not None else ():
        across = np.maximum(across, np.abs(p[:, None] - p[None, :]))
    return 0.5 * np.sqrt(2 - 2 * threshold) * np.minimum(np.sqrt(gap2), across)


def _fit(one: DataFrame, n: int, cell_rows: int, max_cells: int, sample_rows: int) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length, the number of its first cell, its centroids and the spread around them."""
    share = min(1.0, sample_rows / max(n, 1))
    some = one.where(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") < F.lit(int(share * (1 << 32)) + (share == 1.0))).select("dim", "key", "unit")
    by: dict[int, list[tuple[str, np.ndarray]]] = {}
    for r in some.collect():
        by.setdefault(r.dim, []).append((r.key, np.frombuffer(r.unit, np.float64)))
    out, at = {}, 0
    for dim, rows in sorted(by.items()):
        x = np.stack([v for _, v in sorted(rows, key=lambda r: r[0])])
        k = int(min(max_cells, max(1, len(x) / share // cell_rows), len(x)))
        c = spherical_kmeans(x, k)
        out[dim] = (at, c, *spread(x, c))
        at += k
    return out


def _place(one: DataFrame, shared, threshold: float, sigmas: float) -> DataFrame:
    """A row for each vector in its own cell and in those that it visits. Lengths that the sample lacks are one cell."""
    schema = pa.schema([("cell", pa.int32()), ("home", pa.int32()), ("node", pa.int64()), ("m", pa.int64()), ("core", pa.bool_()), ("seeks", pa.bool_()), ("visits", pa.list_(pa.int32())), ("unit", pa.binary())])
    angle = np.arccos(threshold)
    inner, outer = np.cos(angle / 2), np.cos(1.5 * angle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = {dim: margins(c, cov, few, threshold, sigmas, steps) for dim, (_, c, cov, few, steps) in shared.value.items()}
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                units = b.column(3).take(pa.array(rows))
                x = np.stack(_unit(units))
                node, m = (b.column(i).to_numpy(zero_copy_only=False)[rows] for i in (0, 1))
                if dim not in shared.value:
                    own = pa.array(np.full(len(rows), -dim, np.int32))
                    no = pa.array(np.zeros(len(rows), bool))
                    yield pa.RecordBatch.from_arrays([own, own, pa.array(node), pa.array(m), no, pa.array(np.ones(len(rows), bool)), pa.array([[]] * len(rows), pa.list_(pa.int32())), units], schema=schema)
                    continue
                first, c = shared.value[dim][:2]
                s = x @ c.T
                home = s.argmax(axis=1)
                top = s[np.arange(len(x)), home]
                near = top[:, None] - s <= limits[dim][home] + 1e-9
                near[np.arange(len(x)), home] = True
                r, j = np.nonzero(near)
                visits = [(first + np.flatnonzero(v)).tolist() for v in near]
                core = top[r] >= inner
                is_home = home[r] == j
                seeks = (s[r, j] >= outer) & ~(core & is_home)
                yield pa.RecordBatch.from_arrays([
                    pa.array((first + j).astype(np.int32)), pa.array((first + home[r]).astype(np.int32)), pa.array(node[r]), pa.array(m[r]),
                    pa.array(core & is_home), pa.array(seeks), pa.array([visits[i] for i in r], pa.list_(pa.int32())), units.take(pa.array(r)),
                ], schema=schema)

    return one.select("node", "m", "dim", "unit").mapInArrow(run, "cell int, home int, node long, m long, core boolean, seeks boolean, visits array<int>, unit binary")


def _compare(placed: DataFrame, shared, threshold: float, chunk: int) -> DataFrame:
    """(a, null, n): a has links worth n; (a, b, 0): a link of a chunk pair's spanning forest."""
    stats = placed.groupBy("cell").agg(
        F.sum(F.when(F.col("home") == F.col("cell"), F.when(F.col("core"), 0).otherwise(1))).alias("plain"),
        F.sum(F.col("core").cast("int")).alias("cores"),
        F.sum((F.col("home") != F.col("cell")).cast("int")).alias("guests"),
        F.sum(F.col("seeks").cast("int")).alias("seek"),
    )
    stats = stats.withColumn("residents", F.coalesce("plain", F.lit(0)) + F.when(F.col("seek") > 0, F.col("cores")).otherwise(0))
    stats = stats.select("cell", "seek", F.ceil(F.col("residents") / chunk).cast("int").alias("rs"), F.ceil(F.col("guests") / chunk).cast("int").alias("gs"))
    x = placed.join(stats, "cell").where("rs > 0 and (not core or seek > 0)")
    guest = F.col("home") != F.col("cell")
    place = lambda k: F.pmod(F.xxhash64("node"), k.cast("long")).cast("int")
    own = F.when(guest, F.col("rs") + place(F.greatest("gs", F.lit(1)))).otherwise(place(F.col("rs")))
    x = x.withColumn("own", own)
    others = F.when(guest, F.sequence(F.lit(0), F.col("rs") - 1)).otherwise(F.sequence(F.lit(0), F.col("rs") + F.col("gs") - 1))
    x = x.withColumn("other", F.explode(others))
    x = x.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "home", "node", "m", "core", "visits", "unit")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        current = None

        def close() -> Iterator[pa.RecordBatch]:
            cell, lo, hi = current
            left = [r for r in held if r[3] == lo]
            right = left if lo == hi else [r for r in held if r[3] == hi]
            if not left or not right:
                return
            a, b = (np.stack([np.frombuffer(r[9], np.float64) for r in side]) for side in (left, right))
            ok = a @ b.T >= threshold
            ok &= ~(np.array([r[7] for r in left])[:, None] & np.array([r[7] for r in right])[None, :])
            if lo == hi:
                ok = np.triu(ok, 1)
            homes = np.array([r[4] for r in right])
            for home in np.unique(homes[homes != cell]).tolist():
                if home < cell:  # pairs that meet in the guest's own cell too are counted there
                    both = np.array([home in r[8] for r in left])
                    ok[np.ix_(both, homes == home)] = False
            p, q = np.nonzero(ok)
            if not len(p):
                return
            ids, w = [np.array([r[5] for r in side]) for side in (left, right)], [np.array([r[6] for r in side]) for side in (left, right)]
            n = [np.bincount(p, w[1][q], len(left)), np.bincount(q, w[0][p], len(right))]
            parent: dict[int, int] = {}

            def root(v: int) -> int:
                while parent.setdefault(v, v) != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            tree = []
            for u, v in zip(ids[0][p].tolist(), ids[1][q].tolist()):
                x, y = root(u), root(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    tree.append((u, v))
            for side in (0, 1):
                got = np.flatnonzero(n[side])
                yield pa.RecordBatch.from_arrays([pa.array(ids[side][got]), pa.nulls(len(got), pa.int64()), pa.array(n[side][got].astype(np.int64))], schema=schema)
            if tree:
                yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in tree]), pa.array([t[1] for t in tree]), pa.array([0] * len(tree))], schema=schema)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:3] != current:
                    if held:
                        yield from close()
                    held, current = [], r[:3]
                held.append(r)
        if held:
            yield from close()

    return x.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "node").mapInArrow(run, "a long, b long, n long")
