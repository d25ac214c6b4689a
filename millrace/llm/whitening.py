"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, every distinct one is fitted once, and the leading eigenvectors of their covariance are
found from products ``X'XQ`` of the centred rows with a narrow block Q.  Spark runs one job per product; a task adds up
its rows, so a job returns a matrix of the block's size whatever the number of rows, and the full covariance is never built.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, materialise

# Components returned, further directions carried to widen the gap, products per filter, and rounds before it raises.
COMPONENTS, GUARDS, DEGREE, ROUNDS = 4, 12, 8, 100
# Residual, as a share of the largest eigenvalue, at which a component is certified; rounds go on while they still gain.
CERTIFIED, GAIN = 1e-10, 0.5
# Eigenvalues below this share of the largest count as zero: no direction to scale.
NO_SPREAD = 1e-12
SCALE = 256.0
# Bytes of a block of vectors; so many partial sums are added up by one task.
BLOCK_BYTES = 1 << 20
FAN_IN = 64

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LONGS = 2 ** 63


def usable(vector: str) -> Column:
    """True where the vector has entries and all of them are finite numbers."""
    v = col(vector)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))


def whole_numbers(vector: str) -> Column:
    """floor(256 * c) of every entry, as long (the long's limits beyond them)."""
    return F.transform(col(vector), lambda c: F.floor(F.lit(SCALE) * c.cast("double")))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """The arrays of a column as rows of a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """The rows' vectors ``x`` as blocks of about BLOCK_BYTES, a cheap form to read once per product."""
    most = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches):
        for batch in batches:
            x = matrix(batch, "x", dim)
            blocks = [x[i:i + most].astype("<i8").tobytes() for i in range(0, len(x), most)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.binary())})

    return rows.select("x").mapInArrow(pack, "block binary")


def vectors_of(batch: pa.RecordBatch, dim: int):
    """The blocks of a batch as matrices."""
    for block in batch.column("block"):
        yield np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dim)


def add_up(rows: DataFrame, dim: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``part`` (``width`` numbers for a matrix of vectors).

    Every task returns one row; where there are many, tasks add them up in turn before the driver adds the last few.
    """

    def reduce(batches):
        total = np.zeros(width)
        for batch in batches:
            for x in vectors_of(batch, dim):
                total += part(x)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    def merge(batches):
        yield from reduce_sums(batches, width)

    sums, tasks = rows.mapInArrow(reduce, "v array<double>"), rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(merge, "v array<double>")
    return np.sum([r["v"] for r in sums.collect()] or [np.zeros(width)], axis=0)


def reduce_sums(batches, width: int):
    total = np.zeros(width)
    for batch in batches:
        if batch.num_rows:
            total += matrix(batch, "v", width).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension; tasks add whole numbers, Spark adds their decimals."""

    def reduce(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            for x in vectors_of(batch, dim):
                n += len(x)
                small = max(-int(x.min()), int(x.max())) < LONGS // (2 * len(x))
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"d": pa.array(range(dim + 1), pa.int32()),
                                          "s": pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))})

    parts = rows.mapInArrow(reduce, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s"))
    sums = {r["d"]: int(r["s"]) for r in parts.collect()}
    return sums.get(0, 0), [sums.get(d, 0) for d in range(1, dim + 1)]


class FitList:
    """Blocks of distinct vectors of one length: exact sums, and products with their covariance (divisor n)."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim
        self.n, self.sums = exact_sums(rows, dim)
        self.mean = mean = np.array([s / max(self.n, 1) for s in self.sums])
        self.trace = float(self._mean_of(1, lambda x: np.square(x - mean).sum().reshape(1))[0])

    def _mean_of(self, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return add_up(self.rows, self.dim, width, part) / max(self.n, 1)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times the block ``q``: one pass over the centred rows."""
        mean = self.mean

        def part(x):
            x = x - mean
            return (x.T @ (x @ q)).ravel()

        return self._mean_of(q.size, part).reshape(q.shape)

    def whitened_covariance(self, project: np.ndarray) -> np.ndarray:
        """Covariance of the projected rows, from the projections themselves."""
        mean, k = self.mean, project.shape[1]

        def part(x):
            w = (x - mean) @ project
            return (w.T @ w).ravel()

        return self._mean_of(k * k, part).reshape(k, k)


def damp(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, cut: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of the covariance applied to ``q``: small on [0, cut], growing beyond, about 1 at ``top``.

    The three-term recurrence of the polynomials on the interval mapped to [-1, 1], scaled in every step by the
    values at ``top`` so that nothing overflows.
    """
    half = cut / 2
    first = half / (top - half)
    ratio, before = first, q
    now = (times(q) - half * q) * (ratio / half)
    for _ in range(DEGREE - 1):
        next_ratio = 1 / (2 / first - ratio)
        before, now = now, 2 * next_ratio / half * (times(now) - half * now) - ratio * next_ratio * before
        ratio = next_ratio
    return now


def leading_components(fit: FitList, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their eigenvectors (columns) of the covariance.

    A round filters the block, makes it orthonormal (QR) and solves the small problem inside it (Rayleigh-Ritz).
    Components are certified by their residuals |Vq - eq|; rounds end when these no longer shrink, at the floor that
    rounding sets, or at once where the block spans the whole space.  Raises if the floor is above CERTIFIED.
    """
    block, wanted = min(fit.dim, wanted + GUARDS), min(fit.dim, wanted)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((fit.dim, block)))[0]
    best, kept = math.inf, None
    for _ in range(ROUNDS):
        image = fit.times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], 0.0)
        off = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max()
        if off < best or kept is None:
            gained, best, kept = off < GAIN * best, off, (values[:wanted], q[:, :wanted])
        else:
            gained = False
        if top <= 0 or block == fit.dim or (not gained and best <= CERTIFIED * top):
            break
        cut = min(max(values[-1], 1e-6 * top), 0.999 * top)
        q = np.linalg.qr(damp(fit.times, q, cut, top))[0]
    if best > CERTIFIED * max(top, 0.0) + 1e-300 and block < fit.dim:
        raise RuntimeError(f"components not certified: residual {best} of {top}")
    values, vectors = kept
    sound = values > NO_SPREAD * max(values.max(initial=0.0), np.finfo(float).tiny)
    return values[sound], vectors[:, sound]


def _whiten_length(rows: DataFrame, fit_rows: DataFrame, dim: int, wanted: int) -> DataFrame:
    fit = FitList(materialise(packed(fit_rows, dim)), dim)
    values, vectors = leading_components(fit, wanted)
    project, k = vectors / np.sqrt(values), len(values)
    error = float(np.abs(fit.whitened_covariance(project) - np.eye(k)).max()) if k else 0.0
    n, sums, mean = fit.n, fit.sums, fit.mean
    explained = values / fit.trace if k else values

    def deviations(x: np.ndarray) -> pa.Array:
        """Sum of (n*x - S)^2; null where it is beyond a long."""
        most = max([abs(n * v - s) for v in (int(x.min()), int(x.max())) for s in (min(sums), max(sums))])
        if most * most * dim < LONGS and n * max(-int(x.min()), int(x.max())) < LONGS:
            return pa.array(np.square(n * x - np.asarray(sums, np.int64)).sum(axis=1))
        exact = np.square(n * x.astype(object) - np.asarray(sums, object)).sum(axis=1)
        return pa.array([v if v < LONGS else None for v in exact], pa.int64())

    def scale(batches):
        for batch in batches:
            rows_here = batch.num_rows
            if not rows_here or not k:
                continue
            x = matrix(batch, "x", dim)
            at = np.repeat(np.arange(rows_here), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                "n": pa.array(np.full(rows_here * k, n, np.int64)),
                "deviation": deviations(x).take(pa.array(at)),
                "whitened": pa.array(((x - mean) @ project).ravel()),
                "explained": pa.array(np.tile(explained, rows_here)),
                "identity_error": pa.array(np.full(rows_here * k, error))})

    return rows.mapInArrow(scale, OUT)


def whiten_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                      wanted: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable vector on the leading components of the distinct vectors' covariance.

    Returns a row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are left out.  Vectors of different lengths have no
    common covariance, so each length is fitted by itself, with its own n.  Repeated vectors count once in the fit and
    are all returned; a null id stays null.  Components without spread (fewer distinct vectors or dimensions than
    components) are not returned, so one distinct vector alone gives no rows.  Equal eigenvalues leave their components
    free within the plane they span.  ``deviation`` is null where the exact sum is beyond a long; entries whose
    whole number is beyond a long count as the long's limit.  Other columns are ignored.  An empty table gives an empty one.
    """
    rows = materialise(vectors.where(usable(vector_col)).select(
        col(id_col).cast("long").alias("vec_id"), whole_numbers(vector_col).alias("x")))
    # Map-side combine keeps one copy of a repeated vector per task before the shuffle.
    distinct = materialise(rows.select("x").distinct())
    lengths = sorted(r["d"] for r in distinct.select(F.size("x").alias("d")).distinct().collect())
    out = None
    for d in lengths:
        part = _whiten_length(rows.where(F.size("x") == d), distinct.where(F.size("x") == d), d, wanted)
        out = part if out is None else out.unionAll(part)
    return vectors.sparkSession.createDataFrame([], OUT) if out is None else out
