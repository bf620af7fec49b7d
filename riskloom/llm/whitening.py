"""Operator 11: embedding whitening by Jacobi-Davidson.

The leading principal components of all vectors are found without ever forming their
covariance. What the solver needs are products of the covariance with a few vectors at a
time; each is one Spark job that multiplies centred rows in tasks and sums partial results
by dimension. The driver keeps blocks of ``dimensions x MOST_BASIS`` numbers at most.

The solver is a block Jacobi-Davidson: Rayleigh-Ritz in a subspace, projected correction
equations for all pairs that are not done, solved by an inner MINRES whose steps share
their products, and locking of pairs whose residual has reached double precision. A few
guard pairs beyond those wanted are carried along, so that none of the wanted is missed.

Entries become whole numbers, so counts, sums and deviations are exact, and centring
subtracts whole numbers before anything is rounded.

Defined results: rows whose vector is null, or holds null or non-finite entries or such
that 1024 times it is beyond 2^52, give nothing and count for nothing; so do rows whose
vector has another length than most have (of equally frequent lengths the longest
counts) and empty vectors. A row without vec_id counts like any other, and repeated rows
count each time. Components without variance (within rounding) do not exist; one row or
equal rows give an empty result, and so does an empty table. Equal eigenvalues: any
orthonormal vectors of their space. A deviation beyond a 64-bit number is null. Only
``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

COMPONENTS = 8

#: Pairs that are carried along beyond those wanted, and basis vectors before a restart.
GUARDS, MOST_BASIS = 4, 48

#: Steps of the inner MINRES, and rounds of corrections before the solver gives up.
INNER, MOST_ROUNDS = 6, 60

#: Entries are scaled and shifted to whole numbers; larger ones cannot be.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 52)

#: Values in one block of rows.
BLOCK_VALUES = 1 << 17


def minres(product: Callable, shifts: np.ndarray, right: np.ndarray, held: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Columns t with (V - shift) t = right, all orthogonal to ``held``; each step is one product for all columns."""
    project = lambda x: x - held @ (held.T @ x)
    norm = lambda x: np.sqrt((x * x).sum(0))
    v_old, v = np.zeros_like(right), project(right)
    beta = norm(v)
    first = np.where(beta > 0, beta, 1.0)
    v = v / first
    x = w = w_old = np.zeros_like(right)
    eta, beta_now = beta.copy(), np.zeros(len(beta))
    c = c_old = np.ones(len(beta))
    s = s_old = np.zeros(len(beta))
    for _ in range(steps):
        y = project(product(v) - v * shifts)
        alpha = (v * y).sum(0)
        y = project(y - v * alpha - v_old * beta_now)
        beta_next = norm(y)
        delta = c * alpha - c_old * s * beta_now
        rho = np.hypot(delta, beta_next)
        rho_2, rho_3 = s * alpha + c_old * c * beta_now, s_old * beta_now
        safe = np.where(rho > 0, rho, 1.0)
        c_old, s_old, c, s = c, s, delta / safe, beta_next / safe
        w_old, w = w, (v - w_old * rho_3 - w * rho_2) / safe
        x = x + w * (c * eta)
        eta = -s * eta
        v_old, v, beta_now = v, y / np.where(beta_next > 0, beta_next, 1.0), beta_next
        if (np.abs(eta) <= goal * beta).all():
            break
    return x


def orthonormal(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Columns of ``x`` made orthonormal and orthogonal to ``held``; what vanishes is left out."""
    out = held
    for column in x.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            column = column - out @ (out.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10:
            column = column / left
            column = column - out @ (out.T @ column)
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, held.shape[1] :]


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive operator, to double precision.

    ``product`` takes and gives ``size x k`` blocks.
    """
    wanted, carried = min(wanted, size), min(wanted + GUARDS, size)
    most = min(max(MOST_BASIS, 3 * carried), size)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((size, carried)), np.zeros((size, 0)))
    image = product(basis)
    for _ in range(MOST_ROUNDS):
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz, moved = basis @ vectors, image @ vectors
        first = values[:carried]
        residual = moved[:, :carried] - ritz[:, :carried] * first
        left = np.sqrt((residual * residual).sum(0))
        done = left <= 64 * np.finfo(float).eps * max(values[0], np.finfo(float).tiny)
        # guards need only be certain enough to be told from the wanted
        close = done | ((np.arange(carried) >= wanted) & (left <= 1e-2 * values[0]))
        if (done[:wanted].all() and close.all()) or basis.shape[1] >= size:
            return values[:wanted], ritz[:, :wanted] / np.sqrt((ritz[:, :wanted] ** 2).sum(0))
        if basis.shape[1] + carried > most:
            keep = min(2 * carried, most - carried)
            if keep >= carried:
                basis, image = ritz[:, :keep], moved[:, :keep]
        open_ = np.flatnonzero(~close)  # the others are locked: corrections stay orthogonal to them
        correction = minres(product, first[open_], -residual[:, open_], ritz[:, :carried], INNER, 1e-3)
        new = orthonormal(correction, basis)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((size, 1)), basis)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise ArithmeticError("the eigenvectors did not reach double precision")


@dataclass(frozen=True)
class Centre:
    """What the fit list is centred by: rows, and the sum of every dimension as a whole part of the mean and the rest."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, whole numbers, of the rows whose vector has only finite entries."""
    vector = F.col("embedding").cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST)
    kept = embeddings.select(F.col("vec_id").cast("long"), vector.alias("v")).where(F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", fits))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def usual_length(rows: DataFrame) -> int:
    """The length that most vectors have; 0 without vectors."""
    found = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found.size if found else 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of an Arrow list column, one in each row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def centre_of(rows: DataFrame, size: int) -> Centre:
    """Exact count and sums; tasks give one row for each dimension."""
    number = pa.decimal128(38, 0)

    def run(batches):
        n, total = 0, [0] * size
        for batch in batches:
            x = matrix(batch.column(0), size)
            n += len(x)
            # sums of 2^10 numbers below 2^53 stay exact
            for lo in range(0, len(x), 1024):
                total = [a + int(b) for a, b in zip(total, x[lo : lo + 1024].sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total, number)], names=["at", "n", "total"])

    sums = rows.select("x").mapInArrow(run, "at int, n long, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = sorted(sums.collect())  # a row for each dimension
    return Centre(found[0].n, tuple(int(r.total) for r in found))


def centred_blocks(rows: DataFrame, size: int, centre: Centre) -> DataFrame:
    """Blocks of rows, less the whole part of the mean, as bytes: ``wide`` 64-bit numbers or 32-bit ones where these do."""
    whole = centre.whole

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(0), size) - whole
            step = max(1, BLOCK_VALUES // size)
            for lo in range(0, len(x), step):
                part = x[lo : lo + step]
                wide = bool((np.abs(part) > np.iinfo(np.int32).max).any())
                yield pa.RecordBatch.from_arrays([pa.array([wide]), pa.array([part.astype(np.int64 if wide else np.int32).tobytes()], pa.binary())], names=["wide", "block"])

    return rows.select("x").mapInArrow(run, "wide boolean, block binary")


def summed(blocks: DataFrame, size: int, centre: Centre, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all centred rows of what ``part`` makes of a block of them; each task gives ``shape`` numbers."""
    shift, width = centre.rest / centre.n, int(np.prod(shape))

    def run(batches):
        total = None
        for batch in batches:
            for wide, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = np.frombuffer(block.as_buffer(), np.int64 if wide else np.int32).reshape(-1, size) - shift
                own = part(z).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["at", "value"])

    rows = blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # ``width`` rows
    out = np.zeros(width)
    out[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return out.reshape(shape)


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of ``rows`` (x of ``size`` entries); None if there is no variance."""
    centre = centre_of(rows, size)
    blocks = stash(centred_blocks(rows, size, centre)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = centre.n
        trace = float(summed(blocks, size, centre, lambda z: (z * z).sum(), (1,))[0]) / n
        if trace <= 0:
            return None
        product = lambda u: summed(blocks, size, centre, lambda z: z.T @ (z @ u), u.shape) / n
        values, vectors = leading_pairs(product, size, components)
        real = values > size * np.finfo(float).eps * trace
        values, vectors = values[real], vectors[:, real]
        scale = vectors / np.sqrt(values)
        k = len(values)
        mean = summed(blocks, size, centre, lambda z: (z @ scale).sum(0), (k,)) / n

        def squares(z):
            w = z @ scale - mean
            return w.T @ w

        error = summed(blocks, size, centre, squares, (k, k)) / n - np.eye(k)
        return Whitening(centre, values, vectors, values / trace, float(np.abs(error).max()))
    finally:
        blocks.unpersist()


def deviations(delta: np.ndarray, centre: Centre) -> list[int | None]:
    """Sums of (n * x - S)^2 of rows, less the whole part of the mean; None beyond 64 bits."""
    n, rest = centre.n, centre.rest
    most = n * (int(np.abs(delta).max(initial=0)) + 1)
    if most * most * delta.shape[1] < 1 << 63:
        d = n * delta - rest
        return (d * d).sum(1).tolist()
    rest = rest.tolist()
    sums = [sum((n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in delta.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, size: int, found: Whitening) -> DataFrame:
    """A row for each row of ``rows`` (vec_id, x) and component."""
    k, shipped = len(found.values), found

    def run(batches):
        centre, scale = shipped.centre, shipped.projection
        whole, shift = centre.whole, centre.rest / centre.n
        step = max(1, BLOCK_VALUES // size)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = part.num_rows
                delta = matrix(part.column(1), size) - whole
                values = (delta - shift) @ scale
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)),
                    pa.array(deviations(delta, centre), pa.int64()).take(each), pa.array(values.ravel()), pa.array(np.tile(shipped.explained, m)), pa.array(np.full(m * k, shipped.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error."""
    rows = scaled(embeddings)
    size = usual_length(rows)
    rows = rows.where(F.size("x") == size)
    found = fit(rows, size, components) if size else None
    if found is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    return whitened(rows, size, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
