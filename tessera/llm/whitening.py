"""Embedding whitening: leading principal components by Jacobi-Davidson, without a covariance matrix.

The covariance V is only ever multiplied: a pass over the packed vectors sends every task's sum of
centred products with a few columns. The driver holds the search space, at most WIDTH columns of
the vectors' length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import cut

# Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
#: Components, and residuals relative to the largest eigenvalue that count as double precision.
COMPONENTS, TOLERANCE = 8, 1e-14
#: Columns of the search space per component, inner MINRES steps at most, outer rounds at most.
WIDTH, INNER, OUTER = 6, 10, 200
#: Numbers of a packed block, and sums that the driver adds at a time.
BLOCK, SLOTS = 1 << 20, 64
#: Entries past this, either way, are refused, so that sums of 4 billion vectors stay exact.
MOST = 1 << 31

Multiply = Callable[[np.ndarray], np.ndarray]


def finite(v: Column) -> Column:
    """Not null and without null or non-finite entries."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def packed_vectors(embeddings: DataFrame, size: int) -> DataFrame:
    """Blocks ``(ids, n, x)`` of the usable vectors of length ``size``, x their shifted integers, written once to the shared folder."""
    good = embeddings.where(finite(F.col("v")) & (F.size("v") == size)).select("vec_id", "v")
    most = max(1, BLOCK // max(1, size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                scaled = np.floor(SCALE * np.asarray(part["v"].flatten().to_numpy(zero_copy_only=False), np.float64)) + SHIFT
                if len(scaled) and np.abs(scaled).max() >= MOST:
                    raise ValueError(f"an entry is past {MOST / SCALE:.0f}")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["vec_id"])
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int64()), pa.array([scaled.astype(np.int64).tobytes()], pa.binary())], ["ids", "n", "x"])

    return cut(good.mapInArrow(pack, f"ids array<{dict(good.dtypes)['vec_id']}>, n long, x binary"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, x in zip(batch["ids"], batch["x"], strict=True):
            yield ids.values, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, size)


def summed(packed: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], size: int, dtype: type = np.float64) -> np.ndarray:
    """The sum over all blocks of ``part(x)``. Tasks send one sum each; many tasks' sums are added by others first."""

    def packed_sum(total: np.ndarray) -> pa.RecordBatch:
        slot = TaskContext.get().partitionId() % SLOTS
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "total"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for _, x in _blocks(batches, size):
            total += part(x)
        yield packed_sum(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            for one in batch["total"]:
                total += np.frombuffer(one.as_buffer(), dtype).reshape(shape)
        yield packed_sum(total)

    sums = packed.select("ids", "x").mapInArrow(each, "slot int, total binary")
    if packed.rdd.getNumPartitions() > SLOTS:
        sums = sums.repartition(SLOTS, "slot").mapInArrow(add, "slot int, total binary")
    total = np.zeros(shape, dtype)
    for row in sorted(sums.collect()):
        total += np.frombuffer(row["total"], dtype).reshape(shape)
    return total


def _orthonormal(new: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal columns ``held``; what adds nothing is left out."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
    for _ in range(3):
        for basis in held:
            new = new - basis @ (basis.T @ new)
        left, values, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, values > 1e-10]
    return new


def minres(multiply: Multiply, right: np.ndarray, most: int, tolerance: float) -> np.ndarray:
    """Solutions of symmetric systems, one per column of ``right``, in step: every step multiplies all columns at once.

    Lanczos with Givens rotations; a column stops when its residual has shrunk by ``tolerance``, all
    stop after ``most`` steps.
    """
    count = right.shape[1]
    norm = np.linalg.norm(right, axis=0)
    solution, direction, direction_before, before = (np.zeros_like(right) for _ in range(4))
    vector = right / np.where(norm > 0, norm, 1)
    cos, cos_before, sin, sin_before, beta = np.ones(count), np.ones(count), np.zeros(count), np.zeros(count), np.zeros(count)
    rest, open_ = norm.copy(), norm > 0
    for _ in range(most):
        image = multiply(vector)
        alpha = (vector * image).sum(0)
        image = image - alpha * vector - beta * before
        next_beta = np.linalg.norm(image, axis=0)
        second = cos * cos_before * beta + sin * alpha
        corner = cos * alpha - sin * cos_before * beta
        length = np.hypot(corner, next_beta)
        safe = np.where(length > 0, length, 1)
        direction, direction_before = (vector - sin_before * beta * direction_before - second * direction) / safe, direction
        cos, cos_before, sin, sin_before = corner / safe, cos, next_beta / safe, sin
        solution += np.where(open_, cos * rest, 0) * direction
        rest = -sin * rest
        before, vector, beta = vector, image / np.where(next_beta > 0, next_beta, 1), next_beta
        open_ &= (np.abs(rest) > tolerance * norm) & (next_beta > 1e-13 * np.abs(alpha))
        if not open_.any():
            break
    return solution


def jacobi_davidson(multiply: Multiply, size: int, count: int, tolerance: float = TOLERANCE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric operator, falling, and unit eigenvectors as columns.

    Each round takes the Ritz pairs of the search space, solves the correction equations of all
    pairs that are not yet within ``tolerance`` by MINRES, projected off all wanted Ritz vectors, and
    adds the solutions. Pairs within it are locked: they stay in the space and are solved for no
    more. Full spaces go on from their best Ritz vectors. In the end random columns outside the
    result are sent through the operator a few times; should one show a larger eigenvalue, it joins
    the space and the search goes on.
    """
    random = np.random.default_rng(seed)
    tolerance = tolerance * max(1.0, np.sqrt(size) / 16)
    width = min(size, WIDTH * count)
    space = _orthonormal(random.standard_normal((size, min(size, count + 2))))
    image, looked, best, stalled = multiply(space), False, np.inf, 0
    for done in range(OUTER):
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = space @ turn[:, :count]
        residual = image @ turn[:, :count] - ritz * values[:count]
        top = max(abs(values[0]), 1e-300)
        error = np.linalg.norm(residual, axis=0) / top
        stalled, best = (0, error.max()) if error.max() < best / 2 else (stalled + 1, best)
        todo = np.flatnonzero(error > tolerance)
        if not len(todo) or stalled > 5 and error.max() < 100 * tolerance:  # as far as rounding lets it come
            if space.shape[1] == size or looked:
                return values[:count], ritz
            looked = True
            probe = krylov = _orthonormal(random.standard_normal((size, 2)), ritz)
            for _ in range(6):
                probe = _orthonormal(multiply(probe), ritz, krylov)
                krylov = np.hstack([krylov, probe])
            met = multiply(krylov)
            seen, way = np.linalg.eigh(krylov.T @ met)
            if not len(seen) or seen[-1] <= values[count - 1] * (1 + 1e-12):
                return values[:count], ritz
            new = _orthonormal(krylov @ way[:, -2:], space)
        else:
            shift = values[todo]

            def off(m: np.ndarray, ritz: np.ndarray = ritz) -> np.ndarray:
                return m - ritz @ (ritz.T @ m)

            def corrected(m: np.ndarray, shift: np.ndarray = shift, off: Multiply = off) -> np.ndarray:
                inside = off(m)
                return off(multiply(inside) - inside * shift)

            new = off(minres(corrected, -off(residual[:, todo]), 2 if error.max() > 0.05 else INNER, 1e-3))
        if space.shape[1] + new.shape[1] > width:
            kept = min(space.shape[1], 2 * count)
            space, image = space @ turn[:, :kept], image @ turn[:, :kept]
        new = _orthonormal(new, space)
        if not new.shape[1]:
            new = _orthonormal(random.standard_normal((size, 1)), space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, multiply(new)])
    raise RuntimeError(f"residuals have not settled after {OUTER} rounds: {best:.1e}")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components of ``embeddings(vec_id, embedding)``.

    Vectors that are null or hold null or non-finite entries are left out, as are damaged ones:
    those of another length than most have (of two lengths as frequent, the longer one stays). The
    others' entries become ``x = floor(1024 * entry) + 100000``. Components are unit eigenvectors of
    x's covariance (divisor n, centred before multiplying), by falling eigenvalue, either sign.

    Returns a row for each remaining row and component: vec_id, component (from 1), n, deviation
    (sum over dimensions of (n * x - S)^2, exact; null past 63 bits), whitened ((x - S/n) on the
    component, by the root of its eigenvalue), explained (eigenvalue by trace), identity_error
    (largest absolute entry of whitened's covariance minus the identity) and deviation_exact
    (deviation as decimal). There are at most as many components as dimensions; components without
    variance (equal vectors, linear dependence) are not returned, so vectors that are all equal give
    no row, nor does an empty table. Rows with a repeated or null vec_id each count and are returned
    each. Other columns are ignored. Entries past 2 million are refused.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", F.col("embedding").alias("v"))
    schema = StructType.fromDDL(
        f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    )
    sizes = rows.where(finite(F.col("v"))).groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if found is None or not found["size"]:
        return spark.createDataFrame([], schema)
    size, n = found["size"], found["n"]
    packed = packed_vectors(rows, size)
    if (summed(packed, lambda x: np.abs(x).sum(0, np.float64), (size,), size) > 9e18).any():
        raise ValueError("the sums of these vectors don't fit 63 bits")
    total = summed(packed, lambda x: x.sum(0), (size,), size, np.int64)
    whole = total // n
    over = total - whole * n  # S/n = whole + over/n, over from 0 to n - 1
    rest = over / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - rest

    def multiply(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ columns)

        return summed(packed, part, columns.shape, size) / n

    trace = float(summed(packed, lambda x: np.square(centred(x)).sum(0), (size,), size).sum()) / n
    if not trace:
        return spark.createDataFrame([], schema)
    values, vectors = jacobi_davidson(multiply, size, min(components, size))
    real = values > values[0] * size * 1e-14
    values, vectors = values[real], vectors[:, real]
    count, scaled = len(values), vectors / np.sqrt(values)
    mean = summed(packed, lambda x: (centred(x) @ scaled).sum(0), (count,), size) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ scaled - mean
        return w.T @ w

    identity_error = float(np.abs(summed(packed, spread, (count, count), size) / n - np.eye(count)).max())
    explained = values / trace

    def deviations(x: np.ndarray) -> list[int]:
        inner = x - whole
        far = n * (int(np.abs(inner).max(initial=0)) + 1)
        if size * far * far < 1 << 63:
            return np.square(n * inner - over).sum(1).tolist()
        exact = inner.astype(object) * n - over.astype(object)
        return (exact * exact).sum(1).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, size):
            deviation, w = deviations(x), centred(x) @ scaled
            each = pa.array(np.repeat(np.arange(len(x)), count))
            columns = [
                ids.take(each),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n, np.int64)),
                pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()).take(each),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), identity_error)),
                pa.array([Decimal(d) for d in deviation], pa.decimal128(38, 0)).take(each),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return packed.select("ids", "x").mapInArrow(project, schema)
