"""Embedding whitening: components by QDWH spectral divide and conquer, applied with a broadcast matrix.

Two passes over the vectors give their count and sums, then the covariance of the centred vectors, as partial
matrices added up in groups of tasks.  The covariance (dimensions squared, whatever the number of rows) is split
on the driver: the polar factor of ``A - shift I`` has the sign of each eigenvalue, so ``(U + I) / 2`` projects on the
invariant subspace above the shift; both subspaces are split in the same way until they are single components.
The leading components go to the tasks as one matrix.  A third pass measures the covariance of what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.session import checkpoint_dir

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0 ** 40          # of an entry's absolute value; larger ones count as this
MAX_DIMENSIONS = 4096        # the covariance is held by the driver: at most 128 MB
SALTS = 32                   # groups of tasks whose partial sums are added up first


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps (QR form)."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps
    eye = np.eye(n)
    for _ in range(12):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4) if low < 1 else 0.0
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * low ** 2) / (1 + wc * low ** 2))
        if 1 - low < 1e-14 and moved < 1e-5 * np.sqrt(n):  # the order is three, so the next step would not move it
            break
    return x


def _basis(p: np.ndarray, k: int) -> np.ndarray:
    """Orthogonal matrix whose first k columns span the range of the rank-k projector ``p`` (pivoted Gram-Schmidt,
    twice, then completed by Householder QR)."""
    left, chosen = p.copy(), []
    for _ in range(k):
        norms = np.einsum("ij,ij->j", left, left)
        v = left[:, int(norms.argmax())].copy()
        for _ in range(2):
            for c in chosen:
                v -= c * (c @ v)
        v /= np.linalg.norm(v)
        chosen.append(v)
        left -= np.outer(v, v @ left)
    q, _ = np.linalg.qr(np.column_stack(chosen), mode="complete")
    return q


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to split at: between the middle entries of the diagonal first, then all over the spectrum's bounds."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(len(a)))
    for parts in (2, 3, 5, 7, 11, 17, 31, 61):
        for i in range(1, parts):
            yield float(diagonal.mean() + spread * (2 * i / parts - 1))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by spectral divide and conquer.

    A block that is a multiple of the identity to rounding is not split: any basis of it will do.
    """
    eps = np.finfo(float).eps
    size = np.linalg.norm(a)
    values, vectors = [], []
    todo = [(np.eye(len(a)), (a + a.T) / 2)]
    while todo:
        basis, block = todo.pop()
        n = len(block)
        rest = block - np.trace(block) / n * np.eye(n)
        if n == 1 or np.linalg.norm(rest) <= 4 * eps * size:
            for k in range(n):
                values.append(float(block[k, k]))
                vectors.append(basis[:, k])
            continue
        best = None
        for shift in _shifts(block):
            moved = block - shift * np.eye(n)
            if not np.linalg.norm(moved):
                continue
            p = (polar(moved) + np.eye(n)) / 2
            k = round(float(np.trace(p)))
            if not 0 < k < n:
                continue
            q = _basis(p, k)
            inner = q.T @ block @ q
            off = np.linalg.norm(inner[:k, k:])
            if best is None or off < best[0]:
                best = (off, q, k, inner)
            if off <= 20 * n * eps * size:
                break
        if best is None:
            raise ArithmeticError("no shift splits the covariance")
        _, q, k, inner = best
        for part in (slice(0, k), slice(k, n)):
            b = inner[part, part]
            todo.append((basis @ q[:, part], (b + b.T) / 2))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.column_stack(vectors)[:, order]


def _entries(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and their entries as whole numbers, a row each (``width``: dimensions, None: of any)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = lengths > 0 if width is None else lengths == width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    keep &= bad[ends] == bad[ends - lengths]
    if width is None:
        return keep, lengths
    flat = flat[np.repeat(keep, lengths)].reshape(-1, width)
    return keep, np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def _vectors(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def _added(partial: DataFrame, dtype) -> np.ndarray:
    """Sum of the tasks' partial matrices ``(part, cells)``, a row of the matrix each: by groups of tasks, then all."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                total = total + np.frombuffer(cells, dtype)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "cells"])

    some = partial.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(SALTS))).groupBy("part", "salt").applyInArrow(add, "part int, cells binary")
    rows = some.groupBy("part").applyInArrow(add, "part int, cells binary").collect()  # a row per dimension
    if not rows:
        return np.zeros((0, 0), dtype)
    return np.array([np.frombuffer(r.cells, dtype) for r in sorted(rows, key=lambda r: r.part)])


def _partial(vectors: DataFrame, width: int, of, dtype) -> np.ndarray:
    """Sum over all batches of the matrix ``of(x)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _entries(batch.column(0), width)[1]
            if len(x):
                here = of(x)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["part", "cells"])
    return _added(vectors.mapInArrow(run, "part int, cells binary"), dtype)


def dimensions(vectors: DataFrame) -> int:
    """The most frequent length of the vectors that count (ties: the greatest), 0 without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lengths = _entries(batch.column(0), None)
            got, n = np.unique(lengths[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(n, pa.int64())], ["d", "n"])
    best = vectors.mapInArrow(run, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return 0 if best is None else best.d


def _distance(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of ``(n x - S)^2`` in whole numbers."""
    most = max(abs(n * int(x.max(initial=0)) - int(sums.min())), abs(n * int(x.min(initial=0)) - int(sums.max())))
    if most and x.shape[1] * most ** 2 < 2 ** 63:
        d = n * x - sums
        return pa.array(np.einsum("ij,ij->i", d, d), pa.int64())
    whole = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([v if v < 2 ** 63 else None for v in whole], pa.int64())


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per vector and leading component.

    Left out are rows whose vector is null, empty, holds null or non-finite entries, or has another length than most
    vectors have.  ``component`` runs from 1 to the number of dimensions at most.  Along a component without
    variance (to rounding) ``whitened`` is null and the identity error leaves it out.  A deviation beyond a long is null.
    Entries beyond 2^40 count as 2^40.  Repeated rows stay and count each; null ids stay.  A table without vectors
    gives no row.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    vectors = rows.select(_vectors(vector).alias("v"))
    out = T.StructType([T.StructField(vec_id, rows.schema[vec_id].dataType)] + [T.StructField(n, t) for n, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    width = dimensions(vectors)
    if width > MAX_DIMENSIONS:
        raise ValueError(f"{width} dimensions, {MAX_DIMENSIONS} at most")
    if not width:
        return spark.createDataFrame([], out)
    first = _partial(vectors, width, lambda x: np.vstack([np.full(width, len(x)), x.sum(0)]), np.int64)
    n, sums = int(first[0, 0]), first[1]
    whole, part = np.divmod(sums, n)
    mean = part / n  # of what is left when the whole part is taken off, so that nothing is rounded away

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - mean

    def products(x: np.ndarray) -> np.ndarray:
        d = centred(x)
        return d.T @ d

    covariance = _partial(vectors, width, products, np.float64) / n
    values, basis = eigen(covariance)
    total = float(np.trace(covariance))
    k = min(components, width)
    live = int((values[:k] > 8 * width * np.finfo(float).eps * total).sum())
    held = spark.sparkContext.broadcast((basis[:, :live] / np.sqrt(values[:live]), whole, mean))  # dimensions x components

    def projected(x: np.ndarray) -> np.ndarray:
        matrix, off, rest = held.value
        return ((x - off) - rest) @ matrix

    def measured(x: np.ndarray) -> np.ndarray:
        w = projected(x)
        return np.vstack([w.sum(0), w.T @ w])

    error = None
    if live:
        got = _partial(vectors, width, measured, np.float64) / n
        error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(live)).max())
    share = [max(float(v), 0.0) / total if total else 0.0 for v in values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                keep, x = _entries(some.column(1), width)
                w = np.full((len(x), k), np.nan)
                w[:, :live] = projected(x)
                ids = some.column(0).filter(pa.array(keep)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                m = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(m, n), pa.int64()),
                    _distance(x, n, sums).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(share, len(x)), pa.float64()), pa.array([error] * m, pa.float64())], out.fieldNames())

    return rows.select(F.col(vec_id).alias("id"), _vectors(vector).alias("v")).mapInArrow(run, out)
