"""Whitening by a one-sided Jacobi SVD of centred vectors.

1. Components c become integers x = floor(SCALE * c) + OFFSET. The fit list is each distinct x vector once (a distinct
   aggregation: copies are merged before the shuffle, so a vector that fills a third of the table is one row a task).
2. The number n of the list and its sums S per dimension, in integers.
3. Blockwise TSQR: a task folds the centred rows (n * x - S) / n of its partition, a block at a time, into one
   triangular R; the R of FAN tasks are stacked and factored again, until one is left. R'R = n V, the covariance.
4. One-sided Jacobi: plane rotations make the columns of R orthogonal, two by two, in sweeps; the rotations' product
   holds the components, the columns' lengths over sqrt(n) are their standard deviations. No covariance is formed, so
   small deviations keep their precision.
5. Rows are projected in one pass; the identity error is taken from the whitened fit list.

Scale: the fit list is a table in the shared folder; every task holds one block and R (width ** 2 numbers); R, n and S
are all that reaches the driver, once, which does the rotations. Tables read by later steps survive lost executors.

Defined cases: null vectors and vectors with null or non-finite components are dropped; shorter vectors are filled up
with components of zero; components without deviation (to precision: under 1e-11 of the largest) can't be
whitened and are left out, so an empty table or a single distinct vector gives no rows; repeated rows get rows each; a
null vec_id stays null; further columns are not read. A component beyond LIMIT, or a deviation beyond 64 bits, raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize, ship
from turnengine.llm.vectors import finite, matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Integers up to here are exact as doubles.
LIMIT = 1 << 50
#: Rows of a block, and triangles that one task stacks.
BLOCK, FAN = 4096, 32
#: Columns of R count as orthogonal from this cosine on.
ORTHOGONAL, SWEEPS = 1e-15, 60


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column lengths, product of the rotations): r times the product has orthogonal columns of these lengths, which fall.

    Every sweep rotates all pairs of columns, in rounds of disjoint pairs (a round-robin tournament).
    """
    a = np.array(r, np.float64)
    d = a.shape[1]
    v = np.eye(d)
    seats = [*range(d), *([-1] * (d % 2))]
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(min(p), max(p)) for p in zip(seats[: len(seats) // 2], seats[::-1], strict=False) if min(p) >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(alpha * beta)
            turn = (np.abs(gamma) > ORTHOGONAL * size) & (size > 0)
            worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max(initial=0)))
            if not turn.any():
                continue
            i, j, alpha, beta, gamma = i[turn], j[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for m in (a, v):
                left, right = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * left - s * right, s * left + c * right
        if worst <= 8 * ORTHOGONAL:
            break
    length = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """Of a fit list: its size, sums per dimension, components (columns), their deviations and shares."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of integer rows."""
        return self.n * x - self.sums[None]

    def whitened(self, scaled: np.ndarray) -> np.ndarray:
        """From n * x - S."""
        return (scaled / self.n) @ self.components / self.deviations


def _integers(embeddings: DataFrame) -> DataFrame:
    return embeddings.where(finite(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET)).alias("x"))


def _filled(column: pa.Array, width: int) -> np.ndarray:
    """Integer rows; missing components are those of zero."""
    x = matrix(column, width)
    short = np.diff((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).offsets.to_numpy())
    if (short < width).any():
        x = np.where(np.arange(width)[None] < short[:, None], x, OFFSET)
    return x.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, BLOCK) for batch in batches for at in range(0, batch.num_rows, BLOCK))


def _totals(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, np.int64)
        for block in _blocks(batches):
            x = _filled(block.column(0), width)
            n, sums = n + len(x), sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *sums.tolist()]], pa.list_(pa.int64()))], names=["told"])

    rows = fit.mapInArrow(run, "told array<long>").select(F.posexplode("told").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()  # width + 1 rows
    told = {r["pos"]: r["n"] for r in rows}
    return told.get(0, 0), np.array([told.get(i + 1, 0) for i in range(width)], np.int64)


def _fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")


def _triangle(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, by a tree of factorisations."""
    width = len(sums)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for block in _blocks(batches):
            r = _fold(r, (n * _filled(block.column(0), width) - sums[None]) / n)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["at", "r"])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, at = None, None
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r, at = _fold(r, np.frombuffer(part).reshape(-1, width)), i // FAN
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["at", "r"])

    parts = materialize(fit.mapInArrow(leaf, "at long, r binary"), "whiten-r")
    last = parts.agg(F.max("at").alias("at")).first()["at"]
    tree = parts
    while last > 0:
        tree = tree.groupBy(F.floor(F.col("at") / FAN)).applyInArrow(stack, "at long, r binary")
        last //= FAN
    r = np.frombuffer(tree.first()["r"]).reshape(-1, width)
    drop_materialized(parts)
    return r


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """From a fit list (x) whose longest vector has width components."""
    n, sums = _totals(fit, width)
    length, rotations = jacobi(_triangle(fit, n, sums)) if n else (np.zeros(0), np.zeros((width, 0)))
    keep = min(components, int((length > 1e-11 * length.max(initial=0)).sum()))
    energy = length**2
    return Whitening(n, sums, rotations[:, :keep], length[:keep] / np.sqrt(max(n, 1)), energy[:keep] / max(energy.sum(), 1e-300))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    width, k = len(model.sums), len(model.deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(k + k * k)
        for block in _blocks(batches):
            w = model.whitened(model.centred(_filled(block.column(0), width)))
            told[:k] += w.sum(axis=0)
            told[k:] += (w.T @ w).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([told.tolist()], pa.list_(pa.float64()))], names=["told"])

    rows = fit.mapInArrow(run, "told array<double>").select(F.posexplode("told").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).collect()  # k + k * k rows
    told = np.zeros(k + k * k)
    for r in rows:
        told[r["pos"]] = r["v"] / model.n
    # the rows are centred already; what rounding leaves of the mean is taken off
    return float(np.abs(told[k:].reshape(k, k) - np.outer(told[:k], told[:k]) - np.eye(k)).max(initial=0))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each kept vector and component: vec_id, component (from 1, by falling deviation), n, deviation (of the
    row: sum of (n * x - S) ** 2), whitened, explained (share of the variance), identity_error."""
    ship(embeddings.sparkSession)
    rows = _integers(embeddings)
    seen = rows.agg(F.max(F.size("x")).alias("width"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low")).first()
    if max(seen["high"] or 0, -(seen["low"] or 0)) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} / {SCALE}")
    width = seen["width"] or 0
    if not width:
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    filled = F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x")))
    fit = materialize(rows.select(filled.alias("x")).distinct(), "whiten-fit")
    model = fit_whitening(fit, width, components)
    error = identity_error(fit, model) if model.n else 0.0
    drop_materialized(fit)
    k = len(model.deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            scaled = model.centred(_filled(block.column(1), width))
            if (np.square(scaled.astype(np.float64)).sum(axis=1) > 9.2e18).any():
                raise OverflowError("a deviation is beyond 64 bits")
            n = len(scaled)
            columns = [
                block.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, np.int64)),
                pa.array(np.repeat((scaled * scaled).sum(axis=1), k)), pa.array(model.whitened(scaled).ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return rows.mapInArrow(run, WHITENED)
