"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes.

Entries c become whole numbers x = floor(64 c) + 1000000, so that counts, sums and each row's deviation are exact. A pass
computes V Q for the covariance V of x and a few columns Q: every task centres its rows (x minus the whole part of the mean,
exactly, then the rest), multiplies them by Q and back by their transpose, and a fixed number of slots adds up what the
tasks return, so that the driver gets matrices of (dimension x columns) only and V itself is never formed. A few Lanczos
passes bound the spectrum. Each iteration then runs the block through a Chebyshev polynomial of V that stays small between
the lower bound and the block's least Ritz value and grows beyond it, orthonormalises by QR and takes Ritz pairs of one
more pass. It ends when every wanted pair's residual is at rounding level, and when a second run of the filter, in which fresh
random columns have taken the guard columns' place, finds no other values. A last pass over all rows measures how far the
whitened rows' covariance is from the identity.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out; vectors of each length are a fit list
of their own, with its own n, mean and components; components without variance (rows that are all equal, fewer rows than
components) give no rows, nor does an empty vector; entries beyond +-2**46 count as that; a deviation beyond a long is null; repeated rows count as
often as they stand there; a null vec_id stays null; an empty table gives no rows; extra columns are ignored. Where
eigenvalues are equal, their components are any orthonormal set of the common space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import materialize, table

#: Components returned; columns of the block beyond them; passes of a filter; Lanczos passes for the bounds; iterations, at most.
COMPONENTS, GUARD, DEGREE, BOUND_PASSES, ITERATIONS = 32, 16, 10, 12, 60
#: Rows that a task centres at a time; matrices that the driver adds up; largest entry as a whole number.
ROWS, SLOTS, LARGEST = 1024, 16, 1 << 52
#: Residual, as a share of the largest eigenvalue, at which a pair is certified, and below which one that stays is.
CERTIFIED, SETTLED = 1e-13, 1e-11
#: Share of the largest eigenvalue below which a component has no variance.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Centre:
    """The exact mean of n rows: whole + rest / n in every dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        off = x - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if off.shape[1] * most * most < 1 << 63:
            return ((self.n * off - self.rest) ** 2).sum(1).tolist()
        rows = (sum((self.n * a - b) ** 2 for a, b in zip(r, self.rest.tolist())) for r in off.tolist())
        return [d if d < 1 << 63 else None for d in rows]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            yield np.asarray(part.column("x").flatten()).reshape(part.num_rows, -1)


def summed(rows: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of of_block over all blocks of rows: one matrix a task, added up in SLOTS groups, then by the driver."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _blocks(batches):
            total += of_block(x)
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at % SLOTS], pa.int32()), pa.array([at], pa.int32()), pa.array([total.tobytes()])], names=["slot", "task", "m"])

    def add(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group, [("task", "ascending")])
        total = np.zeros(shape)
        for m in group.take(order).column("m").to_pylist():
            total += np.frombuffer(m).reshape(shape)
        return pa.table({"slot": pa.array([group.column("slot")[0].as_py()], pa.int32()), "m": pa.array([total.tobytes()])})

    found = rows.select("x").mapInArrow(task, "slot int, task int, m binary").groupBy("slot").applyInArrow(add, "slot int, m binary").collect()
    total = np.zeros(shape)
    for r in sorted(found, key=lambda r: r.slot):
        total += np.frombuffer(bytes(r.m)).reshape(shape)
    return total


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows whose vector has only finite entries."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    base = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.coalesce(~bad, F.lit(False)))

    def x_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("v")
            x = np.clip(np.floor(64 * np.asarray(c.flatten())), -LARGEST, LARGEST).astype(np.int64) + 1000000
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(c)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["id", "x"])

    return base.mapInArrow(x_of, f"id {base.schema['id'].dataType.simpleString()}, x array<long>")


def centres(points: DataFrame) -> dict[int, Centre]:
    """Counts and exact sums of each length; partial sums in halves of 26 bits, so that none overflows."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.asarray(pa.compute.list_value_length(b.column("x")))
            for dim in np.unique(length[length > 0]):
                own = b.take(pa.array(np.flatnonzero(length == dim)))
                x = np.asarray(own.column("x").flatten()).reshape(own.num_rows, -1)
                columns = [np.full(dim, dim), np.arange(dim), np.full(dim, own.num_rows), (x >> 26).sum(0), (x & (1 << 26) - 1).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["dim", "pos", "n", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = points.select("x").mapInArrow(task, "dim long, pos long, n long, high long, low long").groupBy("dim", "pos").agg(F.sum("n").alias("n"), total("high"), total("low")).collect()
    out = {}
    for dim in sorted({r.dim for r in rows}):
        own = sorted((r for r in rows if r.dim == dim), key=lambda r: r.pos)
        split = [divmod((int(r.high) << 26) + int(r.low), r.n) for r in own]
        out[dim] = Centre(own[0].n, np.array([w for w, _ in split], np.int64), np.array([r for _, r in split], np.int64))
    return out


def spectrum_bounds(apply: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator) -> tuple[float, float]:
    """A lower and an upper bound of the eigenvalues, by a few Lanczos passes and their last residual."""
    q = rng.standard_normal(d)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(d, BOUND_PASSES)):
        w = apply(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            for b in basis:
                w = w - (w @ b) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    inner = beta[: len(alpha) - 1]
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(inner, 1) + np.diag(inner, -1))
    return max(0.0, float(ritz[0]) - beta[-1]), float(ritz[-1]) + beta[-1]


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, cut: float, high: float, degree: int = DEGREE) -> np.ndarray:
    """The scaled Chebyshev polynomial of V times q: at most 1 on [low, cut] as against 1 at high."""
    mid, half = (cut + low) / 2, max((cut - low) / 2, 1e-12 * high)
    first = sigma = half / max(high - mid, half)
    x, y = q, (apply(q) - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        x, y = y, (apply(y) - mid * y) * (2 * after / half) - (sigma * after) * x
        sigma = after
    return y


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors (d x k); apply gives V times a block of columns."""
    rng = np.random.default_rng(seed)
    k, m = min(d, k), min(d, k + GUARD)
    low, high = (0.0, 0.0) if m == d else spectrum_bounds(apply, d, rng)

    def ritz(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        q = np.linalg.qr(block)[0]
        y = apply(q)
        g = q.T @ y
        values, u = np.linalg.eigh((g + g.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        miss = np.linalg.norm(y @ u[:, :k] - (q @ u[:, :k]) * values[:k], axis=0).max()
        return values, q @ u, float(miss / max(values[0], 1e-300))

    values, q, miss = ritz(rng.standard_normal((d, m)))
    if m == d or values[0] <= 0:
        return values[:k], q[:, :k]
    witness = None
    for _ in range(ITERATIONS):
        before = miss
        values, q, miss = ritz(chebyshev(apply, q, min(low, values[-1]), values[-1], max(high, values[0])))
        if miss <= CERTIFIED or (miss <= SETTLED and miss > before / 2):
            if witness is not None and np.abs(values[:k] - witness).max() <= SETTLED * values[0]:
                return values[:k], q[:, :k]
            witness = values[:k].copy()
            q = np.concatenate([q[:, :k], rng.standard_normal((d, m - k))], 1)
            values[-1] = min(values[-1], values[k - 1])
    raise RuntimeError(f"the components did not settle: residual {miss:.1e} of the largest eigenvalue")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for every vector and component."""
    points = materialize(whole_numbers(vectors, id_col, vec_col), "whole")
    kind = points.schema["id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = points.sparkSession.createDataFrame([], schema)
    # Lengths are few; each has its own fit list.
    for d, centre in centres(points).items():
        own = points.where(F.size("x") == d)

        def covariance_times(q: np.ndarray, own: DataFrame = own, centre: Centre = centre) -> np.ndarray:
            def of(x: np.ndarray) -> np.ndarray:
                c = centre.of(x)
                return c.T @ (c @ q)

            return summed(own, of, q.shape) / centre.n

        trace = float(summed(own, lambda x, centre=centre: np.array([[(centre.of(x) ** 2).sum()]]), (1, 1))[0, 0]) / centre.n
        if not trace > 0:
            continue
        values, q = leading_pairs(covariance_times, d, components)
        held = values > NO_VARIANCE * values[0]
        values, q = values[held], q[:, held]
        q = q * np.where(q[np.abs(q).argmax(0), np.arange(q.shape[1])] < 0, -1, 1)
        scale, k = q / np.sqrt(values), len(values)

        def squares(x: np.ndarray, centre: Centre = centre, scale: np.ndarray = scale) -> np.ndarray:
            w = centre.of(x) @ scale
            return w.T @ w

        error = float(np.abs(summed(own, squares, (k, k)) / centre.n - np.eye(k)).max())

        def project(batches: Iterable[pa.RecordBatch], centre: Centre = centre, scale: np.ndarray = scale, share: np.ndarray = values / trace, error: float = error, k: int = k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    x = next(_blocks([part]))
                    rows = np.repeat(np.arange(len(x)), k)
                    columns = [part.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), centre.n)), pa.array(centre.deviation(x), pa.int64()).take(pa.array(rows)), pa.array((centre.of(x) @ scale).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(rows), error))]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        out = out.union(own.mapInArrow(project, schema))
    return out


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_chebyshev_whitening": op12_chebyshev_whitening}
ORACLES: dict[str, str] = {}
