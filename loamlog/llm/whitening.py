"""Whitening of embeddings: moments by Welford's updates, merged by pairs, and a QR eigen-solve.

Each partition walks its vectors once and keeps count, mean and the matrix of centred products
by rank-one updates. States of two partitions merge by the parallel update formula, sixteen to a
task in each round, until one is left: d * d numbers, which is all that the driver gets. It
reduces the covariance to a tridiagonal matrix by reflections and finds eigenvalues and vectors
by implicitly shifted QR steps.

Vectors are taken in whole steps of 1 / STEPS, so copies that differ by less are one vector of
the fit list, sums are exact, and a shift of all entries changes no covariance.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import free_name, scratch, staged

#: Steps of an entry to one, and what the contract adds to a step's number.
STEPS, SHIFT = 64, 1_000_000
#: States that a task merges at once.
FAN_IN = 16
#: Entries beyond this have no exact number of steps in a double.
FARTHEST = 2.0**52 / STEPS
#: A variance below this share of the largest is rounding, not variance.
FLAT = 1e-13


@dataclasses.dataclass
class Moments:
    """Count, exact sums, mean and sum of centred outer products of vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, object), np.zeros(d), np.zeros((d, d)))

    def update(self, rows: np.ndarray) -> None:
        """Welford's rank-one update, vector after vector."""
        mean, products = self.mean, self.products
        outer = np.empty_like(products)
        for x in rows:
            self.n += 1
            before = x - mean
            mean += before / self.n
            np.multiply.outer(before, x - mean, out=outer)
            products += outer

    def merge(self, other: Moments) -> Moments:
        """The parallel update formula; the counts' product weighs the two means' distance."""
        if self.n == 0 or other.n == 0:
            return self if other.n == 0 else other
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(
            n, self.sums + other.sums, self.mean + apart * (other.n / n),
            self.products + other.products + np.multiply.outer(apart, apart) * (self.n / n * other.n),
        )

    def covariance(self) -> np.ndarray:
        """Divisor n; made symmetric, as the updates are only up to rounding."""
        return (self.products + self.products.T) / (2 * max(self.n, 1))


STATE = "dim int, part long, n long, sums array<string>, mean binary, products binary"


def state_rows(states: list[tuple[int, int, Moments]]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([d for d, _, _ in states], pa.int32()), pa.array([p for _, p, _ in states], pa.int64()),
            pa.array([m.n for _, _, m in states], pa.int64()), pa.array([[str(s) for s in m.sums] for _, _, m in states], pa.list_(pa.string())),
            pa.array([m.mean.tobytes() for _, _, m in states], pa.binary()), pa.array([m.products.tobytes() for _, _, m in states], pa.binary()),
        ],
        names=["dim", "part", "n", "sums", "mean", "products"],
    )


def state_of(row: dict) -> Moments:
    mean = np.frombuffer(row["mean"], np.float64).copy()
    return Moments(row["n"], np.array([int(s) for s in row["sums"]], object), mean, np.frombuffer(row["products"], np.float64).reshape(len(mean), -1).copy())


def lists(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def merged_moments(vectors: DataFrame, transform=None) -> dict[int, Moments]:
    """Moments of the column ``v`` (lists without nulls) for each length ``dim``.

    ``transform`` maps a matrix of vectors of a length before they are counted; exact sums are
    kept of whole numbers only. What a round shuffles is one state a partition and length.
    """

    def walk(batches):
        held: dict[int, Moments] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = lists(batch.column(1).filter(pa.array(dims == d)))
                exact = [int(s) for s in x.sum(axis=0)] if x.dtype.kind == "i" and np.abs(x).max(initial=0) < 2**40 else None
                y = x.astype(np.float64) if transform is None else transform(d, x.astype(np.float64))
                state = held.setdefault(d, Moments.none(y.shape[1]))
                if transform is None:
                    state.sums = state.sums + np.array(exact if exact is not None else [sum(map(int, c)) for c in x.T], object)
                state.update(y)
        from pyspark import TaskContext

        if held:
            yield state_rows([(d, TaskContext.get().partitionId(), m) for d, m in held.items()])

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        state = state_of(rows[0])
        for row in rows[1:]:
            state = state.merge(state_of(row))
        return pa.Table.from_batches([state_rows([(rows[0]["dim"], rows[0]["part"] // FAN_IN, state)])])

    states = staged(vectors.select("dim", "v").mapInArrow(walk, STATE), "moments")
    last = states.agg(F.max("part")).first()[0]
    while last:
        states = states.groupBy("dim", F.floor(F.col("part") / FAN_IN).alias("meeting")).applyInArrow(merge, STATE)
        last //= FAN_IN
    return {r["dim"]: state_of(r.asDict()) for r in states.collect()}


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and q with a = q t q', by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = math.sqrt(float(v @ v))
        if length == 0 or not np.any(v[1:]):
            continue
        v[0] += math.copysign(length, v[0])
        v /= math.sqrt(float(v @ v))
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit vectors as columns, by implicit QR steps.

    The last entry beside the diagonal goes to zero by chasing a bulge down the tridiagonal
    matrix with plane rotations, shifted by Wilkinson's choice; then the matrix is cut there.
    """
    diagonal, beside, q = tridiagonal(a)
    d, beside = diagonal.tolist(), beside.tolist()
    rows = np.ascontiguousarray(q.T)
    tiny = np.finfo(np.float64).eps
    high = len(d) - 1
    while high > 0:
        for i in range(high):
            if abs(beside[i]) <= tiny * (abs(d[i]) + abs(d[i + 1])):
                beside[i] = 0.0
        if beside[high - 1] == 0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and beside[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        b = beside[high - 1]
        shift = d[high] - b * b / (half + math.copysign(math.hypot(half, b), half))
        x, z = d[low] - shift, beside[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (1.0, 0.0) if r == 0 else (x / r, z / r)
            if k > low:
                beside[k - 1] = r
            p, e, t = d[k], beside[k], d[k + 1]
            d[k] = c * c * p + 2 * c * s * e + s * s * t
            d[k + 1] = s * s * p - 2 * c * s * e + c * c * t
            beside[k] = c * s * (t - p) + (c * c - s * s) * e
            if k < high - 1:
                x, z = beside[k], s * beside[k + 1]
                beside[k + 1] *= c
            upper = c * rows[k] + s * rows[k + 1]
            rows[k + 1] = c * rows[k + 1] - s * rows[k]
            rows[k] = upper
    order = np.argsort(-np.array(d), kind="stable")
    return np.array(d)[order], rows[order].T


@dataclasses.dataclass
class Whitening:
    """What a fit learned of the vectors of one length, in steps without the shift."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def flat(self) -> np.ndarray:
        return ~(self.values > FLAT * max(float(self.values[0]) if len(self.values) else 0.0, 0.0))

    def apply(self, steps: np.ndarray) -> np.ndarray:
        """Projections over the square roots of the variances; NaN along flat directions."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.where(self.flat, np.nan, np.sqrt(np.where(self.flat, 1.0, self.values)))
        return (steps - mean) @ self.vectors / scale

    def deviation(self, steps: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; null where that is more than a long holds."""
        farthest = int(np.abs(steps).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if farthest**2 * len(self.sums) < 2**62:
            off = self.n * steps - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in steps.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def whole_steps(vector: Column) -> Column:
    """The vector in whole steps; null where it is null, empty, or has an entry that is null, not
    finite or beyond the farthest whole step."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < FARTHEST))
    return F.when((F.size(vector) > 0) & good, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(STEPS)))))


def fit(vectors: DataFrame, column: str = "embedding", most: int = 16) -> dict[int, Whitening]:
    """The whitening of each length of vector, fitted on each different vector once.

    ``most`` components are kept. ``error`` is measured: the largest entry of the covariance of
    the whitened fit list less the identity.
    """
    with scratch():
        steps = vectors.select(whole_steps(F.col(column)).alias("v")).where("v IS NOT NULL")
        listed = staged(steps.distinct().select(F.size("v").alias("dim"), "v"), "fit-list")
        out = {}
        for d, m in merged_moments(listed).items():
            v = m.covariance()
            values, axes = symmetric_qr(v)
            out[d] = Whitening(m.n, [int(s) for s in m.sums], values[:most], axes[:, :most], float(np.trace(v)))
        held = vectors.sparkSession.sparkContext.broadcast(out)

        def whitened(d: int, x: np.ndarray) -> np.ndarray:
            return held.value[d].apply(x)[:, ~held.value[d].flat]

        usable = [d for d, w in out.items() if not w.flat.all()]
        if usable:
            for d, m in merged_moments(listed.where(F.col("dim").isin(usable)), whitened).items():
                out[d].error = float(np.abs(m.covariance() - np.eye(len(m.mean))).max())
    return out


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 16, into: str = "whitened") -> DataFrame:
    """The rows that have a usable vector, with ``into``: an array of doubles, one a component,
    null along directions without variance. Other columns stay; one named ``into`` is replaced."""
    fitted = fit(vectors, column, most)
    held = vectors.sparkSession.sparkContext.broadcast(fitted)
    steps = free_name("steps", [*vectors.columns, into])

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        out, sizes = [None] * len(v), v.map(len).to_numpy()
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            found = held.value[d].apply(np.stack(v.iloc[at].to_list()).astype(np.float64))
            for i, row in zip(at.tolist(), found.tolist(), strict=True):
                out[i] = [None if math.isnan(x) else x for x in row]
        return pd.Series(out, dtype=object)

    return vectors.withColumn(steps, whole_steps(F.col(column))).where(F.col(steps).isNotNull()).withColumn(into, project(steps)).drop(steps)


def whitened_components(vectors: DataFrame, column: str = "embedding", most: int = 16) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are null or empty, or hold an entry that is null or not finite, or beyond the
    farthest whole step, are left out. Each different vector is fitted once, repeated rows and
    ids give a row each, a null id stays null. Vectors of another length are fitted among
    themselves. Along a direction without variance (fewer different vectors than dimensions)
    ``whitened`` is null; ``identity_error`` is over the other directions, 0 if there is none.
    ``deviation`` is null where it exceeds a long. An empty table gives an empty result.
    """
    held = vectors.sparkSession.sparkContext.broadcast(fit(vectors, column, most))

    def run(batches):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                model, steps = held.value[d], lists(part.column(1))
                k, n = len(model.values), part.num_rows
                values = model.apply(steps.astype(np.float64)).ravel()
                share = model.values / model.trace if model.trace > 0 else np.zeros(k)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.n, np.int64)), pa.array(model.deviation(steps), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                        pa.array(values, mask=np.isnan(values)), pa.array(np.tile(np.maximum(share, 0.0), n)), pa.array(np.full(n * k, model.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = vectors.select(F.col("vec_id").cast("long"), whole_steps(F.col(column)).alias("v")).where("v IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
