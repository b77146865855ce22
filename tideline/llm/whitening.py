"""Embedding whitening by polarisation covariance.

The covariance of two dimensions is had from variances alone: Var(i + j) - Var(i) - Var(j) = 2 Cov(i, j). Entries are
whole numbers, so the squares of centred values add up exactly, for every dimension and for every sum of two, in
whatever order tasks finish. The sums (a few thousand whole numbers, fixed by the dimension) are all the driver sees.
It takes the differences, still exactly, and hands the covariance to ``eigh``. Every vector is then projected where
it lies.

Centring is exact too. With n vectors and a sum S of a dimension, let m = floor(S / n) and r = S - n m. Tasks add up
squares of z = x - m, which stay small, and n x - S = n z - r turns them into the squares of n x - S.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType

from tideline.llm.common import saved

#: A unit is cut into so many steps, and steps are counted from here.
STEPS, OFFSET = 64, 1_000_000
#: Components that are kept.
COMPONENTS = 32
#: Entries are whole numbers below this, so that they are exact in a double; a vector beyond is dropped as not finite.
LARGEST = float(1 << 52)
#: Components whose share of the variance is lower are rounding noise of ``eigh``: they have no direction.
NO_VARIANCE = 1e-13
WIDE = 1 << 62


def quantised(vector: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that remain of an Arrow column of number lists, their lengths, and their entries as whole numbers, end to end.

    A row remains if it is not null, holds neither null nor non-finite entries nor any of 2^52 steps or more, and has
    ``length`` entries where that is given.
    """
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vector), -1), np.int64)
    flat = vector.flatten()
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        steps = np.floor(c * STEPS)
        bad = ~(np.abs(steps) < LARGEST)
    remains = sizes >= 0
    remains[owner[bad]] = False
    if length is not None:
        remains &= sizes == length
    return np.flatnonzero(remains), sizes[remains], steps[remains[owner]].astype(np.int64) + OFFSET


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors: how many there are, and the sum of each dimension."""
    found: dict[int, list] = {}
    for b in batches:
        _, sizes, entries = quantised(b.column(0))
        for size in np.unique(sizes):
            same = sizes == size
            x = entries[np.repeat(same, sizes)].reshape(int(same.sum()), size)
            n, total = found.get(int(size), (0, [0] * int(size)))
            high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
            found[int(size)] = (n + len(x), [t + (int(h) << 26) + int(v) for t, h, v in zip(total, high, low, strict=True)])
    rows = [(size, i, n, Decimal(t)) for size, (n, total) in found.items() for i, t in enumerate([0, *total], start=-1)]
    yield _rows(rows, [("size", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def squares(z: np.ndarray) -> list[np.ndarray]:
    """For each dimension i: sums over rows of z_i squared, then of (z_i + z_j) squared for every j > i. Exact."""
    reach = 2 * int(np.abs(z).max(initial=0))
    if reach * reach * max(1, len(z)) >= WIDE:
        z = z.astype(object)
    columns = np.ascontiguousarray(z.T)
    out = []
    for i in range(len(columns)):
        pairs = columns[i + 1:] + columns[i]
        out.append(np.concatenate([[(columns[i] * columns[i]).sum()], (pairs * pairs).sum(axis=1)]))
    return out


@dataclass(frozen=True)
class Whitening:
    """Components of a covariance, ready to be sent to tasks."""

    n: int
    #: m and r of each dimension.
    floors: np.ndarray
    rests: np.ndarray
    #: dimension x components
    directions: np.ndarray
    #: Variance along each component, and its share of all variance.
    variances: np.ndarray
    shares: np.ndarray

    def whitened(self, z: np.ndarray) -> np.ndarray:
        """Rows in white coordinates; NaN along components without variance."""
        scale = np.where(self.shares > NO_VARIANCE, np.sqrt(np.maximum(self.variances, 0)), np.nan)
        return (z - self.rests / max(1, self.n)) @ self.directions / scale

    def deviations(self, z: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exactly."""
        reach = self.n * int(np.abs(z).max(initial=0)) + int(np.abs(self.rests).max(initial=0))
        if reach * reach * max(1, z.shape[1]) >= WIDE:
            z = z.astype(object)
        y = z * self.n - self.rests
        return [int(v) for v in (y * y).sum(axis=1)]


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Counts, sums and squares of all remaining vectors, and the components of their covariance.

    Vectors of another length than most (of equally common lengths the longest) are no part of the table and are dropped.
    """
    found = embeddings.select(F.col(vector).cast("array<double>").alias("v"))
    counted = saved(found.mapInArrow(_totals, "size int, dim int, n long, total decimal(38,0)"), "embedding-totals")
    lengths = counted.filter("dim = -1").groupBy("size").agg(F.sum("n").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return Whitening(0, *[np.zeros(0, np.int64)] * 2, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    n, size = int(most["n"]), int(most["size"])
    sums = counted.filter((F.col("size") == size) & (F.col("dim") >= 0)).groupBy("dim").agg(F.sum("total").alias("total"))
    totals = {int(r["dim"]): int(r["total"]) for r in sums.collect()}
    parts = [divmod(totals[i], n) for i in range(size)]
    floors, rests = (np.array([p[k] for p in parts], np.int64) for k in (0, 1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for b in batches:
            _, sizes, entries = quantised(b.column(0), size)
            if len(sizes):
                part = squares(entries.reshape(len(sizes), size) - floors)
                total = [t + p.astype(object) for t, p in zip(total, part, strict=True)] if total else [p.astype(object) for p in part]
        rows = [(i, k, Decimal(int(v))) for i, line in enumerate(total or []) for k, v in enumerate(line)]
        yield _rows(rows, [("dim", pa.int32()), ("past", pa.int32()), ("total", pa.decimal128(38, 0))])

    added = found.mapInArrow(partial, "dim int, past int, total decimal(38,0)").groupBy("dim", "past").agg(F.sum("total").alias("total"))
    raw = {(int(r["dim"]), int(r["past"])): int(r["total"]) for r in added.collect()}
    return _components(n, floors, rests, covariance(n, [int(r) for r in rests], raw), components)


def covariance(n: int, rests: list[int], raw: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance (divisor n) from sums of squares; ``raw`` has them by dimension and distance to the other one, 0 for none.

    Each square sum is turned into that of n x - S, the difference is taken among whole numbers, and each entry is rounded
    to a double once.
    """
    size = len(rests)
    variance = [n * raw[i, 0] - rests[i] ** 2 for i in range(size)]
    out = np.empty((size, size))
    for i in range(size):
        out[i, i] = variance[i] / (n * n)
        for j in range(i + 1, size):
            both = n * raw[i, j - i] - (rests[i] + rests[j]) ** 2
            out[i, j] = out[j, i] = (both - variance[i] - variance[j]) / (2 * n * n)
    return out


def _components(n: int, floors: np.ndarray, rests: np.ndarray, cov: np.ndarray, components: int) -> Whitening:
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values, kind="stable")[::-1][:components]
    trace = float(np.trace(cov))
    shares = np.maximum(values[order], 0) / trace if trace > 0 else np.zeros(len(order))
    return Whitening(n, floors, rests, vectors[:, order], values[order], shares)


def whiten(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The columns beside ``vector``, with ``deviation decimal(38,0)`` and ``whitened array<double>`` for each remaining vector.

    Columns of these two names are replaced. ``whitened`` is null along components without variance.
    """
    rest = embeddings.drop("deviation", "whitened")
    others = [c for c in rest.columns if c != vector]
    rows = rest.select(*others, F.col(vector).cast("array<double>").alias(vector))
    schema = rows.drop(vector).schema.add("deviation", DecimalType(38, 0)).add("whitened", ArrayType(DoubleType()))
    size = len(model.floors)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, entries = quantised(b.column(len(others)), size)
            if not len(sizes) or not model.n:
                continue
            z = entries.reshape(len(sizes), size) - model.floors
            white = np.where(np.isnan(w := model.whitened(z)), None, w) if (model.shares <= NO_VARIANCE).any() else model.whitened(z)
            columns = [b.column(k).take(pa.array(kept)) for k in range(len(others))]
            columns.append(pa.array([Decimal(v) for v in model.deviations(z)], pa.decimal128(38, 0)))
            columns.append(pa.array(list(white), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, [*others, "deviation", "whitened"])

    return rows.mapInArrow(projected, schema)


def identity_error(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors, taken anew from them, minus the identity.

    Only components with variance count; 0 if there are none.
    """
    live = np.flatnonzero(model.shares > NO_VARIANCE)
    if not len(live):
        return 0.0
    size = len(model.floors)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live) + 1, len(live)))
        for b in batches:
            _, sizes, entries = quantised(b.column(0), size)
            if len(sizes):
                w = model.whitened(entries.reshape(len(sizes), size) - model.floors)[:, live]
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    rows = embeddings.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(products, "i int, j int, v double")
    total = np.zeros((len(live) + 1, len(live)))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[-1] / model.n
    return float(np.abs(total[:-1] / model.n - np.outer(mean, mean) - np.eye(len(live))).max())


def whiten_embeddings(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, hold null, NaN or infinite entries (or some of 2^52 steps or more), or are not as long as most
    are dropped; repeated rows and ids each count and come out. Empty vectors have no components, so they give no rows,
    as does an empty table. Along a component without variance ``whitened`` is null and ``explained`` 0 (all of them, where
    all vectors are equal). ``deviation`` is null where it exceeds a long; ``whiten`` has it as a decimal. Other columns are
    not read.
    """
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    model = fit(rows, "vector", components)
    error = identity_error(rows, model, "vector")
    shares = F.array(*(F.lit(float(s)) for s in model.shares)).cast("array<double>")
    return (
        whiten(rows, model, "vector")
        .select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
