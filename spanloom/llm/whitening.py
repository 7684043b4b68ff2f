"""Whitened embeddings, exact distances from the mean, and principal directions.

Entries become integers first (floor(64 c) + 1 000 000), so counts, sums and distances are exact. Fitting:

1. n and the sums per dimension, added up by Spark.
2. Blockwise QR: each task folds blocks of centred rows into one triangle R (d x d); triangles are
   folded again in two steps of fewer tasks, so nobody holds more than two blocks at a time.
3. On the driver, for one R: Householder bidiagonalisation, singular values by shifted differential qd, directions by
   twisted factorisations (``bidiagonal``). Directions have length 1 and are sorted by falling variance; the greatest entry
   is positive.
4. A pass over all rows sums products of whitened values; its distance from the identity is reported.

What is collected or shipped is d or d * d numbers, whatever the number of rows; d is the length
of one embedding.

Rows whose vector is null or holds null, infinite or NaN entries are left out; so are rows whose
length isn't the table's commonest (the least of several) and rows with an entry of 2**40 or more in
size, which exact sums could not hold. Empty vectors have no components. Repeated rows and ids count
each. With no rows left the result is empty. A component without variance (beyond rounding) has a
null whitened value and is left out of the identity check; with no variance at all ``explained`` is null.
A squared distance beyond a long is null. Extra columns don't travel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .batches import prepare
from .bidiagonal import EPS, right_singular

SCALE = 64
SHIFT = 1_000_000
LARGEST = float(1 << 40)
LONG = float(1 << 63)


def scaled(table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x array<long> of the rows whose entries count; ``model`` and ``report`` take those of the commonest length."""
    rows = table.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("c"))
    odd = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    x = F.transform("c", lambda c: F.floor(F.lit(SCALE) * F.when(F.abs(c) < LARGEST, c)) + F.lit(SHIFT))
    return rows.where(F.col("c").isNotNull() & ~odd).select("vec_id", x.alias("x"))


@dataclass(frozen=True)
class Whitening:
    n: int
    d: int
    sums: np.ndarray  # of x, exact
    middle: np.ndarray  # nearest integers to the mean
    directions: np.ndarray  # d x k, divided by the square roots of the variances
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the integer part is taken off exactly."""
        return (x - self.middle) - (self.sums - self.n * self.middle) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2, exact."""
        x = x - self.middle
        rest = self.sums - self.n * self.middle
        most = np.abs(x).max(axis=1, initial=0).astype(float) * self.n + float(np.abs(rest).max(initial=0))
        out: list[int | None] = []
        fits = most * most * max(self.d, 1) < LONG / 2
        quick = ((self.n * x[fits] - rest) ** 2).sum(axis=1).tolist()
        place = iter(quick)
        for row, ok in zip(x, fits):
            if ok:
                out.append(next(place))
            else:
                value = sum((self.n * a - b) ** 2 for a, b in zip(row.tolist(), rest.tolist()))
                out.append(value if value < 1 << 63 else None)
        return out


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _sums(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Commonest length d (the least of several), and number and sums of its rows."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column("x"))
            for d in pc.unique(sizes).to_pylist():
                x = _matrix(batch.filter(pc.equal(sizes, d)), d)
                held.setdefault(d, np.zeros(d + 1, np.int64))
                held[d] += np.append(x.sum(axis=0), len(x))
        for d, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(d + 1)), pa.array(total)], ["d", "at", "value"])

    # a task's sum fits a long; the sum over tasks is taken as a decimal. Only the row of the number has at = d
    parts = rows.select("x").mapInArrow(run, "d long, at long, value long").groupBy("d", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    most = parts.where("at = d").orderBy(F.desc("value"), "d").limit(1).select("d")
    found = {(r.d, r.at): int(r.value) for r in parts.join(most, "d").collect()}
    if not found:
        return 0, 0, np.zeros(0, object)
    d = next(iter(found))[0]
    return d, found[d, d], np.array([found[d, i] for i in range(d)], object)


def _triangle(rows: np.ndarray, d: int) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _fold(blocks, d: int) -> np.ndarray | None:
    r = None
    for block in blocks:
        if len(block):
            r = _triangle(block if r is None else np.vstack([r, block]), d)
    return r


def _factor(rows: DataFrame, d: int, centred) -> np.ndarray:
    """R of all centred rows."""
    kind = "r array<double>"

    def out(r):
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], ["r"])

    def first(batches):
        yield from out(_fold((centred(_matrix(b, d)) for b in batches), d))

    def again(batches):
        yield from out(_fold((b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for b in batches), d))

    some = rows.select("x")
    parts = some.rdd.getNumPartitions()
    found = some.mapInArrow(first, kind)
    if parts > 4:
        found = found.repartition(int(np.ceil(np.sqrt(parts)))).mapInArrow(again, kind)
    last = found.repartition(1).mapInArrow(again, kind).first()
    return np.array(last.r).reshape(d, d)


def _identity_error(rows: DataFrame, fitted: Whitening, used: np.ndarray) -> float:
    """Greatest entry of covariance of the whitened rows minus the identity, over components with variance."""
    d, k = fitted.d, int(used.sum())
    if not k:
        return 0.0

    def run(batches):
        gram, total, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            w = fitted.whitened(_matrix(batch, d))[:, used]
            gram += w.T @ w
            total += w.sum(axis=0)
            n += len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([gram.ravel(), total]))], ["at", "value"])

    found = {r.at: r.value for r in rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    values = np.array([found[i] for i in range(k * k + k)]) / fitted.n
    mean = values[k * k:]
    return float(np.abs(values[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def model(rows: DataFrame, components: int = 32) -> Whitening | None:
    """Fit on all rows of ``scaled``; None if there are none."""
    prepare(rows.sparkSession)
    d, n, sums = _sums(rows)
    if not n:
        return None
    rows = rows.where(F.size("x") == d)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle)], np.int64)
    # sums beyond a long only occur with huge entries; middle and rest stay exact
    exact = rest + n * middle
    k = min(components, d)
    if not d:
        return Whitening(n, 0, exact, middle, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    r = _factor(rows, d, lambda x: (x - middle) - rest / n)
    squares, right = right_singular(r)
    variance, total = squares[:k] / n, float(squares.sum() / n)
    right = right[:, :k] * np.where(np.take_along_axis(right[:, :k], np.abs(right[:, :k]).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    used = variance > (EPS * max(n, d)) ** 2 * squares.max(initial=0.0) / n
    root = np.sqrt(np.where(used, variance, 1.0))
    directions = np.where(used, right / root, np.nan)
    fitted = Whitening(n, d, exact, middle, directions, variance, variance / total if total else np.full(k, np.nan))
    return Whitening(*[getattr(fitted, f) for f in ("n", "d", "sums", "middle", "directions", "variance", "explained")], _identity_error(rows, fitted, used))


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(rows: DataFrame, fitted: Whitening | None) -> DataFrame:
    """One row per vector and component."""
    key = rows.schema["vec_id"].dataType.simpleString()
    if fitted is None or not fitted.d:
        return rows.sparkSession.createDataFrame([], f"vec_id {key}, {SCHEMA}")
    k = fitted.directions.shape[1]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def nulls(values: np.ndarray) -> pa.Array:
        return pa.array(values, mask=np.isnan(values))

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch, fitted.d)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)),
                pa.array(fitted.deviation(x), pa.int64()).take(each), nulls(fitted.whitened(x).ravel()), nulls(np.tile(fitted.explained, m)),
                pa.array(np.full(m * k, fitted.identity_error))], names)

    return rows.where(F.size("x") == fitted.d).mapInArrow(run, f"vec_id {key}, {SCHEMA}")
