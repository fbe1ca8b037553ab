"""Embedding whitening: compensated covariance, eigenvectors by divide and conquer, projection to unit variance.

Sums and centred outer products are kept as pairs of doubles, high and low, by error-free transformations (Knuth's sum, Dekker's
product), so about 106 bits hold however large the offset or the number of rows. A task passes over its rows once, centres each row by
the mean, itself a pair, before it multiplies, and gives one pair of arrays for each matrix row; pairs are merged high and low, at most
``FAN`` tasks at a time, in as many rounds as it takes. The driver gets one matrix, of the vectors' width squared.

The eigenproblem is solved there by ``numpy.linalg.eigh``, which is LAPACK's ``syevd``: reduction to tridiagonal form, then Cuppen's
divide and conquer. Two steps of Ogita and Aishima's refinement against both parts of the matrix follow, in extended precision.

Nulls and edges: vectors that are null or hold null or non-finite components take no part; components missing in shorter vectors count
0 before scaling; integers beyond ``LARGEST`` are held at it; a repeated row counts as often as it is there; a component without
variance (equal vectors, a single row) has whitened and explained 0, which leaves 1 in the identity's error; vectors of fewer components
give fewer; a deviation beyond a long is null; an empty table gives no row; other columns are ignored. Equal eigenvalues leave the
choice of their vectors open, as in any method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.llm.codes import scaled, widest
from presswork.llm.common import table
from presswork.llm.topk import usable
from presswork.session import checkpoint

SCALE, SHIFT, LARGEST, COMPONENTS = 1024, 100_000, 1 << 30, 8
#: Partial matrices that one merge takes.
FAN = 64
#: Products that a step of the accumulation holds.
LANES = 1 << 14
PARTIAL = "row int, task int, high array<double>, low array<double>"
Pair = tuple[np.ndarray, np.ndarray]


# --- pairs of doubles ---------------------------------------------------------------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: np.ndarray) -> Pair:
    """Two halves of 26 bits."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


def added_up(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum over the first axis, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        odd = high[2 * half :], low[2 * half :]
        high, low = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = np.concatenate([high, odd[0]]), np.concatenate([low, odd[1]])
    return (high[0], low[0]) if len(high) else (np.zeros(high.shape[1:]), np.zeros(high.shape[1:]))


# --- sums over all rows -------------------------------------------------------------------------------------------------


def floats(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, missing components 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def merged(rows: DataFrame, per_task: Callable[[Iterator[pa.RecordBatch]], list[Pair]]) -> list[Pair]:
    """What ``per_task`` gives for the batches of each task, a list of pairs, added up over all tasks in the order of their numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        found = per_task(batches)
        columns = [pa.array(range(len(found)), pa.int32()), pa.array([task] * len(found), pa.int32())]
        columns += [pa.array([pair[k].tolist() for pair in found], pa.list_(pa.float64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "task", "high", "low"])

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        high, low = added_up(*(np.array(t[k].to_pylist(), dtype=np.float64) for k in ("high", "low")))
        one = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
        return pa.table({"row": t["row"].slice(0, 1), "task": pa.array([t["task"][0].as_py() // FAN], pa.int32()), "high": one(high), "low": one(low)})

    parts = checkpoint(rows.select("v").mapInArrow(partial, PARTIAL))
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("row", F.floor(F.col("task") / FAN)).applyInArrow(combine, PARTIAL)
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
    return [(np.array(r.high), np.array(r.low)) for r in sorted(parts.collect(), key=lambda r: r.row)]


def moments(rows: DataFrame, width: int) -> tuple[int, list[Fraction]]:
    """Number of rows and the sum of each component: exact for integers, else of twice a double's precision."""

    def sums(batches: Iterator[pa.RecordBatch]) -> list[Pair]:
        total = np.zeros(width + 1), np.zeros(width + 1)
        for batch in batches:
            x = np.column_stack([floats(batch["v"], width), np.ones(batch.num_rows)])
            total = add(total, added_up(x, np.zeros_like(x)))
        return [total]

    found = merged(rows, sums)
    totals = [Fraction(h) + Fraction(e) for h, e in zip(*found[0])] if found else [Fraction(0)] * (width + 1)
    return int(totals[-1]), totals[:-1]


def centred(x: np.ndarray, mean: Pair) -> Pair:
    high, low = two_sum(x, -mean[0])
    return two_sum(high, low - mean[1])


def covariance(rows: DataFrame, n: int, sums: list[Fraction]) -> tuple[Pair, Pair]:
    """The mean and the covariance (divisor n) of ``v``, as pairs."""
    width = len(sums)
    exact = [s / n for s in sums]
    mean = np.array([float(m) for m in exact])
    mean = mean, np.array([float(m - Fraction(h)) for m, h in zip(exact, mean.tolist())])
    i, j = np.triu_indices(width)
    lanes = max(1, LANES // len(i))

    def products(batches: Iterator[pa.RecordBatch]) -> list[Pair]:
        total = np.zeros((lanes, len(i))), np.zeros((lanes, len(i)))
        for batch in batches:
            high, low = centred(floats(batch["v"], width), mean)
            upper, lower = split(high)
            for at in range(0, len(high), lanes):
                rows_ = slice(at, at + lanes)
                a, b, au, bu, al, bl = high[rows_, i], high[rows_, j], upper[rows_, i], upper[rows_, j], lower[rows_, i], lower[rows_, j]
                p = a * b
                e = ((au * bu - p) + au * bl + al * bu) + al * bl + (a * low[rows_, j] + low[rows_, i] * b)
                k = len(p)
                total[0][:k], total[1][:k] = add((total[0][:k], total[1][:k]), (p, e))
        high, low = added_up(*total)
        return [(high[i == k], low[i == k]) for k in range(width)]

    high, low = np.zeros((width, width)), np.zeros((width, width))
    for k, (h, e) in enumerate(merged(rows, products)):
        cells = [(Fraction(a) + Fraction(b)) / n for a, b in zip(h.tolist(), e.tolist())]
        high[k, k:] = high[k:, k] = [float(c) for c in cells]
        low[k, k:] = low[k:, k] = [float(c - Fraction(float(c))) for c in cells]
    return mean, (high, low)


# --- eigenvectors and projection ----------------------------------------------------------------------------------------


def eigen(matrix: Pair, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest component positive."""
    _, vectors = np.linalg.eigh(matrix[0])
    a, x = matrix[0].astype(np.longdouble) + matrix[1], vectors.astype(np.longdouble)
    unit = np.eye(len(a), dtype=np.longdouble)
    for step in range(steps + 1):
        r, s = unit - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        if step == steps:
            break
        gap = values[None, :] - values[:, None]
        near = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + np.linalg.norm(matrix[0]) * np.linalg.norm(r.astype(np.float64)))
        apart = np.abs(gap) > near
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(-values, kind="stable")
    values, x = values[order].astype(np.float64), x[:, order].astype(np.float64)
    return values, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What was fitted: sums, mean and covariance as pairs, eigenvalues and eigenvectors (columns)."""

    n: int
    sums: list[Fraction]
    mean: Pair
    covariance: Pair
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance[0]))
        return np.where(self.live, self.values / trace, 0.0) if trace > 0 else np.zeros(len(self.values))

    @property
    def live(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > max(float(np.trace(self.covariance[0])), 0.0) * len(self.values) * np.finfo(float).eps

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the components of (n x - S) squared, for integers; None beyond a long."""
        sums = [int(s) for s in self.sums]
        wide = self.n * max(float(np.abs(x).max(initial=0.0)), 1.0) >= 2.0**61
        y = x.astype(np.int64).astype(object) if wide else x.astype(np.int64)
        y = y * self.n - np.array(sums, dtype=object if wide else np.int64)
        rough = (y.astype(np.float64) ** 2).sum(axis=1)
        out: list[int | None] = [None] * len(x)
        safe = np.flatnonzero(rough < 9.2e18)
        for k, d in zip(safe, (y[safe] * y[safe]).sum(axis=1)):
            out[k] = int(d)
        for k in np.flatnonzero((rough >= 9.2e18) & (rough < 9.3e18)):
            d = sum(int(v) ** 2 for v in y[k])
            out[k] = d if d < 2**63 else None
        return out

    def transform(self, rows: DataFrame, components: int = COMPONENTS, deviation: bool = False) -> DataFrame:
        """``rows`` with ``v`` replaced by the whitened components; ``deviation``, for integers, on demand."""
        kept = [f for f in rows.schema if f.name != "v"]
        at = min(components, len(self.values))
        weights = self.vectors[:, :at] * np.where(self.live[:at], 1.0, 0.0) / np.sqrt(np.where(self.live[:at], self.values[:at], 1.0))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = floats(batch["v"], len(self.sums))
                high, low = centred(x, self.mean)
                white = high @ weights + low @ weights
                columns = [batch[f.name] for f in kept] + [pa.array(white.tolist(), pa.list_(pa.float64()))]
                if deviation:
                    columns.append(pa.array(self.deviations(x), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "v", *["deviation"][: int(deviation)]])

        spec = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
        return rows.mapInArrow(project, f"{spec}v array<double>{', deviation long' if deviation else ''}")


def fit(rows: DataFrame) -> Whitening:
    """Fit on all rows of ``v``, an array of numbers."""
    width = widest(rows, "v")
    n, sums = moments(rows, max(width, 0))
    mean, cov = covariance(rows, n, sums) if n and width > 0 else ((np.zeros(0), np.zeros(0)), (np.zeros((0, 0)), np.zeros((0, 0))))
    values, vectors = eigen(cov) if len(cov[0]) else (np.zeros(0), np.zeros((0, 0)))
    return Whitening(n, sums, mean, cov, values, vectors)


def identity_error(white: DataFrame) -> float:
    """Largest absolute entry of the covariance of ``v`` minus the identity."""
    n, sums = moments(white, widest(white, "v"))
    _, (high, _) = covariance(white, n, sums)
    return float(np.abs(high - np.eye(len(high))).max())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(
        table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), SCALE, SHIFT, LARGEST).alias("v"))
    )
    width = widest(rows, "v")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(SHIFT), F.lit(width) - F.size("v"))))
    fitted = fit(rows)
    white = checkpoint(fitted.transform(rows, deviation=True))
    error = identity_error(white) if fitted.n and width else 0.0
    explained = F.array(*(F.lit(float(e)) for e in fitted.explained[:COMPONENTS])).cast("array<double>")
    return white.select("vec_id", "deviation", F.posexplode("v").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained") if width else F.lit(0.0).alias("explained"), F.lit(error).alias("identity_error"),
    )
