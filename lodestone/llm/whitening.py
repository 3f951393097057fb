"""Embedding whitening: covariance by Welford updates, merged by the parallel formula, solved by symmetric QR.

1. A vector's entries become integers, x = floor(256 * c); the fit list is each distinct x once.
2. A partition of the fit list streams by: each x moves count, mean and the sum of centred outer products by one
   rank-one update, and exact integer sums go along.
3. States of partitions merge by the parallel formula, MERGED at a time, until one is left; no task and not the
   driver holds more than MERGED matrices of the vectors' width.
4. The driver reduces that one matrix to a tridiagonal one and solves it by shifted QR steps.
5. The fit list passes once more, projected, through the same updates: what its covariance lacks to the identity is
   measured, not derived.

Defined results: vectors that are null, empty, of another length than most, or hold null or non-finite entries take no
part; rows with equal ids all stay, as do rows without one; entries beyond a long's range saturate; a deviation beyond it
is null; a component without variance (less than the width times the double's precision of the largest) has a null
``whitened`` and an ``explained`` of 0; ``identity_error`` is null where no component has variance; vectors of fewer
entries than ``components`` have as many components as entries; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, short_batches

#: An entry c becomes floor(SCALE * c).
SCALE = 256.0
#: Components that are returned.
COMPONENTS = 4
#: States that meet in one task.
MERGED = 16
#: Rows of an Arrow batch.
ROWS = 2048

STATE = "part long, n long, sums array<string>, mean array<double>, m2 binary"


class Moments:
    """Count, exact sums, mean and the sum of centred outer products of integer vectors."""

    def __init__(self, width: int):
        self.n, self.sums, self.mean, self.m2 = 0, [0] * width, np.zeros(width), np.zeros((width, width))
        self._outer = np.empty((width, width))

    def add(self, x: np.ndarray) -> None:
        """Rank-one updates, one for each row."""
        if x.dtype == np.int64:
            # Halves of 32 bits add up without overflow.
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            self.sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(self.sums, high, low, strict=True)]
        for row in x.astype(float):
            self.n += 1
            delta = row - self.mean
            self.mean += delta / self.n
            np.multiply.outer(delta, delta * ((self.n - 1) / self.n), out=self._outer)
            self.m2 += self._outer

    def merge(self, other: Moments) -> None:
        if not other.n:
            return
        n, delta = self.n + other.n, other.mean - self.mean
        self.m2 += other.m2 + np.multiply.outer(delta, delta) * (self.n / n * other.n)
        self.mean = self.mean + delta * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self, part: int) -> tuple:
        return part, self.n, [str(s) for s in self.sums], self.mean.tolist(), self.m2.tobytes()

    @classmethod
    def of(cls, n: int, sums, mean, m2: bytes) -> Moments:
        out = cls(len(mean))
        out.n, out.sums, out.mean = int(n), [int(s) for s in sums], np.array(mean, float)
        out.m2 = np.frombuffer(m2, float).reshape(len(mean), -1).copy()
        return out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix.

    Householder reflections make it tridiagonal; QR steps with the shift of the trailing 2 x 2 block, done by
    rotations along the diagonal, drive the off-diagonal entries to 0 from the end.
    """
    a, n = np.array(a, float), len(a)
    vectors = np.eye(n)  # rows are the eigenvectors
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if not np.any(x[1:]):
            continue
        x[0] += math.copysign(length, x[0])
        u = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = p - (u @ p) * u
        rest -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1, k] = -math.copysign(length, a[k + 1, k])
        vectors[k + 1 :] -= 2 * np.outer(u, u @ vectors[k + 1 :])
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    last, eps = n - 1, np.finfo(float).eps
    while last > 0:
        small = np.abs(e[:last]) <= eps * (np.abs(d[:last]) + np.abs(d[1 : last + 1]))
        e[:last][small] = 0.0
        if e[last - 1] == 0.0:
            last -= 1
            continue
        first = last - 1
        while first > 0 and e[first - 1] != 0.0:
            first -= 1
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + math.copysign(math.hypot(half, e[last - 1]), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * one + 2 * c * s * off + s * s * two, s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            x = e[k]
            if k < last - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            vectors[k], vectors[k + 1] = c * vectors[k] + s * vectors[k + 1], c * vectors[k + 1] - s * vectors[k]
    by = np.argsort(-d, kind="stable")
    return d[by], vectors[by].T


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def moments(rows: DataFrame, width: int, project=None) -> Moments:
    """Moments of the integer vectors ``x``, or of what ``project`` makes of a batch of them."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            x = matrix(batch.column(0), width)
            x = project(x) if project else x
            state = state or Moments(x.shape[1])
            state.add(x)
        if state and state.n:
            cols = zip(state.row(0), ("part", "n", "sums", "mean", "m2"), (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.binary()), strict=True)
            yield pa.RecordBatch.from_pydict({name: pa.array([v], kind) for v, name, kind in cols})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        total = None
        for r in pdf.itertuples():
            state = Moments.of(r.n, r.sums, r.mean, r.m2)
            if total is None:
                total = state
            else:
                total.merge(state)
        return pd.DataFrame([total.row(int(pdf["part"].iloc[0]) // MERGED)], columns=["part", "n", "sums", "mean", "m2"])

    parts = rows.rdd.getNumPartitions()
    states = rows.mapInArrow(stream, STATE).withColumn("part", F.spark_partition_id().cast("long"))
    while parts > 1:
        states = states.groupBy(F.floor(F.col("part") / MERGED)).applyInPandas(merge, STATE)
        parts = -(-parts // MERGED)
    one = states.collect()  # a single state
    return Moments.of(*one[0][1:]) if one else Moments(width)


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, in whole numbers; None beyond a long."""
    most = n * max(1, abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if len(sums) * most * most < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every remaining row and component."""
    spark = vectors.sparkSession
    short_batches(spark, ROWS)
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(ok)
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    widths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "d").limit(1).collect()
    width = widths[0].d if widths else 0
    rows = rows.where(F.size("x") == width)
    if not width:
        return spark.createDataFrame([], shape).withColumnRenamed("id", key)
    fit = cut(rows.select("x").distinct(), "whitening")
    found = moments(fit, width)
    n, sums, top = found.n, found.sums, min(components, width)
    values, axes = symmetric_qr(found.m2 / n)
    trace = float(np.trace(found.m2)) / n
    live = int((values[:top] > width * np.finfo(float).eps * max(values[0], 0.0)).sum())
    centre = np.array([s / n for s in sums])
    to = axes[:, :live] / np.sqrt(values[:live])
    project = lambda x: (x.astype(float) - centre) @ to
    explained = [float(values[k]) / trace if k < live else 0.0 for k in range(top)]
    error = None
    if live:
        white = moments(fit, width, project)
        error = float(np.abs(white.m2 / n - np.eye(live)).max())

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            m = len(x)
            white = [pa.array(c) for c in project(x).T] + [pa.nulls(m, pa.float64())] * (top - live)
            deviation = pa.array(exact_deviation(x, n, sums), pa.int64())
            for k in range(top):
                fixed = [pa.array(np.full(m, k + 1), pa.int32()), pa.array(np.full(m, n), pa.int64()), deviation, white[k].cast(pa.float64()), pa.array(np.full(m, explained[k]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *fixed, pa.array([error] * m, pa.float64())], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(rotate, shape).withColumnRenamed("id", key)
