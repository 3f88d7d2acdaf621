"""Embedding whitening: exact integer moments, leading eigenpairs of the covariance by spectrum slicing, projections."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure_text, materialize
from .spectrum import EPS, leading

#: floor(scale * c) is kept within this of 0, so that all sums fit decimals of 38 digits.
REACH = 1 << 31
LONGEST = (1 << 63) - 1


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (array of double) of the rows whose vector has only finite components and as many as most vectors have (of
    equally many rows, the longer), and that number of components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("v") == d), d


def scaled(column: pa.Array, d: int, scale: int) -> np.ndarray:
    """floor(scale * c) of every component, a row each."""
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), float).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -REACH, REACH).astype(np.int64)


def _whole(numbers) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], pa.decimal128(38, 0))


def sums(rows: DataFrame, d: int, scale: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, object), 0
        for b in batches:
            total += scaled(b.column(0), d, scale).sum(axis=0)
            n += b.num_rows
        yield pa.record_batch([pa.array(range(-1, d), pa.int32()), _whole([n, *total])], ["dim", "total"])

    found = {r["dim"]: int(r["total"]) for r in rows.select("v").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def covariance(rows: DataFrame, d: int, scale: int, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(V, centre, rest): the covariance with divisor n, each entry the double nearest to its exact value; the whole number
    nearest to each mean; and what the mean is beyond it. Rows are centred by those whole numbers before they are
    multiplied, so products are whole; the rest of the mean is taken off in exact fractions. One row for each pair of
    dimensions and partition."""
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    over = [s - n * int(m) for s, m in zip(total, centre)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((d, d), object)
        for b in batches:
            x = scaled(b.column(0), d, scale) - centre
            top = int(np.abs(x).max(initial=0))
            if top * top * max(len(x), 1) < 1 << 53:  # exact in doubles
                m += (x.T.astype(float) @ x.astype(float)).astype(np.int64)
            else:
                x = x.astype(object)
                m += x.T @ x
        i, j = np.triu_indices(d)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _whole(m[i, j])], ["i", "j", "m"])

    v = np.zeros((d, d))
    for i, j, m in rows.select("v").mapInArrow(run, "i int, j int, m decimal(38,0)").groupBy("i", "j").agg(F.sum("m").cast("decimal(38,0)")).collect():
        v[i, j] = v[j, i] = float(Fraction(n * int(m) - over[i] * over[j], n * n))
    return v, centre, np.array([float(Fraction(s, n)) for s in over])


def identity_error(rows: DataFrame, d: int, project) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity. Their mean is 0 but for rounding,
    which is taken off."""
    k = project.width
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = project(b.column(0))
            n, one, two = n + len(w), one + w.sum(axis=0), two + w.T @ w
        i, j = np.triu_indices(k)
        i, j, x = np.r_[i, np.arange(k), -1], np.r_[j, np.full(k, -1), -1], np.r_[two[i, j], one, n]
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(x)], ["i", "j", "x"])

    found = {(i, j): x for i, j, x in rows.select("v").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x")).collect()}
    n = found.pop((-1, -1))
    return max(abs(x / n - found[i, -1] * found[j, -1] / n / n - (i == j)) for (i, j), x in found.items() if j >= 0)


class Projection:
    """Rows centred exactly, onto the components of eigenvalues above rounding, over the root of each."""

    def __init__(self, d: int, scale: int, centre: np.ndarray, rest: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.d, self.scale, self.centre, self.rest = d, scale, centre, rest
        self.width = int((values > d * EPS * max(values[0], 0)).sum()) if len(values) else 0
        self.onto = vectors[:, :self.width] / np.sqrt(values[:self.width])

    def __call__(self, column: pa.Array) -> np.ndarray:
        return (scaled(column, self.d, self.scale) - self.centre - self.rest) @ self.onto


def whiten(vectors: DataFrame, top: int = 32, scale: int = 64) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every usable row of vectors (vec_id,
    embedding) and each of the `top` greatest components.

    An entry c becomes the whole number floor(scale * c); a constant added to all of them would change nothing below. n:
    usable rows. deviation: sum over dimensions of (n * x - S)^2, exact, S the sum of the dimension. whitened: x - S / n on
    the unit eigenvector over the root of its eigenvalue. explained: eigenvalue over the trace. Four scans; what meets on
    the driver are one number for each pair of dimensions.

    Left out: NULL vectors, vectors with NULL or non-finite entries, and vectors of another length than most have (of
    equally many, the longer stay). Entries beyond 2**31 / scale count as that, deviations beyond 64 bits as the largest.
    Where the covariance has no further eigenvalue above rounding (constant dimensions, a single row), whitened is NULL and
    explained 0. Fewer dimensions than top: as many components as dimensions. Rows that repeat are rows of their own, a NULL
    vec_id stays, other columns are not read. Empty table, or empty vectors: no rows.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = usable(vectors)
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = materialize(rows)
    n, total = sums(rows, d, scale)
    v, centre, rest = covariance(rows, d, scale, n, total)
    values, directions = leading(v, top)
    project = Projection(d, scale, centre, rest, values, directions)
    error = identity_error(rows, d, project)
    k, trace, over = len(values), float(np.trace(v)), [s - n * int(m) for s, m in zip(total, centre)]
    explained = np.where(np.arange(k) < project.width, values / trace if trace else 0.0, 0.0)

    def deviations(x: np.ndarray) -> np.ndarray:
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, over))
        if most * most * d < LONGEST:
            return ((n * x - np.array(over, np.int64)) ** 2).sum(axis=1)
        wide = ((n * x.astype(object) - np.array(over, object)) ** 2).sum(axis=1)
        return np.array([min(y, LONGEST) for y in wide], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            white = np.full((m, k), np.nan)
            white[:, :project.width] = project(b.column(1))
            each = np.repeat(np.arange(m), k)
            yield pa.record_batch(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(deviations(scaled(b.column(1), d, scale) - centre)[each]), pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, m)),
                 pa.array([error] * (m * k), pa.float64())], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = configure_text(spark).read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return whiten(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
