"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Entries become integers. Every partition multiplies its integers modulo each of several primes, in chunks so small that
products of doubles stay exact; the matrices add up modulo the prime, row by row, and the Chinese remainder theorem gives
the exact counts, sums and scatter, whatever the order in which partitions came. The covariance is divided out
in exact numbers, rounded once, and decomposed in double precision.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import isqrt, prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, pick

#: Entries are counted in units of 1 / SCALE, from -SHIFT on.
SCALE, SHIFT = 1024, 100_000
#: Primes lie below this, so that the products of CHUNK rows add up exactly in a double.
PRIME_BELOW, CHUNK = 1 << 20, 1 << 13
#: Entries whose integer would not fit a long count as not finite.
LARGEST = 2.0**52
#: A direction with less than this share of all variance counts as none.
LEAST_SHARE = 1e-13
COMPONENTS = 8


class Fit(NamedTuple):
    """What the fit list gives: count, sums by dimension, covariance, its leading directions as rows and their variances."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    directions: np.ndarray
    variances: np.ndarray


def primes_above(least: int) -> list[int]:
    """The largest primes under ``PRIME_BELOW`` whose product is over ``least``."""
    found: list[int] = []
    for p in range(PRIME_BELOW - 1, 2, -2):
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            found.append(p)
            if prod(found) > least:
                return found
    raise ValueError("the sums are too large for the primes")


def usable(vector: Column) -> Column:
    """Vectors that are not null and hold finite entries only."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < LARGEST)  # noqa: E731  # NaN is larger than any number
    return vector.isNotNull() & F.forall(vector, finite)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x * SCALE) + SHIFT)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the integers of all usable vectors of the length that most of them have (the larger, in a tie).

    Empty vectors have no direction and are left out.
    """
    rows = pick(vectors, vec_id="bigint", embedding="array<double>").filter(usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d > 0")
    best = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return rows.filter(F.size("embedding") == (best["d"] if best else -1)).select("vec_id", integers(F.col("embedding")).alias("x"))


def residue_products(primes: list[int]) -> Callable:
    """Per partition and prime the rows of (1, x)' (1, x): count, sums and products modulo the prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                one = np.hstack([np.ones((len(part), 1), np.int64), part])
                if total is None:
                    total = np.zeros((len(primes), one.shape[1], one.shape[1]), np.int64)
                for k, p in enumerate(primes):
                    rest = (one % p).astype(np.float64)
                    total[k] = (total[k] + (rest.T @ rest).astype(np.int64)) % p
        if total is not None:
            for k in range(len(primes)):
                d = total.shape[1]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d, dtype=np.int32)), pa.array(total[k].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([k] * d, pa.int32()), pa.array(range(d), pa.int32()), values], names=["k", "i", "v"])

    return run


def residue_sums(primes: list[int]) -> Callable:
    """The sums of rows of the same prime and number, modulo the prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = defaultdict(int)
        for batch in batches:
            for k, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(2)), strict=True):
                total[k, i] = (total[k, i] + v) % primes[k]
        for (k, i), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([v.tolist()])], names=["k", "i", "v"])

    return run


def from_residues(residues: np.ndarray, primes: list[int]) -> np.ndarray:
    """The integers of least magnitude with these residues (first axis: primes), by the Chinese remainder theorem."""
    whole = prod(primes)
    out = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, primes, strict=True):
        rest = whole // p
        out = (out + r.astype(object) * (rest * pow(rest, -1, p))) % whole
    return np.where(out > whole // 2, out - whole, out)


def exact_scatter(fit: DataFrame) -> np.ndarray | None:
    """(1, x)' (1, x) over all rows as whole numbers of any size: the count, the sums and the products."""
    bounds = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.max(F.size("x")).alias("d")).first()
    if not bounds["n"]:
        return None
    primes = primes_above(2 * bounds["n"] * max(1, bounds["most"]) ** 2)
    kind = "k int, i int, v array<bigint>"
    parts = fit.select("x").mapInArrow(residue_products(primes), kind)
    sums = parts.repartition("k", "i").mapInArrow(residue_sums(primes), kind)
    d = bounds["d"] + 1
    residues = np.zeros((len(primes), d, d), np.int64)
    for r in sums.toLocalIterator():  # bounded by the dimension and the number of primes
        residues[r["k"], r["i"]] = r["v"]
    return from_residues(residues, primes)


def decomposed(scatter: np.ndarray, most: int) -> Fit:
    """Covariance, rounded once from whole numbers, and its unit eigenvectors by falling eigenvalue, ``most`` of them."""
    n, sums = int(scatter[0, 0]), [int(s) for s in scatter[0, 1:]]
    d = len(sums)
    covariance = np.empty((d, d))
    for i in range(d):
        for j in range(d):
            covariance[i, j] = (n * int(scatter[i + 1, j + 1]) - sums[i] * sums[j]) / n**2
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:most]
    values, rows = values[order], vectors[:, order].T
    kept = values > LEAST_SHARE * d * max(np.trace(covariance), np.finfo(float).tiny)
    rows = rows[kept] * np.sign(rows[kept, np.abs(rows[kept]).argmax(1)])[:, None]
    return Fit(n, sums, covariance, rows, values[kept])


def projected(fit: Fit) -> Callable:
    """(vec_id, deviation, whitened) of rows (vec_id, x)."""
    n, sums, weights = fit.n, fit.sums, (fit.directions / np.sqrt(fit.variances)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            largest = max((int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)), 1)
            if largest**2 * x.shape[1] < 1 << 63:
                off = x * n - np.array(sums, np.int64)
                squares = (off * off).sum(1).tolist()
            else:
                off = x.astype(object) * n - np.array(sums, object)
                squares = (off * off).sum(1).tolist()
            white = off.astype(np.float64) / n @ weights
            bounds = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([str(s) for s in squares]), pa.ListArray.from_arrays(bounds, pa.array(white.ravel()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return run


def identity_error(white: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, from sums over all rows."""
    w = [F.element_at("whitened", c + 1) for c in range(components)]
    cells = [(i, j) for i in range(components) for j in range(i, components)]
    got = white.agg(*(F.avg(x) for x in w), *(F.avg(w[i] * w[j]) for i, j in cells)).first()
    means = got[:components]
    return max(abs(got[components + k] - means[i] * means[j] - (i == j)) for k, (i, j) in enumerate(cells))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries (also any of 2^52 or more) go, and rows of another
    length than most have. Every other row counts, repeated ones and null ids too. Directions without variance
    are no components, so rows that are all alike, a single row and an empty table give an empty result.
    ``deviation`` is exact, a decimal of 38 digits.
    """
    spark, fit_rows = vectors.sparkSession, fit_list(vectors)
    kind = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    scatter = exact_scatter(fit_rows)
    fit = decomposed(scatter, components) if scatter is not None else None
    if fit is None or not len(fit.variances):
        return spark.createDataFrame([], kind)
    white = fit_rows.mapInArrow(projected(fit), "vec_id bigint, deviation string, whitened array<double>")
    white = materialize(white, "whitened", keep=True)
    error = identity_error(white, len(fit.variances))
    share = F.array(*(F.lit(float(v)) for v in fit.variances / np.trace(fit.covariance)))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("c") + 1).alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        F.element_at(share, F.col("c") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
