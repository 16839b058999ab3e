"""Moving least squares between point clouds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.errors import GeometryError
from orbweave.operators.spatial import SpatialIndex, nearest, points

# Coefficients of compactly supported radial basis functions, as the power of (1 - x) and the polynomial
# in x by rising power. Buhmann's functions have terms x^2 log x and half powers and are written out below.
RADIAL = {
    "wendland0": (2, [1]),
    "wendland2": (4, [1, 4]),
    "wendland4": (6, [3, 18, 35]),
    "wendland6": (8, [1, 8, 25, 32]),
    "wu2": (4, [4, 16, 12, 3]),
    "wu4": (6, [6, 36, 82, 72, 30, 5]),
}


def radial(name: str, y: np.ndarray) -> np.ndarray:
    """Value of a basis function at the relative distance abs(y), 0 from 1 on."""
    x = np.minimum(np.abs(np.asarray(y, float)), 1.0)
    if name in RADIAL:
        power, poly = RADIAL[name]
        return np.abs((1 - x) ** power * np.polynomial.polynomial.polyval(x, poly))
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.where(x > 0, np.log(x), 0.0)
    if name == "buhmann2":
        return np.abs(2 * x**4 * log - 7 / 2 * x**4 + 16 / 3 * x**3 - 2 * x**2 + 1 / 6)
    if name == "buhmann3":
        return np.abs(x**8 - 84 / 5 * x**6 + 1024 / 5 * x ** (9 / 2) - 378 * x**4 + 1024 / 5 * x ** (7 / 2) - 84 / 5 * x**2 + 1)
    if name == "buhmann4":
        return np.abs(99 / 35 * x**8 - 132 * x**6 + 9216 / 35 * x ** (11 / 2) - 11264 / 35 * x ** (9 / 2) + 198 * x**4 - 396 / 35 * x**2 + 1)
    raise GeometryError(f"no radial basis function {name}")


def monomials(dim: int, degree: int) -> list[tuple[int, ...]]:
    """Powers of each term, by total degree; within one, as 1, x, y, z, xx, xy, yy, xz, yz, zz, ..."""
    terms = [p for p in itertools.product(range(degree + 1), repeat=dim) if sum(p) <= degree]
    return sorted(terms, key=lambda p: (sum(p), *(p[i] for i in reversed(range(1, dim)))))


def basis(x: np.ndarray, degree: int) -> np.ndarray:
    """Value of every term at each row of ``x``."""
    return np.stack([np.prod(x ** np.array(p), axis=1) for p in monomials(x.shape[1], degree)], 1)


def independent_terms(p: np.ndarray) -> np.ndarray:
    """Terms that the points tell apart from earlier ones, by elimination on the term-by-point matrix."""
    rows = p.T.copy()
    keep = np.zeros(len(rows), bool)
    tolerance = max(rows.shape) * np.finfo(float).eps * max(1.0, np.abs(rows).max(initial=0.0)) * 16
    done: list[tuple[int, np.ndarray]] = []
    for i, row in enumerate(rows):
        for pivot, other in done:
            row = row - other * (row[pivot] / other[pivot])
        pivot = int(np.argmax(np.abs(row)))
        if abs(row[pivot]) > tolerance:
            keep[i] = True
            done.append((pivot, row))
    return keep


def pseudo_inverse(a: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix, by its eigenvalues; those below n * largest * epsilon count as 0."""
    w, v = np.linalg.eigh(a)
    small = np.abs(w) <= len(w) * np.abs(w).max(initial=0.0) * np.finfo(float).eps
    inverse = np.where(small, 0.0, 1 / np.where(small, 1.0, w))
    return (v * inverse) @ v.T


def coefficients(target: np.ndarray, sources: np.ndarray, function: str, degree: int) -> np.ndarray:
    """Weight of each source in the value at the target.

    Sources are taken relative to the target and scaled by 1.1 times the largest distance. Terms that they can't tell
    apart are left out before the normal matrix is inverted, so collinear or repeated sources keep exactness for what
    they do determine.
    """
    x = sources - target
    reach = 1.1 * np.sqrt((x**2).sum(1)).max(initial=0.0)
    x = x / (reach or 1.0)
    phi = radial(function, np.sqrt((x**2).sum(1)))
    p = basis(x, degree)
    keep = independent_terms(p)
    p = p[:, keep]
    moment = p.T @ (phi[:, None] * p)
    return (pseudo_inverse(moment) @ (p.T * phi))[0]


def batch_coefficients(target: np.ndarray, sources: np.ndarray, function: str, degree: int) -> np.ndarray:
    """:func:`coefficients` for rows of targets (m, d) with their sources (m, k, d), at once where these determine every term well."""
    m, k, d = sources.shape
    x = sources - target[:, None]
    reach = 1.1 * np.sqrt((x**2).sum(2)).max(1, initial=0.0)
    scaled = x / np.where(reach > 0, reach, 1.0)[:, None, None]
    phi = radial(function, np.sqrt((scaled**2).sum(2)))
    p = basis(scaled.reshape(m * k, d), degree).reshape(m, k, -1)
    weighted = p * phi[:, :, None]
    w, v = np.linalg.eigh(np.einsum("mkt,mku->mtu", weighted, p))
    well = w[:, 0] > 1e-9 * w[:, -1]
    first = np.einsum("mt,mut->mu", v[:, 0, :] / np.where(well[:, None], w, 1.0), v)
    out = np.einsum("mu,mku->mk", first, weighted)
    for i in np.flatnonzero(~well):
        out[i] = coefficients(target[i], sources[i], function, degree)
    return out


def basis_size(dim: int, degree: int) -> int:
    return math.comb(dim + degree, degree)


def mls_coefficients(
    sources: DataFrame, targets: DataFrame, names: Sequence[str], function: str = "wendland0", degree: int = 2, neighbors: int | None = None, source_id: str = "id", target_id: str = "id",
) -> DataFrame:
    """(target_id, source_id, coefficient) over the nearest sources of each target, as many as the basis has terms if not given.

    The coefficients depend on the places only and serve for any number of value columns.
    """
    radial(function, np.zeros(1))
    k = neighbors or basis_size(len(names), degree)
    index = SpatialIndex(sources.select(source_id, *(F.col(n).alias(f"s_{n}") for n in names)), points(*(f"s_{n}" for n in names)), source_id)
    near = index.query(targets.select(target_id, *names), points(*names), nearest(k), target_id, keep=names, keep_values=[f"s_{n}" for n in names])

    item = F.struct("place", F.col("value_id").alias("source_id"), *(F.col(f"s_{n}").cast("double").alias(f"s_{n}") for n in names))
    lists = near.groupBy("query_id", *(F.col(n).cast("double").alias(n) for n in names)).agg(F.array_sort(F.collect_list(item)).alias("near"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            rows, flat = near.value_lengths().to_numpy(), near.flatten()
            ends = np.cumsum(rows)
            target = np.stack([batch.column(n).to_numpy() for n in names], 1)
            source = np.stack([flat.field(f"s_{n}").to_numpy() for n in names], 1)
            out = np.empty(len(source))
            for size in np.unique(rows).tolist():  # as many sources each
                at = np.flatnonzero(rows == size)
                places = (ends[at] - size)[:, None] + np.arange(size)
                out[places] = batch_coefficients(target[at], source[places], function, degree)
            ids = np.repeat(batch.column("query_id").to_numpy(), rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), flat.field("source_id").cast(pa.int64()), pa.array(out)], ["target_id", "source_id", "coefficient"])

    return lists.withColumn("query_id", F.col("query_id").cast("long")).mapInArrow(solve, "target_id long, source_id long, coefficient double")


def interpolate(coefficient: DataFrame, values: DataFrame, columns: Sequence[str], id: str = "id") -> DataFrame:
    """(target_id, ...): the value columns at the targets."""
    met = coefficient.join(values.select(F.col(id).alias("source_id"), *columns), "source_id")
    return met.groupBy("target_id").agg(*(F.sum(F.col("coefficient") * F.col(c)).alias(c) for c in columns))
