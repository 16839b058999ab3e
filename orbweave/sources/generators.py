"""Generated clouds and meshes, and a reproducible sampler."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.errors import GeometryError
from orbweave.sources.files import MESH, _names

CLOUDS = ("filled_box", "hollow_box", "filled_sphere", "hollow_sphere")


def iota(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    """(value): ``first``, ``first`` + 1, ..."""
    return spark.range(n).select((F.col("id") + first).alias("value"))


def point_cloud(spark: SparkSession, kind: str, n: int, dim: int = 3, half: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x, y, ...): points spread evenly in or on a box or ball of half width ``half`` around 0."""
    if kind not in CLOUDS:
        raise GeometryError(f"no point cloud {kind}")
    rows, names = spark.range(n), _names(dim)
    if kind.endswith("box"):
        x = [F.lit(2.0) * F.rand(seed * 31 + i) - 1.0 for i in range(dim)]
        if kind == "hollow_box":  # the faces take turns
            axis, side = F.floor(F.col("id") / 2) % dim, F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0)
            x = [F.when(axis == i, side).otherwise(c) for i, c in enumerate(x)]
        return rows.select("id", *((c * half).alias(m) for c, m in zip(x, names, strict=True)))
    rows = rows.select("id", *(F.randn(seed * 31 + i).alias(m) for i, m in enumerate(names)), F.rand(seed * 31 + dim).alias("__u"))
    size: Column = F.sqrt(sum((F.col(m) * F.col(m) for m in names[1:]), F.col(names[0]) * F.col(names[0])))
    reach = F.pow("__u", F.lit(1.0 / dim)) if kind == "filled_sphere" else F.lit(1.0)
    return rows.withColumn("__s", F.coalesce(F.try_divide(reach * half, size), F.lit(0.0))).select("id", *((F.col(m) * F.col("__s")).alias(m) for m in names))


def lattice(spark: SparkSession, side: int, dim: int = 3, sequence: int = 1, spacing: int = 1, parts: tuple[int, ...] | None = None) -> DataFrame:
    """(id, part, x, ...): ``side`` points on each axis of every part, in runs of ``sequence`` unit steps ``spacing`` apart."""
    parts = parts or (1,) * dim
    whole = side**dim
    rows = spark.range(whole * math.prod(parts)).select("id", F.floor(F.col("id") / whole).alias("part"), (F.col("id") % whole).alias("__i"))
    out = []
    for d, name in enumerate(_names(dim)):
        own = F.floor(F.col("part") / math.prod(parts[:d])) % parts[d]
        p = own * side + F.floor(F.col("__i") / side**d) % side
        out.append((F.floor(p / sequence) * (sequence + spacing - 1) + p % sequence).cast("double").alias(name))
    return rows.select("id", "part", *out)


def closest_factors(n: int, dim: int) -> list[int]:
    """``dim`` factors of ``n`` that are as equal as they can be, the largest first."""
    out: list[int] = []
    for left in range(dim, 1, -1):
        f = max(1, math.ceil(round(n ** (1 / left), 9)))
        while n % f:
            f += 1
        out.append(f)
        n //= f
    return sorted([*out, n], reverse=True)


def seed_spreader(spark: SparkSession, n: int, dim: int = 3, variable_density: bool = False, clusters: int = 10, reset: int = 100, noise: float = 1e-4, width: float = 1e6, seed: int = 1) -> DataFrame:
    """(id, x, ...): clusters left by a spreader that walks through [0, width] and now and then jumps, plus noise.

    The walk is sequential only in its turns, of which there are about n / ``reset``: they are drawn on the driver.
    The points around them are independent columns.
    """
    rng = np.random.default_rng(seed)
    inner = n - int(n * noise)
    restart = (clusters - 1) / max(1, inner)
    stops, at, jumps = [], 0, 0
    while at < inner:
        until = min(inner, at + int(rng.geometric(restart)) if restart > 0 else inner)
        centre, r = rng.uniform(0, width, dim), 100.0 * (jumps % (10 if variable_density else 1) + 1)
        jumps += 1
        while at < until:
            stops.append((at, r, *map(float, centre)))
            step = rng.normal(size=dim)
            centre = np.clip(centre + step / np.linalg.norm(step) * r * dim / 2, 0, width)
            at = min(at + reset, until)
    names = _names(dim)
    turns = spark.createDataFrame(stops, "first long, r double, " + ", ".join(f"o{i} double" for i in range(dim)))
    starts = np.array([s[0] for s in stops])
    # Every turn knows its end, so a point finds its turn by expanding the turns.
    ends = spark.createDataFrame(list(zip(starts.tolist(), [*starts[1:].tolist(), inner], strict=True)), "first long, stop long")
    points = turns.join(ends, "first").withColumn("id", F.explode(F.sequence("first", F.col("stop") - 1)))
    points = points.select("id", "r", *(f"o{i}" for i in range(dim)), *(F.randn(seed * 7 + i).alias(f"g{i}") for i in range(dim)), F.rand(seed * 7 + dim).alias("u"))
    size = F.sqrt(sum((F.col(f"g{i}") * F.col(f"g{i}") for i in range(1, dim)), F.col("g0") * F.col("g0")))
    points = points.withColumn("s", F.coalesce(F.try_divide(F.pow("u", F.lit(1.0 / dim)) * F.col("r"), size), F.lit(0.0)))
    inside = points.select("id", *((F.col(f"o{i}") + F.col(f"g{i}") * F.col("s")).alias(m) for i, m in enumerate(names)))
    outside = spark.range(inner, n).select("id", *((F.rand(seed * 13 + i) * width).alias(m) for i, m in enumerate(names)))
    return inside.unionByName(outside)


# The multiplier, modulus and seed of the sampler's random numbers.
LEHMER_FACTOR = 48271
LEHMER_MODULUS = 0x7FFFFFFF
LEHMER_SEED = 1337


def sample_ordered(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """``n`` rows in order, the same ones on any machine: each row is taken with the chance that fills the rest.

    Whether a row is taken depends on how many were before it, so one task draws over the ordered ids alone; the rows
    are then picked by a join.
    """
    total = df.count()
    if not 1 < n <= total:
        raise GeometryError("a sample has at least two rows and no more than there are")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen, taken = LEHMER_SEED % (n - 1) + 1, 0, 0
        for batch in batches:
            kept = []
            for i in batch.column(0).to_pylist():
                if taken < n:
                    state = state * LEHMER_FACTOR % LEHMER_MODULUS
                    if state % (total - seen) < n - taken:
                        kept.append(i)
                        taken += 1
                seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], [order])

    ids = df.select(F.col(order).cast("long").alias(order)).orderBy(order).coalesce(1).mapInArrow(run, f"{order} long")
    return df.join(ids, order, "left_semi")


# -- meshes ----------------------------------------------------------------------------------------------------------------


def icosahedron() -> tuple[np.ndarray, np.ndarray]:
    """Corners on the unit sphere, and triangles: the sets of three corners at the smallest distance."""
    g = (1 + 5**0.5) / 2
    v = np.array([p for s in (1, -1) for t in (g, -g) for p in ((0, s, t), (s, t, 0), (t, 0, s))], float)
    near = np.isclose(np.linalg.norm(v[:, None] - v[None], axis=2), 2.0)
    faces = [(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if near[i, j] and near[j, k] and near[i, k]]
    return v / np.linalg.norm(v[0]), np.array(faces)


def subdivide(v: np.ndarray, faces: np.ndarray, on_sphere: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each triangle as four, by the middles of its sides."""
    sides = np.sort(faces[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1)
    unique, at = np.unique(sides, axis=0, return_inverse=True)
    middle = v[unique].mean(1)
    if on_sphere:
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    m = at.reshape(-1, 3) + len(v)
    a, b, c = faces.T
    ab, bc, ca = m.T
    return np.concatenate([v, middle]), np.concatenate([np.stack(t, 1) for t in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))])


def rotate(v: np.ndarray, axis: int, angle: float) -> np.ndarray:
    """About one axis, in radians."""
    i, j = (axis + 1) % 3, (axis + 2) % 3
    out = v.copy()
    out[:, i], out[:, j] = v[:, i] * math.cos(angle) - v[:, j] * math.sin(angle), v[:, i] * math.sin(angle) + v[:, j] * math.cos(angle)
    return out


def _mesh(spark: SparkSession, v: np.ndarray, faces: np.ndarray) -> DataFrame:
    flat = v[faces].reshape(len(faces), 9)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(flat)], "id long, " + ", ".join(f"{c} double" for c in MESH))


def sphere_mesh(spark: SparkSession, refinements: int = 2, angle: float = 0.0) -> DataFrame:
    """(id, ax, ..., cz): an icosahedron refined onto the unit sphere, turned about x."""
    v, faces = icosahedron()
    for _ in range(refinements):
        v, faces = subdivide(v, faces)
    return _mesh(spark, rotate(v, 0, angle), faces)


def plane_mesh(spark: SparkSession, cells: int, z: float = 0.0) -> DataFrame:
    """(id, ax, ..., cz): the unit square cut into 2 * ``cells`` ** 2 triangles."""
    i, j = (x.ravel() for x in np.meshgrid(np.arange(cells), np.arange(cells)))
    v = np.array([(x / cells, y / cells, z) for y in range(cells + 1) for x in range(cells + 1)])
    p = j * (cells + 1) + i
    return _mesh(spark, v, np.concatenate([np.stack([p, p + 1, p + cells + 1], 1), np.stack([p + 1, p + cells + 2, p + cells + 1], 1)]))
