"""Joins by comparing blocks of rows: for geometries that are large beside the scene, or dense within the radius.

Where a grid has few cells, nearly all rows meet in it, and a row on either side is entered in many of its cells. Here
both sides are cut into balanced blocks of bounded size with tight boxes, and each two blocks whose boxes meet are one
group of a shuffle, so each pair of rows is looked at once. The coordinates of the geometries are computed once a row,
as columns; a task streams its groups, tests boxes by broadcasting, and evaluates the predicate on arrays of the pairs
that are left, in pieces that fit a cache. What it emits is streamed, too, so memory doesn't grow with the results.

Rows with coordinates that are null, not finite or huge are left to joins over columns, which know their order.
"""

from __future__ import annotations

import dataclasses
import functools
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions import arrays
from orbweave.functions import geometry as G
from orbweave.operators.parts import Parts
from orbweave.plans.shared import materialize

#: Rows of a block at most, parts of a side at most, and what a task evaluates at a time: pairs of boxes, pairs of rows.
ROWS, PARTS, BOXES, PAIRS = 1 << 16, 512, 1 << 17, 1 << 14
#: Points of a tile on average, and the part of two tiles' boxes that must meet for all their pairs to be compared: of shapes much of whose work is done once a row, and of others.
TILE, DENSE = 128, (0.3, 0.7)
#: Rays that are compared with tiles at a time.
RAYS = 2_048
#: Scenes of a smaller size, or of more than its inverse, aren't sieved: products of their coordinates may round to 0.
TINY = 1e-30
#: Larger coordinates, whose products could overflow, aren't compared on arrays.
HUGE = 1e40
#: Geometries whose predicates are compared on arrays.
SHAPES = (G.Point, G.Box, G.Sphere, G.Segment, G.Triangle, G.Tetrahedron, G.Ellipsoid, G.KDOP)
#: Shuffle partitions at most.
TASKS = 4_000


def leaves(g) -> list[Column]:
    """The columns of a geometry, in the order of its fields."""
    if dataclasses.is_dataclass(g):
        return [x for f in dataclasses.fields(g) for x in leaves(getattr(g, f.name))]
    if isinstance(g, list | tuple):
        return [x for y in g for x in leaves(y)]
    return [] if isinstance(g, int) else [g]


def numbered(g, numbers: Iterator[int]):
    """``g`` with the number of each column instead of it."""
    if dataclasses.is_dataclass(g):
        return type(g)(*(numbered(getattr(g, f.name), numbers) for f in dataclasses.fields(g)))
    if isinstance(g, list | tuple):
        return [numbered(y, numbers) for y in g]
    return g if isinstance(g, int) else _Place(next(numbers))


@dataclasses.dataclass(frozen=True)
class _Place:
    number: int


def filled(g, columns: Callable[[int], arrays.Numbers]):
    if isinstance(g, _Place):
        return columns(g.number)
    if dataclasses.is_dataclass(g):
        return type(g)(*(filled(getattr(g, f.name), columns) for f in dataclasses.fields(g)))
    return [filled(y, columns) for y in g] if isinstance(g, list) else g


def regular(g: G.Geometry) -> Column:
    """Whether all coordinates are finite and not huge."""
    return F.coalesce(G._all([(F.abs(x.cast("double")) < HUGE) for x in leaves(g)]), F.lit(False))


@dataclasses.dataclass(frozen=True)
class Asked:
    """What holds for a pair: ``kind`` intersects, within (a number, or with None a column of the queries, which comes after all coordinates), ray or nearest.

    With ``terms`` (points within a number, with other first carried columns and farther than ``least``) pairs are counted and
    their terms added up for each query and block, and not returned. A term is computed from the distance and the places.
    """

    kind: str
    radius: float | None = None
    measured: bool = False
    first: int | None = None
    every: bool = False
    least: float = -1.0
    terms: dict[str, Callable] | None = None


class _Side:
    """A side cut into blocks: a column for the block of a row, and the box of each block."""

    def __init__(self, df: DataFrame, box: G.Box, id: Column, rows: int, most: int | None = None, sampled: int = 1 << 13):
        most = most or max(1, min(PARTS, max(min(27, rows // 512), rows // ROWS)))
        parts = Parts(df, [(lo + hi) / F.lit(2.0) for lo, hi in zip(box.lo, box.hi, strict=True)], box, id, most=most, sampled=sampled)
        starts, shares, self.lo, self.hi, self.n = {}, {}, [], [], []
        for part, n, lo, hi in parts.rows:
            starts[part], shares[part] = len(self.lo), -(-n // ROWS)
            self.lo += [lo] * shares[part]
            self.hi += [hi] * shares[part]
            self.n += [n // shares[part]] * shares[part]
        table = lambda d: F.from_json(F.lit(json.dumps([d.get(p, 0) for p in range(max(d, default=0) + 1)])), "array<int>")
        share = F.pmod(F.xxhash64(id), F.element_at(table(shares), F.col("__part") + 1)).cast("int")
        self.df = parts.assigned.withColumn("__block", F.element_at(table(starts), F.col("__part") + 1) + share)


def _meeting(q: _Side, v: _Side, every: bool) -> np.ndarray:
    """Which blocks of ``q`` meet which of ``v``."""
    if every or not q.lo or not v.lo:
        return np.ones((len(q.lo), len(v.lo)), bool)
    a, b, c, d = (np.array(x) for x in (q.lo, q.hi, v.lo, v.hi))
    return ((a[:, None] <= d[None]) & (c[None] <= b[:, None])).all(2)


def block_pairs(q: DataFrame, v: DataFrame, qg: G.Geometry, vg: G.Geometry, qbox: G.Box, vbox: G.Box, qid: Column, vid: Column, carried: Sequence[Sequence[str]], asked: Asked, rows: Sequence[int], radius: Column | None = None) -> DataFrame:
    """The ``carried`` columns of both sides for each pair for which ``asked`` holds, and ``distance`` (and ``__out`` of rays) where measured.

    ``qbox`` and ``vbox`` are columns of boxes that must meet; ``rows`` counts each side. With ``asked.first`` only so
    many values of a query and block by distance and the first carried column of the values.
    """
    names = [list(dict.fromkeys(c)) for c in carried]
    # Each block of values returns ``first`` values of a query, so for nearest ones there are as few as hold them.
    sides = [_Side(q, qbox, qid, rows[0]), _Side(v, vbox, vid, rows[1], max(1, rows[1] // ROWS) if asked.kind == "nearest" else None)]
    meet = _meeting(*sides, asked.every)
    geometry = [leaves(qg), leaves(vg)]
    width, axes = max(map(len, geometry)) + (radius is not None), len(qbox.lo)
    # Coordinates travel as arrays: as columns of their own each would double the constraints that the optimizer derives.
    out = []
    for s, (side, box, columns) in enumerate(zip(sides, (qbox, vbox), geometry, strict=True)):
        others = [np.flatnonzero(x).tolist() for x in (meet if s == 0 else meet.T)]
        other = F.explode(F.element_at(F.from_json(F.lit(json.dumps(others)), "array<array<int>>"), F.col("__block") + 1))
        own = F.col("__block").cast("long")
        pair = side.df.withColumn("__other", other).withColumn("__pair", own * len(meet.T) + F.col("__other") if s == 0 else F.col("__other").cast("long") * len(meet.T) + own)
        numbers = [x.cast("double") for x in columns] + [F.lit(0.0)] * (width - len(columns))
        if s == 0 and radius is not None:
            numbers[-1] = radius.cast("double")
        kept = [F.col(n) if s == t else F.lit(None).cast(d.schema[n].dataType).alias(n) for t, d in enumerate((q, v)) for n in names[t]]
        out.append(pair.select("__pair", F.lit(1 - s).alias("__side"), F.array(*numbers).alias("__g"), F.array(*box.lo, *box.hi).alias("__b"), *kept))
    fields = [T.StructField(n, d.schema[n].dataType) for d, own in ((q, names[0]), (v, names[1] if asked.terms is None else [])) for n in own]
    fields += [T.StructField("__n", T.LongType())] if asked.terms is not None else []
    measures = [*asked.terms] if asked.terms is not None else ["distance", "__out"] if asked.kind == "ray" else ["distance"] if asked.measured else []
    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in measures)])
    shapes = [numbered(g, iter(range(1000))) for g in (qg, vg)]
    dealt = out[0].unionByName(out[1]).repartition(max(1, min(TASKS, int(meet.sum()))), "__pair").sortWithinPartitions("__pair", "__side")
    return dealt.mapInArrow(_compare(shapes, width, axes, names, measures, asked), schema)


def _compare(shapes, width, axes, names, measures, asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        first = int((t.column("__side").to_numpy() == 0).sum())  # the values come before the queries
        if 0 < first < t.num_rows:
            yield from (_pairs if asked.terms is None else _sums)(t.slice(first), t.slice(0, first), shapes, width, axes, names, measures, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            keys = b.column("__pair").to_numpy()
            ends = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(ends, ends[1:], strict=False):
                if i == j:
                    continue
                if held and keys[i] != at:
                    yield from group(held)
                    held = []
                at = keys[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from group(held)

    return run


def _parts(q: pa.Table, v: pa.Table, name: str, n: int) -> list[list[np.ndarray]]:
    """The ``n`` numbers that both sides' rows have in the column ``name``, each as an array."""
    return [[np.ascontiguousarray(x) for x in t.column(name).chunk(0).flatten().to_numpy().reshape(-1, n).T] for t in (q, v)]


def _pairs(q: pa.Table, v: pa.Table, shapes, width, axes, names, measures, asked) -> Iterator[pa.RecordBatch]:
    """Results of one block of queries and one of values, piece by piece."""
    (qn, vn), (qb, vb) = _parts(q, v, "__g", width), _parts(q, v, "__b", 2 * axes)
    qt, vt = q.select(names[0]).combine_chunks(), v.select(names[1]).combine_chunks()
    if asked.kind != "nearest" and not asked.every and all(isinstance(x, G.Point) for x in shapes):
        found = _by_tiles(qn, vn, qb, vb, axes, shapes, asked, bool(measures))
    else:
        found = _by_rows(qn, vn, qb, vb, axes, shapes, asked, len(measures), vt.column(0).to_numpy() if asked.first else None)
    made, size = [], 0
    with arrays.numbers():
        for some in found:
            made.append(some)
            size += len(some[0])
            if size >= 1 << 16:
                yield _batch(made, qt, vt, names, measures)
                made, size = [], 0
    if size:
        yield _batch(made, qt, vt, names, measures)


def _by_rows(qn, vn, qb, vb, axes, shapes, asked, measures, ids) -> Iterator[list[np.ndarray]]:
    """(row of the queries, of the values, measures) of pairs that match, some queries after others, each with all values."""
    passing = near_lines(shapes, qn, vn, vb, axes) if asked.kind == "ray" else None
    found_by = _nearest_rows if asked.kind == "nearest" else _in_tiles if passing is None else functools.partial(_rays_in_tiles, passing)
    for found in found_by(qn, vn, qb, vb, axes, shapes, asked, measures > 0):
        if asked.first and len(found[0]):
            order = np.lexsort((ids[found[1]], found[2], found[0]))
            found = [x[order] for x in found]
            starts = np.flatnonzero(np.r_[True, found[0][1:] != found[0][:-1]])
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            found = [x[place < asked.first] for x in found]
        yield found


def _nearest_rows(qn, vn, qb, vb, axes, shapes, asked, measured) -> Iterator[list[np.ndarray]]:
    step = max(1, BOXES // len(vn[0]))
    for start in range(0, len(qn[0]), step):
        i, j = _candidates(slice(start, start + step), qn, vn, shapes, asked)
        i = i + start
        found = [_matching(i[k : k + PAIRS], j[k : k + PAIRS], qn, vn, shapes, asked, measured) for k in range(0, len(i), PAIRS)]
        if found:
            yield [np.concatenate(x) for x in zip(*found, strict=True)]


def _matching(i: np.ndarray, j: np.ndarray, qn, vn, shapes, asked, measured) -> list[np.ndarray]:
    """Of pairs of rows those that match, and their measures."""
    hit, values = _holds(i, j, qn, vn, shapes, asked, measured)
    return [i[hit], j[hit], *(x[hit] + 0.0 for x in values)]


def _in_tiles(qn, vn, qb, vb, axes, shapes, asked, measured) -> Iterator[list[np.ndarray]]:
    """As :func:`_by_rows`, by tiles of near rows.

    Of two tiles all pairs are compared, with what depends on one row computed once a row, if a good part of their boxes
    meet. Otherwise pairs that :func:`sieve` leaves are picked and compared in pieces.
    """
    ray = asked.kind == "ray"
    (qo, qs, qlo, qhi), (vo, vs, vlo, vhi) = _tiles(qb, axes, TILE), _tiles(vb, axes, 2 * TILE)
    trifle = 0.0 if asked.every else 1e-15 * max(np.abs(x).max() for x in (qlo, qhi, vlo, vhi))  # boxes are rounded
    qn, vn, qb, vb = ([x[o] for x in n] for n, o in ((qn, qo), (vn, vo), (qb, qo), (vb, vo)))
    sift = None if asked.every and not ray else sieve(shapes, qn, vn, asked)
    dense = DENSE[0 if any(type(x) in (G.KDOP, G.Ellipsoid) for x in shapes) else 1]
    pool, size = [], 0

    def picked() -> list[np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*pool, strict=True))
        found = [_matching(i[k : k + PAIRS], j[k : k + PAIRS], qn, vn, shapes, asked, measured) for k in range(0, len(i), PAIRS)]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    for k, some in enumerate(qs):
        found = []
        near = np.arange(len(vs)) if asked.every else np.flatnonzero(((qlo[k] - trifle <= vhi) & (vlo <= qhi[k] + trifle)).all(1))
        for other in (vs[t] for t in near):
            meet = _ray_meets(some, other, qn, vn, vb, axes, shapes) if ray and sift is None else None if asked.every else _boxes_meet(some, other, qb, vb, axes)
            if sift is not None:
                meet = sift(some, other, meet)
            if meet is None or sift is None and not ray and np.count_nonzero(meet) > dense * meet.size:
                hit, values = _holds((some, None), (None, other), qn, vn, shapes, asked, measured)
                i, j, flat = _places(hit if meet is None else hit & meet, some, other)
                found.append([i, j, *(np.broadcast_to(x, hit.shape).ravel()[flat] + 0.0 for x in values)])
            else:
                pool.append(_places(meet, some, other)[:2])
                size += len(pool[-1][0])
        if size >= PAIRS or size and (asked.first or k == len(qs) - 1):
            found.append(picked())
            pool, size = [], 0
        if found:
            i, j, *values = (np.concatenate(x) for x in zip(*found, strict=True))
            yield [qo[i], vo[j], *values]


def _rays_in_tiles(passing, qn, vn, qb, vb, axes, shapes, asked, measured) -> Iterator[list[np.ndarray]]:
    """As :func:`_by_rows` for rays with boxes or spheres: a ray meets only the tiles of near values whose box it meets, and of these values those that it passes closely."""
    vo, vs, _, _ = _tiles(vb, axes, TILE)
    held = [x[vo] for x in vn]
    low, high = ([f(x[vo], y[vo]) for x, y in zip(vb[:axes], vb[axes:], strict=True)] for f in (np.minimum, np.maximum))
    tiles = [np.array([x[s].min() for s in vs]) for x in low] + [np.array([x[s].max() for s in vs]) for x in high]
    for start in range(0, len(qn[0]), RAYS):
        meet = _ray_meets(slice(start, start + RAYS), slice(None), qn, None, tiles, axes, shapes)
        pool = []
        for k in np.flatnonzero(meet.any(0)).tolist():
            rays = np.flatnonzero(meet[:, k]) + start
            i, j = np.nonzero(passing(rays, vo[vs[k]]))
            pool.append((rays[i], j + vs[k].start))
        if not pool:
            continue
        i, j = (np.concatenate(x) for x in zip(*pool, strict=True))
        found = [_matching(i[k : k + PAIRS], j[k : k + PAIRS], qn, held, shapes, asked, measured) for k in range(0, len(i), PAIRS)]
        if found:
            i, j, *values = (np.concatenate(x) for x in zip(*found, strict=True))
            yield [i, vo[j], *values]


def _places(hit: np.ndarray, some: slice, other: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, the columns and the flat places of what is true; ``some`` and ``other`` are where rows and columns begin."""
    flat = np.flatnonzero(hit)
    i = np.repeat(np.arange(len(hit)), np.count_nonzero(hit, axis=1))
    return i + some.start, flat - (i * hit.shape[1] - other.start), flat


def _boxes_meet(some: slice, other: slice, qb, vb, axes: int) -> np.ndarray:
    meet = None
    for k in range(axes):
        for x, y in ((qb[k][some][:, None], vb[axes + k][other][None]), (vb[k][other][None], qb[axes + k][some][:, None])):
            meet = np.less_equal(x, y) if meet is None else np.logical_and(meet, np.less_equal(x, y), out=meet)
    return meet


def _ray_meets(some: slice, other: slice, qn, vn, vb, axes: int, shapes) -> np.ndarray:
    ray = filled(shapes[0], lambda k: arrays.Numbers(qn[k][some, None]))
    pad = 1e-9 * (1 + max(np.abs(x).max(initial=0) for x in vb) + sum(np.abs(x.v).max(initial=0) for x in ray.o))
    lo, hi = G.ray_box(ray, G.Box([arrays.Numbers(x[None, other] - pad) for x in vb[:axes]], [arrays.Numbers(x[None, other] + pad) for x in vb[axes:]]))
    return (lo.v <= hi.v) & (hi.v >= 0)


# -- sieves --------------------------------------------------------------------------------------------------------------


def sieve(shapes, qn, vn, asked: Asked) -> Callable[[slice, slice, np.ndarray | None], np.ndarray] | None:
    """For lines and points with triangles or tetrahedra: what leaves out pairs that can't match, by products of matrices; else None.

    Tests are half spaces, wider by far more than rounding of the predicates is, which decide on what is left.
    """
    q, v = shapes
    if type(v) in (G.Point, G.Sphere, G.Segment):
        number = asked.kind == "intersects" or asked.radius is not None
        turned = sieve((v, q), vn, qn, asked) if type(q) in (G.Triangle, G.Tetrahedron) and number else None
        return turned and (lambda some, other, meet: turned(other, some, None if meet is None else meet.T).T)
    if type(v) not in (G.Triangle, G.Tetrahedron) or len(v.a if type(v) is G.Triangle else v.corners[0]) != 3:
        return None
    own = lambda x, n: np.array([n[p.number] for p in x])
    corners = [own(c, vn) for c in v.corners]
    middle = np.mean(corners[0], axis=1, keepdims=True)
    corners = [c - middle for c in corners]
    length = lambda x: np.sqrt((x * x).sum(0))
    reach = max(length(c).max() for c in corners)
    cross = lambda x, y: np.cross(x, y, axis=0)
    planes = lambda n, at: np.vstack([n, -(n * at).sum(0)])
    if type(v) is G.Triangle and type(q) in (G.Ray, G.Segment) and asked.kind in ("ray", "intersects"):
        o = own(q.o if type(q) is G.Ray else q.a, qn) - middle
        end = o if type(q) is G.Ray else own(q.b, qn) - middle
        d = own(q.d, qn) if type(q) is G.Ray else np.divide(end - o, length(end - o), out=np.zeros_like(o), where=length(end - o) > 0)
        reach += max(length(o).max(), length(end).max())
        return _lines(corners, o, d, end if type(q) is G.Segment else None, reach, cross, length, planes) if TINY < reach < 1 / TINY else None
    if type(q) not in (G.Point, G.Sphere) or asked.kind not in ("intersects", "within"):
        return None
    p = own(q.at if type(q) is G.Point else q.c, qn) - middle
    far = reach + length(p).max()
    if not TINY < far < 1 / TINY:
        return None
    trifle = 1e-7 * far
    at = np.vstack([p, np.ones(p.shape[1])]).T
    if type(v) is G.Tetrahedron and type(q) is G.Point and asked.kind == "intersects":
        faces, away = [], 0.0
        for k in range(4):
            a, b, c = (corners[j] for j in range(4) if j != k)
            n = cross(b - a, c - a)
            height, size = (n * (corners[k] - a)).sum(0), length(n)
            plain = (np.abs(height) > 1e-6 * size * reach) & (size > 1e-6 * length(b - a) * length(c - a))
            faces.append(planes(np.where(plain, -np.sign(height) * n / np.where(plain, size, 1.0), 0.0), a))
    elif type(v) is G.Triangle:
        away = qn[q.r.number] if type(q) is G.Sphere else asked.radius if asked.radius is not None else qn[-1]
        edges = [corners[(k + 1) % 3] - corners[k] for k in range(3)]
        n = cross(edges[0], edges[1])
        size, sides = length(n), [length(e) for e in edges]
        plain = size**2 > 2e-8 * far * np.maximum.reduce(sides) ** 3  # else the predicate's weights of the corners are too inexact
        n = np.where(plain, n / np.where(plain, size, 1.0), 0.0)
        outward = [np.where(plain, cross(e, n) / np.where(plain & (s > 0), s, 1.0), 0.0) for e, s in zip(edges, sides, strict=True)]
        faces = [planes(n, corners[0]), planes(-n, corners[0]), *(planes(m, c) for m, c in zip(outward, corners, strict=True))]
        if type(q) is G.Sphere and asked.kind == "within":
            return None
    else:
        return None
    away = np.broadcast_to(np.maximum(np.asarray(away, float), 0.0) * (1 + 1e-9) + trifle, p.shape[1])

    def points(some: slice, other: slice, meet: np.ndarray | None) -> np.ndarray:
        for f in faces:
            inside = at[some] @ f[:, other] <= away[some, None]
            meet = inside if meet is None else np.logical_and(meet, inside, out=meet)
        return meet

    return points


def near_lines(shapes, qn, vn, vb, axes: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """For rays with boxes or spheres: which of some rays pass others' bounding spheres, in front of their origins, by products of matrices; else None.

    Spheres are wider by far more than rounding of the predicates is, which decide on what is left.
    """
    q, v = shapes
    if type(q) is not G.Ray or type(v) not in (G.Box, G.Sphere):
        return None
    o, d = (np.array([qn[p.number] for p in x]) for x in (q.o, q.d))
    centre = np.array([(x + y) / 2 for x, y in zip(vb[:axes], vb[axes:], strict=True)])
    half = np.array([np.abs(y - x) / 2 for x, y in zip(vb[:axes], vb[axes:], strict=True)])
    radius = half.max(0) if type(v) is G.Sphere else np.sqrt((half * half).sum(0))
    middle = centre.mean(1, keepdims=True)
    o, centre = o - middle, centre - middle
    size = np.abs(d).max(0)
    d = np.divide(d, size, out=np.zeros_like(d), where=size > 0)
    length = np.sqrt((d * d).sum(0))
    d = np.divide(d, length, out=np.zeros_like(d), where=length > 0)
    far = np.sqrt((o * o).sum(0)).max() + np.sqrt((centre * centre).sum(0)).max() + radius.max()
    if not TINY < far < 1 / TINY:
        return None
    radius = radius * (1 + 1e-9)
    # How far along a ray the centre is, and the squared distance from the origin less the squared radius.
    along = np.vstack([d, -(o * d).sum(0)]).T, np.vstack([centre, np.ones(len(radius))])
    square = np.vstack([-2 * o, np.ones(o.shape[1]), (o * o).sum(0) - 1e-9 * far**2]).T, np.vstack([centre, (centre * centre).sum(0) - radius**2, np.ones(len(radius))])
    behind = -radius - 1e-9 * far

    def passing(rays: np.ndarray, others: np.ndarray) -> np.ndarray:
        s = along[0][rays] @ along[1][:, others]
        meet = square[0][rays] @ square[1][:, others] <= s * s
        return np.logical_and(meet, s >= behind[others], out=meet)

    return passing


def _lines(corners, o, d, end, reach, cross, length, planes) -> Callable[[slice, slice, np.ndarray | None], np.ndarray]:
    """A line passes all edges on one side, and the plane lies before a ray, or between the ends of a segment.

    On which side of an edge a line passes is a product of their Pluecker coordinates. Lines within 1e-6 of a plane count
    as in it, so tests are wider than that.
    """
    a, most = corners[0], length(d).max()
    line = np.vstack([d, cross(o, d)]).T
    edges = [np.vstack([cross(p, q), q - p]) for p, q in zip(corners, [*corners[1:], a], strict=True)]
    n = cross(corners[1] - a, corners[2] - a)
    wide = 1e-5 * (reach + 1) * reach * (most + 1)
    size = length(n).max()
    near = 1e-5 * size * (reach + 1) * (most + 1) + 1e-10 * reach**3
    plane, one = planes(n, a), np.ones(o.shape[1])
    first = np.vstack([o, one]).T
    second = np.vstack([-d, 0 * one]).T if end is None else np.vstack([end, one]).T

    def sift(some: slice, other: slice, meet: np.ndarray | None) -> np.ndarray:
        u, w = first[some] @ plane[:, other], second[some] @ plane[:, other]
        ahead = (u * w >= 0) if end is None else (u * w <= 0)
        ahead |= (np.abs(u) <= near) | (np.abs(w) <= near)
        least = most = None
        for e in edges:
            x = line[some] @ e[:, other]
            least, most = (x, x) if least is None else (np.minimum(least, x), np.maximum(most, x))
        ahead &= (least >= -wide) | (most <= wide)
        return ahead if meet is None else np.logical_and(meet, ahead, out=meet)

    return sift


def _tiles(b: list[np.ndarray], axes: int, most: int) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """An order of the rows by which those near each other come together, its slices of about ``most`` rows, and the boxes of these."""
    n = len(b[0])
    strips = max(1, round((n / most) ** (1 / axes)))
    group, order = np.zeros(n, np.int64), np.arange(n)
    for k in range(axes):
        order = np.lexsort((b[k] + b[axes + k], group))
        sizes = np.bincount(group)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = group[order]
        group[order] = own * strips + (np.arange(n) - starts) * strips // np.repeat(sizes, sizes)
    order = np.argsort(group, kind="stable")
    ends = [*np.flatnonzero(np.diff(group[order], prepend=-1)).tolist(), n]
    slices = [slice(i, j) for a, z in zip(ends, ends[1:], strict=False) for i, j in ((k, min(z, k + 2 * most)) for k in range(a, z, 2 * most))]
    sides = [np.array([[f(x[order[s]]) for x in b[at : at + axes]] for s in slices]) for f, at in ((np.min, 0), (np.max, axes))]
    return order, slices, *sides


def _by_tiles(qn, vn, qb, vb, axes, shapes, asked, measured) -> Iterator[list[np.ndarray]]:
    """As :func:`_by_rows` for points, by tiles of near rows: those that are apart are left out."""
    for some, other, hit, values in _near_tiles(qn, vn, qb, vb, axes, shapes, asked, measured):
        flat = np.flatnonzero(hit)
        if len(flat):
            i, j = np.divmod(flat, hit.shape[1])
            yield [some[i], other[j], *(x.ravel()[flat] + 0.0 for x in values)]


def _near_tiles(qn, vn, qb, vb, axes, shapes, asked, measured) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each two tiles that are near: their rows on both sides, which of all their pairs match, and the pairs' measures."""
    (qo, qs, qlo, qhi), (vo, vs, vlo, vhi) = _tiles(qb, axes, TILE), _tiles(vb, axes, TILE)
    trifle = 1e-15 * max(np.abs(x).max() for x in (qlo, qhi, vlo, vhi))  # boxes are rounded
    qlo, qhi = qlo - trifle, qhi + trifle
    qn, vn = [x[qo] for x in qn], [x[vo] for x in vn]
    for k, some in enumerate(qs):
        for other in np.flatnonzero(((qlo[k] <= vhi) & (vlo <= qhi[k])).all(1)):
            yield qo[some], vo[vs[other]], *_holds((some, None), (None, vs[other]), qn, vn, shapes, asked, measured)


def _sums(q: pa.Table, v: pa.Table, shapes, width, axes, names, measures, asked) -> Iterator[pa.RecordBatch]:
    """For each query of a block how many values of another match, and the sums of its pairs' terms; null where all of them are."""
    (qn, vn), (qb, vb) = _parts(q, v, "__g", width), _parts(q, v, "__b", 2 * axes)
    qid, vid = q.column(names[0][0]).to_numpy(), v.column(names[1][0]).to_numpy()
    n, known, total = np.zeros(len(qid), np.int64), np.zeros((len(measures), len(qid)), np.int64), np.zeros((len(measures), len(qid)))
    with arrays.numbers():
        for some, other, hit, (d,) in _near_tiles(qn, vn, qb, vb, axes, shapes, asked, True):
            hit = hit & (d > asked.least) & (qid[some][:, None] != vid[other][None])
            count = np.count_nonzero(hit, axis=1)
            n[some] += count
            row = np.repeat(np.arange(len(some)), count)
            own = lambda k: arrays.Numbers(qn[k][some[row]])  # noqa: B023, E731
            its = lambda k: arrays.Numbers(vn[k][other[np.nonzero(hit)[1]]])  # noqa: B023, E731
            for t, f in enumerate(asked.terms.values()):
                x = arrays.plain(f(arrays.Numbers(d[hit]), own, its))
                total[t, some] += np.bincount(row, x.v if x.null is None else np.where(x.null, 0.0, x.v), len(some))
                known[t, some] += count if x.null is None else np.bincount(row[~x.null], minlength=len(some))
    some = np.flatnonzero(n)
    columns = [q.column(c).combine_chunks().take(pa.array(some)) for c in names[0]]
    sums = [pa.array(x[some], mask=k[some] == 0) for x, k in zip(total, known, strict=True)]
    yield pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns), pa.array(n[some]), *sums], names=[*names[0], "__n", *measures])


def _batch(made, qt: pa.Table, vt: pa.Table, names, measures) -> pa.RecordBatch:
    a, b, *values = (np.concatenate(x) for x in zip(*made, strict=True))
    columns = [t.column(n).chunk(0).take(pa.array(at)) for t, at, own in ((qt, a, names[0]), (vt, b, names[1])) for n in own]
    return pa.RecordBatch.from_arrays([*columns, *map(pa.array, values)], names=[*names[0], *names[1], *measures])


def _candidates(rows: slice, qn, vn, shapes, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (from the first of ``rows``) that are among the nearest of their query."""
    qg, vg = (filled(g, lambda k, n=n, at=at: arrays.Numbers(n[k][at])) for g, n, at in zip(shapes, (qn, vn), ((rows, None), (None, slice(None))), strict=True))
    d = G.distance(qg, vg)
    d = d.v if d.null is None else np.where(d.null, np.inf, d.v)
    k = min(asked.first, d.shape[1]) - 1
    return np.nonzero(d <= np.partition(d, k, axis=1)[:, k : k + 1])


def _holds(a, b, qn, vn, shapes, asked: Asked, measured: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which pairs of rows ``a`` of the queries and ``b`` of the values match, and their measures."""
    qg = filled(shapes[0], lambda k: arrays.Numbers(qn[k][a]))
    vg = filled(shapes[1], lambda k: arrays.Numbers(vn[k][b]))
    if asked.kind == "ray":
        lo, hi = G.ray_interval(qg, vg)
        return ((lo <= hi) & (hi >= 0)).true(), [np.maximum(lo.v, 0.0), hi.v]
    if asked.kind == "intersects":
        hit, values = G.intersects(qg, vg), [G.distance(qg, vg).v] if measured else []
    else:
        d = G.distance(qg, vg)
        hit = d < G.INF if asked.kind == "nearest" else d <= (asked.radius if asked.radius is not None else arrays.Numbers(qn[-1][a]))
        values = [d.v] if measured else []
    shape = np.broadcast_shapes(*(np.shape(n[0][at]) for n, at in ((qn, a), (vn, b))))
    return np.broadcast_to(hit.true(), shape), values


# -- nearest values ------------------------------------------------------------------------------------------------------

#: Values of a leaf on average, leaves at most, distances that a task holds at a time, queries of a task on average.
LEAF, LEAVES, DISTANCES, QUERIES = 128, 4_096, 1 << 16, 4_096
#: Types of columns that a condition on pairs may read on arrays.
NUMERIC = ("byte", "short", "integer", "long", "float", "double", "boolean")


def on_arrays(f: Callable, *args) -> bool:
    """Whether ``f`` can be evaluated on arrays: a condition or metric of a caller may use functions of columns only."""
    try:
        with arrays.numbers():
            return isinstance(arrays.plain(f(*args)), arrays.Numbers)
    except Exception:  # whatever Spark or numpy say to operands that aren't theirs
        return False


@dataclasses.dataclass(frozen=True)
class Near:
    """How the nearest are found on arrays: shapes, metric, condition, most values of a query, and reach for a distance of 1."""

    shapes: Sequence
    metric: Callable
    where: Callable | None
    most: int
    factor: float

    def distances(self, q: _Rows, v: _Rows, rows: slice) -> np.ndarray:
        """Of ``rows`` of the queries to all values; infinite where the condition doesn't hold."""
        qg = filled(self.shapes[0], lambda k: arrays.Numbers(q.g[k][rows][:, None]))
        vg = filled(self.shapes[1], lambda k: arrays.Numbers(v.g[k][None]))
        with arrays.numbers():
            d = arrays.plain(self.metric(qg, vg))
            ok = d < G.INF
            if self.where:
                ok = ok & self.where(lambda n: q.column("q_" + n, (rows, None)), lambda n: v.column("v_" + n, (None, slice(None))))
        return np.broadcast_to(np.where(ok.true(), d.v + 0.0, np.inf), (len(q.g[0][rows]), v.n))


class _Rows:
    """Rows of one side: coordinates as arrays, and columns that a condition reads."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.n, self.known = batch, batch.num_rows, {}
        flat = batch.column("__g").flatten().to_numpy()
        self.g = [np.ascontiguousarray(x) for x in flat.reshape(self.n, -1).T]

    def column(self, name: str, at) -> arrays.Numbers:
        if name not in self.known:
            c = self.batch.column(name)
            gaps = c.is_null().to_numpy(zero_copy_only=False) if c.null_count else None
            self.known[name] = c.fill_null(False if pa.types.is_boolean(c.type) else 0).to_numpy(zero_copy_only=False), gaps
        return arrays.Numbers(*(x if x is None else x[at] for x in self.known[name]))


class _Boxes:
    """The boxes of leaves, and how far a query's box is from them."""

    def __init__(self, side: _Side):
        self.lo, self.hi, self.n = np.array(side.lo, float), np.array(side.hi, float), np.array(side.n)

    def gaps(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
        b = batch.column("__b").flatten().to_numpy().reshape(batch.num_rows, 2, -1)
        step = max(1, DISTANCES // len(self.n))
        for start in range(0, len(b), step):
            some, square = b[start : start + step], 0.0
            for k in range(b.shape[2]):
                gap = np.maximum(self.lo[None, :, k] - some[:, 1, k, None], some[:, 0, k, None] - self.hi[None, :, k])
                square = square + np.maximum(gap, 0.0) ** 2
            yield slice(start, start + step), np.sqrt(square)


def _first_look(boxes: _Boxes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with the nearest leaf that has as many values as they ask for (and one more, as a condition may leave one out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit, home = batch.column("__limit").to_numpy(), np.empty(batch.num_rows, np.int32)
            for rows, gap in boxes.gaps(batch):
                home[rows] = np.where(boxes.n[None] > limit[rows][:, None], gap, np.inf).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "__block"])

    return run


def _meet_leaves(q: DataFrame, v: DataFrame, qid: Column, act: Callable, schema: T.StructType, leaves_: int) -> DataFrame:
    """What ``act`` gives for rows of queries and the values of their leaf ``__block``: a task holds the values of one leaf and streams the queries.

    Where many queries ask for one leaf, they are dealt in shares of ROWS on average, each with a copy of its values.
    """
    asked = {r[0]: r[1] for r in q.groupBy("__block").count().collect()}  # at most one row a leaf
    shares = F.from_json(F.lit(json.dumps([-(-asked.get(b, 0) // ROWS) for b in range(leaves_)])), "array<int>")
    share = F.element_at(shares, F.col("__block") + 1)
    pair = F.col("__block").cast("long") * (1 << 24)
    v = v.where(share > 0).withColumn("__share", F.explode(F.sequence(F.lit(0), F.greatest(share - 1, F.lit(0)))))
    v = v.select((pair + F.col("__share")).alias("__pair"), F.lit(0).alias("__side"), *(c for c in v.columns if c not in ("__block", "__share")))
    q = q.select((pair + F.pmod(F.xxhash64(qid), share)).alias("__pair"), F.lit(1).alias("__side"), *(c for c in q.columns if c != "__block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, values = None, [], None
        for b in batches:
            keys = b.column("__pair").to_numpy() * 2 + b.column("__side").to_numpy()
            ends = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(ends, ends[1:], strict=False):
                if i == j:
                    continue
                if keys[i] // 2 != at:
                    at, held, values = keys[i] // 2, [], None
                if keys[i] % 2 == 0:
                    held.append(b.slice(i, j - i))
                    continue
                if values is None:
                    values = _Rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                yield from act(b.slice(i, j - i), values)

    tasks = max(1, min(TASKS, len(asked), -(-sum(asked.values()) // QUERIES)))
    dealt = q.unionByName(v, allowMissingColumns=True).repartition(tasks, "__pair").sortWithinPartitions("__pair", "__side")
    return dealt.mapInArrow(run, schema)


def nearest_values(q: DataFrame, v: DataFrame, qg: G.Geometry, vg: G.Geometry, qbox: G.Box, vbox: G.Box, qid: Column, vid: Column, carried: Sequence[Sequence[str]], limit: Column, near: Near, rows: int) -> tuple[DataFrame, DataFrame]:
    """The ``carried`` columns and ``distance`` of values among which are the ``limit`` nearest of each query, and the queries (carried columns) that are left, as their leaf has too few.

    Values are cut into leaves of about LEAF. A query's nearest leaf gives it a distance within which it has its values;
    then it meets the leaves within that distance, each of which returns its first values by (distance, first carried
    column). Leaves grow only with the values beyond LEAVES * LEAF, so the work follows the queries.
    """
    names = [list(dict.fromkeys(c)) for c in carried]
    side = _Side(v, vbox, vid, rows, max(1, min(LEAVES, rows // max(LEAF, 4 * near.most))), 1 << 16)
    boxes = _Boxes(side)
    coordinates = lambda g: F.array(*(x.cast("double") for x in leaves(g))).alias("__g")
    asked = q.select(*names[0], limit.cast("int").alias("__limit"), coordinates(qg), F.array(*qbox.lo, *qbox.hi).alias("__b"))
    values = materialize(side.df.select(*names[1], coordinates(vg), "__block"), "leaves")
    homes = T.StructType([*asked.schema.fields, T.StructField("__block", T.IntegerType())])
    asked = materialize(asked.mapInArrow(_first_look(boxes), homes), "homes")

    def reach(batch: pa.RecordBatch, v: _Rows) -> Iterator[pa.RecordBatch]:
        limit, out = batch.column("__limit").to_numpy(), np.full(batch.num_rows, np.inf)
        q, step = _Rows(batch), max(1, DISTANCES // v.n)
        for start in range(0, q.n, step):
            some = slice(start, start + step)
            d, k = near.distances(q, v, some), limit[some].astype(np.int64)
            m = min(near.most, v.n)
            first = np.sort(np.partition(d, m - 1, axis=1)[:, :m] if m < v.n else d, axis=1)
            out[some] = np.where(k <= m, np.take_along_axis(first, np.minimum(k, m)[:, None] - 1, 1)[:, 0], np.inf)
        found = [np.zeros(0, np.int32)]
        count = np.zeros(q.n, np.int32)
        for some, gap in boxes.gaps(batch):
            i, j = np.nonzero((gap <= out[some][:, None] * near.factor) & (out[some] < np.inf)[:, None])
            count[some] = np.bincount(i, minlength=len(gap))
            found.append(j.astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(np.concatenate(found)))
        kept = [batch.column(n) for n in asked_names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out), lists], names=[*asked_names, "__reach", "__blocks"])

    asked_names = [*names[0], "__limit", "__g"]
    fields = [*(asked.schema[n] for n in asked_names), T.StructField("__reach", T.DoubleType()), T.StructField("__blocks", T.ArrayType(T.IntegerType()))]
    reached = materialize(_meet_leaves(asked, values, qid, reach, T.StructType(fields), len(side.n)), "reach")

    def nearest(batch: pa.RecordBatch, v: _Rows) -> Iterator[pa.RecordBatch]:
        q, step, ids = _Rows(batch), max(1, DISTANCES // v.n), v.batch.column(names[1][0]).to_numpy()
        limit, reach = batch.column("__limit").to_numpy(), batch.column("__reach").to_numpy()
        made = []
        for start in range(0, q.n, step):
            some = slice(start, start + step)
            d = near.distances(q, v, some)
            i, j = np.nonzero((d <= reach[some][:, None]) & (d < np.inf))
            x = d[i, j]
            if len(i) and (np.bincount(i) > limit[some][: i[-1] + 1]).any():
                order = np.lexsort((ids[j], x, i))
                i, j, x = i[order], j[order], x[order]
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                first = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < limit[some][i]
                i, j, x = i[first], j[first], x[first]
            made.append((i + start, j, x))
        i, j, x = (np.concatenate(c) for c in zip(*made, strict=True))
        columns = [t.column(n).take(pa.array(at)) for t, at, own in ((batch, i, names[0]), (v.batch, j, names[1])) for n in own]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(x)], names=[*names[0], *names[1], "distance"])

    fields = [*(asked.schema[n] for n in names[0]), *(values.schema[n] for n in names[1]), T.StructField("distance", T.DoubleType())]
    again = reached.select("*", F.explode("__blocks").alias("__block")).drop("__blocks")
    found = _meet_leaves(again, values, qid, nearest, T.StructType(fields), len(side.n))
    return found, reached.where(~(F.col("__reach") < G.INF)).select(*names[0])
