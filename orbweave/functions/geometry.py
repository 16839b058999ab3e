"""Geometries over columns, and scalar functions on them as Column expressions.

A geometry is a small object that holds the columns of its coordinates, so every function is an expression of plain
arithmetic that whole-stage code generation compiles. All comparisons are closed: what touches, intersects. A null
coordinate gives a null result, which no filter or join matches. Divisions go through ``try_divide`` or are guarded,
since ANSI mode raises on zero.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column

from orbweave.functions import arrays as F
from orbweave.functions.errors import GeometryError

Number = Column | float | int | str
#: Finite bounds of the empty box.
EMPTY = 3.4028234663852886e38
INF = float("inf")


def _col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _cols(xs: Sequence[Number]) -> list[Column]:
    return [_col(x) for x in xs]


# -- vectors ---------------------------------------------------------------------------------------------------------

Vector = list[Column]


def add(a: Vector, b: Vector) -> Vector:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def times(a: Vector, s: Column) -> Vector:
    return [x * s for x in a]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda x, y: x + y, (x * y for x, y in zip(a, b, strict=True)))


def cross(a: Vector, b: Vector) -> Vector:
    if len(a) != 3 or len(b) != 3:
        raise GeometryError("the cross product needs three dimensions")
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vector) -> Vector:
    """Unit vector; a zero vector stays zero, and -0.0 becomes 0.0."""
    n = norm(a)
    return [F.when(n > 0, F.try_divide(x, n)).otherwise(x) + F.lit(0.0) for x in a]


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def least(xs: Sequence[Column]) -> Column:
    return xs[0] if len(xs) == 1 else F.least(*xs)


def greatest(xs: Sequence[Column]) -> Column:
    return xs[0] if len(xs) == 1 else F.greatest(*xs)


def let(values: dict[str, Column], body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``body`` over values that are computed once, whatever the number of times it uses them.

    Column expressions are trees, so what is used ten times is otherwise computed and compiled ten times.
    """
    if F.on():
        return body({k: F.plain(v) for k, v in values.items()}.__getitem__)
    one = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.element_at(F.transform(one, lambda s: body(s.getField)), 1)


# -- geometries ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Geometry:
    @property
    def dim(self) -> int:
        raise NotImplementedError

    @property
    def kind(self) -> str:
        return type(self).__name__.lower()

    def struct(self) -> Column:
        """The geometry as one struct column."""
        raise NotImplementedError


def _point_struct(v: Vector) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(v, _names(len(v)), strict=True)))


def _names(dim: int) -> list[str]:
    return ["x", "y", "z"][:dim] if dim <= 3 else [f"c{i}" for i in range(dim)]


def _of_struct(col: Number, dim: int) -> Vector:
    return [_col(col).getField(n) for n in _names(dim)]


@dataclass(frozen=True)
class Point(Geometry):
    at: Vector

    @staticmethod
    def of(*xs: Number) -> Point:
        return Point(_cols(xs))

    @staticmethod
    def from_struct(col: Number, dim: int) -> Point:
        return Point(_of_struct(col, dim))

    @property
    def dim(self) -> int:
        return len(self.at)

    def struct(self) -> Column:
        return _point_struct(self.at)


@dataclass(frozen=True)
class Box(Geometry):
    lo: Vector
    hi: Vector

    @staticmethod
    def of(lo: Sequence[Number], hi: Sequence[Number]) -> Box:
        return Box(_cols(lo), _cols(hi))

    @staticmethod
    def empty(dim: int) -> Box:
        return Box([F.lit(EMPTY)] * dim, [F.lit(-EMPTY)] * dim)

    @staticmethod
    def from_struct(col: Number, dim: int) -> Box:
        return Box(_of_struct(_col(col).getField("min"), dim), _of_struct(_col(col).getField("max"), dim))

    @property
    def dim(self) -> int:
        return len(self.lo)

    def struct(self) -> Column:
        return F.struct(_point_struct(self.lo).alias("min"), _point_struct(self.hi).alias("max"))


@dataclass(frozen=True)
class Sphere(Geometry):
    c: Vector
    r: Column

    @staticmethod
    def of(c: Sequence[Number], r: Number) -> Sphere:
        return Sphere(_cols(c), _col(r))

    @staticmethod
    def from_struct(col: Number, dim: int) -> Sphere:
        return Sphere(_of_struct(_col(col).getField("c"), dim), _col(col).getField("r"))

    @property
    def dim(self) -> int:
        return len(self.c)

    def struct(self) -> Column:
        return F.struct(_point_struct(self.c).alias("c"), self.r.alias("r"))


class _Corners(Geometry):
    """Geometries given by their corners."""

    NAMES: tuple[str, ...] = ()
    DIMS: tuple[int, ...] = (2, 3)

    @classmethod
    def of(cls, *corners: Sequence[Number]):
        if len(corners) != len(cls.NAMES) or len(corners[0]) not in cls.DIMS:
            raise GeometryError(f"{cls.__name__} takes {len(cls.NAMES)} corners in {' or '.join(map(str, cls.DIMS))} dimensions")
        return cls(*(_cols(c) for c in corners))

    @classmethod
    def from_struct(cls, col: Number, dim: int):
        return cls(*(_of_struct(_col(col).getField(n), dim) for n in cls.NAMES))

    @property
    def corners(self) -> list[Vector]:
        return [getattr(self, n) for n in self.NAMES]

    @property
    def dim(self) -> int:
        return len(self.corners[0])

    def struct(self) -> Column:
        return F.struct(*(_point_struct(v).alias(n) for v, n in zip(self.corners, self.NAMES, strict=True)))


@dataclass(frozen=True)
class Segment(_Corners):
    a: Vector
    b: Vector
    NAMES = ("a", "b")


@dataclass(frozen=True)
class Triangle(_Corners):
    a: Vector
    b: Vector
    c: Vector
    NAMES = ("a", "b", "c")


@dataclass(frozen=True)
class Tetrahedron(_Corners):
    a: Vector
    b: Vector
    c: Vector
    d: Vector
    NAMES = ("a", "b", "c", "d")
    DIMS = (3,)


@dataclass(frozen=True)
class Ray(Geometry):
    """``d`` has unit length and no -0.0."""

    o: Vector
    d: Vector

    @staticmethod
    def of(o: Sequence[Number], d: Sequence[Number]) -> Ray:
        if len(o) != 3 or len(d) != 3:
            raise GeometryError("rays have three dimensions")
        return Ray(_cols(o), normalize(_cols(d)))

    @staticmethod
    def from_struct(col: Number, dim: int = 3) -> Ray:
        return Ray(_of_struct(_col(col).getField("o"), 3), _of_struct(_col(col).getField("d"), 3))

    @property
    def dim(self) -> int:
        return 3

    def struct(self) -> Column:
        return F.struct(_point_struct(self.o).alias("o"), _point_struct(self.d).alias("d"))


@dataclass(frozen=True)
class Ellipsoid(Geometry):
    """(x - c)' m (x - c) <= 1; ``m`` is symmetric, row by row."""

    c: Vector
    m: list[Column]

    @staticmethod
    def of(c: Sequence[Number], m: Sequence[Number]) -> Ellipsoid:
        if len(c) not in (2, 3) or len(m) != len(c) ** 2:
            raise GeometryError("an ellipsoid takes a centre in 2 or 3 dimensions and a square matrix")
        return Ellipsoid(_cols(c), _cols(m))

    @property
    def dim(self) -> int:
        return len(self.c)

    def row(self, i: int) -> Vector:
        return self.m[i * self.dim : (i + 1) * self.dim]

    def form(self, x: Vector, y: Vector) -> Column:
        """x' m y."""
        return dot(x, [dot(self.row(i), y) for i in range(self.dim)])

    def struct(self) -> Column:
        return F.struct(_point_struct(self.c).alias("c"), F.array(*self.m).alias("m"))


def kdop_directions(dim: int, k: int) -> list[tuple[int, ...]]:
    """k / 2 directions: the axes, then edge and corner directions of the square or cube with a positive first part."""
    signed = [d for d in itertools.product((-1, 0, 1), repeat=dim) if any(d) and next(x for x in d if x) > 0]
    by_size = {n: sorted((d for d in signed if sum(map(abs, d)) == n), reverse=True) for n in range(1, dim + 1)}
    edges, corners = by_size.get(2, []), by_size.get(3, [])
    choice = {(2, 4): by_size[1], (2, 8): by_size[1] + edges}
    if dim == 3:
        choice = {(3, 6): by_size[1], (3, 14): by_size[1] + corners, (3, 18): by_size[1] + edges, (3, 26): by_size[1] + edges + corners}
    if (dim, k) not in choice:
        raise GeometryError(f"no {k}-DOP in {dim} dimensions")
    return choice[dim, k]


@dataclass(frozen=True)
class KDOP(Geometry):
    """Bounds ``lo`` and ``hi`` of the projections on :func:`kdop_directions`."""

    lo: list[Column]
    hi: list[Column]
    n: int

    @staticmethod
    def empty(dim: int, k: int) -> KDOP:
        kdop_directions(dim, k)
        return KDOP([F.lit(EMPTY)] * (k // 2), [F.lit(-EMPTY)] * (k // 2), dim)

    @staticmethod
    def around(geometry: Geometry, k: int) -> KDOP:
        return expand(KDOP.empty(geometry.dim, k), geometry)

    @property
    def dim(self) -> int:
        return self.n

    @property
    def k(self) -> int:
        return 2 * len(self.lo)

    @property
    def directions(self) -> list[tuple[int, ...]]:
        return kdop_directions(self.n, self.k)

    def struct(self) -> Column:
        return F.struct(F.array(*self.lo).alias("lo"), F.array(*self.hi).alias("hi"))


def project(v: Vector, direction: tuple[int, ...]) -> Column:
    """Dot product with a direction of -1, 0 and 1."""
    parts = [x if d > 0 else -x for x, d in zip(v, direction, strict=True) if d]
    return reduce(lambda a, b: a + b, parts)


# -- dispatch --------------------------------------------------------------------------------------------------------

_INTERSECTS: dict[tuple[type, type], Callable] = {}
_DISTANCE: dict[tuple[type, type], Callable] = {}


def _rule(table: dict, a: type, b: type) -> Callable:
    def put(f: Callable) -> Callable:
        table[a, b] = f
        return f

    return put


def _dispatch(table: dict, name: str, a: Geometry, b: Geometry) -> Column:
    if a.dim != b.dim:
        raise GeometryError(f"{name} of {a.dim} and {b.dim} dimensions")
    if f := table.get((type(a), type(b))):
        return f(a, b)
    if f := table.get((type(b), type(a))):
        return f(b, a)
    raise GeometryError(f"no {name} for {a.kind} and {b.kind}")


def intersects(a: Geometry, b: Geometry) -> Column:
    """Whether the closed sets meet; symmetric in its arguments."""
    return _dispatch(_INTERSECTS, "intersects", a, b)


def distance(a: Geometry, b: Geometry) -> Column:
    """Smallest distance, 0 where they meet; for a ray and a box the way along the ray, infinite for a miss."""
    return _dispatch(_DISTANCE, "distance", a, b)


# -- closest points and distances ------------------------------------------------------------------------------------


def _clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (F.lit(float(v)) if isinstance(v, int | float) else v for v in (lo, hi))
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def closest_point(p: Point, g: Geometry) -> Point:
    """The point of ``g`` (box, segment or triangle) that is closest to ``p``."""
    if isinstance(g, Box):
        return Point([_clamp(x, lo, hi) for x, lo, hi in zip(p.at, g.lo, g.hi, strict=True)])
    if isinstance(g, Segment):
        d = sub(g.b, g.a)
        t = F.coalesce(F.try_divide(dot(sub(p.at, g.a), d), dot(d, d)), F.lit(0.0))
        t = _clamp(t, 0.0, 1.0)
        return Point([F.when(x.isNull() | t.isNull(), F.lit(None)).otherwise(a + s * t) for x, a, s in zip(p.at, g.a, d, strict=True)])
    if isinstance(g, Triangle):
        return _closest_on_triangle(p, g)
    raise GeometryError(f"no closest point of a {g.kind}")


def _closest_on_triangle(p: Point, t: Triangle) -> Point:
    """By the Voronoi regions of corners, edges and face."""
    if F.on() and all(x.null is None for v in (p.at, *t.corners) for x in v):
        return _closest_numbers(p, t)
    ab, ac = sub(t.b, t.a), sub(t.c, t.a)
    ap, bp, cp = sub(p.at, t.a), sub(p.at, t.b), sub(p.at, t.c)
    dots = {f"d{i + 1}": dot(u, v) for i, (u, v) in enumerate(itertools.product((ap, bp, cp), (ab, ac)))}

    def weights(g: Callable[[str], Column]) -> Column:
        d1, d2, d3, d4, d5, d6 = (g(f"d{i}") for i in range(1, 7))
        va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
        zero, one = F.lit(0.0), F.lit(1.0)
        on_bc = F.try_divide(d4 - d3, (d4 - d3) + (d5 - d6))
        at = lambda v, w, kind: F.struct(v.alias("v"), w.alias("w"), F.lit(kind).alias("kind"))
        return (
            F.when((d1 <= 0) & (d2 <= 0), at(zero, zero, 0)).when((d3 >= 0) & (d4 <= d3), at(one, zero, 1)).when((d6 >= 0) & (d5 <= d6), at(zero, one, 2))
            .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), at(F.try_divide(d1, d1 - d3), zero, 3)).when((vb <= 0) & (d2 >= 0) & (d6 <= 0), at(zero, F.try_divide(d2, d2 - d6), 4))
            .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), at(zero, on_bc, 5)).otherwise(at(F.try_divide(vb, va + vb + vc), F.try_divide(vc, va + vb + vc), 6))
        )

    w = let(dots, weights)
    on = [f"{n}{i}" for n in ("a", "b", "c") for i in range(p.dim)]
    corners = dict(zip(on, [*t.a, *t.b, *t.c], strict=True))

    def place(g: Callable[[str], Column]) -> Column:
        k, v, u = g("w").getField("kind"), g("w").getField("v"), g("w").getField("w")
        out = []
        for i in range(p.dim):
            a, b, c = g(f"a{i}"), g(f"b{i}"), g(f"c{i}")
            on_edge = F.when(k == 3, a + (b - a) * v).when(k == 4, a + (c - a) * u).when(k == 5, b + (c - b) * u)
            out.append(F.when(k == 0, a).when(k == 1, b).when(k == 2, c).when(k <= 5, on_edge).otherwise(a + (b - a) * v + (c - a) * u).alias(f"x{i}"))
        return F.struct(*out)

    at = let(corners | {"w": w}, place)
    return Point([at.getField(f"x{i}") for i in range(p.dim)])


def _closest_numbers(p: Point, t: Triangle) -> Point:
    """:func:`_closest_on_triangle` on arrays without nulls: the regions are numbered first, and each sum is done once for all of them."""
    ab, ac, bc = sub(t.b, t.a), sub(t.c, t.a), sub(t.c, t.b)
    d1, d2, d3, d4, d5, d6 = (dot(u, v).v for u, v in itertools.product((sub(p.at, c) for c in t.corners), (ab, ac)))
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    up, on = d4 - d3, d5 - d6
    regions = [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (d6 >= 0) & (d5 <= d6), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (up >= 0) & (on >= 0)]
    left, own = ~regions[0], [regions[0]]
    for region in regions[1:]:
        own.append(region & left)
        left = left & ~region
    by, over = np.where(left, vb, 0.0), np.where(left, va + vb + vc, 1.0)
    by, over = np.where(own[3], d1, by), np.where(own[3], d1 - d3, over)
    to, under = np.where(left, vc, 0.0), np.where(left, over, 1.0)
    for region, x, y in ((own[4], d2, d2 - d6), (own[5], up, up + on)):
        to, under = np.where(region, x, to), np.where(region, y, under)
    nothing = (over == 0) | (under == 0)
    v, w = by / np.where(over == 0, 1.0, over), to / np.where(under == 0, 1.0, under)
    from_b, null = own[1] | own[5], nothing if nothing.any() else None
    out = []
    for i in range(p.dim):
        x = np.where(from_b, t.b[i].v + bc[i].v * w, t.a[i].v + ab[i].v * v + ac[i].v * w)
        out.append(F.Numbers(np.where(own[2], t.c[i].v, x), null))
    return Point(out)


@_rule(_DISTANCE, Point, Point)
def _(a: Point, b: Point) -> Column:
    return norm(sub(b.at, a.at))


@_rule(_DISTANCE, Point, Box)
def _(p: Point, b: Box) -> Column:
    return norm(sub(p.at, closest_point(p, b).at))


@_rule(_DISTANCE, Point, Sphere)
def _(p: Point, s: Sphere) -> Column:
    return F.greatest(norm(sub(p.at, s.c)) - s.r, F.lit(0.0))


@_rule(_DISTANCE, Sphere, Sphere)
def _(a: Sphere, b: Sphere) -> Column:
    return F.greatest(norm(sub(b.c, a.c)) - a.r - b.r, F.lit(0.0))


@_rule(_DISTANCE, Point, Triangle)
def _(p: Point, t: Triangle) -> Column:
    closest = F.struct(*(x.alias(f"x{i}") for i, x in enumerate(closest_point(p, t).at)))
    at = {f"p{i}": x for i, x in enumerate(p.at)} | {"c": closest}
    return let(at, lambda g: norm([g(f"p{i}") - g("c").getField(f"x{i}") for i in range(p.dim)]))


@_rule(_DISTANCE, Point, Segment)
def _(p: Point, s: Segment) -> Column:
    return norm(sub(p.at, closest_point(p, s).at))


def _faces(t: Tetrahedron) -> list[tuple[Triangle, Vector]]:
    """Each face with the corner opposite to it."""
    c = t.corners
    return [(Triangle(*(c[j] for j in range(4) if j != i)), c[i]) for i in range(4)]


def _inner_side(p: Point, face: Triangle, opposite: Vector) -> Column:
    """Non-negative where ``p`` is on the side of ``opposite``."""
    n = cross(sub(face.b, face.a), sub(face.c, face.a))
    return dot(n, sub(opposite, face.a)) * dot(n, sub(p.at, face.a))


@_rule(_DISTANCE, Point, Tetrahedron)
def _(p: Point, t: Tetrahedron) -> Column:
    parts = [F.when(_inner_side(p, f, o) >= 0, F.lit(INF)).otherwise(distance(p, f)) for f, o in _faces(t)]
    return let({"v": F.least(*parts)}, lambda g: F.when(g("v") == INF, F.lit(0.0)).otherwise(g("v")))


@_rule(_DISTANCE, Box, Box)
def _(a: Box, b: Box) -> Column:
    gaps = [F.greatest(x - v, u - y, F.lit(0.0)) for x, y, u, v in zip(a.lo, a.hi, b.lo, b.hi, strict=True)]
    return F.when(_empty(a) | _empty(b), F.lit(INF)).otherwise(norm(gaps))


def _empty(b: Box) -> Column:
    return _any([lo > hi for lo, hi in zip(b.lo, b.hi, strict=True)])


@_rule(_DISTANCE, Sphere, Box)
def _(s: Sphere, b: Box) -> Column:
    return F.greatest(distance(Point(s.c), b) - s.r, F.lit(0.0))


def _entry(lo: Column, hi: Column) -> Column:
    return let({"lo": lo, "hi": hi}, lambda g: F.when((g("lo") <= g("hi")) & (g("hi") >= 0), F.greatest(g("lo"), F.lit(0.0))).otherwise(F.lit(INF)))


@_rule(_DISTANCE, Ray, Box)
def _(r: Ray, b: Box) -> Column:
    return _entry(*ray_box(r, b))


@_rule(_DISTANCE, Ray, Sphere)
def _(r: Ray, s: Sphere) -> Column:
    return _entry(*ray_sphere(r, s))


@_rule(_DISTANCE, Ray, Triangle)
def _(r: Ray, t: Triangle) -> Column:
    return _entry(*ray_triangle(r, t))


# -- rays ------------------------------------------------------------------------------------------------------------


def ray_box(r: Ray, b: Box) -> tuple[Column, Column]:
    """Where the line of the ray enters and leaves the box; enters after it leaves for a miss."""
    lows, highs = [], []
    for o, d, lo, hi in zip(r.o, r.d, b.lo, b.hi, strict=True):
        t0, t1 = F.try_divide(lo - o, d), F.try_divide(hi - o, d)
        inside = (o >= lo) & (o <= hi)
        lows.append(F.when(d == 0, F.when(inside, F.lit(-INF)).otherwise(F.lit(INF))).otherwise(F.least(t0, t1)))
        highs.append(F.when(d == 0, F.when(inside, F.lit(INF)).otherwise(F.lit(-INF))).otherwise(F.greatest(t0, t1)))
    return F.greatest(*lows), F.least(*highs)


def ray_sphere(r: Ray, s: Sphere) -> tuple[Column, Column]:
    """Where the line of the ray enters and leaves the sphere; (inf, -inf) for a miss. The larger root is found first."""
    oc = sub(r.o, s.c)
    a, b, c = dot(r.d, r.d), F.lit(2.0) * dot(oc, r.d), dot(oc, oc) - s.r * s.r
    disc = b * b - F.lit(4.0) * a * c
    q = F.lit(-0.5) * (b + F.when(b < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.sqrt(F.greatest(disc, F.lit(0.0))))
    t0, t1 = F.try_divide(q, a), F.coalesce(F.try_divide(c, q), F.try_divide(q, a))
    return F.when(disc < 0, F.lit(INF)).otherwise(F.least(t0, t1)), F.when(disc < 0, F.lit(-INF)).otherwise(F.greatest(t0, t1))


def ray_triangle(r: Ray, t: Triangle, eps: float = 1e-12) -> tuple[Column, Column]:
    """Where the line of the ray enters and leaves the triangle: equal unless it lies in its plane; (inf, -inf) for a miss.

    Space is sheared so that the line becomes the axis along which it goes fastest. A corner then has two coordinates
    that depend on the corner and the ray only, and an edge one signed area, whose sign turns exactly where the edge is
    another triangle's too. The line meets the triangle where no two areas differ in sign, so it can't slip through a
    shared edge or corner. In the triangle's plane (within ``eps``) the inward side of each edge is a linear function
    along the line, and the three give an interval.
    """
    corners = t.corners
    names = [f"{n}{i}" for n in "odabc" for i in range(3)]
    got = lambda g, n: [g(f"{n}{i}") for i in range(3)]

    def planes(g: Callable[[str], Column]) -> Column:
        a, b, c = (got(g, n) for n in "abc")
        return F.struct(*(x.alias(f"n{i}") for i, x in enumerate(cross(sub(b, a), sub(c, a)))))

    def sides(g: Callable[[str], Column]) -> Column:
        o, d, v = got(g, "o"), got(g, "d"), [got(g, n) for n in "abc"]
        n = [g("plane").getField(f"n{i}") for i in range(3)]
        out = {"size": dot(n, n), "slope": dot(n, d), "height": dot(n, sub(v[0], o))}
        for i in range(3):
            edge = sub(v[(i + 1) % 3], v[i])
            out |= {f"u{i}": dot(cross(edge, sub(o, v[i])), n), f"w{i}": dot(cross(edge, d), n)}
        return F.struct(*(x.alias(k) for k, x in out.items()))

    def interval(g: Callable[[str], Column]) -> Column:
        s = g("s").getField
        size, slope, height, u, w = s("size"), s("slope"), s("height"), [s(f"u{i}") for i in range(3)], [s(f"w{i}") for i in range(3)]
        bound = [F.try_divide(-x, y) for x, y in zip(u, w, strict=True)]
        lo = F.greatest(*(F.when(y > 0, x).when((y == 0) & (v < 0), F.lit(INF)).otherwise(F.lit(-INF)) for v, y, x in zip(u, w, bound, strict=True)))
        hi = F.least(*(F.when(y < 0, x).when((y == 0) & (v < 0), F.lit(-INF)).otherwise(F.lit(INF)) for v, y, x in zip(u, w, bound, strict=True)))
        flat = (slope * slope <= F.lit(eps) * size) & (height * height <= F.lit(eps) * size) & (size > 0)
        return F.struct((flat & (lo <= hi)).alias("along"), lo.alias("lo"), hi.alias("hi"))

    def turned(g: Callable[[str], Column]) -> Column:
        """Direction and corners, seen from the origin, with the axis of the fastest way last."""
        o, d, v = got(g, "o"), got(g, "d"), [got(g, n) for n in "abc"]
        x, y, z = (F.abs(c) for c in d)
        first, second = (x >= y) & (x >= z), y >= z
        pick = lambda c, k: F.when(first, c[k]).when(second, c[(k + 1) % 3]).otherwise(c[(k + 2) % 3])
        return F.struct(*(pick(c, (k + 1) % 3).alias(f"{n}{k}") for n, c in (("d", d), *((m, sub(c, o)) for m, c in zip("abc", v, strict=True))) for k in range(3)))

    def sheared(g: Callable[[str], Column]) -> Column:
        t = g("t").getField
        return F.struct(*((t(f"{n}{k}") - F.try_divide(t(f"d{k}"), t("d2")) * t(f"{n}2")).alias(f"{n}{k}") for n in "abc" for k in range(2)), *(F.try_divide(t(f"{n}2"), t("d2")).alias(f"{n}2") for n in "abc"))

    def areas(g: Callable[[str], Column]) -> Column:
        p = g("p").getField
        return F.struct(*((p(f"{m}0") * p(f"{n}1") - p(f"{m}1") * p(f"{n}0")).alias(x) for x, m, n in (("u", "c", "b"), ("v", "a", "c"), ("w", "b", "a"))), *(p(f"{n}2").alias(f"{n}2") for n in "abc"))

    def hits(g: Callable[[str], Column]) -> Column:
        """Where the line meets the triangle; null for a miss."""
        e = g("e").getField
        u = [e(x) for x in "uvw"]
        one_side = _all([x >= 0 for x in u]) | _all([x <= 0 for x in u])
        return F.when(one_side, F.try_divide(u[0] * e("a2") + u[1] * e("b2") + u[2] * e("c2"), u[0] + u[1] + u[2]))

    def ends(g: Callable[[str], Column]) -> Column:
        i, hit = g("i").getField, g("hit")
        return F.struct(*(F.when(i("along"), i(k)).otherwise(F.coalesce(hit, F.lit(miss))).alias(k) for k, miss in (("lo", INF), ("hi", -INF))))

    def nowhere_flat(g: Callable[[str], Column]) -> bool:
        """Of arrays, whether no line lies in the plane of its triangle, so that the inward sides need not be computed."""
        o, d, v = got(g, "o"), got(g, "d"), [got(g, n) for n in "abc"]
        n = cross(sub(v[1], v[0]), sub(v[2], v[0]))
        size, slope, height = dot(n, n), dot(n, d), dot(n, sub(v[0], o))
        return not np.any(((slope * slope <= F.lit(eps) * size) & (height * height <= F.lit(eps) * size) & (size > 0)).true())

    def whole(g: Callable[[str], Column]) -> Column:
        if F.on() and nowhere_flat(g):
            hit = let({"e": let({"p": let({"t": let({n: g(n) for n in names}, turned)}, sheared)}, areas)}, hits)
            return F.struct(*(F.coalesce(hit, F.lit(miss)).alias(k) for k, miss in (("lo", INF), ("hi", -INF))))
        every = {n: g(n) for n in names}
        flat = let({"s": let(every | {"plane": let({n: g(n) for n in names[6:]}, planes)}, sides)}, interval)
        areas_ = let({"p": let({"t": let(every, turned)}, sheared)}, areas)
        return let({"i": flat, "hit": let({"e": areas_}, hits)}, ends)

    out = let(dict(zip(names, [*r.o, *r.d, *(x for c in corners for x in c)], strict=True)), whole)
    return out.getField("lo"), out.getField("hi")


def ray_interval(r: Ray, g: Geometry) -> tuple[Column, Column]:
    f = {Box: ray_box, Sphere: ray_sphere, Triangle: ray_triangle}.get(type(g))
    if f is None:
        raise GeometryError(f"no ray intersection with a {g.kind}")
    return f(r, g)


def overlap_distance(r: Ray, g: Geometry) -> tuple[Column, Column]:
    """Length of the ray inside ``g`` in front of its origin, and the way to where it enters (0 and infinite for a miss)."""
    lo, hi = ray_interval(r, g)
    front = (lo <= hi) & (hi >= 0)
    start = F.greatest(lo, F.lit(0.0))
    return F.when(front, hi - start).otherwise(F.lit(0.0)), F.when(front, start).otherwise(F.lit(INF))


# -- intersects ------------------------------------------------------------------------------------------------------


@_rule(_INTERSECTS, Point, Point)
def _(a: Point, b: Point) -> Column:
    return _all([x == y for x, y in zip(a.at, b.at, strict=True)])


@_rule(_INTERSECTS, Box, Box)
def _(a: Box, b: Box) -> Column:
    return _all([(x <= v) & (y >= u) for x, y, u, v in zip(a.lo, a.hi, b.lo, b.hi, strict=True)])


@_rule(_INTERSECTS, Point, Box)
def _(p: Point, b: Box) -> Column:
    return _all([(x >= lo) & (x <= hi) for x, lo, hi in zip(p.at, b.lo, b.hi, strict=True)])


@_rule(_INTERSECTS, Sphere, Box)
def _(s: Sphere, b: Box) -> Column:
    return distance(Point(s.c), b) <= s.r


@_rule(_INTERSECTS, Sphere, Sphere)
def _(a: Sphere, b: Sphere) -> Column:
    return norm(sub(b.c, a.c)) <= a.r + b.r


@_rule(_INTERSECTS, Sphere, Point)
def _(s: Sphere, p: Point) -> Column:
    return norm(sub(p.at, s.c)) <= s.r


@_rule(_INTERSECTS, Sphere, Triangle)
def _(s: Sphere, t: Triangle) -> Column:
    return distance(Point(s.c), t) <= s.r


@_rule(_INTERSECTS, Point, Triangle)
def _(p: Point, t: Triangle) -> Column:
    return _all([w >= 0 for w in barycentric(p, t)])


@_rule(_INTERSECTS, Box, Triangle)
def _(b: Box, t: Triangle) -> Column:
    """Separating axes: the box's, the triangle's normal, and the products of axes and edges."""
    if b.dim != 3:
        raise GeometryError("box and triangle intersect in three dimensions only")
    centre = [(hi + lo) / F.lit(2.0) for lo, hi in zip(b.lo, b.hi, strict=True)]
    once = {f"h{i}": (hi - lo) / F.lit(2.0) for i, (lo, hi) in enumerate(zip(b.lo, b.hi, strict=True))}
    once |= {f"v{j}{i}": x for j, c in enumerate(t.corners) for i, x in enumerate(sub(c, centre))}
    return let(once, _no_separating_axis)


def _no_separating_axis(g: Callable[[str], Column]) -> Column:
    """Of a box around 0 with half extents h and a triangle with corners v."""
    half = [g(f"h{i}") for i in range(3)]
    v = [[g(f"v{j}{i}") for i in range(3)] for j in range(3)]
    edges = [sub(v[1], v[0]), sub(v[2], v[1]), sub(v[0], v[2])]
    meets = [(least([c[i] for c in v]) <= half[i]) & (greatest([c[i] for c in v]) >= -half[i]) for i in range(3)]
    n = cross(edges[0], edges[1])
    meets.append(F.abs(dot(n, v[0])) <= dot(half, [F.abs(x) for x in n]))
    for e in edges:
        for i in range(3):
            j, k = (i + 1) % 3, (i + 2) % 3
            on = [e[j] * c[k] - e[k] * c[j] for c in v]  # on the product of the edge and axis i
            reach = half[k] * F.abs(e[j]) + half[j] * F.abs(e[k])
            meets.append((least(on) <= reach) & (greatest(on) >= -reach))
    return _all(meets)


@_rule(_INTERSECTS, Point, KDOP)
def _(p: Point, k: KDOP) -> Column:
    return _all([(project(p.at, d) >= lo) & (project(p.at, d) <= hi) for d, lo, hi in zip(k.directions, k.lo, k.hi, strict=True)])


@_rule(_INTERSECTS, KDOP, KDOP)
def _(a: KDOP, b: KDOP) -> Column:
    if a.k != b.k:
        raise GeometryError("k-DOPs of different k")
    return _all([(x <= v) & (y >= u) for x, y, u, v in zip(a.lo, a.hi, b.lo, b.hi, strict=True)])


@_rule(_INTERSECTS, KDOP, Box)
def _(k: KDOP, b: Box) -> Column:
    return intersects(k, KDOP.around(b, k.k)) & ~_empty(b)


@_rule(_INTERSECTS, Point, Tetrahedron)
def _(p: Point, t: Tetrahedron) -> Column:
    return _all([_inner_side(p, f, o) >= 0 for f, o in _faces(t)])


def _turn(a: Vector, b: Vector, c: Vector) -> Column:
    """Orientation of three points in the plane: -1, 0 or 1."""
    return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _between(a: Vector, b: Vector, p: Vector) -> Column:
    return _all([(x >= F.least(u, v)) & (x <= F.greatest(u, v)) for u, v, x in zip(a, b, p, strict=True)])


@_rule(_INTERSECTS, Segment, Segment)
def _(s: Segment, t: Segment) -> Column:
    if s.dim != 2:
        raise GeometryError("segments intersect in two dimensions only")
    o1, o2, o3, o4 = _turn(s.a, s.b, t.a), _turn(s.a, s.b, t.b), _turn(t.a, t.b, s.a), _turn(t.a, t.b, s.b)
    touching = [F.also(o == 0, lambda x=x, p=p: _between(x.a, x.b, p)) for o, x, p in ((o1, s, t.a), (o2, s, t.b), (o3, t, s.a), (o4, t, s.b))]
    return ((o1 != o2) & (o3 != o4) & (o1 * o2 <= 0) & (o3 * o4 <= 0) & (o1 * o2 * o3 * o4 != 0)) | _any(touching)


@_rule(_INTERSECTS, Segment, Box)
def _(s: Segment, b: Box) -> Column:
    if s.dim != 2:
        raise GeometryError("segment and box intersect in two dimensions only")
    (x0, y0), (x1, y1) = b.lo, b.hi
    corners = [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    edges = [Segment(corners[i], corners[(i + 1) % 4]) for i in range(4)]
    return intersects(Point(s.a), b) | intersects(Point(s.b), b) | _any([intersects(s, e) for e in edges])


@_rule(_INTERSECTS, Segment, Triangle)
def _(s: Segment, t: Triangle) -> Column:
    if s.dim != 3:
        raise GeometryError("segment and triangle intersect in three dimensions only")
    d = sub(s.b, s.a)
    _, hi = ray_triangle(Ray(s.a, normalize(d)), t)
    return let({"hi": hi, "n": norm(d)}, lambda g: (g("hi") >= 0) & (g("hi") <= g("n")))


@_rule(_INTERSECTS, Ellipsoid, Point)
def _(e: Ellipsoid, p: Point) -> Column:
    d = sub(p.at, e.c)
    return e.form(d, d) <= 1


@_rule(_INTERSECTS, Ellipsoid, Segment)
def _(e: Ellipsoid, s: Segment) -> Column:
    d, back = sub(s.b, s.a), sub(e.c, s.a)
    t = _clamp(F.coalesce(F.try_divide(e.form(d, back), e.form(d, d)), F.lit(0.0)), 0.0, 1.0)
    x = [u + v * t - w for u, v, w in zip(s.a, d, e.c, strict=True)]
    return e.form(x, x) <= 1


@_rule(_INTERSECTS, Ellipsoid, Box)
def _(e: Ellipsoid, b: Box) -> Column:
    """The centre is inside, or the form's least value on an edge (in the plane) or a face is at most 1.

    On a face the free minimum is clamped in each coordinate first and the other coordinate is then minimised again,
    from either side, which gives the least value on the rectangle.
    """
    sides = []
    for i in range(e.dim):
        for bound in (b.lo[i], b.hi[i]):
            free = [j for j in range(e.dim) if j != i]
            x0 = bound - e.c[i]
            m = lambda p, q: e.m[p * e.dim + q]
            lo, hi = [b.lo[j] - e.c[j] for j in free], [b.hi[j] - e.c[j] for j in free]
            if e.dim == 2:
                j = free[0]
                y = _clamp(F.coalesce(F.try_divide(-m(i, j) * x0, m(j, j)), F.lit(0.0)), lo[0], hi[0])
                tries = [[y]]
            else:
                j, k = free
                det = m(j, j) * m(k, k) - m(j, k) * m(j, k)
                y = F.coalesce(F.try_divide(-x0 * (m(i, j) * m(k, k) - m(i, k) * m(j, k)), det), F.lit(0.0))
                z = F.coalesce(F.try_divide(-x0 * (m(i, k) * m(j, j) - m(i, j) * m(j, k)), det), F.lit(0.0))
                y, z = _clamp(y, lo[0], hi[0]), _clamp(z, lo[1], hi[1])
                z1 = _clamp(F.coalesce(F.try_divide(-(m(i, k) * x0 + m(j, k) * y), m(k, k)), F.lit(0.0)), lo[1], hi[1])
                y1 = _clamp(F.coalesce(F.try_divide(-(m(i, j) * x0 + m(j, k) * z), m(j, j)), F.lit(0.0)), lo[0], hi[0])
                tries = [[y, z1], [y1, z]]
            for t in tries:
                x: Vector = [x0] * e.dim
                for j, v in zip(free, t, strict=True):
                    x[j] = v
                sides.append(e.form(x, x) <= 1)
    return intersects(Point(e.c), b) | _any(sides)


@_rule(_INTERSECTS, Ray, Box)
def _(r: Ray, b: Box) -> Column:
    return distance(r, b) < INF


@_rule(_INTERSECTS, Ray, Triangle)
def _(r: Ray, t: Triangle) -> Column:
    return distance(r, t) < INF


@_rule(_INTERSECTS, Ray, Sphere)
def _(r: Ray, s: Sphere) -> Column:
    return distance(r, s) < INF


# -- measures --------------------------------------------------------------------------------------------------------


def barycentric(p: Point, g: Geometry) -> list[Column]:
    """Weights of the corners of a triangle in the plane or a tetrahedron; null for a degenerate one."""
    if isinstance(g, Triangle) and g.dim == 2:
        ab, ac, ap = sub(g.b, g.a), sub(g.c, g.a), sub(p.at, g.a)
        det = ab[0] * ac[1] - ab[1] * ac[0]
        v = F.try_divide(ap[0] * ac[1] - ap[1] * ac[0], det)
        w = F.try_divide(ab[0] * ap[1] - ab[1] * ap[0], det)
        return [F.lit(1.0) - v - w, v, w]
    if isinstance(g, Tetrahedron):
        triple = lambda a, b, c: dot(a, cross(b, c))
        ab, ac, ad, ap = (sub(x, g.a) for x in (g.b, g.c, g.d, p.at))
        bp, bd, bc = sub(p.at, g.b), sub(g.d, g.b), sub(g.c, g.b)
        whole = triple(ab, ac, ad)
        return [F.try_divide(x, whole) for x in (triple(bp, bd, bc), triple(ap, ac, ad), triple(ap, ad, ab), triple(ap, ab, ac))]
    raise GeometryError(f"no barycentric coordinates for a {g.kind} in {g.dim} dimensions")


def centroid(g: Geometry) -> Point:
    """Mean of the corners; centre of boxes, k-DOPs (of their box), spheres and ellipsoids; a ray's origin."""
    if isinstance(g, Point):
        return g
    if isinstance(g, Box):
        return Point([(lo + hi) / F.lit(2.0) for lo, hi in zip(g.lo, g.hi, strict=True)])
    if isinstance(g, KDOP):
        return centroid(Box(g.lo[: g.dim], g.hi[: g.dim]))
    if isinstance(g, Sphere | Ellipsoid):
        return Point(g.c)
    if isinstance(g, Ray):
        return Point(g.o)
    corners = g.corners
    return Point([reduce(lambda x, y: x + y, xs) / F.lit(float(len(corners))) for xs in zip(*corners, strict=True)])


def _parts(g: Geometry) -> list[Column]:
    if isinstance(g, Point):
        return g.at
    if isinstance(g, Box):
        return [*g.lo, *g.hi]
    if isinstance(g, Sphere):
        return [*g.c, g.r]
    if isinstance(g, Ray):
        return [*g.o, *g.d]
    raise GeometryError(f"no equality of {g.kind}s")


def equals(a: Geometry, b: Geometry) -> Column:
    """Exact equality of two points, boxes, spheres or rays."""
    if type(a) is not type(b) or a.dim != b.dim:
        raise GeometryError(f"no equality of {a.kind} and {b.kind}")
    return _all([x == y for x, y in zip(_parts(a), _parts(b), strict=True)])


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def is_valid(g: Geometry) -> Column:
    """Finite points; boxes of positive finite extent in each dimension; spheres with a finite radius of 0 or more."""
    if isinstance(g, Point):
        return _all([_finite(x) for x in g.at])
    if isinstance(g, Box):
        return _all([_finite(lo) & _finite(hi) & (hi > lo) for lo, hi in zip(g.lo, g.hi, strict=True)])
    if isinstance(g, Sphere):
        return _all([*(_finite(x) for x in g.c), _finite(g.r), g.r >= 0])
    raise GeometryError(f"no validity of a {g.kind}")


def convert(g: Geometry, to: str) -> Geometry:
    """Coordinates cast to another type: ``float`` or ``double``."""
    if isinstance(g, Point):
        return Point([x.cast(to) for x in g.at])
    if isinstance(g, Box):
        return Box([x.cast(to) for x in g.lo], [x.cast(to) for x in g.hi])
    raise GeometryError(f"no conversion of a {g.kind}")


def translate_and_scale(p: Point, scene: Box) -> Point:
    """Position in the scene's box as 0 to 1; 0 on an axis without extent."""
    return Point([F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)) for x, lo, hi in zip(p.at, scene.lo, scene.hi, strict=True)])


def bounds(g: Geometry) -> Box:
    """The smallest box around ``g``."""
    if isinstance(g, Box):
        return g
    if isinstance(g, Point):
        return Box(g.at, g.at)
    if isinstance(g, Sphere):
        return Box([x - g.r for x in g.c], [x + g.r for x in g.c])
    if isinstance(g, KDOP):
        return Box(g.lo[: g.dim], g.hi[: g.dim])
    if isinstance(g, Ellipsoid):
        reach = [F.sqrt(v) for v in _inverse_diagonal(g)]
        return Box([c - r for c, r in zip(g.c, reach, strict=True)], [c + r for c, r in zip(g.c, reach, strict=True)])
    if isinstance(g, _Corners):
        return Box([least(list(xs)) for xs in zip(*g.corners, strict=True)], [greatest(list(xs)) for xs in zip(*g.corners, strict=True)])
    raise GeometryError(f"a {g.kind} has no finite box")


def _inverse_diagonal(e: Ellipsoid) -> list[Column]:
    m, n = e.m, e.dim
    if n == 2:
        det = m[0] * m[3] - m[1] * m[2]
        return [F.try_divide(m[3], det), F.try_divide(m[0], det)]
    minor = [m[4] * m[8] - m[5] * m[7], m[0] * m[8] - m[2] * m[6], m[0] * m[4] - m[1] * m[3]]
    det = m[0] * minor[0] - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    return [F.try_divide(x, det) for x in minor]


def expand(to: Box | KDOP, g: Geometry) -> Box | KDOP:
    """The box or k-DOP grown to hold ``g``; an empty box adds nothing."""
    if isinstance(to, Box):
        b = bounds(g)
        return Box([F.least(x, y) for x, y in zip(to.lo, b.lo, strict=True)], [F.greatest(x, y) for x, y in zip(to.hi, b.hi, strict=True)])
    if isinstance(g, KDOP):
        if g.k != to.k:
            raise GeometryError("k-DOPs of different k")
        return KDOP([F.least(x, y) for x, y in zip(to.lo, g.lo, strict=True)], [F.greatest(x, y) for x, y in zip(to.hi, g.hi, strict=True)], to.n)
    if isinstance(g, Point):
        corners = [g.at]
    elif isinstance(g, Box):
        corners = [list(c) for c in itertools.product(*zip(g.lo, g.hi, strict=True))]
    elif isinstance(g, _Corners):
        corners = g.corners
    else:
        raise GeometryError(f"a k-DOP can't be grown by a {g.kind}")
    lo, hi = [], []
    for d, x, y in zip(to.directions, to.lo, to.hi, strict=True):
        on = [project(c, d) for c in corners]
        low, high = F.least(x, *on), F.greatest(y, *on)
        if isinstance(g, Box):
            low, high = F.when(_empty(g), x).otherwise(low), F.when(_empty(g), y).otherwise(high)
        lo.append(low)
        hi.append(high)
    return KDOP(lo, hi, to.n)


def grow(g: Geometry, r: Number) -> Geometry:
    """All points within ``r`` of a point, box or sphere, a trifle larger against rounding; rays stay as they are."""
    r = _col(r) * F.lit(1 + 4 * math.ulp(1.0))
    if isinstance(g, Point):
        return Sphere(g.at, r)
    if isinstance(g, Sphere):
        return Sphere(g.c, g.r + r)
    if isinstance(g, Box):
        return Box([x - r for x in g.lo], [x + r for x in g.hi])
    if isinstance(g, Ray):
        return g
    raise GeometryError(f"a {g.kind} can't be grown")
