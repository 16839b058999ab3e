"""Scalar functions against literal values, in both orders of arguments."""

import math

import numpy as np
import pytest

from orbweave.functions.errors import GeometryError
from orbweave.functions.geometry import INF, KDOP, Box, Ellipsoid, Point, Ray, Segment, Sphere, Tetrahedron, Triangle, barycentric, bounds, centroid, closest_point, distance, equals, expand, intersects, is_valid, kdop_directions, overlap_distance, ray_triangle, translate_and_scale
from orbweave.functions.morton import morton32, morton64

P = Point.of


@pytest.fixture(scope="module", autouse=True)
def cases(spark):
    """Columns exist only within a session."""
    global UNIT, SQUARE, BALL, TRI, TRI3, TET, SEG, FLAT, OVAL, ROUND, DISTANCES, MEETS
    UNIT, SQUARE = Box.of([0, 0, 0], [1, 1, 1]), Box.of([0, 0], [1, 1])
    BALL = Sphere.of([0, 0, 0], 1)
    TRI = Triangle.of([-1, 0], [1, 0], [0, 1])
    TRI3 = Triangle.of([1, 0, 0], [0, 1, 0], [0, 0, 1])
    TET = Tetrahedron.of([0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1])
    SEG = Segment.of([0, 0], [1, 1])
    FLAT = Triangle.of([0, 0, 0], [1, 0, 0], [0, 1, 0])
    OVAL, ROUND = Ellipsoid.of([0, 0], [1, 0, 0, 0.25]), Ellipsoid.of([0, 0, 0], [1, 0, 0, 0, 1, 0, 0, 0, 1])

    DISTANCES = [
        (P(2, 0.5, 0.5), UNIT, 1), (P(0.5, 0.5, 0.5), UNIT, 0), (P(2, 0, 0), BALL, 1), (P(0.5, 0.5, 0.5), BALL, 0), (P(0, -1), SEG, 1), (P(1.5, 1), SEG, 0.5),
        *((P(*p), TRI, 1) for p in ((-2, 0), (0, 2), (2, 0), (0, -1))), (P(2, 0, 0), TET, 1), (P(-1, -1, -1), TET, math.sqrt(3)), (P(0.4, 0.4, 0.1), TET, 0),
        (UNIT, Box.of([2, 0, 0], [3, 1, 1]), 1), (UNIT, Box.of([0, 0, 4], [1, 1, 5]), 3), (Box.empty(3), UNIT, INF), (BALL, Box.of([2, 3, 4], [2.5, 3.5, 4.5]), math.sqrt(29) - 1),
        (Sphere.of([-1, 1], 1), Sphere.of([2, -3], 1), 3), (Ray.of([0.5, 0.5, -0.5], [0, 0, 1]), UNIT, 0.5), (Ray.of([0.5, 0.5, -0.5], [0, 0, -1]), UNIT, INF),
        (Ray.of([0.5, 0.5, 0.5], [0, 0, 1]), UNIT, 0), (Ray.of([0.5, 0.5, -0.5], [-0.0, -0.0, 1]), UNIT, 0.5), (P(0, 0), Segment.of([1, 0], [1, 0]), 1),
    ]
    MEETS = [
        (BALL, P(-0.6, -0.8, 0), 1), (BALL, P(-0.7, -0.8, 0), 0), (Segment.of([1, 1], [2, 2]), SEG, 1), (Segment.of([1, 1], [2, 2]), Segment.of([0, 0], [0.9, 0.9]), 0),
        (Segment.of([1, 1], [2, 2]), Segment.of([1, 3], [3, 1.1]), 0), (Segment.of([1, 1], [2, 2]), Segment.of([1, 2], [2, 1]), 1), (SQUARE, Segment.of([-1, 2], [2, -1]), 1),
        (SQUARE, Segment.of([0.5, 1.6], [2, 0]), 0), (P(0.2, 0.2, 0.1), TET, 1), (P(0.5, 0.5, 0.5), TET, 0), (Segment.of([0, 0, 0], [1, 1, 1]), TRI3, 1), (Segment.of([0, 0, 0], [0.45, 0.25, 0.25]), TRI3, 0),
        (UNIT, Box.of([1, 1, 1], [2, 2, 2]), 1), (UNIT, Box.of([1.1, 1, 1], [2, 2, 2]), 0), (UNIT, Box.empty(3), 0), (UNIT, Triangle.of([2, 0, 0], [0, 2, 0], [0, 0, 2]), 1), (UNIT, Triangle.of([4, 0, 0], [0, 4, 0], [0, 0, 4]), 0),
        (Ray.of([-1, 0.2, 0], [1, 0, 0]), FLAT, 1), (Ray.of([-1, 2, 0], [1, 0, 0]), FLAT, 0), (Ray.of([0.2, 0.2, -1], [0, 0, 1]), FLAT, 1), (Ray.of([0.2, 0.2, -1], [0, 0, -1]), FLAT, 0),
        (OVAL, P(0, 2), 1), (OVAL, P(0.1, 2), 0), (OVAL, Segment.of([-2, 2], [2, 2]), 1), (OVAL, Segment.of([-2, 2.1], [2, 2.1]), 0), (OVAL, Box.of([0.9, 0.9], [2, 2]), 0), (OVAL, Box.of([0.5, 0.5], [2, 2]), 1),
        (ROUND, Box.of([0.5, 0.5, 0.5], [2, 2, 2]), 1), (ROUND, Box.of([0.6, 0.6, 0.6], [2, 2, 2]), 0), (KDOP.around(TRI3, 14), P(0, 0, 0), 0), (KDOP.around(TRI3, 6), P(0, 0, 0), 1),
        (KDOP.around(TRI3, 14), Box.of([0, 0, 0], [0.1, 0.1, 0.1]), 0), (KDOP.around(TRI3, 14), UNIT, 1), (KDOP.around(TRI3, 18), KDOP.around(UNIT, 18), 1), (BALL, TRI3, 1), (Sphere.of([0, 0, 0], 0.5), TRI3, 0), (P(0, 0.5), TRI, 1), (P(0, 1.1), TRI, 0),
    ]


def evaluate(spark, columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_distance(spark):
    got = evaluate(spark, [f for a, b, _ in DISTANCES for f in (distance(a, b), distance(b, a))])
    assert got == pytest.approx([x for *_, x in DISTANCES for _ in range(2)])


def test_intersects(spark):
    got = evaluate(spark, [f for a, b, _ in MEETS for f in (intersects(a, b), intersects(b, a))])
    wrong = [i // 2 for i, (g, x) in enumerate(zip(got, [x for *_, x in MEETS for _ in range(2)], strict=True)) if g is not bool(x)]
    assert not wrong


def test_rays(spark):
    got = evaluate(spark, [overlap_distance(Ray.of([-2, 0, z], [1, 0, 0]), BALL)[0] for z in (0.5, 0, 2)] + [*ray_triangle(Ray.of([-1, 0.2, 0], [2, 0, 0]), FLAT)])
    assert got == pytest.approx([math.sqrt(3), 2, 0, 1, 1.8])


def test_measures(spark):
    tri, tet = Triangle.of([-1, -1], [1, -1], [-1, 1]), Tetrahedron.of([0, 0, 0], [0, 2, 0], [2, 0, 0], [0, 0, 2])
    assert evaluate(spark, barycentric(P(-0.4, 0.2), tri)) == pytest.approx([0.1, 0.3, 0.6])
    assert evaluate(spark, barycentric(P(0.5, 0.5, 0.5), tet)) == pytest.approx([0.25] * 4)
    assert evaluate(spark, barycentric(P(0, 0), Triangle.of([0, 0], [1, 1], [2, 2]))) == [None] * 3
    assert evaluate(spark, centroid(Box.of([-10, 0, 10], [0, 10, 20])).at) == [-5, 5, 15]
    assert evaluate(spark, centroid(Triangle.of([0, 0, -2], [3, 0, 1], [0, 3, 1])).at) == pytest.approx([1, 1, 0])
    assert evaluate(spark, centroid(Tetrahedron.of([0, 0, -2], [-4, 3, 4], [1, 9, 5], [-1, 0, 1])).at) == pytest.approx([-1, 3, 2])
    assert evaluate(spark, closest_point(P(2, 2), SEG).at) == [1, 1]
    assert evaluate(spark, [is_valid(UNIT), is_valid(Box.empty(3)), is_valid(Sphere.of([0], -1)), is_valid(P(float("nan"))), equals(UNIT, UNIT), equals(BALL, Sphere.of([0, 0, 0], 2))]) == [True, False, False, False, True, False]
    assert evaluate(spark, translate_and_scale(P(1, 5), Box.of([0, 5], [2, 5])).at) == [0.5, 0]
    b = expand(expand(Box.empty(3), TRI3), BALL)
    assert evaluate(spark, b.lo + b.hi) == [-1] * 3 + [1] * 3
    oval = bounds(OVAL)
    assert evaluate(spark, oval.lo + oval.hi) == pytest.approx([-1, -2, 1, 2])
    k = expand(KDOP.empty(3, 14), Box.empty(3))
    assert evaluate(spark, [k.lo[0] > k.hi[0]]) == [True]


def test_null_coordinates_match_nothing(spark):
    from pyspark.sql import functions as F

    n = Point([F.lit(None).cast("double"), F.lit(0.0)])
    assert evaluate(spark, [intersects(n, SQUARE), distance(n, SEG), distance(n, P(1, 1))]) == [None] * 3


def test_morton(spark):
    got = evaluate(spark, [morton32(P(1, 1), SQUARE), morton32(P(1, 0), SQUARE), morton32(P(0, 0, 1), UNIT), morton32(P(1, 1, 0), UNIT), morton64(P(1, 1, 1), UNIT), morton64(P(1, 1, 0), UNIT), morton32(P(9, -9), SQUARE)])
    assert got == [0xFFFFFFFF, 0xAAAAAAAA, 0x9249249, 0x36DB6DB6, 0x7FFFFFFFFFFFFFFF, 0x6DB6DB6DB6DB6DB6, 0xAAAAAAAA]


@pytest.mark.parametrize("dim", range(1, 11))
def test_morton_bits(spark, dim):
    import random

    n = min(32 // dim, 52)
    cells = [random.Random(dim).randrange(1 << n) for _ in range(dim)]
    code = sum((c >> b & 1) << (b * dim + dim - 1 - i) for i, c in enumerate(cells) for b in range(n))
    assert evaluate(spark, [morton32(P(*((c + 0.5) / (1 << n) for c in cells)), Box.of([0] * dim, [1] * dim))]) == [code]


def test_what_is_refused():
    for bad in (lambda: intersects(P(0, 0), UNIT), lambda: distance(OVAL, SQUARE), lambda: kdop_directions(3, 8), lambda: Ray.of([0, 0], [1, 0]), lambda: closest_point(P(0, 0, 0), TET), lambda: morton32(P(*[0] * 11), Box.of([0] * 11, [1] * 11))):
        with pytest.raises(GeometryError):
            bad()
    assert [len(kdop_directions(3, k)) * 2 for k in (6, 14, 18, 26)] == [6, 14, 18, 26]


def test_rays_do_not_slip_between_triangles(spark):
    """Through every corner and along every side of a closed mesh, from inside; grazing rays too."""
    from orbweave.operators.spatial import SpatialIndex, intersects
    from orbweave.sources import generators

    v, faces = generators.icosahedron()
    v, faces = generators.subdivide(*generators.subdivide(v, faces))
    sides = np.unique(np.sort(faces[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1), axis=0)
    r = np.random.default_rng(3)
    through = [*v, *(v[a] * f + v[b] * (1 - f) for a, b in sides for f in (0.5, *r.random(2)))]
    origins = [(0.0, 0.0, 0.0), (0.1, 0.2, -0.05), (0.3, -0.6, 0.55)]
    rays = spark.createDataFrame([(i * 10 + k, *o, *map(float, p - np.array(o))) for i, p in enumerate(through) for k, o in enumerate(origins)], "id long, a double, b double, c double, d double, e double, f double")
    triangle = lambda c: Triangle.of(*([c(f"{n}{x}") for x in "xyz"] for n in "abc"))
    ray = lambda c: Ray.of([c(x) for x in "abc"], [c(x) for x in "def"])
    hit = SpatialIndex(generators.sphere_mesh(spark, 2), triangle).query(rays, ray, intersects())
    assert hit.select("query_id").distinct().count() == len(through) * len(origins)


def test_rays_at_sides_and_corners_of_one_triangle(spark):
    t = Triangle.of([0, 0, 0], [1, 0, 0], [0, 1, 0])
    hits = [([0.1, 0.2, 0.3], [0, 0, -1]), ([1.1, 1.2, 1], [-1, -1, -1]), ([0, 0, -1], [0, 0, 1]), ([1, 0, -2], [0, 0, 1]), ([0, 1, -3], [0, 0, 1]), ([1, 2, 3], [0, -2, -3]), ([0.5, 0.5, -3], [0, 0, 1]), ([0.1, 0, -1], [0, 0, 1]), ([0.3, 0.3, 0], [1, 1, 0]), ([1, 0, 0], [1, 2, 3])]
    misses = [([1, 2, 3], [1, 1, 0]), ([-1, 2, -3], [0, 0, 1]), ([-1, -1, 0], [0, 1, 0]), ([-0.1, 0, 1], [1, 0, 0]), ([0.1, 0.2, 0.3], [0, 0, 1]), ([0.2, 0.2, 0.5], [0, 0, 0])]
    got = evaluate(spark, [intersects(Ray.of(o, d), t) for o, d in hits + misses])
    assert got == [True] * len(hits) + [False] * len(misses)
    whole = evaluate(spark, [x for o, d in (([0.01, 0.2, 1.0], [0, 0, 1]), ([-1, 2, 0], [1, -1, 0]), ([-1, 2, 0], [-1, 1, 0]), ([0.5, 0.5, 0], [-1, 1, 0])) for x in ray_triangle(Ray.of(o, d), t)])
    root = math.sqrt(2)
    assert whole == pytest.approx([-1, -1, root, 2 * root, -2 * root, -root, -root / 2, root / 2])
