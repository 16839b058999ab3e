"""Joins by blocks of rows give what joins over columns give, whatever the coordinates."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orbweave.functions import arrays
from orbweave.functions import geometry as G
from orbweave.operators import blocks
from orbweave.operators import spatial as S

NAMES = [f"e{i}" for i in range(1, 13)]
at = lambda c, *i: [c(f"e{k}") for k in i]
BOX = lambda c: G.Box.of(at(c, 1, 2, 3), [c(f"e{i}") + F.lit(0.5) * F.abs(c(f"e{i + 3}")) for i in (1, 2, 3)])
BOX2 = lambda c: G.Box.of(at(c, 1, 2), [c(f"e{i}") + F.lit(0.5) * F.abs(c(f"e{i + 2}")) for i in (1, 2)])
TRIANGLE = lambda c: G.Triangle.of(at(c, 1, 2, 3), at(c, 4, 5, 6), at(c, 7, 8, 9))
SPHERE = lambda c: G.Sphere.of(at(c, 7, 8, 9), F.lit(0.6) * F.abs(c("e10")))
ELLIPSE = lambda c: G.Ellipsoid.of(at(c, 1, 2), [F.lit(4.0) + c("e3"), F.lit(0.5) * c("e4"), F.lit(0.5) * c("e4"), F.lit(4.0) + c("e5")])
POINT = lambda c: G.Point.of(*at(c, 10, 11, 12))
POINT2 = lambda c: G.Point.of(*at(c, 7, 8))
SEGMENT = lambda c: G.Segment.of(at(c, 1, 2, 3), at(c, 10, 11, 12))
SEGMENT2 = lambda c: G.Segment.of(at(c, 5, 6), at(c, 7, 8))
KDOP = lambda c: G.KDOP.around(TRIANGLE(c), 14)
TET = lambda c: G.Tetrahedron.of(*(at(c, i, i + 1, i + 2) for i in (1, 4, 7, 10)))
RAY = lambda c: G.Ray.of(at(c, 1, 2, 3), at(c, 4, 5, 6))


@pytest.fixture(scope="module")
def cloud(spark):
    """Coordinates on a lattice (so that shapes touch and degenerate) and elsewhere; nulls, infinities and NaN ones."""
    r = random.Random(5)
    rows = [(i, *(r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) if i % 2 else r.gauss(0, 0.6) for _ in NAMES)) for i in range(70)]
    for i, x in enumerate((None, float("inf"), float("nan"), float("-inf"))):
        rows += [(100 + 20 * i + j, *(x if k == j else row for k, row in enumerate(rows[j][1:]))) for j in (0, 3, 6, 8, 10)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in NAMES)).repartition(3)


def both_ways(monkeypatch, find, *columns):
    """What blocks find and what the grid finds."""
    out, calls = [], []
    monkeypatch.setattr(blocks, "block_pairs", lambda *a, f=blocks.block_pairs, **k: calls.append(1) or f(*a, **k))
    for cells in (1 << 60, -1):
        monkeypatch.setattr(S, "COARSE", cells)
        df = find()
        out.append(sorted(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in row) for row in df.select("query_id", "value_id", *columns).collect()))
    assert len(calls) == 1
    return out


PAIRS = {
    "box_triangle": (BOX, TRIANGLE), "sphere_triangle": (SPHERE, TRIANGLE), "ellipse_box": (ELLIPSE, BOX2), "ellipse_segment": (SEGMENT2, ELLIPSE), "ellipse_point": (POINT2, ELLIPSE),
    "point_tetrahedron": (POINT, TET), "segments": (SEGMENT2, SEGMENT2), "segment_box": (SEGMENT2, BOX2), "segment_triangle": (SEGMENT, TRIANGLE), "kdop_box": (KDOP, BOX),
    "kdops": (KDOP, KDOP), "kdop_point": (POINT, KDOP), "spheres": (SPHERE, SPHERE), "sphere_box": (SPHERE, BOX), "boxes": (BOX, BOX),
}


@pytest.mark.parametrize("pair", PAIRS)
def test_intersections(cloud, monkeypatch, pair):
    q, v = PAIRS[pair]
    blocked, gridded = both_ways(monkeypatch, lambda: S.SpatialIndex(cloud, v).query(cloud, q, S.intersects(), where=lambda a, b: a("id") != b("id")))
    assert blocked == gridded and blocked


@pytest.mark.parametrize("q,v,radius", [(BOX, BOX, 0.2), (POINT, TRIANGLE, 0.4), (POINT, POINT, 0.5), (POINT, BOX, "r")])
def test_within(cloud, monkeypatch, q, v, radius):
    asked = cloud.withColumn("r", F.when(F.col("id") % 9 > 0, F.col("id") % 5 / 4))
    blocked, gridded = both_ways(monkeypatch, lambda: S.SpatialIndex(cloud, v).query(asked, q, S.within(radius)), "distance")
    assert blocked == gridded and blocked


@pytest.mark.parametrize("v", [TRIANGLE, SPHERE, BOX])
@pytest.mark.parametrize("predicate", [S.ordered_intersects(), S.nearest(2)], ids=["ordered", "nearest"])
def test_rays(cloud, monkeypatch, v, predicate):
    cloud = cloud.where("id < 100")
    blocked, gridded = both_ways(monkeypatch, lambda: S.SpatialIndex(cloud, v).query(cloud, RAY, predicate), "distance", "place")
    assert blocked == gridded and blocked


def test_small_blocks_find_each_pair_once(cloud, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "PAIRS", 50)
    monkeypatch.setattr(blocks, "BOXES", 20)
    blocked, gridded = both_ways(monkeypatch, lambda: S.SpatialIndex(cloud, TRIANGLE).query(cloud, BOX, S.intersects()))
    assert blocked == gridded and len(set(blocked)) == len(blocked)


def test_nearest_by_brute_force_keeps_few_rows_of_a_block(spark, monkeypatch):
    places = list(itertools.product(range(4), range(4), range(3)))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places * 3)], "id long, x double, y double, z double")
    made = []
    monkeypatch.setattr(blocks, "block_pairs", lambda *a, f=blocks.block_pairs, **k: made.append(f(*a, **k)) or made[-1])
    found = S.SpatialIndex(df, S.points("x", "y", "z"), strategy="brute").query(df, S.points("x", "y", "z"), S.nearest(4))
    want = {}
    for i, p in enumerate(places * 3):
        order = sorted((sum((a - b) ** 2 for a, b in zip(p, o, strict=True)) ** 0.5, j) for j, o in enumerate(places * 3))
        want[i] = [j for _, j in order[:4]]
    got = {}
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["value_id"])
    assert got == want
    assert made and made[0].count() == 4 * len(places) * 3  # one block, not all pairs


@pytest.fixture(scope="module")
def skewed(spark):
    """A dense centre in a wide cloud, and many values at one place."""
    r = random.Random(9)
    rows = [(i, *(r.gauss(0, 0.01 if i % 3 else 3.0) for _ in range(3)), i % 6) for i in range(3000)] + [(3000 + i, 1.0, 1.0, 1.0, 2) for i in range(60)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, k int").repartition(3)


NEAREST = {
    "five": (lambda c: G.Point.of(c("x"), c("y"), c("z")), 5, {}),
    "others": (lambda c: G.Point.of(c("x"), c("y"), c("z")), 4, {"where": lambda q, v: q("id") != v("id")}),
    "column": (lambda c: G.Point.of(c("x"), c("y"), c("z")), "k", {}),
    "metric": (lambda c: G.Point.of(c("x"), c("y")), 3, {"metric": lambda p, q: arrays.abs(p.at[0] - q.at[0]) + arrays.abs(p.at[1] - q.at[1]), "metric_bound": 0.99}),
    "boxes": (lambda c: G.Box.of([c("x"), c("y")], [c("x") + F.lit(0.1), c("y") + F.lit(0.2)]), 2, {}),
}


@pytest.mark.parametrize("case", NEAREST)
def test_nearest_by_leaves(skewed, monkeypatch, case):
    shape, k, more = NEAREST[case]
    met = []

    def meeting(q, *rest, f=blocks._meet_leaves):
        met.append(q.count())
        return f(q, *rest)

    monkeypatch.setattr(blocks, "_meet_leaves", meeting)
    monkeypatch.setattr(blocks, "ROWS", 100)
    monkeypatch.setattr(blocks, "LEAF", 24)
    asked = skewed.where("id % 5 = 0 OR id > 3050")
    got = {(r["query_id"], r["place"]): r["value_id"] for r in S.SpatialIndex(skewed, shape).query(asked, shape, S.nearest(k), **more).collect()}
    assert len(met) == 2 and (case == "boxes" or met[1] < 40 * met[0])  # few leaves a query, unless most values are at distance 0
    q, v = ({n: asked[n].alias(f"{p}_{n}") for n in asked.columns} for p in "qv")
    a, b = asked.select(*q.values()), skewed.select(*v.values())
    get = [lambda n, p=p: F.col(f"{p}_{n}") for p in "qv"]
    d = more.get("metric", G.distance)(shape(get[0]), shape(get[1]))
    pairs = a.crossJoin(b).where(more["where"](*get) if "where" in more else F.lit(True)).withColumn("d", d)
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("d", "v_id"))
    want = pairs.withColumn("p", place).where(F.col("p") <= (F.col(f"q_{k}") if isinstance(k, str) else k))
    assert got == {(r["q_id"], r["p"]): r["v_id"] for r in want.select("q_id", "p", "v_id").collect()}


def test_small_spheres_by_blocks(spark, monkeypatch):
    """A grid of 8,000 cells still makes several rows of each sphere, so blocks are compared."""
    r = random.Random(2)
    df = spark.createDataFrame([(i, *(r.random() for _ in range(3)), 0.025) for i in range(400)], "id long, x double, y double, z double, r double")
    calls = []
    monkeypatch.setattr(blocks, "block_pairs", lambda *a, f=blocks.block_pairs, **k: calls.append(1) or f(*a, **k))
    rows = df.collect()
    got = {tuple(p) for p in S.SpatialIndex(df, S.spheres(["x", "y", "z"], "r")).query(df, S.spheres(["x", "y", "z"], "r"), S.intersects()).collect()}
    assert calls and got == {(a["id"], b["id"]) for a in rows for b in rows if math.dist(a[1:4], b[1:4]) <= a["r"] + b["r"]}


def test_forces_without_a_second_join(spark, monkeypatch):
    """Coordinates come with the pairs; forces are those of all pairs."""
    r = random.Random(4)
    rows = [(i, *(r.random() for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = S.pair_forces(df, ["x", "y", "z"], 0.3, sigma=0.1, least=0.05)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for a, b in itertools.permutations(rows, 2):
        d = math.dist(a[1:], b[1:])
        if 0.05 < d <= 0.3:
            s = (0.01 / d**2) ** 3
            e, f = want.get(a[0], (0.0, 0.0))
            want[a[0]] = e + 2 * (s * s - s), f + 24 * (2 * s * s - s) / d**2 * (a[1] - b[1])
    got = {x["id"]: (x["energy"], x["force_x"]) for x in got.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in want)


def test_sums_of_pairs_are_made_in_blocks(spark, monkeypatch):
    """A row for each point and block, not for each pair; the sums are those of all pairs."""
    monkeypatch.setattr(blocks, "TILE", 16)
    r = random.Random(6)
    rows = [(i, *(r.random() for _ in range(3))) for i in range(600)] + [(600 + i, 0.5, 0.5, 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3)
    made = []
    monkeypatch.setattr(blocks, "block_pairs", lambda *a, f=blocks.block_pairs, **k: made.append(f(*a, **k)) or made[-1])
    terms = {"inverse": lambda d, a, b: arrays.try_divide(arrays.lit(1.0), d), "shift": lambda d, a, b: a(1) - b(1)}
    got = {x["id"]: tuple(x)[1:] for x in S.pair_sums(df, ["x", "y", "z"], 0.3, terms).collect()}
    want = {}
    for a, b in itertools.permutations(rows, 2):
        if 0 < (d := math.dist(a[1:], b[1:])) <= 0.3:
            n, i, s = want.get(a[0], (0, 0.0, 0.0))
            want[a[0]] = n + 1, i + 1 / d, s + a[2] - b[2]
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in want)
    assert made and made[0].count() < sum(n for n, _, _ in want.values()) / 10
    monkeypatch.setattr(S, "COARSE", -1)
    plain = {x["id"]: tuple(x)[1:] for x in S.pair_sums(df, ["x", "y", "z"], 0.3, terms).collect()}
    assert len(made) == 1 and plain.keys() == got.keys() and all(plain[i] == pytest.approx(got[i], rel=1e-9, abs=1e-9) for i in got)


def test_nearest_by_brute_force_carries_few_columns_and_rows(spark, monkeypatch):
    """What blocks return are ids and distances, k of a query and block of values, of which there are few."""
    r = random.Random(8)
    df = spark.createDataFrame([(i, *(r.random() for _ in range(3)), "x" * 50) for i in range(2000)], "id long, x double, y double, z double, t string")
    made = []
    monkeypatch.setattr(blocks, "block_pairs", lambda *a, f=blocks.block_pairs, **k: made.append(f(*a, **k)) or made[-1])
    shape = S.points("x", "y", "z")
    found = S.SpatialIndex(df, shape, strategy="brute").query(df, shape, S.nearest(3), keep=["x"])
    got = {(n["query_id"], n["place"]): (n["value_id"], n["x"]) for n in found.collect()}
    rows = df.collect()
    for a in rows[::100]:
        order = sorted((math.dist(a[1:4], b[1:4]), b["id"]) for b in rows)
        assert [got[a["id"], p] for p in (1, 2, 3)] == [(j, a["x"]) for _, j in order[:3]]
    assert made[0].columns == ["q_id", "q_x", "v_id", "distance"] and made[0].count() == 3 * len(rows) == len(got)


SIEVED = {
    "ray_triangle": (G.Ray, G.Triangle, "ray", None), "segment_triangle": (G.Segment, G.Triangle, "intersects", None), "triangle_segment": (G.Triangle, G.Segment, "intersects", None),
    "point_tetrahedron": (G.Point, G.Tetrahedron, "intersects", None), "sphere_triangle": (G.Sphere, G.Triangle, "intersects", None), "point_triangle": (G.Point, G.Triangle, "within", 0.2),
    "triangle_point": (G.Triangle, G.Point, "within", 0.2),
}


@pytest.mark.parametrize("lattice", [False, True], ids=["anywhere", "lattice"])
@pytest.mark.parametrize("case", SIEVED)
def test_sieves_leave_out_only_what_does_not_match(monkeypatch, case, lattice):
    """The predicate on all pairs finds the same, and is asked for few pairs only; on a lattice shapes touch and degenerate."""
    *kinds, kind, radius = SIEVED[case]
    r = np.random.default_rng(3)
    n, parts = 300, {G.Ray: 2, G.Segment: 2, G.Point: 1, G.Sphere: 1, G.Triangle: 3, G.Tetrahedron: 4}
    sides, shapes, boxes = [], [], []
    for k in kinds:
        vectors = r.integers(-2, 3, (parts[k], 3, n)).astype(float) if lattice else r.normal(0, 1, (parts[k], 3, n)) + 100.0
        if k is G.Ray:
            vectors[1] = r.integers(-1, 2, (3, n)) if lattice else r.normal(0, 1, (3, n))
            vectors[1] /= np.maximum(np.sqrt((vectors[1] ** 2).sum(0)), 1e-9)
        size = [np.abs(r.integers(0, 2, n) if lattice else r.normal(0, 0.3, n)).astype(float)] if k is G.Sphere else []
        places = iter(range(100))
        vs = [[blocks._Place(next(places)) for _ in range(3)] for _ in vectors]
        shapes.append(k(vs[0], blocks._Place(next(places))) if k is G.Sphere else k(*vs))
        sides.append([x for v in vectors for x in v] + size)
        ends = vectors[:1] if k is G.Ray else vectors
        grown = (size[0] if size else 0.0) + (radius or 0.0) * (len(boxes) == 0) + 1e-9
        boxes.append([*(ends.min(0) - grown), *(ends.max(0) + grown)])
    asked = blocks.Asked(kind, radius, measured=kind != "intersects", every=kind == "ray")
    with arrays.numbers():
        hit, _ = blocks._holds((slice(None), None), (None, slice(None)), *sides, shapes, asked, asked.measured)
        (qlo, qhi), (vlo, vhi) = ((np.array(b[:3]), np.array(b[3:])) for b in boxes)
        if not asked.every:  # a flat tetrahedron has no side on which a point is outside, so boxes decide first
            hit = hit & ((qlo[:, :, None] <= vhi[:, None]) & (vlo[:, None] <= qhi[:, :, None])).all(0)
        tried = []
        monkeypatch.setattr(blocks, "_holds", lambda a, b, *rest, f=blocks._holds: tried.append(len(a)) or f(a, b, *rest))
        found = list(blocks._in_tiles(*sides, *boxes, 3, shapes, asked, asked.measured))
    got = [p for f in found for p in zip(f[0].tolist(), f[1].tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(hit)), strict=True)) and got
    assert lattice or sum(tried) < 1.5 * len(got) + 100


@pytest.mark.parametrize("lattice", [False, True], ids=["anywhere", "lattice"])
@pytest.mark.parametrize("kind", [G.Box, G.Sphere])
def test_rays_are_compared_with_few_values(monkeypatch, kind, lattice):
    """The predicate on all pairs finds the same; rays aren't compared with each value. On a lattice rays touch boxes, and some have no direction."""
    r = np.random.default_rng(8)
    n = 3000 if not lattice else 400
    place = lambda: r.integers(-3, 4, (3, n)).astype(float) if lattice else r.random((3, n)) + 100.0
    o, d, at = place(), r.integers(-1, 2, (3, n)).astype(float) if lattice else r.normal(0, 1, (3, n)), place()
    size = r.integers(0, 2, (3, n)).astype(float) if lattice else np.abs(r.normal(0, 0.01, (3, n)))
    slot = lambda *k: [blocks._Place(i) for i in k]
    shapes = [G.Ray(slot(0, 1, 2), slot(3, 4, 5)), G.Box(slot(0, 1, 2), slot(3, 4, 5)) if kind is G.Box else G.Sphere(slot(0, 1, 2), slot(3)[0])]
    values = [*at, *(at + size)] if kind is G.Box else [*at, size[0]]
    box = [*at, *(at + size)] if kind is G.Box else [*(at - size[0]), *(at + size[0])]
    asked = blocks.Asked("ray", measured=True, every=True)
    with arrays.numbers():
        hit, measures = blocks._holds((slice(None), None), (None, slice(None)), [*o, *d], values, shapes, asked)
        tried = []
        for name in ("_holds", "_ray_meets"):
            size_of = lambda x: x[0].size if isinstance(x, tuple) else x.size
            monkeypatch.setattr(blocks, name, lambda *a, f=getattr(blocks, name): tried.append(size_of(f(*a))) or f(*a))
        found = list(blocks._by_rows([*o, *d], values, [*o, *o], box, 3, shapes, asked, 2, None))
    got = {(i, j): (x, y) for f in found for i, j, x, y in zip(*(x.tolist() for x in f), strict=True)}
    assert sum(len(f[0]) for f in found) == len(got) and got
    assert got == {(i, j): tuple(m[i, j] for m in measures) for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True)}
    assert lattice or sum(tried) < n * n / 10


def test_energy_is_deposited_in_rounds_of_rays(cloud, monkeypatch):
    """Each ray is in one round, with all values; of a round only sums are kept."""
    cloud = cloud.where("id < 100")
    whole = {r["value_id"]: r["deposit"] for r in S.energy_deposit(S.SpatialIndex(cloud, BOX), cloud, RAY).collect()}
    asked, hits = [], S.SpatialIndex.ray_hits
    monkeypatch.setattr(S, "ROUND", cloud.count() / 5, raising=False)
    monkeypatch.setattr(S.SpatialIndex, "ray_hits", lambda self, rays, *more: asked.append({r["id"] for r in rays.select("id").collect()}) or hits(self, rays, *more))
    parts = {r["value_id"]: r["deposit"] for r in S.energy_deposit(S.SpatialIndex(cloud, BOX), cloud, RAY).collect()}
    assert parts == pytest.approx(whole) and whole
    assert len(asked) == 3 and sum(map(len, asked)) == len(set().union(*asked)) == cloud.count()
