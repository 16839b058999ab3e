"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it.

Points, boxes and other geometries come from the first entries of ``embeddings``: e1, e2, ... are its values as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import arrays
from orbweave.functions import geometry as G
from orbweave.functions.morton import morton32, morton64
from orbweave.operators import cluster, spatial, vectors
from orbweave.operators.spatial import SpatialIndex, intersects, nearest, ordered_intersects, within

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

USED = 15
E = "WITH e AS (SELECT vec_id id, label, " + ", ".join(f"embedding[{i}]::DOUBLE e{i}" for i in range(1, USED + 1)) + " FROM embeddings)"


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH RECURSIVE") or "embeddings" in sql or "events" in sql else E + sql
        return f

    return put


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, e1, ..., e15."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("id"), "label", *(F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(USED)))


def _e(*i: int) -> list[str]:
    return [f"e{k}" for k in i]


P3 = spatial.points("e1", "e2", "e3")
P2 = spatial.points("e1", "e2")
BOX = lambda c: G.Box.of([c(n) for n in _e(1, 2, 3)], [c(a) + F.lit(0.5) * F.abs(c(b)) for a, b in (("e1", "e4"), ("e2", "e5"), ("e3", "e6"))])
BOX2 = lambda c: G.Box.of([c("e1"), c("e2")], [c("e1") + F.lit(0.5) * F.abs(c("e4")), c("e2") + F.lit(0.5) * F.abs(c("e5"))])
SPHERE = lambda c: G.Sphere.of([c(n) for n in _e(7, 8, 9)], F.lit(0.3) * F.abs(c("e10")))
SEGMENT = lambda c: G.Segment.of([c("e1"), c("e2")], [c("e3"), c("e4")])
SEGMENT3 = lambda c: G.Segment.of([c(n) for n in _e(1, 2, 3)], [c(n) for n in _e(4, 5, 6)])
TRIANGLE2 = lambda c: G.Triangle.of(*([c(f"e{i}"), c(f"e{i + 1}")] for i in (1, 3, 5)))
TRIANGLE = lambda c: G.Triangle.of(*([c(f"e{i + j}") for j in range(3)] for i in (1, 4, 7)))
TET = lambda c: G.Tetrahedron.of(*([c(f"e{i + j}") for j in range(3)] for i in (1, 4, 7, 10)))
RAY = lambda c: G.Ray.of([c(n) for n in _e(1, 2, 3)], [c(n) for n in _e(4, 5, 6)])
ELLIPSOID = lambda c: G.Ellipsoid.of([c("e1"), c("e2")], [F.lit(40.0) + F.lit(10.0) * c("e3"), F.lit(5.0) * c("e4"), F.lit(5.0) * c("e4"), F.lit(40.0) + F.lit(10.0) * c("e5")])


def _join(spark, sf_dir, q, v, predicate, **more) -> DataFrame:
    t = values(spark, sf_dir)
    return SpatialIndex(t, v).query(t, q, predicate, **more)


# -- SQL pieces --------------------------------------------------------------------------------------------------------------


def d(a: list[str], b: list[str]) -> str:
    """Distance of two points given by expressions."""
    return "sqrt(" + " + ".join(f"({y} - {x}) * ({y} - {x})" for x, y in zip(a, b, strict=True)) + ")"


def at(alias: str, *i: int) -> list[str]:
    return [f"{alias}.e{k}" for k in i]


A3, B3 = at("a", 1, 2, 3), at("b", 1, 2, 3)
LO, HI = at("b", 1, 2, 3), [f"(b.e{i} + 0.5::DOUBLE * abs(b.e{i + 3}))" for i in (1, 2, 3)]
ALO, AHI = at("a", 1, 2, 3), [f"(a.e{i} + 0.5::DOUBLE * abs(a.e{i + 3}))" for i in (1, 2, 3)]


def clamp(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END)"


def box_distance(p: list[str], lo: list[str] = LO, hi: list[str] = HI) -> str:
    """Distance of a point to its clamped image."""
    return "sqrt(" + " + ".join(f"({x} - {clamp(x, u, v)}) * ({x} - {clamp(x, u, v)})" for x, u, v in zip(p, lo, hi, strict=True)) + ")"


def pairs(condition: str, columns: str = "") -> str:
    return f" SELECT a.id query_id, b.id value_id{columns} FROM e a, e b WHERE {condition}"


# -- radius joins, neighbour lists, compressed rows ----------------------------------------------------------------------------


@query(f" SELECT a.id query_id, count(*) n FROM e a, e b WHERE {d(A3, B3)} <= 0.05 GROUP BY a.id")
def radius_count(spark, sf_dir):
    """Neighbours within a radius, for each point."""
    return _join(spark, sf_dir, P3, P3, within(0.05)).groupBy("query_id").agg(F.count("*").alias("n"))


@query(pairs(f"{d(A3, B3)} <= 0.08", f", {d(A3, B3)} distance"))
def radius_pairs(spark, sf_dir):
    return _join(spark, sf_dir, P3, P3, within(0.08))


@query(f" SELECT a.id a, b.id b, {d(A3, B3)} distance FROM e a, e b WHERE a.id < b.id AND {d(A3, B3)} <= 0.1")
def half_pairs(spark, sf_dir):
    return spatial.half_neighbors(values(spark, sf_dir), _e(1, 2, 3), 0.1)


@query(f" SELECT a.id a, b.id b, {d(A3, B3)} distance FROM e a, e b WHERE a.id <> b.id AND {d(A3, B3)} <= 0.1")
def full_neighbors(spark, sf_dir):
    return spatial.full_neighbors(values(spark, sf_dir), _e(1, 2, 3), 0.1)


@query(f", n AS (SELECT a.id query_id, count(b.id) n FROM e a LEFT JOIN e b ON a.id > b.id AND {d(A3, B3)} <= 0.05 GROUP BY a.id) SELECT query_id, n, coalesce(sum(n) OVER (ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT \"offset\" FROM n")
def crs_offsets(spark, sf_dir):
    t = values(spark, sf_dir)
    half = spatial.half_neighbors(t, _e(1, 2, 3), 0.05).select(F.col("b").alias("query_id"), F.col("a").alias("value_id"))
    return spatial.offsets(spatial.counts(half, t))


@query(f" SELECT a.id query_id, b.id value_id, row_number() OVER (ORDER BY a.id, b.id) - 1 AS \"position\" FROM e a JOIN e b ON {d(A3, B3)} <= 0.05")
def crs_positions(spark, sf_dir):
    t = values(spark, sf_dir)
    return spatial.to_crs(_join(spark, sf_dir, P3, P3, within(0.05)), t)


# -- geometry joins --------------------------------------------------------------------------------------------------------------


@query(pairs(" AND ".join(f"{x} <= {v} AND {y} >= {u}" for x, y, u, v in zip(ALO, AHI, LO, HI, strict=True))))
def box_box_join(spark, sf_dir):
    return _join(spark, sf_dir, BOX, BOX, intersects())


@query(pairs(" AND ".join(f"{x} >= {u} AND {x} <= {v}" for x, u, v in zip(A3, LO, HI, strict=True))))
def point_in_box(spark, sf_dir):
    return _join(spark, sf_dir, P3, BOX, intersects())


@query(pairs(f"{box_distance(at('a', 7, 8, 9))} <= 0.3::DOUBLE * abs(a.e10)"))
def sphere_box(spark, sf_dir):
    return _join(spark, sf_dir, SPHERE, BOX, intersects())


@query(pairs(f"{d(at('a', 7, 8, 9), at('b', 7, 8, 9))} <= 0.3::DOUBLE * abs(a.e10) + 0.3::DOUBLE * abs(b.e10)"))
def sphere_sphere(spark, sf_dir):
    return _join(spark, sf_dir, SPHERE, SPHERE, intersects())


def _det(ax, ay, bx, by) -> str:
    return f"(({ax}) * ({by}) - ({ay}) * ({bx}))"


_AB, _AC, _AP = ("b.e3 - b.e1", "b.e4 - b.e2"), ("b.e5 - b.e1", "b.e6 - b.e2"), ("a.e7 - b.e1", "a.e8 - b.e2")


@query(f", w AS (SELECT a.id query_id, b.id value_id, {_det(*_AP, *_AC)} / {_det(*_AB, *_AC)} v, {_det(*_AB, *_AP)} / {_det(*_AB, *_AC)} w FROM e a, e b WHERE {_det(*_AB, *_AC)} <> 0) SELECT query_id, value_id FROM w WHERE v >= 0 AND w >= 0 AND 1::DOUBLE - v - w >= 0")
def point_in_triangle(spark, sf_dir):
    return _join(spark, sf_dir, spatial.points("e7", "e8"), TRIANGLE2, intersects())


def _vec(p: list[str], q: list[str]) -> list[str]:
    return [f"({y} - {x})" for x, y in zip(p, q, strict=True)]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def _closest_sql(p: list[str], corners: list[list[str]]) -> tuple[str, str]:
    """A CTE body of the Voronoi quantities for each pair, and the squared distance from them."""
    a, b, c = corners
    dots = [_dot(_vec(a, b), _vec(a, p)), _dot(_vec(a, c), _vec(a, p)), _dot(_vec(a, b), _vec(b, p)), _dot(_vec(a, c), _vec(b, p)), _dot(_vec(a, b), _vec(c, p)), _dot(_vec(a, c), _vec(c, p))]
    names = ", ".join(f"{x} p{i}, {u} a{i}, {v} b{i}, {w} c{i}" for i, (x, u, v, w) in enumerate(zip(p, a, b, c, strict=True)))
    first = f"SELECT a.id query_id, b.id value_id, {names}, " + ", ".join(f"{x} d{i + 1}" for i, x in enumerate(dots)) + " FROM e a, e b"
    parts = []
    for i in range(len(p)):
        parts.append(
            f"(p{i} - CASE WHEN d1 <= 0 AND d2 <= 0 THEN a{i} WHEN d3 >= 0 AND d4 <= d3 THEN b{i} WHEN d6 >= 0 AND d5 <= d6 THEN c{i} "
            f"WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN a{i} + (b{i} - a{i}) * (d1 / (d1 - d3)) WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN a{i} + (c{i} - a{i}) * (d2 / (d2 - d6)) "
            f"WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN b{i} + (c{i} - b{i}) * ((d4 - d3) / ((d4 - d3) + (d5 - d6))) ELSE a{i} + (b{i} - a{i}) * (vb / (va + vb + vc)) + (c{i} - a{i}) * (vc / (va + vb + vc)) END)"
        )
    return f", t AS ({first}), u AS (SELECT *, d3 * d6 - d5 * d4 va, d5 * d2 - d1 * d6 vb, d1 * d4 - d3 * d2 vc FROM t), k AS (SELECT query_id, value_id, sqrt({' + '.join(f'{x} * {x}' for x in parts)}) distance FROM u)", "k"


@query(_closest_sql(at("a", 13, 14, 15), [at("b", 1, 2, 3), at("b", 4, 5, 6), at("b", 7, 8, 9)])[0] + " SELECT k.query_id, k.value_id FROM k JOIN e ON e.id = k.query_id WHERE distance <= 0.3::DOUBLE * abs(e.e10)")
def sphere_triangle(spark, sf_dir):
    return _join(spark, sf_dir, lambda c: G.Sphere.of([c(n) for n in _e(13, 14, 15)], F.lit(0.3) * F.abs(c("e10"))), TRIANGLE, intersects())


def _side_sql(p: list[str], f: list[list[str]], o: list[str]) -> str:
    n = _cross(_vec(f[0], f[1]), _vec(f[0], f[2]))
    return f"{_dot(n, _vec(f[0], o))} * {_dot(n, _vec(f[0], p))} >= 0"


_T = [at("b", i, i + 1, i + 2) for i in (1, 4, 7, 10)]


@query(pairs(" AND ".join(_side_sql(at("a", 13, 14, 15), [_T[j] for j in range(4) if j != i], _T[i]) for i in range(4))))
def point_in_tetrahedron(spark, sf_dir):
    return _join(spark, sf_dir, spatial.points("e13", "e14", "e15"), TET, intersects())


def _turn(a: list[str], b: list[str], c: list[str]) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def _between(a: list[str], b: list[str], p: list[str]) -> str:
    return " AND ".join(f"{x} >= least({u}, {v}) AND {x} <= greatest({u}, {v})" for u, v, x in zip(a, b, p, strict=True))


def crossing(a: list[str], b: list[str], c: list[str], e: list[str]) -> str:
    o = [_turn(a, b, c), _turn(a, b, e), _turn(c, e, a), _turn(c, e, b)]
    touch = [(o[0], a, b, c), (o[1], a, b, e), (o[2], c, e, a), (o[3], c, e, b)]
    return f"(({o[0]} * {o[1]} < 0 AND {o[2]} * {o[3]} < 0) OR " + " OR ".join(f"({t} = 0 AND {_between(x, y, p)})" for t, x, y, p in touch) + ")"


@query(pairs(crossing(at("a", 1, 2), at("a", 3, 4), at("b", 1, 2), at("b", 3, 4))))
def segment_segment(spark, sf_dir):
    return _join(spark, sf_dir, SEGMENT, SEGMENT, intersects())


_C = [["b.e1", "b.e2"], [HI[0], "b.e2"], [HI[0], HI[1]], ["b.e1", HI[1]]]


@query(pairs("(" + " OR ".join(["(" + " AND ".join(f"a.e{i + j} >= {LO[j]} AND a.e{i + j} <= {HI[j]}" for j in range(2)) + ")" for i in (1, 3)] + [crossing(at("a", 1, 2), at("a", 3, 4), _C[i], _C[(i + 1) % 4]) for i in range(4)]) + ")"))
def segment_box(spark, sf_dir):
    return _join(spark, sf_dir, SEGMENT, BOX2, intersects())


def _form(x: list[str], y: list[str]) -> str:
    m = ["(40::DOUBLE + 10::DOUBLE * b.e3)", "(5::DOUBLE * b.e4)", "(40::DOUBLE + 10::DOUBLE * b.e5)"]
    return f"({x[0]} * ({m[0]} * {y[0]} + {m[1]} * {y[1]}) + {x[1]} * ({m[1]} * {y[0]} + {m[2]} * {y[1]}))"


@query(pairs(f"{_form(_vec(at('b', 1, 2), at('a', 7, 8)), _vec(at('b', 1, 2), at('a', 7, 8)))} <= 1"))
def ellipsoid_point(spark, sf_dir):
    return _join(spark, sf_dir, spatial.points("e7", "e8"), ELLIPSOID, intersects())


_SD, _SB = _vec(at("a", 7, 8), at("a", 9, 10)), _vec(at("a", 7, 8), at("b", 1, 2))


@query(f", s AS (SELECT a.id query_id, b.id value_id, {_form(_SD, _SB)} / {_form(_SD, _SD)} u FROM e a, e b), t AS (SELECT query_id, value_id, {clamp('u', '0::DOUBLE', '1::DOUBLE')} t FROM s), x AS (SELECT query_id, value_id, a.e7 + {_SD[0]} * t - b.e1 x0, a.e8 + {_SD[1]} * t - b.e2 x1, b.e3, b.e4, b.e5 FROM t JOIN e a ON a.id = query_id JOIN e b ON b.id = value_id) SELECT query_id, value_id FROM x b WHERE {_form(['b.x0', 'b.x1'], ['b.x0', 'b.x1'])} <= 1")
def ellipsoid_segment(spark, sf_dir):
    return _join(spark, sf_dir, lambda c: G.Segment.of([c("e7"), c("e8")], [c("e9"), c("e10")]), ELLIPSOID, intersects())


def _kdop_bounds(alias: str) -> list[tuple[str, str]]:
    corners = [at(alias, i, i + 1, i + 2) for i in (1, 4, 7)]
    out = []
    for direction in G.kdop_directions(3, 14):
        on = ["(" + " ".join(f"{'+' if s > 0 else '-'} {x}" for x, s in zip(c, direction, strict=True) if s) + ")" for c in corners]
        out.append((f"least({', '.join(on)})", f"greatest({', '.join(on)})"))
    return out


def _projected(p: list[str], direction: tuple[int, ...]) -> str:
    return "(" + " ".join(f"{'+' if s > 0 else '-'} {x}" for x, s in zip(p, direction, strict=True) if s) + ")"


@query(pairs(" AND ".join(f"{_projected(at('a', 13, 14, 15), k)} BETWEEN {lo} AND {hi}" for k, (lo, hi) in zip(G.kdop_directions(3, 14), _kdop_bounds("b"), strict=True))))
def kdop_point(spark, sf_dir):
    return _join(spark, sf_dir, spatial.points("e13", "e14", "e15"), lambda c: G.KDOP.around(TRIANGLE(c), 14), intersects())


@query(pairs(" AND ".join(f"{x[0]} <= {y[1]} AND {x[1]} >= {y[0]}" for x, y in zip(_kdop_bounds("a"), _kdop_bounds("b"), strict=True))))
def kdop_kdop(spark, sf_dir):
    k = lambda c: G.KDOP.around(TRIANGLE(c), 14)
    return _join(spark, sf_dir, k, k, intersects())


# -- distances ---------------------------------------------------------------------------------------------------------------------


def _measured(spark, sf_dir, **columns) -> DataFrame:
    c = F.col
    return values(spark, sf_dir).select("id", *(f(c).alias(name) for name, f in columns.items()))


def each(columns: str) -> str:
    return f" SELECT b.id, {columns} FROM e b"


@query(each(f"{box_distance(at('b', 7, 8, 9))} AS point_box, greatest({box_distance(at('b', 7, 8, 9))} - 0.3::DOUBLE * abs(b.e10), 0::DOUBLE) sphere_box, greatest({d(at('b', 7, 8, 9), at('b', 1, 2, 3))} - 0.3::DOUBLE * abs(b.e10), 0::DOUBLE) point_sphere, {d(at('b', 1, 2, 3), at('b', 4, 5, 6))} AS point_point"))
def distances(spark, sf_dir):
    p = lambda c, *i: G.Point.of(*(c(n) for n in _e(*i)))
    return _measured(spark, sf_dir, point_box=lambda c: G.distance(p(c, 7, 8, 9), BOX(c)), sphere_box=lambda c: G.distance(SPHERE(c), BOX(c)), point_sphere=lambda c: G.distance(p(c, 1, 2, 3), SPHERE(c)), point_point=lambda c: G.distance(p(c, 1, 2, 3), p(c, 4, 5, 6)))


_GAPS = [f"greatest({x} - {v}, {u} - {y}, 0::DOUBLE)" for x, y, u, v in zip(ALO, AHI, LO, HI, strict=True)]
_BOX_BOX = "sqrt(" + " + ".join(f"{g} * {g}" for g in _GAPS) + ")"


@query(pairs(f"{_BOX_BOX} <= 0.02", f", {_BOX_BOX} distance"))
def box_box_within(spark, sf_dir):
    return _join(spark, sf_dir, BOX, BOX, within(0.02))


_PS, _PP = _vec(at("b", 1, 2, 3), at("b", 4, 5, 6)), _vec(at("b", 1, 2, 3), at("b", 7, 8, 9))


@query(f", s AS (SELECT id, {_dot(_PP, _PS)} / {_dot(_PS, _PS)} u FROM e b), t AS (SELECT id, {clamp('u', '0::DOUBLE', '1::DOUBLE')} t FROM s) SELECT id, sqrt({' + '.join(f'(b.e{i + 6} - (b.e{i} + {_PS[i - 1]} * t)) * (b.e{i + 6} - (b.e{i} + {_PS[i - 1]} * t))' for i in (1, 2, 3))}) distance FROM t JOIN e b USING (id)")
def point_segment(spark, sf_dir):
    return _measured(spark, sf_dir, distance=lambda c: G.distance(G.Point.of(*(c(n) for n in _e(7, 8, 9))), SEGMENT3(c)))


@query(_closest_sql(at("a", 13, 14, 15), [at("b", 1, 2, 3), at("b", 4, 5, 6), at("b", 7, 8, 9)])[0] + " SELECT query_id, value_id, distance FROM k WHERE distance <= 0.05")
def point_triangle_within(spark, sf_dir):
    return _join(spark, sf_dir, spatial.points("e13", "e14", "e15"), TRIANGLE, within(0.05))


@query(each(f"{_det('b.e7 - b.e1', 'b.e8 - b.e2', *_AC)} / {_det(*_AB, *_AC)} v, {_det(*_AB, 'b.e7 - b.e1', 'b.e8 - b.e2')} / {_det(*_AB, *_AC)} w"))
def barycentric(spark, sf_dir):
    w = lambda c: G.barycentric(G.Point.of(c("e7"), c("e8")), TRIANGLE2(c))
    return _measured(spark, sf_dir, v=lambda c: w(c)[1], w=lambda c: w(c)[2])


@query(each("(b.e1 + (b.e1 + 0.5::DOUBLE * abs(b.e4))) / 2 box_x, (b.e1 + b.e4 + b.e7) / 3 triangle_x, (b.e2 + b.e5 + b.e8 + b.e11) / 4 tet_y, (b.e1 + b.e4) / 2 segment_x, b.e7 sphere_x"))
def centroids(spark, sf_dir):
    x = lambda shape, i: lambda c: G.centroid(shape(c)).at[i]
    return _measured(spark, sf_dir, box_x=x(BOX, 0), triangle_x=x(TRIANGLE, 0), tet_y=x(TET, 1), segment_x=x(SEGMENT3, 0), sphere_x=x(SPHERE, 0))


# -- nearest ---------------------------------------------------------------------------------------------------------------------------


def ranked(distance: str, k: str, where: str = "true") -> str:
    return f", r AS (SELECT a.id query_id, b.id value_id, {distance} distance, {k} k FROM e a, e b WHERE {where}), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, value_id) place FROM r) SELECT query_id, value_id, distance, place::INT place FROM s WHERE place <= k"


@query(ranked(d(A3, B3), "5"))
def knn_points(spark, sf_dir):
    return _join(spark, sf_dir, P3, P3, nearest(5))


@query(ranked(box_distance(at("a", 7, 8, 9)), "4"))
def knn_boxes(spark, sf_dir):
    return _join(spark, sf_dir, spatial.points("e7", "e8", "e9"), BOX, nearest(4))


@query(ranked(d(A3, B3), "a.id % 7"))
def knn_variable_k(spark, sf_dir):
    t = values(spark, sf_dir).withColumn("k", (F.col("id") % 7).cast("int"))
    return SpatialIndex(t, P3).query(t, P3, nearest("k"))


@query(ranked("2::DOUBLE * abs(b.e1 - a.e1) + 0.5::DOUBLE * abs(b.e2 - a.e2)", "3", "a.id <> b.id"))
def knn_custom_metric(spark, sf_dir):
    """A metric that is at least half the Euclidean distance, so the grid still serves."""
    metric = lambda p, q: arrays.lit(2.0) * arrays.abs(q.at[0] - p.at[0]) + arrays.lit(0.5) * arrays.abs(q.at[1] - p.at[1])
    return _join(spark, sf_dir, P2, P2, nearest(3), where=lambda q, v: q("id") != v("id"), metric=metric, metric_bound=0.45)


@query("""WITH r AS (SELECT a.vec_id query_id, b.vec_id value_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))), 6) distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, value_id) place FROM r) SELECT query_id, value_id, distance, place::INT place FROM s WHERE place <= 10""")
def knn_vectors(spark, sf_dir):
    """Ten nearest of all vectors for each vector whose id is divisible by 20, in all 64 dimensions."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.nearest_vectors(t.where("id % 20 = 0"), t, 10, digits=6)


# -- ordered, limited, semi and anti -----------------------------------------------------------------------------------------------------


def _slab(alias: str = "b") -> str:
    n = "sqrt(a.e4 * a.e4 + a.e5 * a.e5 + a.e6 * a.e6)"
    lows, highs = [], []
    for i in range(3):
        t0, t1 = (f"(({x} - a.e{i + 1}) / (a.e{i + 4} / {n}))" for x in (LO[i], HI[i]))
        lows.append(f"least({t0}, {t1})")
        highs.append(f"greatest({t0}, {t1})")
    return f", t AS (SELECT a.id query_id, b.id value_id, greatest({', '.join(lows)}) lo, least({', '.join(highs)}) hi FROM e a, e b), h AS (SELECT query_id, value_id, greatest(lo, 0::DOUBLE) distance, hi - greatest(lo, 0::DOUBLE) length FROM t WHERE lo <= hi AND hi >= 0)"


@query(_slab() + " SELECT query_id, value_id FROM h")
def ray_box_hits(spark, sf_dir):
    return _join(spark, sf_dir, RAY, BOX, intersects())


@query(_slab() + " SELECT query_id, value_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, value_id)::INT place FROM h")
def ray_box_ordered(spark, sf_dir):
    return _join(spark, sf_dir, RAY, BOX, ordered_intersects())


@query(_slab() + " SELECT query_id, value_id, distance FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, value_id) = 1")
def ray_first_hit(spark, sf_dir):
    return _join(spark, sf_dir, RAY, BOX, ordered_intersects()).where("place = 1").select("query_id", "value_id", "distance")


@query(_slab() + ", f AS (SELECT *, ln(2 - exp(-length)) g FROM h), c AS (SELECT value_id, length, exp(coalesce(sum(g) OVER (PARTITION BY query_id ORDER BY distance, value_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) energy FROM f) SELECT value_id, round(sum(energy * (1 - exp(-length))), 6) deposit FROM c GROUP BY value_id")
def ray_energy(spark, sf_dir):
    """What rays deposit in the boxes that they cross, each crossing adding to the ray's energy."""
    return spatial.energy_deposit(SpatialIndex(values(spark, sf_dir), BOX), values(spark, sf_dir), RAY).select("value_id", F.round("deposit", 6).alias("deposit"))


@query(f" SELECT id FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.id <> a.id AND {d(A3, B3)} <= 0.03)")
def semi_within(spark, sf_dir):
    t = values(spark, sf_dir)
    return SpatialIndex(t, P3).exists(t, P3, 0.03, where=lambda q, v: q("id") != v("id")).select(F.col("query_id").alias("id"))


@query(f" SELECT id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.id <> a.id AND {d(A3, B3)} <= 0.03)")
def anti_within(spark, sf_dir):
    t = values(spark, sf_dir)
    return spatial.without_match(t, SpatialIndex(t, P3).exists(t, P3, 0.03, where=lambda q, v: q("id") != v("id"))).select("id")


@query(f" SELECT a.id query_id, b.id value_id FROM e a JOIN e b ON {d(A3, B3)} <= 0.08 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) <= 3")
def first_n_within(spark, sf_dir):
    return spatial.first_matches(_join(spark, sf_dir, P3, P3, within(0.08)).select("query_id", "value_id"), 3)


# -- aggregates, codes --------------------------------------------------------------------------------------------------------------------


@query(f" SELECT {', '.join(f'min({LO[i]}) lo_{i}, max({HI[i]}) hi_{i}' for i in range(3))} FROM e b")
def extent(spark, sf_dir):
    return SpatialIndex(values(spark, sf_dir), BOX).bounds()


@query(f" SELECT label, {', '.join(f'min({LO[i]}) lo_{i}, max({HI[i]}) hi_{i}' for i in range(3))} FROM e b GROUP BY label")
def extent_per_label(spark, sf_dir):
    b = BOX(F.col)
    return values(spark, sf_dir).groupBy("label").agg(*(f.alias(n) for i in range(3) for f, n in ((F.min(b.lo[i]), f"lo_{i}"), (F.max(b.hi[i]), f"hi_{i}"))))


@query(" SELECT " + ", ".join(f"min({lo}) lo_{i}, max({hi}) hi_{i}" for i, (lo, hi) in enumerate(_kdop_bounds("b"))) + " FROM e b")
def kdop_extent(spark, sf_dir):
    return spatial.kdop_extent(values(spark, sf_dir), TRIANGLE, 14)


def _morton_sql(bits: int) -> str:
    cells = [f"least(greatest(floor((e{i + 1} - lo{i}) / (hi{i} - lo{i}) * {1 << bits}), 0), {(1 << bits) - 1})::BIGINT" for i in range(3)]
    code = " + ".join(f"(((({c}) >> {b}) & 1) << {3 * b + 2 - i})" for i, c in enumerate(cells) for b in range(bits))
    return f"({code})"


@query(f", x AS (SELECT {', '.join(f'min(e{i + 1}) lo{i}, max(e{i + 1}) hi{i}' for i in range(3))} FROM e) SELECT id, {_morton_sql(10)} code32, {_morton_sql(21)} code64 FROM e, x")
def morton_codes(spark, sf_dir):
    t = values(spark, sf_dir)
    r = spatial.extent(t, P3).first()
    scene = G.Box.of([r[f"lo_{i}"] for i in range(3)], [r[f"hi_{i}"] for i in range(3)])
    return t.select("id", morton32(P3(F.col), scene).alias("code32"), morton64(P3(F.col), scene).alias("code64"))


# -- clusters -------------------------------------------------------------------------------------------------------------------------------


def _dbscan_sql(eps: float, m: int, star: bool = False) -> str:
    near = d(at("a", 1, 2, 3), at("b", 1, 2, 3))
    border = "" if star else ", bl AS (SELECT g.s id, min(cl.label) label FROM g JOIN cl ON cl.id = g.t WHERE g.s NOT IN (SELECT id FROM core) GROUP BY g.s)"
    return f"""WITH RECURSIVE e AS (SELECT vec_id id, embedding[1]::DOUBLE e1, embedding[2]::DOUBLE e2, embedding[3]::DOUBLE e3 FROM embeddings),
g AS (SELECT a.id s, b.id t FROM e a, e b WHERE {near} <= {eps}), core AS (SELECT s id FROM g GROUP BY s HAVING count(*) >= {m}),
ce AS (SELECT s, t FROM g WHERE s IN (SELECT id FROM core) AND t IN (SELECT id FROM core)),
r(id, l) AS (SELECT id, id FROM core UNION SELECT ce.t, r.l FROM r JOIN ce ON ce.s = r.id),
cl AS (SELECT id, min(l) label FROM r GROUP BY id){border}, sz AS (SELECT label, count(*) c FROM cl GROUP BY label)
SELECT e.id, CASE WHEN {m} = 2 AND sz.c = 1 THEN -1 ELSE coalesce(cl.label, {'NULL' if star else 'bl.label'}, -1) END label
FROM e LEFT JOIN cl ON cl.id = e.id {'' if star else 'LEFT JOIN bl ON bl.id = e.id'} LEFT JOIN sz ON sz.label = cl.label"""


@query(_dbscan_sql(0.03, 2))
def friends_of_friends(spark, sf_dir):
    return cluster.dbscan(values(spark, sf_dir), _e(1, 2, 3), 0.03, 2)


@query(_dbscan_sql(0.05, 5))
def dbscan(spark, sf_dir):
    return cluster.dbscan(values(spark, sf_dir), _e(1, 2, 3), 0.05, 5, implementation="fdbscan")


@query(_dbscan_sql(0.05, 5))
def dbscan_densebox(spark, sf_dir):
    return cluster.dbscan(values(spark, sf_dir), _e(1, 2, 3), 0.05, 5, implementation="densebox")


@query(_dbscan_sql(0.05, 5, star=True))
def dbscan_star(spark, sf_dir):
    return cluster.dbscan(values(spark, sf_dir), _e(1, 2, 3), 0.05, 5, algorithm="dbscan_star")


@query(f"WITH RECURSIVE o AS ({_dbscan_sql(0.05, 5).replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}) SELECT label, count(*) n FROM o WHERE label >= 0 GROUP BY label HAVING count(*) >= 3")
def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(dbscan(spark, sf_dir), 3)


@query(f", r AS (SELECT a.id, {d(A3, B3)} distance, row_number() OVER (PARTITION BY a.id ORDER BY {d(A3, B3)}) place FROM e a, e b) SELECT id, distance core FROM r WHERE place = 4")
def core_distance(spark, sf_dir):
    return cluster.core_distances(values(spark, sf_dir), _e(1, 2, 3), 4)


@query(None)
def emst(spark, sf_dir):
    return cluster.spanning_tree(values(spark, sf_dir), _e(1, 2, 3))


@query(None)
def reachability_tree(spark, sf_dir):
    return cluster.spanning_tree(values(spark, sf_dir), _e(1, 2, 3), 5)


# -- interpolation, forces ------------------------------------------------------------------------------------------------------------------------


_LJ = f", p AS (SELECT a.id, b.e1 - a.e1 dx, {d(A3, B3)} r FROM e a JOIN e b ON a.id <> b.id AND {d(A3, B3)} <= 0.1 AND {d(A3, B3)} > 0), q AS (SELECT id, dx, r, 0.0001 / (r * r) s FROM p)"


@query(_LJ + " SELECT id, round(sum(4 * (s * s * s * s * s * s - s * s * s)) / 2, 4) energy, count(*) n FROM q GROUP BY id")
def pair_energy(spark, sf_dir):
    """Half the Lennard-Jones energy of each point with its neighbours, for a size of 0.01."""

    def energy(r, a, b):
        s = arrays.lit(0.0001) / (r * r)
        return arrays.lit(4.0) * (s * s * s * s * s * s - s * s * s)

    return spatial.pair_sums(values(spark, sf_dir), _e(1, 2, 3), 0.1, {"energy": energy}).select("id", F.round(F.col("energy") / 2, 4).alias("energy"), "n")


@query("""WITH p AS (SELECT event_id id, user_id u, epoch_us(ts) / 3600000000::DOUBLE t, value v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT a.id query_id, count(*) n FROM p a JOIN p b ON abs(b.t - a.t) <= 0.5 AND sqrt((b.t - a.t) * (b.t - a.t) + (b.v - a.v) * (b.v - a.v)) <= 0.5 GROUP BY a.id) SELECT query_id, n FROM n""")
def events_within(spark, sf_dir):
    """Events close in time (hours) and value, counted for each event."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL AND ts IS NOT NULL")
    t = t.select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000.0)).alias("t"), F.col("value").alias("v"))
    shape = spatial.points("t", "v")
    return SpatialIndex(t, shape).query(t, shape, within(0.5)).groupBy("query_id").agg(F.count("*").alias("n"))


from orbweave.plans import queries_more  # noqa: E402, F401 (registers the rest)
