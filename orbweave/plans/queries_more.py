"""Further registered queries: the remaining pairs of geometries, rays, brute-force joins, trees, sequences and sources."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orbweave.functions import geometry as G
from orbweave.operators import cluster, interpolation, spatial
from orbweave.operators.grid import CartesianGrid, near_parts
from orbweave.operators.spatial import SpatialIndex, intersects, nearest, ordered_intersects, within
from orbweave.plans.queries import A3, ALO, AHI, B3, BOX, HI, LO, P3, RAY, SPHERE, TET, TRIANGLE, _closest_sql, _cross, _dbscan_sql, _dot, _e, _form, _join, _kdop_bounds, _measured, _side_sql, _vec, at, clamp, d, each, emst, pairs, query, ranked, reachability_tree, values
from orbweave.plans.shared import new_path
from orbweave.sources import generators

# -- pairs of geometries -----------------------------------------------------------------------------------------------


@query(pairs(f"{d(at('a', 7, 8, 9), at('b', 13, 14, 15))} <= 0.3::DOUBLE * abs(a.e10)"))
def sphere_point(spark, sf_dir):
    return _join(spark, sf_dir, SPHERE, spatial.points("e13", "e14", "e15"), intersects())


_CORNERS = [at("b", 1, 2, 3), at("b", 4, 5, 6), at("b", 7, 8, 9)]


def _separating() -> str:
    """A box and a triangle meet unless one of 13 axes separates their projections."""
    axes = [["1::DOUBLE" if i == j else "0::DOUBLE" for j in range(3)] for i in range(3)]
    edges = [_vec(_CORNERS[i], _CORNERS[(i + 1) % 3]) for i in range(3)]
    all_axes = [*axes, _cross(edges[0], edges[1]), *(_cross(e, x) for e in edges for x in axes)]
    half = [f"(({v} - {u}) / 2)" for u, v in zip(ALO, AHI, strict=True)]
    centre = [f"(({v} + {u}) / 2)" for u, v in zip(ALO, AHI, strict=True)]
    tests = []
    for x in all_axes:
        on = [f"({_dot(x, c)} - {_dot(x, centre)})" for c in _CORNERS]
        reach = "(" + " + ".join(f"{h} * abs({c})" for h, c in zip(half, x, strict=True)) + ")"
        tests.append(f"least({', '.join(on)}) <= {reach} AND greatest({', '.join(on)}) >= -{reach}")
    return " AND ".join(tests)


@query(pairs("a.id <> b.id AND " + _separating()))
def box_triangle(spark, sf_dir):
    """Of different rows, as a row's box and triangle share a corner."""
    return _join(spark, sf_dir, BOX, TRIANGLE, intersects(), where=lambda q, v: q("id") != v("id"))


def _box_on(direction: tuple[int, ...]) -> tuple[str, str]:
    """Least and greatest value of the second box along a direction."""
    low = " + ".join(LO[i] if s > 0 else f"-{HI[i]}" for i, s in enumerate(direction) if s)
    high = " + ".join(HI[i] if s > 0 else f"-{LO[i]}" for i, s in enumerate(direction) if s)
    return f"({low})", f"({high})"


@query(pairs(" AND ".join(f"{lo} <= {_box_on(k)[1]} AND {hi} >= {_box_on(k)[0]}" for k, (lo, hi) in zip(G.kdop_directions(3, 14), _kdop_bounds("a"), strict=True))))
def kdop_box(spark, sf_dir):
    return _join(spark, sf_dir, lambda c: G.KDOP.around(TRIANGLE(c), 14), BOX, intersects())


def _plane_hit(o: list[str], direction: list[str]) -> str:
    """CTEs with t, where a line meets the plane of the second triangle, for lines that meet the triangle."""
    n = _cross(_vec(_CORNERS[0], _CORNERS[1]), _vec(_CORNERS[0], _CORNERS[2]))
    first = f"SELECT a.id query_id, b.id value_id, {_dot(n, _vec(o, _CORNERS[0]))} / {_dot(n, direction)} t FROM e a, e b WHERE {_dot(n, direction)} <> 0"
    p = [f"({x} + {y} * t)" for x, y in zip(o, direction, strict=True)]
    inside = " AND ".join(f"{_dot(_cross(_vec(_CORNERS[i], _CORNERS[(i + 1) % 3]), _vec(_CORNERS[i], p)), n)} >= 0" for i in range(3))
    return f", t AS ({first}), h AS (SELECT query_id, value_id, t FROM t JOIN e a ON a.id = query_id JOIN e b ON b.id = value_id WHERE {inside})"


@query(_plane_hit(at("a", 10, 11, 12), _vec(at("a", 10, 11, 12), at("a", 13, 14, 15))) + " SELECT query_id, value_id FROM h WHERE t >= 0 AND t <= 1")
def segment_triangle(spark, sf_dir):
    return _join(spark, sf_dir, lambda c: G.Segment.of([c(n) for n in _e(10, 11, 12)], [c(n) for n in _e(13, 14, 15)]), TRIANGLE, intersects())


_EBOX = [(f"b.e{i}", f"(b.e{i} + 0.5::DOUBLE * abs(b.e{i + 2}))") for i in (7, 8)]
_ECENTRE = at("a", 1, 2)


def _edge_least(p: list[str], q: list[str]) -> str:
    """The ellipse's form at the point of the segment where it is least."""
    form = lambda x, y: _form(x, y).replace("b.e", "a.e")
    step, back = _vec(p, q), _vec(p, _ECENTRE)
    raw = lambda v: [x.replace("b.e", "@") for x in v]
    put = lambda sql: sql.replace("@", "b.e")
    t = clamp(f"({put(form(raw(step), raw(back)))} / {put(form(raw(step), raw(step)))})", "0::DOUBLE", "1::DOUBLE")
    x = [f"({u} + {s} * {t} - {c})" for u, s, c in zip(p, step, _ECENTRE, strict=True)]
    return put(form(raw(x), raw(x)))


_EC = [[_EBOX[0][i], _EBOX[1][j]] for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]


@query(pairs("(" + " AND ".join(f"{c} >= {lo} AND {c} <= {hi}" for c, (lo, hi) in zip(_ECENTRE, _EBOX, strict=True)) + ") OR " + " OR ".join(f"{_edge_least(_EC[i], _EC[(i + 1) % 4])} <= 1" for i in range(4))))
def ellipsoid_box(spark, sf_dir):
    t = values(spark, sf_dir)
    box = lambda c: G.Box.of([c("e7"), c("e8")], [c("e7") + F.lit(0.5) * F.abs(c("e9")), c("e8") + F.lit(0.5) * F.abs(c("e10"))])
    ellipse = lambda c: G.Ellipsoid.of([c("e1"), c("e2")], [F.lit(40.0) + F.lit(10.0) * c("e3"), F.lit(5.0) * c("e4"), F.lit(5.0) * c("e4"), F.lit(40.0) + F.lit(10.0) * c("e5")])
    return SpatialIndex(t, box).query(t, ellipse, intersects())


# -- rays --------------------------------------------------------------------------------------------------------------

_UNIT = [f"(a.e{i} / sqrt(a.e4 * a.e4 + a.e5 * a.e5 + a.e6 * a.e6))" for i in (4, 5, 6)]


@query(_plane_hit(A3, _UNIT) + " SELECT query_id, value_id, round(t, 6) distance, row_number() OVER (PARTITION BY query_id ORDER BY t, value_id)::INT place FROM h WHERE t >= 0")
def ray_triangle_ordered(spark, sf_dir):
    return _join(spark, sf_dir, RAY, lambda c: TRIANGLE(c), ordered_intersects()).withColumn("distance", F.round("distance", 6))


@query(" SELECT id, true hit FROM e")
def rays_at_shared_sides(spark, sf_dir):
    """Whether rays at a point of the side that two triangles share hit one of them; none may slip through."""
    t = values(spark, sf_dir)
    p, q, r = ([F.col(f"e{i + k}") for k in range(3)] for i in (4, 7, 10))
    s = [x + y - z for x, y, z in zip(p, q, r, strict=True)]
    f = F.lit(0.25) + F.lit(0.5) * F.abs(F.col("e13")) / (F.lit(1.0) + F.abs(F.col("e13")))
    ray = G.Ray.of(_e(1, 2, 3), [x + f * (y - x) - F.col(f"e{k}") for k, x, y in zip((1, 2, 3), p, q, strict=True)])
    return t.select("id", (G.intersects(ray, G.Triangle.of(p, q, r)) | G.intersects(ray, G.Triangle.of(q, p, s))).alias("hit"))


_OC = _vec(at("b", 7, 8, 9), A3)


@query(f", r AS (SELECT a.id query_id, b.id value_id, {_dot(_OC, _UNIT)} m, {_dot(_OC, _OC)} - 0.09::DOUBLE * b.e10 * b.e10 c FROM e a, e b), h AS (SELECT query_id, value_id, -m - sqrt(m * m - c) lo, -m + sqrt(m * m - c) hi FROM r WHERE m * m >= c) SELECT query_id, value_id, round(greatest(lo, 0::DOUBLE), 6) distance, round(hi - greatest(lo, 0::DOUBLE), 6) length FROM h WHERE hi >= 0")
def ray_sphere_hits(spark, sf_dir):
    t = values(spark, sf_dir)
    return SpatialIndex(t, SPHERE).ray_hits(t, RAY).withColumns({c: F.round(c, 6) for c in ("distance", "length")})


@query(_plane_hit(A3, _UNIT) + " SELECT query_id, value_id, round(t, 6) distance FROM h WHERE t >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t, value_id) <= 2")
def ray_nearest_triangles(spark, sf_dir):
    return _join(spark, sf_dir, RAY, TRIANGLE, nearest(2)).select("query_id", "value_id", F.round("distance", 6).alias("distance"))


# -- measures ----------------------------------------------------------------------------------------------------------


def _tet_distance() -> str:
    p, corners = at("b", 13, 14, 15), [at("b", i, i + 1, i + 2) for i in (1, 4, 7, 10)]
    parts = []
    for i in range(4):
        face = [corners[j] for j in range(4) if j != i]
        ctes = _closest_sql(p, face)[0].replace("FROM e a, e b", "FROM e a JOIN e b ON a.id = b.id")
        for name in "tuk":
            ctes = ctes.replace(f" {name} AS (", f" {name}{i} AS (").replace(f"FROM {name})", f"FROM {name}{i})").replace(f"FROM {name},", f"FROM {name}{i},")
        parts.append(ctes)
    inside = ", ".join(f"{_side_sql(p, [corners[j] for j in range(4) if j != i], corners[i])} AS s{i}" for i in range(4))
    least = ", ".join(f"CASE WHEN s{i} THEN 'inf'::DOUBLE ELSE k{i}.distance END" for i in range(4))
    return "".join(parts) + f", s AS (SELECT b.id, {inside} FROM e b), m AS (SELECT s.id, least({least}) v FROM s " + " ".join(f"JOIN k{i} ON k{i}.query_id = s.id" for i in range(4)) + ") SELECT id, round(CASE WHEN v = 'inf'::DOUBLE THEN 0 ELSE v END, 7) distance FROM m"


@query(_tet_distance())
def point_tetrahedron_distance(spark, sf_dir):
    return _measured(spark, sf_dir, distance=lambda c: F.round(G.distance(G.Point.of(*(c(n) for n in _e(13, 14, 15))), TET(c)), 7))


@query(each(f"greatest({d(at('b', 7, 8, 9), at('b', 11, 12, 13))} - 0.3::DOUBLE * abs(b.e10) - 0.1::DOUBLE * abs(b.e14), 0::DOUBLE) AS distance"))
def sphere_sphere_distance(spark, sf_dir):
    other = lambda c: G.Sphere.of([c(n) for n in _e(11, 12, 13)], F.lit(0.1) * F.abs(c("e14")))
    return _measured(spark, sf_dir, distance=lambda c: G.distance(SPHERE(c), other(c)))


def _triple(a: list[str], b: list[str], c: list[str]) -> str:
    return _dot(a, _cross(b, c))


_TC = [at("b", i, i + 1, i + 2) for i in (1, 4, 7, 10)]
_TP = at("b", 13, 14, 15)
_WHOLE = _triple(*(_vec(_TC[0], x) for x in _TC[1:]))


def _swapped(i: int) -> str:
    """The weight of corner i: the volume with that corner moved to the point, by the whole."""
    c = [_TP if j == i else x for j, x in enumerate(_TC)]
    return f"round({_triple(*(_vec(c[0], x) for x in c[1:]))} / {_WHOLE}, 4) AS w{i}"


@query(each(", ".join(map(_swapped, range(4)))))
def barycentric_tetrahedron(spark, sf_dir):
    w = lambda c: G.barycentric(G.Point.of(*(c(n) for n in _e(13, 14, 15))), TET(c))
    return _measured(spark, sf_dir, **{f"w{i}": (lambda c, i=i: F.round(w(c)[i], 4)) for i in range(4)})


@query(each("(b.e1 * 0.1::DOUBLE)::FLOAT::DOUBLE AS x, (b.e2 * 0.1::DOUBLE)::FLOAT::DOUBLE AS y, (b.e1 * 0.1::DOUBLE)::FLOAT::DOUBLE AS lo_x, ((b.e1 + 0.5::DOUBLE * abs(b.e4)) * 0.1::DOUBLE)::FLOAT::DOUBLE AS hi_x"))
def converted(spark, sf_dir):
    p = lambda c: G.convert(G.convert(G.Point.of(c("e1") * F.lit(0.1), c("e2") * F.lit(0.1)), "float"), "double")
    b = lambda c: G.convert(G.convert(G.Box([x * F.lit(0.1) for x in BOX(c).lo], [x * F.lit(0.1) for x in BOX(c).hi]), "float"), "double")
    return _measured(spark, sf_dir, x=lambda c: p(c).at[0], y=lambda c: p(c).at[1], lo_x=lambda c: b(c).lo[0], hi_x=lambda c: b(c).hi[0])


@query(each("b.e4 > 0 AND b.e5 > 0 AND b.e6 > 0 AS box_valid, b.e10 >= 0 AS sphere_valid, b.id % 3 <> 0 AS point_valid, b.id % 2 = 0 AS boxes_equal, b.e1 = b.e2 AS points_equal"))
def validity(spark, sf_dir):
    """Boxes turned inside out, negative radii, infinite points; boxes that differ in one bound."""
    box = lambda c: G.Box.of([c(n) for n in _e(1, 2, 3)], [c(f"e{i}") + c(f"e{i + 3}") for i in (1, 2, 3)])
    moved = lambda c: G.Box.of([c(n) for n in _e(1, 2, 3)], [c("e4"), c("e5"), c("e6") + c("id") % 2])
    bound = lambda c: G.Box.of([c(n) for n in _e(1, 2, 3)], [c("e4"), c("e5"), c("e6")])
    far = lambda c: G.Point.of(c("e1"), F.when(c("id") % 3 == 0, F.lit(G.INF)).otherwise(c("e2")))
    return _measured(
        spark, sf_dir, box_valid=lambda c: G.is_valid(box(c)), sphere_valid=lambda c: G.is_valid(G.Sphere.of([c(n) for n in _e(7, 8, 9)], c("e10"))), point_valid=lambda c: G.is_valid(far(c)),
        boxes_equal=lambda c: G.equals(bound(c), moved(c)), points_equal=lambda c: G.equals(G.Point.of(c("e1")), G.Point.of(c("e2"))),
    )


@query(each(", ".join(f"least({LO[i]}, b.e{i + 7}) AS lo_{i}, greatest({HI[i]}, b.e{i + 7}) AS hi_{i}" for i in range(3))))
def expanded_boxes(spark, sf_dir):
    grown = lambda c: G.expand(BOX(c), G.Point.of(*(c(n) for n in _e(7, 8, 9))))
    return _measured(spark, sf_dir, **{f"{k}_{i}": (lambda c, k=k, i=i: getattr(grown(c), k)[i]) for i in range(3) for k in ("lo", "hi")})


# -- strategies, limits, grids ---------------------------------------------------------------------------------------------


@query(pairs(f"{d(A3, B3)} <= 0.08", f", {d(A3, B3)} distance"))
def brute_within(spark, sf_dir):
    t = values(spark, sf_dir)
    return SpatialIndex(t, P3, strategy="brute").query(t, P3, within(0.08))


@query(ranked(d(A3, B3), "5"))
def brute_nearest(spark, sf_dir):
    t = values(spark, sf_dir)
    return SpatialIndex(t, P3, strategy="brute").query(t, P3, nearest(5))


@query(pairs(f"{d(A3, B3)} <= 0.05"))
def limited_within(spark, sf_dir):
    """As an error would tell if a point had more than a thousand results."""
    return _join(spark, sf_dir, P3, P3, within(0.05), max_results=1000).select("query_id", "value_id")


@query(pairs(f"{d(A3, B3)} <= 0.05 AND a.e1 > 0.15", f", {d(A3, B3)} distance"))
def stored_within(spark, sf_dir):
    """Values written once along a curve; the queries of one side of the scene read the row groups there."""
    t = values(spark, sf_dir)
    path = new_path(spark, "stored-index")
    spatial.StoredIndex.write(t.select("id", *_e(1, 2, 3)), P3, path, partitions=8)
    return spatial.StoredIndex(spark, path, P3).query(t.where("e1 > 0.15"), P3, within(0.05))


_AFAR = [f"({k}::DOUBLE + {f}::DOUBLE * a.e{i})" for i, (k, f) in zip((1, 2, 3), ((100, 40), (0, 5), (-3, 1)), strict=True)]


@query(ranked(d(_AFAR, B3), "5"))
def knn_far(spark, sf_dir):
    """Queries a hundred units from all values: only the parts within the bound are looked into."""
    t = values(spark, sf_dir)
    q = t.select("id", *(F.expr(x.replace("a.", "").replace("::DOUBLE", "D")).alias(f"e{i}") for i, x in zip((1, 2, 3), _AFAR, strict=True)))
    return SpatialIndex(t, P3).query(q, P3, nearest(5))


@query(ranked(d(A3, B3), "4", "b.id % 53 = a.id % 53"))
def knn_where_few(spark, sf_dir):
    """A condition that one value in 53 passes, so samples of cells give no bound."""
    return _join(spark, sf_dir, P3, P3, nearest(4), where=lambda q, v: v("id") % 53 == q("id") % 53)


@query(ranked(f"sqrt({d(A3, B3)})", "3"))
def knn_root_metric(spark, sf_dir):
    """A metric that no factor of the distance bounds, but a box does."""
    root = lambda p, q: F.sqrt(G.distance(p, q))
    return _join(spark, sf_dir, P3, P3, nearest(3), metric=root, metric_box=root)


@query(f" SELECT a.id query_id, least(count(*), 3) n FROM e a, e b WHERE {d(A3, B3)} <= 0.1 GROUP BY a.id")
def some_within(spark, sf_dir):
    """Three matches of each point, or all if it has fewer, by a search that stops there; how many it found."""
    t = values(spark, sf_dir)
    return SpatialIndex(t, P3).some(t, P3, 3, 0.1).groupBy("query_id").agg(F.count("*").alias("n"))


@query(f" SELECT a.id, least(count(*), 6) n FROM e a, e b WHERE {d(A3, B3)} <= 0.08 GROUP BY a.id")
def bounded_counts(spark, sf_dir):
    return spatial.bounded_counts(values(spark, sf_dir), _e(1, 2, 3), 0.08, 6)


@query(f" SELECT a.id query_id FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE {' AND '.join(f'{x} <= {v} AND {y} >= {u}' for x, y, u, v in zip(ALO, AHI, LO, HI, strict=True))} AND b.id > a.id)")
def box_exists(spark, sf_dir):
    t = values(spark, sf_dir)
    return SpatialIndex(t, BOX).exists(t, BOX, where=lambda q, v: v("id") > q("id"))


_CELL = ["least(greatest(floor((b.e{} + 0.5::DOUBLE) / 0.125::DOUBLE), 0), 8)::BIGINT".format(i) for i in (1, 2, 3)]


@query(each(f"{_CELL[0]} + 9 * {_CELL[1]} + 81 * {_CELL[2]} AS cell, -0.5::DOUBLE + {_CELL[1]} * 0.125::DOUBLE AS lo_y"))
def grid_cells(spark, sf_dir):
    grid = CartesianGrid.of([-0.5] * 3, [0.5] * 3, 0.125)
    cell = lambda c: grid.index(P3(c))
    return _measured(spark, sf_dir, cell=cell, lo_y=lambda c: grid.box(cell(c)).lo[1])


@query(", p AS (SELECT label, " + ", ".join(f"min(e{i}) l{i}, max(e{i}) h{i}" for i in (1, 2, 3)) + " FROM e WHERE e1 > 0.05 GROUP BY label) SELECT a.label part, b.label other FROM p a, p b WHERE sqrt(" + " + ".join(f"power(greatest(a.l{i} - b.h{i}, b.l{i} - a.h{i}, 0::DOUBLE), 2)" for i in (1, 2, 3)) + ") <= 0.01")
def parts_near(spark, sf_dir):
    return near_parts(values(spark, sf_dir).where("e1 > 0.05"), "label", _e(1, 2, 3), 0.01)


# -- sequences ---------------------------------------------------------------------------------------------------------------


@query(f" SELECT a.id query_id, count(*) n FROM e a, e b WHERE {d(A3, B3)} <= 0.05 GROUP BY a.id")
def counts_from_offsets(spark, sf_dir):
    """Offsets of all results, and the counts found again from them."""
    t = values(spark, sf_dir)
    crs = spatial.offsets(spatial.counts(_join(spark, sf_dir, P3, P3, within(0.05)), t), block=64)
    total = crs.agg(F.max(F.struct("query_id", "n", "offset")).alias("m")).select((F.col("m.query_id") + 1).alias("query_id"), (F.col("m.n") + F.col("m.offset")).alias("offset"))
    return spatial.to_counts(crs.select("query_id", "offset").unionByName(total), block=8).select("query_id", "n")


@query(" SELECT id AS \"index\", e1 AS \"key\", row_number() OVER (ORDER BY e1, id) - 1 AS place FROM e")
def sorted_by_key(spark, sf_dir):
    return spatial.sort_by_key(values(spark, sf_dir).withColumnRenamed("id", "index"), "e1")


@query(" SELECT row_number() OVER (ORDER BY e1, id) - 1 AS place, e2 FROM e")
def permuted(spark, sf_dir):
    t = values(spark, sf_dir).withColumnRenamed("id", "index").select("index", "e1", "e2")
    return spatial.apply_permutation(spatial.sort_by_key(t, "e1"), t.select("index", "e2"))


@query(" SELECT a.id query_id, count(*) FILTER (b.e1 < a.e2) AS \"lower\", count(*) FILTER (b.e1 <= a.e2) AS \"upper\" FROM e a, e b GROUP BY a.id")
def insertion_points(spark, sf_dir):
    t = values(spark, sf_dir)
    return spatial.insertion_points(t.select(F.col("e1").alias("value")), t.select("id", F.col("e2").alias("value")))


@query(" SELECT id, row_number() OVER (ORDER BY id) - 1 AS \"index\" FROM e")
def indexed(spark, sf_dir):
    return spatial.attach_indices(values(spark, sf_dir).select("id").orderBy("id"))


@query(" SELECT unnest(range(5, 5 + (SELECT count(*) FROM e))) AS \"value\"")
def counted_up(spark, sf_dir):
    """As many numbers as there are rows, from 5 up."""
    return generators.iota(spark, values(spark, sf_dir).count(), 5)


_SIDE = "SELECT ceil(cbrt(count(*) / 4.0::DOUBLE - 0.001::DOUBLE))::BIGINT s FROM e"


@query(f", s AS ({_SIDE}), p AS (SELECT id, label, s, id // (s * s * s) part, id % (s * s * s) i FROM e, s) SELECT id, part, (i % s + s * (part % 2))::DOUBLE x, (i // s % s)::DOUBLE y, (i // (s * s) + s * (part // 2))::DOUBLE z, label FROM p WHERE part < 4")
def lattice_points(spark, sf_dir):
    """Each row at the place of its id in a lattice of four parts that has room for all of them."""
    t = values(spark, sf_dir)
    side = math.ceil((t.count() / 4.0 - 0.001) ** (1 / 3))
    at = generators.lattice(spark, side, parts=(2, 1, 2))
    return at.join(t.select("id", "label"), "id").select("id", F.col("part").cast("long").alias("part"), "x", "y", "z", "label")


_SPARSE = "((id * 7919) % 1009) * 9000000000000 + id"


@query(f", c AS (SELECT {_SPARSE} query_id, id % 7 n FROM e) SELECT query_id, n, (sum(n) OVER (ORDER BY query_id) - n)::BIGINT AS \"offset\" FROM c")
def offsets_of_sparse_ids(spark, sf_dir):
    """Offsets over ids that lie far apart, in ranges of about 64 of them."""
    return spatial.offsets(values(spark, sf_dir).select(F.expr(_SPARSE).alias("query_id"), (F.col("id") % 7).alias("n")), block=64)


@query(" , v AS (SELECT CASE WHEN id % 500 = 0 THEN 1e12 WHEN id % 3 = 0 THEN 0.25 ELSE e1 END x FROM e) SELECT a.id query_id, count(*) FILTER (v.x < a.e2) AS \"lower\", count(*) FILTER (v.x <= a.e2) AS \"upper\" FROM e a, v GROUP BY a.id")
def insertion_points_skewed(spark, sf_dir):
    """A third of the values equal, and outliers that stretch their range a trillionfold."""
    t = values(spark, sf_dir)
    x = F.when(F.col("id") % 500 == 0, F.lit(1e12)).when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.col("e1"))
    return spatial.insertion_points(t.select(x.alias("value")), t.select("id", F.col("e2").alias("value")), block=100)


@query(f" SELECT a.id, round(sum(24::DOUBLE * (2 * power(0.0001 / {d(A3, B3)} ** 2, 6) - power(0.0001 / {d(A3, B3)} ** 2, 3)) / {d(A3, B3)} ** 2 * (a.e1 - b.e1)), 3) fx, round(sum(4 * (power(0.0001 / {d(A3, B3)} ** 2, 6) - power(0.0001 / {d(A3, B3)} ** 2, 3))) / 2, 4) energy FROM e a JOIN e b ON a.id <> b.id AND {d(A3, B3)} <= 0.1 AND {d(A3, B3)} > 0.01 GROUP BY a.id")
def pair_forces(spark, sf_dir):
    """The Lennard-Jones force along x and energy of each point, of pairs that don't overlap."""
    out = spatial.pair_forces(values(spark, sf_dir), _e(1, 2, 3), 0.1, sigma=0.01, least=0.01)
    return out.select("id", F.round("force_e1", 3).alias("fx"), F.round("energy", 4).alias("energy"))


# -- trees -------------------------------------------------------------------------------------------------------------------


def _tree_sql(k: int) -> str:
    """CTEs up to g (i, source, target, weight): Prim's algorithm, each point outside holding its best edge to the tree."""
    core = f"SELECT id, e1, e2, e3, (SELECT x FROM (SELECT {d(A3, B3)} x FROM e b ORDER BY x LIMIT 1 OFFSET {k - 1})) core FROM e a" if k > 1 else "SELECT id, e1, e2, e3, 0::DOUBLE core FROM e a"
    w = f"greatest({d(A3, B3)}, a.core, b.core)"
    return f"""WITH RECURSIVE e AS (SELECT vec_id id, embedding[1]::DOUBLE e1, embedding[2]::DOUBLE e2, embedding[3]::DOUBLE e3 FROM embeddings),
p AS MATERIALIZED ({core}),
r(i, id, w, link) AS (SELECT 0::BIGINT, a.id, {w}, b.id FROM p a JOIN p b ON b.id = (SELECT min(id) FROM p) AND a.id <> b.id
 UNION ALL SELECT r.i + 1, r.id, least(r.w, {w}), CASE WHEN ({w}, least(a.id, b.id), greatest(a.id, b.id)) < (r.w, least(r.id, r.link), greatest(r.id, r.link)) THEN b.id ELSE r.link END
 FROM r JOIN (SELECT id FROM r ORDER BY w, least(id, link), greatest(id, link) LIMIT 1) m ON r.id <> m.id JOIN p a ON a.id = r.id JOIN p b ON b.id = m.id),
g AS (SELECT i, least(id, link) source, greatest(id, link) target, w weight FROM r QUALIFY row_number() OVER (PARTITION BY i ORDER BY w, least(id, link), greatest(id, link)) = 1)"""


def _dendrogram_sql(k: int) -> str:
    """Edges merged in order; each round holds every vertex's component and its last edge."""
    return _tree_sql(k) + """,
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY weight, source, target) - 1 n, source, target, weight FROM g),
c(n, id, part, top) AS (SELECT 0::BIGINT, id, id, NULL::BIGINT FROM p
 UNION ALL SELECT c.n + 1, c.id, CASE WHEN c.part = t.part THEN s.part ELSE c.part END, CASE WHEN c.part IN (s.part, t.part) THEN o.n ELSE c.top END
 FROM c JOIN o ON o.n = c.n JOIN c s ON s.id = o.source JOIN c t ON t.id = o.target),
q AS (SELECT o.n parent, c.id, c.top FROM o JOIN c ON c.n = o.n AND c.id IN (o.source, o.target)),
z AS (SELECT (SELECT count(*) FROM o) m)
SELECT o.n node, 'edge' kind, NULL::BIGINT vertex, coalesce(q.parent, -1) parent, weight height FROM o LEFT JOIN q ON q.top = o.n
UNION ALL SELECT m + row_number() OVER (ORDER BY p.id) - 1, 'vertex', p.id, q.parent, 0 FROM p JOIN q ON q.id = p.id AND q.top IS NULL, z"""


query(_tree_sql(1) + " SELECT source, target, weight FROM g")(emst)
query(_tree_sql(5) + " SELECT source, target, weight FROM g")(reachability_tree)


@query(_dendrogram_sql(1))
def single_linkage(spark, sf_dir):
    return cluster.dendrogram(emst(spark, sf_dir))


@query(_dendrogram_sql(1))
def single_linkage_rounds(spark, sf_dir):
    """The hierarchy by contraction over the cluster, in parts of 60 edges."""
    return cluster.dendrogram(emst(spark, sf_dir), local_edges=60)


@query(_dbscan_sql(0.05, 5))
def dbscan_halo(spark, sf_dir):
    """Eight parts with halos, clustered side by side."""
    t = values(spark, sf_dir)
    return cluster.halo_dbscan(t, _e(1, 2, 3), 0.05, 5, part_points=max(1, t.count() // 8))


@query(f"WITH RECURSIVE o AS ({_dbscan_sql(0.05, 5)}) SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 place FROM o WHERE label >= 0 QUALIFY count(*) OVER (PARTITION BY label) >= 3")
def cluster_members(spark, sf_dir):
    labels = cluster.dbscan(values(spark, sf_dir), _e(1, 2, 3), 0.05, 5)
    return cluster.cluster_members(labels, 3)


@query(_dendrogram_sql(5))
def hdbscan(spark, sf_dir):
    return cluster.hdbscan(values(spark, sf_dir), _e(1, 2, 3), 5)


@query(_tree_sql(1) + " SELECT source, target, weight FROM g")
def emst_rounds(spark, sf_dir):
    """The tree by rounds over the cluster, whatever the number of points."""
    return cluster.spanning_tree(values(spark, sf_dir), _e(1, 2, 3), local_points=0)


@query(" SELECT id target_id, round(2 * e3 - e4 + 1, 6) f FROM e")
def mls_interpolate(spark, sf_dir):
    """A linear field is reproduced at other points."""
    t = values(spark, sf_dir)
    sources, targets = t.select("id", "e1", "e2", (F.lit(2.0) * F.col("e1") - F.col("e2") + 1.0).alias("f")), t.select("id", F.col("e3").alias("e1"), F.col("e4").alias("e2"))
    coefficient = interpolation.mls_coefficients(sources, targets, ["e1", "e2"], "wendland2", 1, 6)
    return interpolation.interpolate(coefficient, sources, ["f"]).withColumn("f", F.round("f", 6))


@query(" SELECT id target_id, round(e3 * e3 - 3 * e3 * e4 + e4, 5) f FROM e")
def mls_quadratic(spark, sf_dir):
    """A quadratic field is reproduced with twice as many sources as terms."""
    t = values(spark, sf_dir)
    field = F.col("e1") * F.col("e1") - F.lit(3.0) * F.col("e1") * F.col("e2") + F.col("e2")
    sources, targets = t.select("id", "e1", "e2", field.alias("f")), t.select("id", F.col("e3").alias("e1"), F.col("e4").alias("e2"))
    coefficient = interpolation.mls_coefficients(sources, targets, ["e1", "e2"], "wu4", 2, 12)
    return interpolation.interpolate(coefficient, sources, ["f"]).withColumn("f", F.round("f", 5))


_FAULTY = "CASE WHEN id % 10 = 0 THEN -1 WHEN id % 10 = 1 AND label >= 0 THEN 3 ELSE label END"


def _verified_sql(eps: float, m: int) -> str:
    """The faults that wrong labels make, counted from the pairs."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id id, embedding[1]::DOUBLE e1, embedding[2]::DOUBLE e2, embedding[3]::DOUBLE e3 FROM embeddings),
g AS (SELECT a.id s, b.id t FROM e a, e b WHERE {d(A3, B3)} <= {eps}), core AS (SELECT s id FROM g GROUP BY s HAVING count(*) >= {m}),
ce AS (SELECT s, t FROM g WHERE s IN (SELECT id FROM core) AND t IN (SELECT id FROM core)),
r(id, l) AS (SELECT id, id FROM core UNION SELECT ce.t, r.l FROM r JOIN ce ON ce.s = r.id),
cl AS (SELECT id, min(l) part FROM r GROUP BY id),
bl AS (SELECT g.s id, min(cl.part) part FROM g JOIN cl ON cl.id = g.t WHERE g.s NOT IN (SELECT id FROM core) GROUP BY g.s),
o AS (SELECT e.id, coalesce(cl.part, bl.part, -1) label, cl.part, cl.id IS NOT NULL core FROM e LEFT JOIN cl ON cl.id = e.id LEFT JOIN bl ON bl.id = e.id),
x AS (SELECT id, {_FAULTY} label, part, core FROM o),
b AS (SELECT a.id, a.label, max((a.label = n.label)::INT) shares FROM x a LEFT JOIN g ON g.s = a.id LEFT JOIN x n ON n.id = g.t AND n.core WHERE NOT a.core GROUP BY a.id, a.label)
SELECT (SELECT count(*) FROM x WHERE core AND label < 0) core_noise,
 (SELECT count(*) FROM ce JOIN x a ON a.id = s JOIN x n ON n.id = t WHERE a.label <> n.label) split_core,
 (SELECT count(*) FROM b WHERE shares IS NULL AND label >= 0) stray_label, (SELECT count(*) FROM b WHERE shares = 0) wrong_border,
 (SELECT count(*) FROM (SELECT label FROM x WHERE core AND label >= 0 GROUP BY label HAVING count(DISTINCT part) > 1)) merged_label"""


@query(_verified_sql(0.05, 5))
def dbscan_verified(spark, sf_dir):
    """Wrong labels, and how many violations of each kind the verifier finds."""
    t = values(spark, sf_dir)
    labels = cluster.dbscan(t, _e(1, 2, 3), 0.05, 5).withColumn("label", F.expr(_FAULTY).cast("long"))
    return cluster.verify_dbscan(t, labels, _e(1, 2, 3), 0.05, 5)
