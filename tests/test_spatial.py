"""Joins, run for each strategy; compared as sets within a query."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from orbweave.functions import geometry as G
from orbweave.functions.errors import GeometryError, LimitExceeded
from orbweave.operators import spatial as S
from orbweave.operators.parts import Parts, box_gap
from orbweave.operators.vectors import nearest_vectors

XYZ = ("x", "y", "z")
P3, B3 = S.points(*XYZ), S.boxes(("x", "y", "z"), ("u", "v", "w"))
POINTS, BOXES = "id long, x double, y double, z double", "id long, x double, y double, z double, u double, v double, w double"

both = pytest.mark.parametrize("strategy", ["grid", "brute"])


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], POINTS)


def hits(df, *columns):
    return sorted(tuple(r) for r in df.select("query_id", "value_id", *columns).collect())


def diagonal(spark, n):
    return cloud(spark, [(i, i, i) for i in range(n)])


@both
def test_empty_and_one(spark, strategy):
    none = cloud(spark, [])
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], BOXES)
    q = cloud(spark, [(5, 5, 5), (0.5, 0.5, 0.5)])
    assert hits(S.SpatialIndex(none, P3, strategy=strategy).query(q, P3, S.within(1))) == []
    assert hits(S.SpatialIndex(none, P3, strategy=strategy).query(q, P3, S.nearest(2))) == []
    index = S.SpatialIndex(one, B3, strategy=strategy)
    assert hits(index.query(q, P3, S.intersects())) == [(1, 0)]
    assert hits(index.query(q, P3, S.nearest(3))) == [(0, 0), (1, 0)]
    assert hits(index.query(none, P3, S.intersects())) == []
    assert S.SpatialIndex(none, P3).empty() and index.size() == 1


@both
def test_two_leaves_and_k(spark, strategy):
    q = diagonal(spark, 2).withColumn("k", F.when(F.col("id") == 0, 2).otherwise(4))
    found = S.SpatialIndex(diagonal(spark, 2), P3, strategy=strategy).query(q, P3, S.nearest("k"))
    assert hits(found, "place") == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1)]
    assert hits(S.SpatialIndex(diagonal(spark, 2), P3, strategy=strategy).query(q, P3, S.nearest(0))) == []


@both
def test_duplicates(spark, strategy):
    v, q = cloud(spark, [(0, 0, 0)] + [(1, 1, 1)] * 3), cloud(spark, [(0, 0, 0), (1, 1, 1), (0.5, 0.5, 0.5)])
    assert hits(S.SpatialIndex(v, P3, strategy=strategy).query(q, P3, S.within(1))) == [(0, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)]


@both
def test_lattice(spark, strategy):
    side = range(5)
    at = list(itertools.product(side, side, side))
    v = cloud(spark, [(10 * a, 10 * b, 10 * c) for a, b, c in at])
    q = v.select("id", *((F.col(c) - 10).alias(c) for c in XYZ), *((F.col(c) + 10).alias(d) for c, d in zip(XYZ, "uvw", strict=True)))
    want = sorted((i, j) for i, a in enumerate(at) for j, b in enumerate(at) if all(abs(x - y) <= 1 for x, y in zip(a, b, strict=True)))
    assert hits(S.SpatialIndex(v, P3, strategy=strategy).query(q, B3, S.intersects())) == want
    assert hits(S.SpatialIndex(v, P3, strategy=strategy).query(v, P3, S.within(10))) == sorted((i, j) for i, a in enumerate(at) for j, b in enumerate(at) if sum(abs(x - y) for x, y in zip(a, b, strict=True)) <= 1)


def test_strategies_agree_on_random_clouds(spark):
    r = random.Random(4)
    pts = cloud(spark, [(r.random(), r.random() ** 2, r.random() ** 4) for _ in range(250)])
    boxes = spark.createDataFrame([(i, *(p := [r.random() for _ in range(3)]), *(a + r.random() ** 8 for a in p)) for i in range(200)], BOXES)
    ray = lambda c: G.Ray.of([c(n) for n in XYZ], [c("y") - 0.4, c("z") - 0.4, c("x") - 0.4])
    for v, vs, q, qs, p, more in ((pts, P3, pts, P3, S.within(0.15), ["distance"]), (boxes, B3, boxes, B3, S.intersects(), []), (boxes, B3, pts, P3, S.nearest(4), ["place"]), (pts, P3, pts, P3, S.nearest(7), ["place"]), (boxes, B3, boxes, B3, S.within(0.05), []), (boxes, B3, pts, ray, S.ordered_intersects(), ["place"])):
        grid, brute = (hits(S.SpatialIndex(v, vs, strategy=s).query(q, qs, p), *more) for s in ("grid", "brute"))
        assert grid == brute and grid


@both
def test_ordered_rays(spark, strategy):
    v = spark.createDataFrame([(i, *[float(i)] * 3, *[i + 1.0] * 3) for i in range(10)], BOXES)
    q = spark.createDataFrame([(0, -0.5, -0.5, -0.5, 1.0, 1.0, 1.0), (1, 10.5, 10.5, 10.5, -1.0, -1.0, -1.0)], BOXES)
    ray = lambda c: G.Ray.of([c(n) for n in XYZ], [c(n) for n in "uvw"])
    found = S.SpatialIndex(v, B3, strategy=strategy).query(q, ray, S.ordered_intersects())
    order = {i: [r["value_id"] for r in found.where(F.col("query_id") == i).orderBy("place").collect()] for i in (0, 1)}
    assert order == {0: list(range(10)), 1: list(range(9, -1, -1))}


def test_custom_metric(spark):
    v, q = cloud(spark, [(1, 0, 0), (0, 3, 0), (0, 0, 0)]), cloud(spark, [(0, 1, 0)])
    metric = lambda a, b: F.lit(2.0) * F.abs(a.at[0] - b.at[0]) + F.abs(a.at[1] - b.at[1]) / 2
    flat = S.points("x", "y")
    for bound in (None, 0.4):
        found = S.SpatialIndex(v, flat).query(q, flat, S.nearest(2), metric=metric, metric_bound=bound)
        assert [r["value_id"] for r in found.orderBy("place").collect()] == [2, 1]


def test_callbacks_as_columns(spark):
    v = diagonal(spark, 10)
    q = cloud(spark, [(0, 0, 0)]).withColumn("payload", F.lit(5.0))
    found = S.SpatialIndex(v, P3).query(q, P3, S.within(100), keep=["payload"])
    assert sorted(r[0] for r in found.select(F.round(F.col("distance") + F.col("payload"), 6)).collect()) == pytest.approx([5 + i * 3**0.5 for i in range(10)], abs=1e-6)
    everything = S.SpatialIndex(diagonal(spark, 4), P3).query(diagonal(spark, 4), P3, S.within(100))
    assert S.first_matches(everything, 2).count() == 8
    assert [S.at_most(everything, n).count() for n in (4, 5)] == [16, 16]
    with pytest.raises(LimitExceeded):
        S.at_most(everything, 3)
    with pytest.raises(GeometryError):
        S.within(0)


@pytest.mark.parametrize("r, want", [(1, [0, 0, 0, 0]), (2, [0, 1, 1, 1]), (4, [0, 1, 2, 2]), (6, [0, 1, 2, 3])])
def test_neighbour_lists(spark, r, want):
    v = diagonal(spark, 4)
    half = S.half_neighbors(v, XYZ, r)
    lists = half.select(F.col("b").alias("query_id"), F.col("a").alias("value_id"))
    start = S.offsets(S.counts(lists, v), block=2)
    rows = start.orderBy("query_id").collect()
    assert [x["n"] for x in rows] == want and [x["offset"] for x in rows] == [sum(want[:i]) for i in range(4)]
    assert S.full_neighbors(v, XYZ, r).count() == 2 * sum(want)
    assert sorted(x["position"] for x in S.to_crs(lists, v).collect()) == list(range(sum(want)))
    ends = start.select("query_id", "offset").union(spark.createDataFrame([(4, sum(want))], "query_id long, offset long"))
    assert [x["n"] for x in S.to_counts(ends).orderBy("query_id").collect()] == want


def test_indices_and_curve(spark):
    df = spark.range(100).repartition(5)
    assert sorted(r["index"] for r in S.attach_indices(df).collect()) == list(range(100))
    assert S.attach_indices(df.limit(0)).count() == 0
    assert [r["id"] for r in S.along_curve(spark.range(50).repartition(3), F.col("id"), 1).collect()] == list(range(50))


def test_vectors(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = {}
    for r in nearest_vectors(v.where("id % 20 = 0"), v, 6, value_blocks=5).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["value_id"])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert got == {i: np.argsort(d[i], kind="stable")[:6].tolist() for i in range(0, 300, 20)}


def test_nearest_vectors_of_equal_values(spark):
    import numpy as np

    ids = list(range(300))
    np.random.default_rng(4).shuffle(ids)
    v = spark.createDataFrame([(i, [1.0, 2.0, 3.0 + (i >= 280)]) for i in ids], "id long, embedding array<double>")
    for digits in (None, 6):
        got = nearest_vectors(v.where("id IN (7, 290)"), v, 4, digits, value_blocks=2).orderBy("query_id", "place").collect()
        assert [(r["query_id"], r["value_id"], r["distance"]) for r in got] == [(q, lo + i, 0.0) for q, lo in ((7, 0), (290, 280)) for i in range(4)]
    few = nearest_vectors(v.where("id = 3"), v.where("id < 2"), 4, value_blocks=3).orderBy("place").collect()
    assert [r["value_id"] for r in few] == [0, 1]


def test_rays_meet_all_shapes_as_brute_force_says(spark):
    r = random.Random(11)
    rows = [(i, *(r.uniform(-2, 2) for _ in range(9)), r.random() ** 3) for i in range(150)] + [(150 + i, *[float(i)] * 9, 0.0) for i in range(3)]
    v = spark.createDataFrame(rows, "id long, " + ", ".join(f"a{i} double" for i in range(9)) + ", r double")
    rays = spark.createDataFrame([(i, *(r.uniform(-3, 3) for _ in range(3)), *(r.choice([0.0, r.uniform(-1, 1)]) for _ in range(3))) for i in range(60)] + [(60, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], BOXES)
    ray = lambda c: G.Ray.of([c(n) for n in XYZ], [c(n) for n in "uvw"])
    box = lambda c: G.Box.of([F.least(c(f"a{i}"), c(f"a{i + 3}")) for i in range(3)], [F.greatest(c(f"a{i}"), c(f"a{i + 3}")) for i in range(3)])
    sphere = lambda c: G.Sphere.of([c("a0"), c("a1"), c("a2")], c("r"))
    triangle = lambda c: G.Triangle.of(*([c(f"a{i + j}") for j in range(3)] for i in (0, 3, 6)))
    for shape in (box, sphere, triangle):
        for predicate, more in ((S.intersects(), []), (S.ordered_intersects(), ["place"]), (S.nearest(2), ["place"])):
            grid, brute = (hits(S.SpatialIndex(v, shape, strategy=s).query(rays, ray, predicate), *more) for s in ("grid", "brute"))
            assert grid == brute
    assert S.SpatialIndex(v.limit(0), box).query(rays, ray, S.intersects()).count() == 0


def test_exists_and_bounded_counts(spark):
    r = random.Random(12)
    rows = [(r.random() ** 3, r.random(), r.random()) for _ in range(150)] + [(5.0, 5.0, 5.0)] * 40 + [(9.0, 9.0, 9.0)]
    v = cloud(spark, rows)
    near = {i: sum(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 <= 0.2 for b in rows) for i, a in enumerate(rows)}
    assert {x["id"]: x["n"] for x in S.bounded_counts(v, XYZ, 0.2, 4).collect()} == {i: min(n, 4) for i, n in near.items()}
    for strategy in ("grid", "brute"):
        found = S.SpatialIndex(v, P3, strategy=strategy).exists(v, P3, 0.2, where=lambda a, b: a("id") != b("id"))
        assert sorted(x[0] for x in found.collect()) == [i for i, n in near.items() if n > 1]


def test_permutations_and_insertion_points(spark):
    xs = [5.0, 1.0, 1.0, 9.0, -2.0, 5.0]
    df = spark.createDataFrame(list(enumerate(xs)), "index long, x double")
    place = S.sort_by_key(df, "x")
    assert [r["index"] for r in place.orderBy("place").collect()] == [4, 1, 2, 0, 5, 3]
    assert [r["index"] for r in S.sort_by_key(df, "x", ascending=False).orderBy("place").collect()] == [3, 0, 5, 1, 2, 4]
    assert [r["x"] for r in S.apply_permutation(place, df).orderBy("place").collect()] == sorted(xs)
    asked = spark.createDataFrame(list(enumerate([-5.0, 1.0, 3.0, 5.0, 10.0])), "id long, value double")
    got = {r["query_id"]: (r["lower"], r["upper"]) for r in S.insertion_points(df.withColumnRenamed("x", "value"), asked).collect()}
    assert got == {0: (0, 0), 1: (1, 3), 2: (3, 3), 3: (3, 5), 4: (6, 6)}
    none = S.insertion_points(df.limit(0).withColumnRenamed("x", "value"), asked).collect()
    assert len(none) == 5 and all((r["lower"], r["upper"]) == (0, 0) for r in none)


def test_pair_forces_are_opposite(spark):
    got = {r["id"]: r for r in S.pair_forces(cloud(spark, [(0, 0, 0), (1.5, 0, 0), (9, 9, 9)]), XYZ, 3.0).collect()}
    s = (1 / 1.5**2) ** 3
    assert got[0]["energy"] == got[1]["energy"] == pytest.approx(2 * (s * s - s)) and 2 not in got
    assert got[0]["force_x"] == -got[1]["force_x"] == pytest.approx(24 * (2 * s * s - s) / 1.5**2 * -1.5)


def brute_nearest(v, q, k, keep=lambda a, b: True):
    out = []
    for i, a in enumerate(q):
        near = sorted((math.dist(a, b), j) for j, b in enumerate(v) if keep(i, j))[:k]
        out += [(i, j, place + 1) for place, (_, j) in enumerate(near)]
    return sorted(out)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


r7 = random.Random(7)
CLOUD = [tuple(r7.random() for _ in range(3)) for _ in range(400)]
FAR = [(1000 + 3 * r7.random(), 500 * r7.random(), -r7.random()) for _ in range(60)]
CASES = {
    "far queries": (CLOUD, FAR, None), "equal values": ([(1.0, 2.0, 3.0)] * 400, CLOUD[:60], None), "one value and equal ones": ([(9.0, 9.0, 9.0), *[(1.0, 2.0, 3.0)] * 300], CLOUD[:40] + FAR[:20], None),
    "a where that passes none": (CLOUD, CLOUD[:60], lambda q, v: q("id") < F.lit(-1)), "a where that passes few": (CLOUD, CLOUD[:60] + FAR[:20], lambda q, v: v("id") % 97 == q("id") % 97), "more than there are": (CLOUD[:6], FAR[:10] + CLOUD[:9], None),
}


@pytest.mark.parametrize("case", CASES)
def test_nearest_apart_from_the_values_makes_no_cross_join(spark, case):
    v, q, where = CASES[case]
    keep = {"a where that passes none": lambda i, j: False, "a where that passes few": lambda i, j: j % 97 == i % 97}.get(case, lambda i, j: True)
    k = 9 if case == "more than there are" else 4
    found = S.SpatialIndex(cloud(spark, v), P3).query(cloud(spark, q), P3, S.nearest(k), where=where)
    assert "Cartesian" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert hits(found, "place") == brute_nearest(v, q, k, keep)


def test_nearest_looks_into_few_parts_from_afar(spark):
    values = cloud(spark, CLOUD)
    parts = Parts(values, [F.col(c) for c in XYZ], G.Box.of(XYZ, XYZ), F.col("id"), most=64)
    sizes = [n for _, n, _, _ in parts.rows]
    assert sum(sizes) == 400 and max(sizes) <= 3 * 400 / len(sizes)
    away = lambda b: box_gap(G.Box([F.lit(50.0)] * 3, [F.lit(50.0)] * 3), b)
    reach = min(math.dist((50, 50, 50), p) for p in CLOUD)
    near = spark.range(1).select(parts.within(away, F.lit(reach)).alias("p"), parts.nearest(away, 3).alias("m"), parts.good(away, F.lit(5)).alias("g"), parts.good(away, F.lit(500)).alias("none"), parts.within(away, F.lit(1e9)).alias("all")).first()
    assert 1 <= len(near["p"]) <= 4 and near["m"][0] in near["p"] and near["none"] is None and sorted(near["all"]) == [p for p, *_ in parts.rows]
    assert {p: n for p, n, _, _ in parts.rows}[near["g"]] >= 5


def test_nearest_of_many_equal_values_keeps_few_of_each_place(spark):
    n = 20_000
    v = spark.range(n).select("id", *(F.lit(x).alias(c) for c, x in zip(XYZ, (1.0, 2.0, 3.0), strict=True))).union(cloud(spark, CLOUD[:50]).withColumn("id", F.col("id") + n))
    q = spark.range(n).select("id", *(F.lit(x).alias(c) for c, x in zip(XYZ, (1.0, 2.0, 3.0), strict=True)))
    found = S.SpatialIndex(v, P3).query(q, P3, S.nearest(3)).groupBy("value_id").count().collect()
    assert {(r["value_id"], r["count"]) for r in found} == {(0, n), (1, n), (2, n)}


def test_metrics_without_a_factor_search_parts_best_first(spark):
    """The square root of a distance has no factor to it, but a bound over a box."""
    metric = lambda a, b: F.sqrt(G.distance(a, b))
    found = S.SpatialIndex(cloud(spark, CLOUD), P3).query(cloud(spark, CLOUD[:40] + FAR[:10]), P3, S.nearest(3), metric=metric, metric_box=lambda a, b: F.sqrt(G.distance(a, b)))
    assert "Cartesian" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert hits(found, "place") == brute_nearest(CLOUD, CLOUD[:40] + FAR[:10], 3)


def test_a_stored_index_reads_what_a_small_region_needs(spark, tmp_path):
    r = random.Random(21)
    v = cloud(spark, [(r.random(), r.random(), r.random()) for _ in range(4000)])
    path = str(tmp_path / "index")
    S.StoredIndex.write(v, P3, path, partitions=64)
    stored, plain = S.StoredIndex(spark, path, P3), S.SpatialIndex(v, P3)
    q = cloud(spark, [(0.2 + r.random() / 20, 0.7 + r.random() / 20, 0.1) for _ in range(30)])
    for predicate in (S.within(0.06), S.intersects(), S.nearest(3)):
        assert hits(stored.query(q, P3, predicate)) == hits(plain.query(q, P3, predicate))
    some = stored.inside((0.2, 0.7, 0.1), (0.25, 0.75, 0.15))
    some.collect()
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 4000 / 8
    assert stored.query(q.limit(0), P3, S.within(1)).count() == 0
    S.StoredIndex.write(v.limit(0), P3, str(tmp_path / "none"))
    assert S.StoredIndex(spark, str(tmp_path / "none"), P3).query(q, P3, S.within(1)).count() == 0


def test_some_matches_stop_early(spark, monkeypatch):
    r = random.Random(22)
    rows = [(r.random(), r.random(), r.random()) for _ in range(300)] + [(0.5, 0.5, 0.5)] * 200
    v, q = cloud(spark, rows), [(r.random(), r.random(), r.random()) for _ in range(60)]
    for n in (1, 3):
        got = hits(S.SpatialIndex(v, P3).some(cloud(spark, q), P3, n, 0.15))
        count = {i: sum(math.dist(a, b) <= 0.15 for b in rows) for i, a in enumerate(q)}
        assert all(math.dist(q[i], rows[j]) <= 0.15 for i, j in got)
        assert {i: sum(a == i for a, _ in got) for i in count} == {i: min(n, c) for i, c in count.items()}
    rounds, pairs = [], S.bucket_pairs
    monkeypatch.setattr(S, "bucket_pairs", lambda a, b, *more: rounds.append(b.count()) or pairs(a, b, *more))
    same = spark.range(100_000).select("id", *(F.lit(x).alias(c) for c, x in zip(XYZ, (1.0, 2.0, 3.0), strict=True)))
    assert S.SpatialIndex(same, P3).some(same, P3, 1, 0.5).count() == 100_000
    assert rounds == [4], "one round over four values"
    with pytest.raises(LimitExceeded):
        S.SpatialIndex(same, P3).checked(same.limit(5), P3, 2, 0.5)
    assert S.SpatialIndex(v, P3).checked(cloud(spark, q), P3, 500, 0.1).count() == 60
    with pytest.raises(GeometryError):
        S.SpatialIndex(v, P3).some(v, P3, 0, 0.1)
