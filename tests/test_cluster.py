import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions.errors import GeometryError
from orbweave.operators import cluster as C
from orbweave.operators.components import connected_components

XY = ("x", "y")
TEN = [(4, 3), (0, 0), (0, 1), (1, 1), (1, 0), (3, 3), (3, 4), (4, 4), (4, 0), (2, 2)]


def flat(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double")


def line(spark, xs):
    return flat(spark, [(x, 0) for x in xs])


def labels(df):
    return [r["label"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("implementation", ["fdbscan", "densebox"])
@pytest.mark.parametrize("eps, m, want", [(1, 2, [0, 1, 1, 1, 1, 0, 0, 0, -1, -1]), (1, 5, [-1] * 10), (1.5, 2, [0] * 8 + [-1, 0]), (1.5, 4, [0, 1, 1, 1, 1, 0, 0, 0, -1, 0])])
def test_dbscan(spark, implementation, eps, m, want):
    df = flat(spark, TEN)
    got = C.dbscan(df, XY, eps, m, implementation=implementation)
    assert labels(got) == want
    assert list(C.verify_dbscan(df, got, XY, eps, m).first()) == [0] * 5


def test_dbscan_star_and_checks(spark):
    df = flat(spark, [(0, 0), (1, 1), (3, 3), (6, 6)])
    assert labels(C.dbscan(df, XY, 8**0.5, 3)) == [1, 1, 1, -1]
    assert labels(C.dbscan(df, XY, 8**0.5, 3, algorithm="dbscan_star")) == [-1, 1, -1, -1]
    for bad in ((0, 2, "dbscan"), (1, 1, "dbscan"), (1, 2, "other")):
        with pytest.raises(GeometryError):
            C.dbscan(df, XY, *bad)


def test_verifier_sees_faults(spark):
    df = flat(spark, TEN)
    good = [0, 1, 1, 1, 1, 0, 0, 0, -1, 0]
    for change in ({0: -1}, {5: 1}, {8: 0}, {9: -1}):
        bad = [(i, change.get(i, v)) for i, v in enumerate(good)]
        assert sum(C.verify_dbscan(df, spark.createDataFrame(bad, "id long, label long"), XY, 1.5, 4).first()) > 0


def test_random_clouds_agree(spark):
    r = random.Random(2)
    df = flat(spark, [(r.random() ** 2, r.random() ** 2) for _ in range(200)])
    for m in (2, 4, 9):
        a, b = (labels(C.dbscan(df, XY, 0.05, m, implementation=i)) for i in ("fdbscan", "densebox"))
        assert a == b and list(C.verify_dbscan(df, C.dbscan(df, XY, 0.05, m), XY, 0.05, m).first()) == [0] * 5
    sizes = {x["label"]: x["n"] for x in C.cluster_sizes(C.dbscan(df, XY, 0.05, 4), 2).collect()}
    members = C.cluster_members(C.dbscan(df, XY, 0.05, 4), 2).groupBy("label").count().collect()
    assert {x["label"]: x["count"] for x in members} == sizes
    assert len(set(labels(C.friends_of_friends(df, XY, 2.0)))) == 1


@pytest.mark.parametrize("local", [10**6, 3])
def test_components(spark, local):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10] + [(100, 100), (7, 38), (200, 300), (300, 200)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    want = {}
    for lo, hi in ((1, 10), (11, 20), (21, 30), (31, 40)):
        want |= {i: 1 if lo == 31 else lo for i in range(lo, hi + 1)}
    assert got == want | {100: 100, 200: 200, 300: 200}


@pytest.mark.parametrize("xs, k, want", [
    ([0, 1, 2, 3, 4], 1, [0] * 5), ([0, 1, 2, 3, 4], 3, [2, 1, 1, 1, 2]), ([0, 1, 2, 3, 4], 5, [4, 3, 2, 3, 4]), ([0, 1, 2, 3, 6, 10], 2, [1, 1, 1, 1, 3, 4]), ([0, 1, 2, 3, 6, 10], 6, [10, 9, 8, 7, 6, 10]),
])
def test_core_distances(spark, xs, k, want):
    assert [r["core"] for r in C.core_distances(line(spark, xs), XY, k).orderBy("id").collect()] == want


@pytest.mark.parametrize("local", [10**6, 1])
@pytest.mark.parametrize("xs, k, want", [([0, 1, 2, 3, 4], 3, [1, 1, 2, 2]), ([0, 1, 2, 3, 4], 5, [3, 3, 4, 4]), ([0, 1, 2, 3, 6, 10], 1, [1, 1, 1, 3, 4]), ([0, 1, 2, 3, 6, 10], 6, [7, 8, 9, 10, 10])])
def test_tree_weights(spark, local, xs, k, want):
    assert sorted(r["weight"] for r in C.spanning_tree(line(spark, xs), XY, k, local_points=local).collect()) == want


def test_tree_edges_and_rounds(spark):
    six = flat(spark, [(1, 0), (0, 1), (1, 3), (4, 2), (2, 3), (2, 4)])
    assert sorted((r["source"], r["target"]) for r in C.spanning_tree(six, XY).collect()) == [(0, 1), (1, 2), (2, 4), (3, 4), (4, 5)]
    r = random.Random(6)
    pts = [(r.choice([0, 5, 9]) + r.random(), r.random()) for _ in range(60)]
    for k in (1, 4):
        a, b = (sorted(x["weight"] for x in C.spanning_tree(flat(spark, pts), XY, k, local_points=n).collect()) for n in (10**6, 5))
        assert a == pytest.approx(b) and len(a) == 59
    assert C.spanning_tree(flat(spark, [(0, 0)]), XY).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_tree_between_far_clusters(spark, monkeypatch, k):
    """Lists of neighbours keep their first length, and edges equal those of one task, repeated places included."""
    lengths, lists = [], C._neighbour_lists
    monkeypatch.setattr(C, "_neighbour_lists", lambda p, a, names, k: lengths.append(k) or lists(p, a, names, k))
    r = random.Random(8)
    pts = [(x + r.random(), y + r.random()) for x, y in ((0, 0), (50, 3), (400, 0)) for _ in range(70)] + [(7.0, 7.0)] * 40 + [(900.0, 1.0), (900.0, 1.0)]
    a, b = (sorted(map(tuple, C.spanning_tree(flat(spark, pts), XY, k, local_points=n).collect())) for n in (10**6, 5))
    assert a == b and len(a) == len(pts) - 1 and lengths == [8]
    assert sorted(map(tuple, C.spanning_tree(flat(spark, [(1, 2)] * 4), XY, k, local_points=1).collect())) == [(0, i, 0.0) for i in (1, 2, 3)]


def test_dendrogram(spark):
    def parents(edges):
        rows = C.dendrogram(spark.createDataFrame(edges, "source long, target long, weight double")).orderBy("node").collect()
        return [r["parent"] for r in rows], [r["height"] for r in rows if r["kind"] == "edge"]

    assert parents([(0, 3, 7.0), (1, 2, 3.0), (0, 1, 2.0)]) == ([1, 2, -1, 0, 0, 1, 2], [2, 3, 7])
    assert parents([(2, 3, 2.0), (2, 0, 9.0), (0, 1, 3.0)]) == ([2, 2, -1, 1, 1, 0, 0], [2, 3, 9])
    grid = C.hdbscan(flat(spark, list(itertools.product(range(4), range(4)))), XY, 5).collect()
    counts = np.bincount([r["parent"] for r in grid if r["parent"] >= 0])
    assert counts.tolist() == [2] * 15


def test_dense_cells_make_no_pairs_and_agree(spark, monkeypatch):
    monkeypatch.setattr(C, "WITNESSES", 1)
    r = random.Random(5)
    rows = [(r.gauss(0, 0.02) + x, r.gauss(0, 0.02) + y) for x, y in ((0, 0), (0.12, 0), (0.12, 0.13), (1, 1)) for _ in range(60)] + [(r.random() * 2, r.random() * 2) for _ in range(60)]
    df = flat(spark, rows)
    for eps in (0.03, 0.06, 0.1):
        for algorithm in ("dbscan", "dbscan_star"):
            a, b = (labels(C.dbscan(df, XY, eps, 4, algorithm, i)) for i in ("fdbscan", "densebox"))
            assert a == b
    same = spark.range(30_000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).union(spark.createDataFrame([(40_000, 1.0, 2.5)], "id long, x double, y double"))
    got = C.dbscan(same, XY, 0.4, 5).groupBy("label").count().collect()
    assert {x["label"]: x["count"] for x in got} == {0: 30_000, -1: 1}


def tree_of(kind, n, r):
    order = r.sample(range(n), n)
    ends = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: r.randrange(i), "broom": lambda i: i - 1 if i < n // 2 else n // 2 - 1}[kind]
    return [(order[ends(i)] * 7, order[i] * 7) for i in range(1, n)]


@pytest.mark.parametrize("kind, weigh", [("path", lambda r, i: r.random()), ("star", lambda r, i: float(r.randrange(3))), ("random", lambda r, i: 1.0), ("broom", lambda r, i: float(i))])
def test_contracted_dendrogram_equals_one_task(spark, kind, weigh):
    """Distinct, few, equal and sorted weights; parts of eight edges."""
    r = random.Random(len(kind))
    edges = spark.createDataFrame([(a, b, weigh(r, i)) for i, (a, b) in enumerate(tree_of(kind, 30, r))], "source long, target long, weight double")
    one, many = (sorted(map(tuple, C.dendrogram(edges, n).select("node", "kind", F.coalesce("vertex", F.lit(-1)), "parent", "height").collect())) for n in (100, 8))
    assert one == many and len(one) == 59


def test_contracted_dendrogram_holds_few_edges_in_a_task(spark):
    r = random.Random(3)
    edges = spark.createDataFrame([(a, b, r.random()) for a, b in tree_of("random", 400, r)], "source long, target long, weight double")
    rows = C.dendrogram(edges, 128).collect()
    parents = {x["node"]: x["parent"] for x in rows}
    assert np.bincount([p for p in parents.values() if p >= 0]).tolist() == [2] * 399
    assert [n for n, p in parents.items() if p < 0] == [398]
    heights = {x["node"]: x["height"] for x in rows}
    assert all(heights[n] <= heights[p] for n, p in parents.items() if p >= 0)
    assert C.dendrogram(edges.limit(0), 4).count() == 0 and C.dendrogram(edges.limit(1), 1).count() == 3


def test_merging_a_part_names_larger_components_by_their_last_edge():
    child, parent = C.merge_in_order(np.array([12, 10, 11]), np.array([5, 100, 101]), np.array([101, 101, 102]))
    assert list(zip(child.tolist(), parent.tolist(), strict=True)) == [(100, 10), (101, 10), (10, 11), (102, 11), (5, 12), (11, 12)]


def test_friends_of_friends_makes_no_pairs_of_equal_points(spark):
    df = spark.range(3_000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).union(spark.createDataFrame([(5_000, 9.0, 9.0)], "id long, x double, y double"))
    assert {(x["label"], x["count"]) for x in C.friends_of_friends(df, XY, 0.5).groupBy("label").count().collect()} == {(0, 3_000), (5_000, 1)}


@pytest.mark.parametrize("algorithm", ["dbscan", "dbscan_star"])
def test_halo_labels_equal_those_of_global_joins(spark, algorithm):
    """Parts of about 25 points, clusters across many of them, places held by several points."""
    r = random.Random(9)
    rows = [(r.gauss(x, s), r.gauss(y, s)) for x, y, s in ((0, 0, 0.1), (0.5, 0, 0.03), (0.2, 0.6, 0.2)) for _ in range(90)] + [(i / 40, 1.2) for i in range(60)] + [(0.5, 0.5)] * 20 + [(r.random(), r.random()) for _ in range(40)] + [(1e7, -3e6), (float("nan"), 0.0)]
    df = flat(spark, rows)
    for eps, m in ((0.03, 2), (0.11, 9)):
        want = labels(C.dbscan(df.where("NOT isnan(x)"), XY, eps, m, algorithm, "fdbscan"))
        got = C.halo_dbscan(df, XY, eps, m, algorithm, part_points=25)
        assert labels(got) == [*want, -1]
    assert C.halo_dbscan(df.limit(0), XY, 0.1, 3).count() == 0


def test_halo_in_one_and_three_dimensions(spark):
    r = random.Random(10)
    df = spark.createDataFrame([(i, r.random() ** 2, r.random(), r.random()) for i in range(250)], "id long, x double, y double, z double")
    for names, eps in ((["x"], 0.002), (["x", "y", "z"], 0.14)):
        assert labels(C.halo_dbscan(df, names, eps, 4, part_points=12)) == labels(C.dbscan(df, names, eps, 4, implementation="fdbscan"))


def test_halo_copies_follow_the_borders(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 200).cast("double").alias("x"), F.floor(F.col("id") / 200).cast("double").alias("y"))
    parts = C.Parts(df, [F.col("x"), F.col("y")], C.G.Box.of(XY, XY), F.col("id"), most=16)
    copies = df.select(F.size(parts.touching([F.col(c) - 1.0 for c in XY], [F.col(c) + 1.0 for c in XY])).alias("n")).groupBy("n").count().collect()
    of = {x["n"]: x["count"] for x in copies}
    assert set(of) <= {1, 2, 4} and of[1] > 16_000


def test_verifier_writes_no_pairs_of_equal_points(spark):
    """20,000 points at one place, of which a few have a wrong label: the pairs of different labels are counted, not made."""
    n = 20_000
    df = spark.range(n).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    good = df.select("id", F.lit(0).cast("long").alias("label"))
    assert list(C.verify_dbscan(df, good, XY, 0.5, 5).first()) == [0] * 5
    bad = good.withColumn("label", F.when(F.col("id") < 3, F.lit(7)).when(F.col("id") == 9, F.lit(-1)).otherwise(F.col("label")))
    assert list(C.verify_dbscan(df, bad, XY, 0.5, 5).first()) == [1, 2 * (3 * (n - 4) + (n - 4) + 3), 0, 0, 0]


def test_dense_points_make_no_pairs(spark, monkeypatch):
    """Points within eps of each other are cores of their cell, in both ways of clustering, and aren't compared."""
    r = random.Random(3)
    rows = [(i, *(r.gauss(40.0 * (i % 3 // 2), 0.1) for _ in range(3))) for i in range(1500)] + [(1500 + i, 2.0 + 0.4 * i, 0.0, 0.0) for i in range(40)] + [(1600, 0.9, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    want = {}
    for a in rows:
        near = [b for b in rows if math.dist(a[1:], b[1:]) <= 1.0]
        want[a[0]] = (len(near) >= 4, [b[0] for b in near])
    labels = {}
    for i, (core, _) in want.items():
        if core and i not in labels:
            todo, labels[i] = [i], i
            while todo:
                for j in want[todo.pop()][1]:
                    if want[j][0] and j not in labels:
                        labels[j] = i
                        todo.append(j)
    label = {i: labels[i] if core else min((labels[j] for j in near if want[j][0]), default=-1) for i, (core, near) in want.items()}

    def none(*_):
        raise AssertionError("pairs of points")

    monkeypatch.setattr(C, "half_neighbors", none)
    found = C.dbscan(df, ["x", "y", "z"], 1.0, 4, implementation="fdbscan")
    assert {r["id"]: r["label"] for r in found.collect()} == label
    made = []

    def counted(self, *sides, f=C.CellPairs.__call__):
        for i, j in f(self, *sides):
            made.append(len(i))
            yield i, j

    monkeypatch.setattr(C.CellPairs, "__call__", counted)
    ids, x, yes = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]), np.ones(len(rows), bool)
    kind, own, root = C.cluster_part(ids, x, np.ones(len(rows), np.int64), yes, yes, ~yes, 1.0, 4)
    assert dict(zip(own[kind == 0].tolist(), root[kind == 0].tolist(), strict=True)) == labels
    assert sum(made) < 200_000  # of 1.25 million pairs
