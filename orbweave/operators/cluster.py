"""Density-based clustering, minimum spanning trees and hierarchies over points."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import geometry as G
from orbweave.functions.errors import GeometryError
from orbweave.operators.components import connected_components, local_labels
from orbweave.operators.parts import Parts
from orbweave.operators.spatial import AXES, PAD, SpatialIndex, attach_indices, bounded_counts, boxes, bucket_pairs, half_neighbors, nearest, points, within
from orbweave.plans.shared import drop_table, materialize, splittable_join

#: Points up to which a spanning tree is built in one task, with distances row by row (n floats at a time).
LOCAL_POINTS = 5_000
#: Halvings of the cells in a search between components, after which the pairs that are left are measured as they are.
HALVINGS = 60


#: Points of a dense cell that are tried first when two cells may touch.
WITNESSES = 8


def _dense_links(dense: DataFrame, axes: Sequence[str], eps: float, other: DataFrame) -> DataFrame:
    """(a, b): nodes of dense cells of which points lie within ``eps`` of each other, as far as they matter for components.

    Cells whose tight boxes are near are tried by a few points each. Of the pairs left, those that ``other`` edges and
    the found ones connect already are skipped; the others are looked through by a semi-join that ends at a first match.
    """
    lo, hi = [f"lo{i}" for i in range(len(axes))], [f"hi{i}" for i in range(len(axes))]
    cells = dense.groupBy("node").agg(*(f(c).alias(n) for i, c in enumerate(axes) for f, n in ((F.min, lo[i]), (F.max, hi[i]))))
    cells = materialize(cells, "dense-cells")
    near = SpatialIndex(cells, boxes(lo, hi), "node").query(cells, boxes(lo, hi), within(eps), "node", where=lambda q, v: q("node") < v("node"))
    near = materialize(near.select(F.col("query_id").alias("na"), F.col("value_id").alias("nb")), "near-cells")
    side = lambda df, s: df.select(F.col("node").alias(f"n{s}"), *(F.col(c).alias(f"{c}_{s}") for c in axes))
    at = lambda s: G.Point([F.col(f"{c}_{s}") for c in axes])
    few = dense.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id")))).where(F.col("place") <= WITNESSES)
    few = materialize(few.select("node", *axes), "witnesses")
    quick = near.join(side(few, "a"), "na").join(side(few, "b"), "nb").where(G.distance(at("a"), at("b")) <= eps).select("na", "nb").distinct()
    found = materialize(quick.select(F.col("na").alias("a"), F.col("nb").alias("b")), "cell-links")
    labels = connected_components(found.union(other))
    of = lambda s: labels.select(F.col("node").alias(f"n{s}"), F.col("label").alias(f"l{s}"))
    left = near.join(of("a"), "na", "left").join(of("b"), "nb", "left").where("la IS NULL OR lb IS NULL OR la <> lb").select("na", "nb")
    box = cells.select(F.col("node").alias("nb"), *lo, *hi)
    asked = left.join(side(dense, "a"), "na").join(box, "nb").where(G.distance(at("a"), G.Box([F.col(c) for c in lo], [F.col(c) for c in hi])) <= eps).drop(*lo, *hi)
    against = side(dense, "b").withColumnRenamed("nb", "nb2")
    slow = asked.join(against, (F.col("nb") == F.col("nb2")) & (G.distance(at("a"), at("b")) <= eps), "left_semi").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct()
    return found.union(materialize(slow, "cell-links"))


def dbscan(df: DataFrame, names: Sequence[str], eps: float, min_points: int, algorithm: str = "dbscan", implementation: str = "densebox", id: str = "id") -> DataFrame:
    """(id, label): the smallest id of a core point of the point's cluster, -1 for noise.

    A core point has ``min_points`` points within ``eps``, itself included. Core points within ``eps`` of each other
    share a cluster. Another point near core points takes the smallest of their labels, or with algorithm
    ``dbscan_star`` is noise. With ``min_points`` 2 the clusters are the components of at least two points.

    implementation ``densebox`` takes the points of each grid cell with a diagonal of at most ``eps`` that holds
    ``min_points`` as core without counting and as one node of the components: no pairs are made within a cell, and
    two such cells are joined by one pair of points. The other points are counted, linked and labelled by joins that
    feed aggregations; only links between core points of thin cells are written. ``fdbscan`` counts first, up to
    ``min_points``, and takes the core points of each such cell, however few, as one node; it writes no links of points. ``halo`` cuts space into balanced parts, sends each part the
    points within 2 eps of it, clusters the parts side by side and joins their clusters at the points that parts share:
    what is shuffled follows the points and those near borders, not the pairs. It fits clouds whose densest places are
    well spread; a part's task holds its points and their halo, and compares those within a cell or next to it.
    """
    if eps <= 0 or min_points < 2:
        raise GeometryError("eps must be above 0 and min_points at least 2")
    if algorithm not in ("dbscan", "dbscan_star") or implementation not in ("fdbscan", "densebox", "halo"):
        raise GeometryError("algorithm is dbscan or dbscan_star, implementation fdbscan, densebox or halo")
    if implementation == "halo":
        return halo_dbscan(df, names, eps, min_points, algorithm, id)
    axes = [f"x{i}" for i in range(len(names))]
    cell = [f"c{i}" for i in range(len(names))]
    h = eps / math.sqrt(len(names)) * (1 - 1e-12)
    pts = df.select(F.col(id).cast("long").alias("id"), *(F.col(n).cast("double").alias(x) for n, x in zip(names, axes, strict=True)))
    placed = pts.select("*", *(F.floor(F.col(x) / F.lit(h)).alias(c) for x, c in zip(axes, cell, strict=True)))
    full = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.min("id").alias("node")).where((F.col("n") >= min_points) & F.lit(implementation == "densebox"))
    placed = materialize(placed.join(full.select(*cell, "node"), cell, "left").drop(*cell), "points")
    dense, thin = placed.where("node IS NOT NULL"), placed.where("node IS NULL").drop("node")
    at = points(*axes)
    everywhere = SpatialIndex(placed.select("id", *axes), at, cell=2 * eps)
    if implementation == "fdbscan":
        many = bounded_counts(thin, axes, eps, min_points).where(F.col("n") >= min_points).select("id")
        core = materialize(thin.join(many, "id", "left_semi"), "core")
        celled = core.select("*", *(F.floor(F.col(x) / F.lit(h)).alias(c) for x, c in zip(axes, cell, strict=True)))
        dense = materialize(celled.join(celled.groupBy(*cell).agg(F.min("id").alias("node")), cell).select("id", *axes, "node"), "core-cells")
        edges = _dense_links(dense, axes, eps, df.sparkSession.createDataFrame([], "a long, b long"))
        nodes = dense
    else:
        many = everywhere.query(thin, at, within(eps)).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
        core = materialize(thin.join(many.select(F.col("query_id").alias("id")), "id", "left_semi"), "core")
        edges = half_neighbors(core, axes, eps).select("a", "b")
        to_cells = SpatialIndex(dense, at, cell=2 * eps).query(core, at, within(eps), keep_values=["node"])
        edges = materialize(edges.union(to_cells.select(F.col("query_id").alias("a"), F.col("node").alias("b")).distinct()), "core-links")
        edges = edges.union(_dense_links(dense, axes, eps, edges))
        nodes = dense.unionByName(core.withColumn("node", F.col("id")))
    found = connected_components(edges).withColumnRenamed("node", "n")
    labelled = materialize(nodes.join(found, nodes["node"] == found["n"], "left").select("id", *axes, F.coalesce("label", "node").alias("label")), "core-labels")
    labels = labelled.select("id", "label")
    if algorithm == "dbscan":
        border = thin.join(core.select("id"), "id", "left_anti")
        near = SpatialIndex(labelled, at, cell=2 * eps).query(border, at, within(eps), keep_values=["label"])
        labels = labels.unionByName(near.groupBy(F.col("query_id").alias("id")).agg(F.min("label").alias("label")))
    return df.select(id).join(labels.withColumnRenamed("id", id), id, "left").select(id, F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


#: Points of a part in ``halo``, on average; parts at most; pairs that its task compares at once.
PART_POINTS, MOST_PARTS, PAIRS_AT_ONCE = 200_000, 4_096, 1 << 21


class CellPairs:
    """Pairs of rows of ``x`` within ``eps``, in batches: rows of equal and neighbouring cells of that size are compared."""

    def __init__(self, x: np.ndarray, eps: float):
        axes = min(AXES, x.shape[1])
        cells = np.floor(x[:, :axes] / (eps * PAD))
        key = np.zeros(len(x), np.int64)
        steps = []
        for a in range(axes):
            # Cells without rows between two others count as one, so numbers stay small however far rows lie apart.
            at, dense = np.unique(cells[:, a], return_inverse=True)
            place = np.cumsum(np.minimum(np.diff(at, prepend=at[:1] - 1), 2).astype(np.int64))
            steps = [s * (int(place[-1]) + 2) for s in steps] + [1]
            key = key * (int(place[-1]) + 2) + place[dense]
        self.steps = steps
        self.order = np.argsort(key, kind="stable")
        self.key, self.x, self.eps = key[self.order], x[self.order], eps

    def __call__(self, asked: np.ndarray, against: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of rows marked in ``asked`` and in ``against``; a row meets itself."""
        one, other = np.flatnonzero(asked[self.order]), np.flatnonzero(against[self.order])
        keys = self.key[other]
        for move in itertools.product((-1, 0, 1), repeat=len(self.steps)):
            want = self.key[one] + sum(m * s for m, s in zip(move, self.steps, strict=True))
            begin, end = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
            ends = np.cumsum(end - begin)
            at = 0
            while at < len(one):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
                size = (end - begin)[at:to]
                i = np.repeat(one[at:to], size)
                j = other[np.arange(size.sum()) - np.repeat(ends[at:to] - size - done, size) + np.repeat(begin[at:to], size)]
                near = np.sqrt(((self.x[i] - self.x[j]) ** 2).sum(1)) <= self.eps
                yield self.order[i[near]], self.order[j[near]]
                at = to

    def mixed(self, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Which of ``rows`` have rows of another label in their own or a neighbouring cell."""
        known = rows[self.order]
        keys, cell = np.unique(self.key[known], return_inverse=True)
        ends = [np.full(len(keys) + 1, x) for x in (len(label), -1)]
        for f, end in zip((np.minimum, np.maximum), ends, strict=True):
            f.at(end, cell, label[self.order][known])
        low, high = (e[:-1].copy() for e in ends)
        for move in itertools.product((-1, 0, 1), repeat=len(self.steps)):
            want = keys + sum(m * s for m, s in zip(move, self.steps, strict=True))
            to = np.searchsorted(keys, want)
            to[(to < len(keys)) & (keys[np.minimum(to, len(keys) - 1)] != want)] = len(keys)
            low, high = np.minimum(low, ends[0][to]), np.maximum(high, ends[1][to])
        out = np.zeros(len(rows), bool)
        out[self.order[known]] = (low != high)[cell]
        return out


def cluster_part(ids: np.ndarray, x: np.ndarray, n: np.ndarray, own: np.ndarray, close: np.ndarray, shared: np.ndarray, eps: float, min_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, id, root) of a part's rows, which are places with ``n`` points each.

    The rows within eps of the part are ``close``; of these the cores are known for certain, as those within 2 eps are
    here. Rows of a cell with a diagonal of ``eps`` are within it of each other: they are core without being compared if
    the cell has ``min_points``, and its cores are linked; cells are linked by a few rows each, and by all rows only where
    that leaves neighbours apart. A root is the smallest id of cores that are linked within the part. Kind 0: an own core and its root. 1: an
    own border row and the root of a core near by. 2: a core that other parts know too, and its root here.
    """
    pairs = CellPairs(x, eps)
    count = np.zeros(len(ids), np.int64)
    _, cell = np.unique(np.floor(x / (eps / math.sqrt(x.shape[1]) * (1 - 1e-12))), axis=0, return_inverse=True)
    cell = cell.reshape(-1)
    sure = (np.bincount(cell, n) >= min_points)[cell]
    for i, j in pairs(close & ~sure, np.ones(len(ids), bool)):
        np.add.at(count, i, n[j])
    core = close & (sure | (count >= min_points))
    label = np.arange(len(ids))
    at = np.flatnonzero(core)
    at = at[np.argsort(cell[at], kind="stable")]
    starts = np.flatnonzero(np.r_[True, cell[at[1:]] != cell[at[:-1]]]) if len(at) else at
    size = np.diff(np.r_[starts, len(at)])
    label[at] = np.repeat(at[starts], size)
    few = np.zeros(len(ids), bool)
    few[at[np.arange(len(at)) - np.repeat(starts, size) < WITNESSES]] = True

    def link(asked: np.ndarray, against: np.ndarray, label: np.ndarray) -> np.ndarray:
        for i, j in pairs(asked, against):
            i, j = label[i], label[j]
            apart = i != j  # labels change between the two orders of a pair, so neither is left out
            if apart.any():
                nodes, low = local_labels(i[apart], j[apart])
                to = np.arange(len(ids))
                to[nodes] = low
                label = to[label]
        return label

    label = link(few, few, label)
    if len(at):
        mixed = pairs.mixed(core, label)
        largest = np.bincount(label[at]).argmax()
        label = link(mixed & (label != largest), mixed, label)
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, label[core], ids[core])
    root = root[label]
    border = [np.unique(np.stack([ids[i], root[j]]), axis=1) for i, j in pairs(own & ~core, core)]
    border = np.concatenate(border, 1) if border else np.zeros((2, 0), np.int64)
    known = core & (shared | ~own)
    parts = [(0, ids[own & core], root[own & core]), (1, *border), (2, ids[known], root[known])]
    return np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in parts]), np.concatenate([a for _, a, _ in parts]), np.concatenate([r for _, _, r in parts])


def halo_dbscan(df: DataFrame, names: Sequence[str], eps: float, min_points: int, algorithm: str = "dbscan", id: str = "id", part_points: int = PART_POINTS) -> DataFrame:
    """:func:`dbscan` by parts with halos of 2 eps; points at one place are one row with their number."""
    axes = [f"x{i}" for i in range(len(names))]
    pts = df.select(F.col(id).cast("long").alias("id"), *(F.col(c).cast("double").alias(x) for c, x in zip(names, axes, strict=True)))
    pts = materialize(pts.where(G._all([(F.col(x) > -G.INF) & (F.col(x) < G.INF) for x in axes])), "points")
    places = materialize(pts.groupBy(*axes).agg(F.min("id").alias("id"), F.count("*").alias("n")), "places")
    total = places.count()
    at = [F.col(x) for x in axes]
    cut = at[:AXES]
    parts = Parts(places, cut, G.Box(at, at), F.col("id"), most=min(MOST_PARTS, max(1, total // part_points)), sampled=1 << 16)
    near = lambda r: parts.touching([c - F.lit(r * PAD) for c in cut], [c + F.lit(r * PAD) for c in cut])
    copies = places.select("id", "n", *axes, parts.of(cut).alias("home"), near(2 * eps).alias("halo"), near(eps).alias("rim"))
    copies = copies.withColumn("part", F.explode("halo")).select("part", "id", "n", *axes, (F.col("part") == F.col("home")).alias("own"), F.array_contains("rim", F.col("part")).alias("close"), (F.size("halo") > 1).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def clustered() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                bools = [t.column(c).to_numpy() for c in ("own", "close", "shared")]
                out = cluster_part(t.column("id").to_numpy(), np.stack([t.column(x).to_numpy() for x in axes], 1), t.column("n").to_numpy(), *bools, eps, min_points)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["kind", "id", "root"])

        for batch in batches:
            of = batch.column("part").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in itertools.pairwise(starts):
                if hi > lo and of[lo] != part:
                    yield from clustered()
                    part, held = of[lo], []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        yield from clustered()

    dealt = copies.repartition(max(1, 2 * len(parts.rows)), "part").sortWithinPartitions("part")
    found = materialize(dealt.mapInArrow(run, "kind int, id long, root long"), "clustered")
    links = connected_components(found.where("kind = 2").select(F.col("id").alias("a"), F.col("root").alias("b")))
    kinds = "kind = 0" if algorithm == "dbscan_star" else "kind < 2"
    named = splittable_join(found.where(kinds), links.withColumnRenamed("node", "root").withColumnRenamed("label", "whole"), "root", "left")
    labels = named.groupBy("id").agg(F.min(F.coalesce("whole", "root")).alias("label"))
    labels = materialize(labels, "place-labels")
    here = splittable_join(places.select("id", *axes), labels, "id").select(F.struct(*axes).alias("place"), "label")
    each = splittable_join(pts.select("id", F.struct(*axes).alias("place")), here, "place").select("id", "label")
    for table in (found, links):
        drop_table(table)
    return df.select(id).join(each.withColumnRenamed("id", id), id, "left").select(id, F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def friends_of_friends(df: DataFrame, names: Sequence[str], eps: float, id: str = "id") -> DataFrame:
    """(id, label): the smallest id of the component in which steps of at most ``eps`` reach; a lone point is its own.

    :func:`dbscan` with two points a cluster, so points of one cell are one node and no pairs are made among them.
    """
    found = dbscan(df, names, eps, 2, id=id)
    return found.select(id, F.when(F.col("label") >= 0, F.col("label")).otherwise(F.col(id).cast("long")).alias("label"))


def cluster_sizes(labels: DataFrame, min_size: int = 1) -> DataFrame:
    """(label, n) of each cluster of at least ``min_size`` points; noise is none."""
    return labels.where("label >= 0").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)


def cluster_members(labels: DataFrame, min_size: int = 1, id: str = "id") -> DataFrame:
    """(label, id, place): the points of each cluster of at least ``min_size`` in order of id, as one row each.

    Points are numbered over range partitions by (label, id), and a place counts from its cluster's first number, so
    the largest cluster spreads over many tasks.
    """
    kept = splittable_join(labels.select("label", id), cluster_sizes(labels, min_size).select("label"), "label")
    numbered = attach_indices(kept.repartitionByRange("label", id).sortWithinPartitions("label", id), "__n")
    first = numbered.groupBy("label").agg(F.min("__n").alias("__first"))
    return splittable_join(numbered, first, "label").select("label", id, (F.col("__n") - F.col("__first")).alias("place"))


def verify_dbscan(df: DataFrame, labels: DataFrame, names: Sequence[str], eps: float, min_points: int, algorithm: str = "dbscan", id: str = "id") -> DataFrame:
    """One row with the numbers of violations: core points that are noise; neighbouring core points with different
    labels; points without core neighbours that have a label; border points whose label none of their core neighbours
    has (or that are noise); labels that hold several components.

    No pairs are written: points of one place and label are one row with their number, a row's core neighbours are
    aggregated to whether one shares its label and how many don't, and components come from :func:`halo_dbscan`.
    """
    at = points(*names)
    counted = bounded_counts(df, names, eps, min_points, id).where(F.col("n") >= min_points).select(id, F.lit(True).alias("core"))
    state = df.select(id, *names).join(labels.select(id, "label"), id).join(counted, id, "left").withColumn("core", F.coalesce("core", F.lit(False)))
    state = materialize(state, "verify")
    groups = state.groupBy(*names, "label", "core").agg(F.min(id).alias("id"), F.count("*").alias("n"))
    groups = materialize(groups, "verify-places")
    cores = groups.where("core").select("id", *names, F.col("label").alias("lb"), F.col("n").alias("nb"))
    met = SpatialIndex(cores, at, cell=2 * eps).query(groups, at, within(eps), keep=["label"], keep_values=["lb", "nb"])
    met = met.groupBy(F.col("query_id").alias("id")).agg(F.max((F.col("label") == F.col("lb")).cast("int")).alias("shares"), F.sum(F.when(F.col("label") != F.col("lb"), F.col("nb")).otherwise(0)).alias("others"))
    met = groups.join(met, "id", "left")
    fault = F.col("label") >= 0 if algorithm == "dbscan_star" else F.col("shares") == 0
    sums = {
        "core_noise": F.when(F.col("core") & (F.col("label") < 0), F.col("n")),
        "split_core": F.when(F.col("core"), F.col("n") * F.col("others")),
        "stray_label": F.when(~F.col("core") & F.col("shares").isNull() & (F.col("label") >= 0), F.col("n")),
        "wrong_border": F.when(~F.col("core") & F.col("shares").isNotNull() & fault, F.col("n")),
    }
    found = met.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items())).first()
    parts = halo_dbscan(df, names, eps, min_points, "dbscan_star", id).withColumnRenamed("label", "part")
    kept = state.where("core AND label >= 0").select(id, "label").join(parts, id)
    merged = kept.groupBy("label").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").count()
    return df.sparkSession.createDataFrame([(*found, merged)], "core_noise long, split_core long, stray_label long, wrong_border long, merged_label long")


# -- distances to neighbours ---------------------------------------------------------------------------------------------


def core_distances(df: DataFrame, names: Sequence[str], k: int, id: str = "id") -> DataFrame:
    """(id, core): the distance to the k-th nearest point, the point itself being the first."""
    index = SpatialIndex(df.select(id, *names), points(*names), id)
    found = index.query(df.select(id, *names), points(*names), nearest(k), id)
    return found.groupBy(F.col("query_id").alias(id)).agg(F.max("distance").alias("core"))


# -- spanning trees --------------------------------------------------------------------------------------------------------


def prim(x: np.ndarray, core: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of the minimum spanning tree over rows of ``x`` by (weight, smaller index, larger index)."""
    n = len(x)
    if n < 2:
        return []
    best, to = np.full(n, np.inf), np.zeros(n, np.int64)
    out, free, at = [], np.ones(n, bool), 0
    ids = np.arange(n)
    for _ in range(n - 1):
        free[at] = False
        d = np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), np.maximum(core, core[at]))
        lower, upper = np.minimum(ids, at), np.maximum(ids, at)
        tie = (d == best) & ((lower < np.minimum(ids, to)) | ((lower == np.minimum(ids, to)) & (upper < np.maximum(ids, to))))
        better = free & ((d < best) | tie)
        best[better], to[better] = d[better], at
        left = np.flatnonzero(free)
        w = best[left]
        left = left[w == w.min()]
        if len(left) > 1:
            order = np.lexsort((np.maximum(left, to[left]), np.minimum(left, to[left])))
            left = left[order]
        at = int(left[0])
        out.append((int(min(at, to[at])), int(max(at, to[at])), float(best[at])))
    return out


def spanning_tree(df: DataFrame, names: Sequence[str], k: int = 1, id: str = "id", local_points: int = LOCAL_POINTS) -> DataFrame:
    """(source, target, weight) with source < target: the Euclidean minimum spanning tree, or with k above 1 that of the
    mutual reachability distance, the largest of a pair's distance and their core distances for ``k``.

    Equal weights are ordered by (smaller id, larger id). Up to ``local_points`` points are solved in one task of
    bounded size. Beyond, Boruvka rounds over the cluster: each component takes its best edge to another one, found
    among its points' nearest neighbours. Where these settle no component, the best edges are searched for between
    cells of different components, so points of one component aren't compared with each other however far the next one
    is. Points at one place (with ``k`` of them if k is above 1) are tied to the smallest of their ids beforehand.
    """
    pts = df.select(F.col(id).cast("long").alias("id"), *(F.col(n).cast("double").alias(n) for n in names))
    pts = pts.join(core_distances(pts, names, k), "id") if k > 1 else pts.withColumn("core", F.lit(0.0))
    pts = materialize(pts, "points")
    n = pts.count()
    if n <= local_points:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if len(b)]
            if not rows:
                return
            t = pa.Table.from_batches(rows)
            ids = t.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x = np.stack([t.column(c).to_numpy() for c in names], 1)[order]
            edges = prim(x, t.column("core").to_numpy()[order])
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[order][e[i]]) for e in edges], pa.int64()) for i in range(2)] + [pa.array([e[2] for e in edges], pa.float64())], ["source", "target", "weight"])

        return pts.repartition(1).mapInArrow(run, "source long, target long, weight double")
    # The smallest edges: weight 0, from the smallest id of a place, which then stands for all of them.
    same = pts.groupBy(*names).agg(F.min("id").alias("source"), F.count("*").alias("n"), F.max("core").alias("high")).where("n > 1 AND high = 0").select(*names, "source")
    tied = pts.join(same, list(names)).where("id <> source").select("source", F.col("id").alias("target"), F.lit(0.0).alias("weight"))
    tied = materialize(tied, "tied")
    rest = materialize(pts.join(tied.select(F.col("target").alias("id")), "id", "left_anti"), "points")
    return _boruvka(rest, names, rest.count(), max(8, k)).unionByName(tied)


def _weight() -> Column:
    return F.greatest("distance", "core_a", "core_b")


def _neighbour_lists(pts: DataFrame, asked: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """(a, b, weight, far): the k nearest others of each asked point; ``far`` bounds the weight to any not listed."""
    index = SpatialIndex(pts, points(*names))
    found = index.query(asked, points(*names), nearest(k), keep=["core"], where=lambda q, v: q("id") != v("id"))
    found = found.select(F.col("query_id").alias("a"), F.col("value_id").alias("b"), "distance", F.col("core").alias("core_a"))
    found = found.join(pts.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    return found.select("a", "b", _weight().alias("weight"), F.max("distance").over(Window.partitionBy("a")).alias("far"), F.count("*").over(Window.partitionBy("a")).alias("listed"))


def _clumps(pts: DataFrame, names: Sequence[str], size: float, parent: float | None = None) -> DataFrame:
    """Points of one component in one cell, as (key, box, least core, count), with the key they had in cells of ``parent``."""
    rows = pts.withColumn("key", _cell(names, size))
    if parent is not None:
        rows = rows.withColumn("parent", _cell(names, parent))
    ends = [f(n).alias(f"{side}_{n}") for n in names for side, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("key", *(["parent"] if parent is not None else [])).agg(*ends, F.min("core").alias("core"), F.count("*").alias("n"))


def _cell(names: Sequence[str], size: float) -> Column:
    return F.struct("label", *(F.floor(F.col(n) / size).alias(f"c{i}") for i, n in enumerate(names)))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _spans(names: Sequence[str]) -> tuple[Column, Column]:
    """Bounds of the least weight between the points of the clumps a and b."""
    low, high = F.greatest("a_core", "b_core"), F.greatest("a_core", "b_core")
    box = lambda p: G.Box([F.col(f"{p}lo_{n}") for n in names], [F.col(f"{p}hi_{n}") for n in names])
    a, b = box("a_"), box("b_")
    gaps = [F.greatest(F.lit(0.0), y - z, w - x) for y, x, w, z in zip(a.lo, a.hi, b.lo, b.hi, strict=True)]
    across = [F.greatest(x - w, z - y) for y, x, w, z in zip(a.lo, a.hi, b.lo, b.hi, strict=True)]
    return F.greatest(low, G.norm(gaps)), F.greatest(high, G.norm(across))


def _closest_others(pts: DataFrame, state: DataFrame, names: Sequence[str]) -> DataFrame | None:
    """(la, e): the best edges of those components of which the bound is within four times the least bound.

    ``pts`` have their component as label; the bound is the best edge in ``state`` or that between first points. Cells
    of different components pair up where their boxes are within the bound, and halve, which lowers the bounds, until
    few pairs of points are left. None where no component has a distance to another one.
    """
    tables: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        tables.append(materialize(df, name))
        return tables[-1]

    pts = written(pts, "labelled")
    first = written(pts.groupBy("label").agg(F.min(F.struct("id", *names, "core")).alias("p")).select("label", "p.*"), "first")
    known = first.join(state.select(F.col("la").alias("label"), F.col("e.weight").alias("bound")), "label", "left")
    index = SpatialIndex(first.withColumnRenamed("core", "core_b"), points(*names))
    found = index.query(known.where("bound IS NULL").withColumnRenamed("core", "core_a"), points(*names), nearest(1), keep=["label", "core_a"], keep_values=["core_b"], where=lambda q, v: q("id") != v("id"))
    bound = written(known.where("bound IS NOT NULL").select("label", "bound").unionByName(found.select("label", _weight().alias("bound"))), "bounds")
    least, n = bound.agg(F.min("bound")).first()[0], pts.count()
    if least is None:
        return None
    bound = bound.where(F.col("bound") <= 4 * least).select(F.col("label").alias("la"), "bound")
    size = 2.0 ** math.ceil(math.log2(4 * least)) if least > 0 else 1.0

    cells = written(_clumps(pts, names, size), "clumps")
    a, b = _renamed(cells, "a_").join(bound, F.col("a_key.label") == F.col("la")), _renamed(cells, "b_")
    box = lambda p: G.Box([F.col(f"{p}lo_{n}") for n in names], [F.col(f"{p}hi_{n}") for n in names])
    low, high = _spans(names)
    pairs = bucket_pairs(a, b, G.grow(box("a_"), F.col("bound") * PAD), box("b_"), F.col("a_key.label") != F.col("b_key.label"))
    for halving in range(HALVINGS):
        pairs = pairs.select("la", "bound", "a_key", "b_key", "a_n", "b_n", low.alias("low"), high.alias("high")).where(F.col("low") <= F.col("bound") * PAD)
        pairs = written(pairs, "clump-pairs")
        lowest = pairs.groupBy("la").agg(F.least(F.min("bound"), F.min("high")).alias("bound"))
        pairs = pairs.drop("bound").join(lowest, "la").where(F.col("low") <= F.col("bound") * PAD)
        pairs = written(pairs.select("la", "bound", "a_key", "b_key", "a_n", "b_n"), "clump-pairs")
        if (pairs.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0] or 0) <= max(10_000, 8 * n) or halving == HALVINGS - 1:
            break
        alive = pairs.select(F.col("a_key").alias("parent")).union(pairs.select("b_key")).distinct()
        cells = written(_clumps(pts, names, size / 2, size).join(alive, "parent", "left_semi"), "clumps")
        kept = pairs.select("la", "bound", F.col("a_key").alias("a_parent"), F.col("b_key").alias("b_parent"))
        pairs = kept.join(_renamed(cells, "a_"), "a_parent").join(_renamed(cells, "b_"), "b_parent")
        size /= 2
    keyed = _renamed(pts.withColumn("key", _cell(names, size)), "_")
    side = lambda p: keyed.select(*(F.col(f"_{c}").alias(f"{p}_{c}") for c in ("key", "id", *names)), F.col("_core").alias(f"core_{p}"))
    met = pairs.select("la", "a_key", "b_key").join(side("a"), "a_key").join(side("b"), "b_key")
    at = lambda p: G.Point([F.col(f"{p}_{n}") for n in names])
    met = met.withColumn("distance", G.distance(at("a"), at("b"))).withColumn("weight", _weight())
    edge = F.struct("weight", F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"))
    out = materialize(met.groupBy("la").agg(F.min(edge).alias("e")), "best")
    for t in tables:
        drop_table(t)
    return out


def _boruvka(pts: DataFrame, names: Sequence[str], n: int, k: int) -> DataFrame:
    tree: DataFrame | None = None
    labels = materialize(pts.select("id", F.col("id").alias("label")), "labels")
    lists = materialize(_neighbour_lists(pts, pts, names, min(k, n - 1)), "neighbours")
    while True:
        of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
        met = lists.join(of("a"), "a").join(of("b"), "b")
        edge = F.struct("weight", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        best = met.where("la <> lb").groupBy("la").agg(F.min(edge).alias("e"))
        # Nothing that is not listed is nearer than `far`; a full list leaves nothing out.
        bound = met.groupBy("la").agg(F.min(F.when(F.col("listed") < n - 1, F.col("far"))).alias("far"))
        state = materialize(labels.select(F.col("label").alias("la")).distinct().join(bound, "la", "left").join(best, "la", "left"), "best")
        sure = state.where("e IS NOT NULL AND (far IS NULL OR e.weight < far)").select("la", "e")
        if sure.isEmpty():
            sure = _closest_others(pts.join(labels, "id"), state, names)
            if sure is None:
                return tree if tree is not None else pts.sparkSession.createDataFrame([], "source long, target long, weight double")
        chosen = materialize(sure.select(F.col("e.lo").alias("source"), F.col("e.hi").alias("target"), F.col("e.weight").alias("weight")).distinct(), "tree")
        tree = chosen if tree is None else tree.unionByName(chosen)
        ends = chosen.join(labels.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(labels.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
        joined = connected_components(ends.select("a", "b")).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = materialize(labels.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        if labels.select("label").distinct().limit(2).count() < 2:
            return tree


# -- hierarchies -----------------------------------------------------------------------------------------------------------


def link(source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-linkage tree over n - 1 edges by (weight, source, target): parents of 2n - 1 nodes, and the edges' heights.

    Node e of the first n - 1 is the e-th edge in order, node n - 1 + v the vertex v; the last edge is the root and
    has parent -1.
    """
    m = len(source)
    order = np.lexsort((target, source, weight))
    root = list(range(m + 1))
    top = [m + v for v in range(m + 1)]
    parents = np.full(2 * m + 1, -1, np.int64)

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for e, i in enumerate(order.tolist()):
        a, b = find(int(source[i])), find(int(target[i]))
        parents[top[a]] = parents[top[b]] = e
        root[max(a, b)] = min(a, b)
        top[min(a, b)] = e
    return parents, weight[order]


def merge_in_order(rank: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their parents where edges between the nodes ``u`` and ``v`` join them in order of rank.

    An edge is the parent of what the two components that it joins are called: a node by its own name, a larger one by
    the rank of its last edge. What nothing joins here gets no parent.
    """
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    name, root = nodes.tolist(), list(range(len(nodes)))
    order = np.argsort(rank, kind="stable")
    ends = flat.reshape(2, -1)[:, order].T.tolist()
    child, parent = [], np.repeat(rank[order], 2)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for e, (a, b) in zip(rank[order].tolist(), ends, strict=True):
        a, b = find(a), find(b)
        child += [name[a], name[b]]
        root[max(a, b)] = min(a, b)
        name[min(a, b)] = e
    return np.array(child, np.int64), parent


def _contracted(edges: DataFrame, n: int, local_edges: int) -> DataFrame:
    """(node, parent) of all nodes but the root, from ``n`` edges (rank, u, v) between nodes that aren't ranks yet.

    The ranks are halved again and again, all parts of a round at once. In each part the components of the lighter half
    are shrunk to one node, the last edge of the component, which is what the heavier half joins. A node so stands in
    one part only, and after the last round every part has at most ``local_edges`` edges and is merged by itself.
    """
    rounds = max(0, math.ceil(math.log2(max(1, n / local_edges))))
    for i in range(rounds):
        half = local_edges << (rounds - 1 - i)
        heavy = F.floor(F.col("rank") / half) % 2 == 1
        light = edges.where(~heavy)
        part = connected_components(light.select(F.col("u").alias("a"), F.col("v").alias("b")), local_edges)
        last = splittable_join(light.select(F.col("u").alias("node"), "rank"), part, "node").groupBy("label").agg(F.max("rank").alias("name"))
        named = materialize(part.join(last, "label").select("node", "name"), "shrunk")
        drop_table(part)
        joined = edges.where(heavy)
        for end in ("u", "v"):
            joined = splittable_join(joined.withColumnRenamed(end, "node"), named, "node", "left").withColumn(end, F.coalesce("name", "node")).drop("node", "name")
        before, edges = edges, materialize(light.unionByName(joined), "contracted")
        drop_table(named)
        if i:
            drop_table(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def merged() -> Iterator[pa.RecordBatch]:
            if held:
                child, parent = merge_in_order(*(np.concatenate([h[k] for h in held]) for k in range(3)))
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], ["node", "parent"])

        for batch in batches:
            part, *rows = (batch.column(c).to_numpy() for c in ("part", "rank", "u", "v"))
            for some in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if len(some) and part[some[0]] != at:
                    yield from merged()
                    at, held = part[some[0]], []
                held.append([r[some] for r in rows])
        yield from merged()

    parts = edges.withColumn("part", F.floor(F.col("rank") / local_edges))
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "node long, parent long")


#: Edges of a spanning tree that one task merges in order.
MERGED_EDGES = 500_000


def dendrogram(edges: DataFrame, local_edges: int = MERGED_EDGES) -> DataFrame:
    """(node, kind, vertex, parent, height) of the single-linkage tree over a spanning tree (source, target, weight).

    Edges are nodes 0 to n - 2 by (height, source, target), vertices (in order of their ids) follow; the root's parent
    is -1. Up to ``local_edges`` edges one task merges them in order. Beyond, the tree is contracted by rounds over the
    cluster until its parts are that small, and the parts are merged side by side; the result is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        s, d, w = (t.column(c).to_numpy() for c in ("source", "target", "weight"))
        ids, flat = np.unique(np.concatenate([s, d]), return_inverse=True)
        parents, heights = link(flat[: len(s)], flat[len(s) :], w)
        m = len(s)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(2 * m + 1)), pa.array(["edge"] * m + ["vertex"] * (m + 1)), pa.array([None] * m + ids.tolist(), pa.int64()),
            pa.array(parents), pa.array(heights.tolist() + [0.0] * (m + 1), pa.float64()),
        ], ["node", "kind", "vertex", "parent", "height"])

    edges = edges.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), F.col("weight").cast("double").alias("weight"))
    edges = materialize(edges, "tree-edges")
    n = edges.count()
    if n <= local_edges:
        return edges.repartition(1).mapInArrow(run, "node long, kind string, vertex long, parent long, height double")
    order = ["weight", "source", "target"]
    ranked = materialize(attach_indices(edges.repartitionByRange(*order).sortWithinPartitions(*order), "rank"), "ranked-edges")
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    vertices = materialize(attach_indices(ids.repartitionByRange("id").sortWithinPartitions("id"), "place").select("id", (F.col("place") + n).alias("node")), "vertices")
    ends = ranked.select("rank", "source", "target")
    for end, name in (("source", "u"), ("target", "v")):
        ends = splittable_join(ends.withColumnRenamed(end, "id"), vertices, "id").withColumnRenamed("node", name).drop("id")
    parents = _contracted(materialize(ends, "numbered-edges"), n, max(1, local_edges))
    nodes = ranked.select(F.col("rank").alias("node"), F.lit("edge").alias("kind"), F.lit(None).cast("long").alias("vertex"), F.col("weight").alias("height"))
    nodes = nodes.unionByName(vertices.select("node", F.lit("vertex").alias("kind"), F.col("id").alias("vertex"), F.lit(0.0).alias("height")))
    return nodes.join(parents, "node", "left").select("node", "kind", "vertex", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), "height")


def hdbscan(df: DataFrame, names: Sequence[str], min_points: int, id: str = "id", local_points: int = LOCAL_POINTS, local_edges: int = MERGED_EDGES) -> DataFrame:
    """The hierarchy of :func:`dendrogram` over the mutual reachability spanning tree."""
    return dendrogram(spanning_tree(df, names, min_points, id, local_points), local_edges)
