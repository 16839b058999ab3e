"""Spatial joins: theta, within a radius, k nearest, ordered; neighbour lists; compressed rows.

Queries and values are DataFrames; a geometry is a function from a column getter to a
:class:`~orbweave.functions.geometry.Geometry`, such as ``lambda c: Point.of(c("x"), c("y"))``.

The bucket join lays a grid over space whose cell size doubles from level to level. A geometry belongs to the level
whose cells are as large as it is, so it covers at most two cells on each axis there; it is also entered on the coarser
levels that the other side has. Pairs meet by an equi-join on level and cell at the coarser of their levels, in the
one cell that holds the lower corner of what their boxes share, so no pair is found twice. The exact predicate is the
residual condition. Catalyst chooses a broadcast, hash or sort-merge join, and adaptive execution splits hot cells.

A ray is cut into pieces as long as a cell on each level that the values have, and its pieces are entered in the cells
that they cross, so it meets only values along its way.
"""

from __future__ import annotations

import dataclasses
import functools
import gc
import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import arrays
from orbweave.functions import geometry as G
from orbweave.functions.errors import GeometryError, LimitExceeded
from orbweave.functions.morton import morton64
from orbweave.operators import blocks
from orbweave.operators.parts import MOST, MOST_LEAVES, Parts, box_gap
from orbweave.plans.shared import materialize, splittable_join

Getter = Callable[[str], Column]
Shape = Callable[[Getter], G.Geometry]
Metric = Callable[[G.Geometry, G.Geometry], Column]

#: A trifle that keeps what is exactly at a bound inside after rounding.
PAD = 1 + 1e-9
#: Levels beyond the first.
LEVELS = 40
#: A grid of at most so many cells sorts out little, so blocks of rows are compared instead.
COARSE = 1 << 15
#: Pairs of a ray and a value in a round of energy deposit, for each row of both sides.
ROUND = 1 << 15
#: Grid axes at most; further dimensions are left to the exact predicate.
AXES = 3


def points(*names: str) -> Shape:
    return lambda c: G.Point.of(*(c(n) for n in names))


def spheres(names: Sequence[str], radius: str | float) -> Shape:
    return lambda c: G.Sphere.of([c(n) for n in names], c(radius) if isinstance(radius, str) else radius)


def boxes(lo: Sequence[str], hi: Sequence[str]) -> Shape:
    return lambda c: G.Box.of([c(n) for n in lo], [c(n) for n in hi])


@dataclass(frozen=True)
class Predicate:
    """What a query asks for: see :func:`intersects`, :func:`within`, :func:`nearest` and :func:`ordered_intersects`."""

    kind: str
    radius: Column | float | str | None = None
    k: int | str | None = None


def intersects() -> Predicate:
    return Predicate("intersects")


def within(radius: float | str) -> Predicate:
    """``radius``: a number above 0, or a column of the queries."""
    if not isinstance(radius, str) and radius <= 0:
        raise GeometryError("the radius must be above 0")
    return Predicate("within", radius=radius)


def nearest(k: int | str = 1) -> Predicate:
    """``k``: a number, or a column of the queries; below 1 a query has no results."""
    return Predicate("nearest", k=k)


def ordered_intersects() -> Predicate:
    """As :func:`intersects`, with ``distance`` and the rank ``place`` by (distance, value_id)."""
    return Predicate("ordered")


def _side(df: DataFrame, prefix: str) -> tuple[DataFrame, Getter]:
    return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns)), lambda n: F.col(prefix + n)


def extent(df: DataFrame, shape: Shape) -> DataFrame:
    """One row with the box around all geometries: lo_0, hi_0, lo_1, ...; the empty box for no rows."""
    b = G.bounds(shape(F.col))
    return df.agg(*itertools.chain(*((F.coalesce(F.min(lo), F.lit(G.EMPTY)).alias(f"lo_{i}"), F.coalesce(F.max(hi), F.lit(-G.EMPTY)).alias(f"hi_{i}")) for i, (lo, hi) in enumerate(zip(b.lo, b.hi, strict=True)))))


def kdop_extent(df: DataFrame, shape: Shape, k: int) -> DataFrame:
    """One row with the k-DOP around all geometries: lo_0, hi_0, ..."""
    d = G.KDOP.around(shape(F.col), k)
    return df.agg(*itertools.chain(*((F.min(lo).alias(f"lo_{i}"), F.max(hi).alias(f"hi_{i}")) for i, (lo, hi) in enumerate(zip(d.lo, d.hi, strict=True)))))


def _boxed(df: DataFrame, box: G.Box, prefix: str) -> DataFrame:
    """``df`` with its box as columns, and its largest extent; rows without a finite box go, as they meet nothing."""
    axes = min(AXES, box.dim)
    df = df.withColumns({f"{prefix}lo{i}": box.lo[i] for i in range(axes)} | {f"{prefix}hi{i}": box.hi[i] for i in range(axes)})
    wide = [F.col(f"{prefix}hi{i}") - F.col(f"{prefix}lo{i}") for i in range(axes)]
    return df.withColumn(f"{prefix}size", G.greatest(wide)).where((F.col(f"{prefix}size") < G.INF) & (G.least(wide) >= 0))


def _typical(*sides: tuple[DataFrame, str]) -> float:
    """A cell size: the larger of the sides' median extents, or of the scene if those are 0."""
    best, scene = 0.0, 0.0
    for df, p in sides:
        axes = sum(c.startswith(f"{p}lo") for c in df.columns)
        r = df.agg(F.percentile_approx(f"{p}size", 0.5), F.count("*"), *(F.max(f"{p}hi{i}") - F.min(f"{p}lo{i}") for i in range(axes))).first()
        if r[0] is not None:
            best = max(best, r[0])
            scene = max(scene, max((x for x in r[2:] if x is not None), default=0.0) / max(1.0, r[1] ** (1 / axes)))
    return best or scene or 1.0


def _gridded(df: DataFrame, prefix: str, h: float, levels: Sequence[int], axes: int) -> DataFrame:
    """A row for each level from its own up, and each cell there."""
    own = F.col(f"{prefix}level")
    df = df.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= own)))
    size = F.lit(h) * F.pow(F.lit(2.0), F.col("level"))
    for i in range(axes):
        df = df.withColumn(f"cell{i}", F.explode(F.sequence(F.floor(F.col(f"{prefix}lo{i}") / size), F.floor(F.col(f"{prefix}hi{i}") / size))))
    return df


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once: a generator of one row, into which no later expression is merged."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _ray_columns(q: DataFrame, ray: G.Ray) -> tuple[DataFrame, G.Ray]:
    """Origin and direction as columns, so that expressions over them stay small."""
    q = _computed(q, {f"__o{i}": x for i, x in enumerate(ray.o)} | {f"__d{i}": x for i, x in enumerate(ray.d)})
    return q, G.Ray([F.col(f"__o{i}") for i in range(3)], [F.col(f"__d{i}") for i in range(3)])


def bucket_pairs(q: DataFrame, v: DataFrame, qbox: G.Box, vbox: G.Box, condition: Column, cell: float | None = None, semi: bool = False) -> DataFrame:
    """Rows of ``q`` and ``v`` (disjoint column names) whose boxes meet and for which ``condition`` holds, each pair once.

    With ``semi``, rows of ``q`` that have such a partner, once for each cell in which they have one.
    """
    axes = min(AXES, qbox.dim)
    names = [*q.columns, *v.columns]
    q, v = _boxed(q, qbox, "__q"), _boxed(v, vbox, "__v")
    h = (cell or _typical((q, "__q"), (v, "__v"))) * PAD
    level = lambda p: F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(F.col(f"{p}size"), F.lit(h)) / F.lit(h))))).cast("int")
    q, v = q.withColumn("__qlevel", level("__q")), v.withColumn("__vlevel", level("__v"))
    levels = sorted({r[0] for r in q.select("__qlevel").distinct().union(v.select("__vlevel").distinct()).collect()})  # at most LEVELS + 1
    if semi:
        names = names[: names.index(v.columns[0])]
    if not levels:
        return q.join(v, F.lit(False), "left_semi" if semi else "inner").select(*names)
    keys = ["level", *(f"cell{i}" for i in range(axes))]
    left, right = _gridded(q, "__q", h, levels, axes), _gridded(v, "__v", h, levels, axes)
    if semi:
        right = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
        same = [F.col(k) == F.col(f"__r_{k}") for k in keys]
        return left.join(right, G._all([*same, F.col("level") == F.greatest("__qlevel", "__vlevel")]) & condition, "left_semi").select(*names)
    met = left.join(right, keys)
    size = F.lit(h) * F.pow(F.lit(2.0), F.col("level"))
    once = [F.floor(F.greatest(F.col(f"__qlo{i}"), F.col(f"__vlo{i}")) / size) == F.col(f"cell{i}") for i in range(axes)]
    touch = [(F.col(f"__qlo{i}") <= F.col(f"__vhi{i}")) & (F.col(f"__vlo{i}") <= F.col(f"__qhi{i}")) for i in range(axes)]
    coarser = F.col("level") == F.greatest("__qlevel", "__vlevel")
    return met.where(G._all([coarser, *once, *touch]) & condition).select(*names)


def _integral(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")


def _needs(where: Callable[[Getter, Getter], Column] | None, *own: Sequence[str]) -> list[list[str]]:
    """The columns of both sides that are read after a join: ``own`` ones, and those that ``where`` asks for."""
    need = [list(x) for x in own]
    if where:
        where(*((lambda n, p=p, x=x: x.append(p + n) or F.col(p + n)) for p, x in zip(("q_", "v_"), need, strict=True)))
    return need


class SpatialIndex:
    """Values with a geometry and an id, to be queried many times.

    strategy ``grid`` joins by the bucket join; ``brute`` compares every query with every value and fits only inputs
    that are known to be small, or predicates without a bound.
    """

    def __init__(self, df: DataFrame, shape: Shape, id: str = "id", strategy: str = "grid", cell: float | None = None):
        if strategy not in ("grid", "brute"):
            raise GeometryError(f"no strategy {strategy}")
        self.df, self.shape, self.id, self.strategy, self.cell = df, shape, id, strategy, cell

    def size(self) -> int:
        return self.df.count()

    def empty(self) -> bool:
        return self.df.isEmpty()

    def bounds(self) -> DataFrame:
        return extent(self.df, self.shape)

    def query(
        self, queries: DataFrame, shape: Shape, predicate: Predicate, id: str = "id", keep: Sequence[str] = (), keep_values: Sequence[str] = (),
        where: Callable[[Getter, Getter], Column] | None = None, metric: Metric | None = None, metric_bound: float | None = None,
        metric_box: Callable[[G.Geometry, G.Box], Column] | None = None, max_results: int | None = None,
    ) -> DataFrame:
        """(query_id, value_id) and, where the predicate measures it, ``distance`` and ``place`` (from 1).

        ``keep`` and ``keep_values`` name columns of either side to carry along. ``where`` is a further condition on
        a pair, before any ranking. ``metric`` replaces the distance; if it is at least ``metric_bound`` times the
        Euclidean one, nearest queries still use the grid. For other metrics ``metric_box`` gives a lower bound of the
        metric from a query to all values within a box, by which balanced parts are searched best first; without
        either all pairs are compared. ``max_results`` raises if a query has more results.
        """
        q, qc = _side(queries, "q_")
        v, vc = _side(self.df, "v_")
        qg, vg = shape(qc), self.shape(vc)
        if isinstance(qg, G.Ray):
            q, qg = _ray_columns(q, qg)
        extra = where(qc, vc) if where else F.lit(True)
        base = [qc(id).alias("query_id"), vc(self.id).alias("value_id")]
        kept = [qc(c).alias(c) for c in keep] + [vc(c).alias(c) for c in keep_values]
        along = isinstance(qg, G.Ray) and self.strategy == "grid" and metric is None and predicate.kind in ("intersects", "ordered", "nearest")
        if along:
            nearest = predicate.kind == "nearest"
            need = _needs(where, ["q_" + id, *("q_" + n for n in keep), *(["q_" + predicate.k] if nearest and isinstance(predicate.k, str) else [])], ["v_" + self.id, *("v_" + n for n in keep_values)])
            first = int(predicate.k) if nearest and where is None and not isinstance(predicate.k, str) and predicate.k >= 1 and _integral(v, "v_" + self.id) else None
            hits = self._along(q, v, qg, vg, qc, vc, extra, need, first)
            if predicate.kind == "intersects":
                return self._limited(hits.select(*base, *kept), max_results)
            place = F.row_number().over(Window.partitionBy(qc(id)).orderBy("distance", vc(self.id)))
            hits = hits.withColumn("place", place)
            if predicate.kind == "nearest":
                hits = hits.where(F.col("place") <= (qc(predicate.k) if isinstance(predicate.k, str) else F.lit(int(predicate.k))))
            return self._limited(hits.select(*base, "distance", "place", *kept), max_results)
        if predicate.kind == "nearest":
            out = self._nearest(q, v, qg, vg, qc, vc, id, predicate.k, where, metric, metric_bound, metric_box, keep, keep_values).select(*base, "distance", "place", *kept)
        else:
            measure = [] if predicate.kind == "intersects" else [(metric or G.distance)(qg, vg).alias("distance")]
            if predicate.kind == "within":
                radius = qc(predicate.radius) if isinstance(predicate.radius, str) else F.lit(float(predicate.radius))
                condition, around = (metric or G.distance)(qg, vg) <= radius, G.bounds(G.grow(qg, radius * PAD))
            else:
                condition = (G.distance(qg, vg) < G.INF) if predicate.kind == "ordered" and isinstance(qg, G.Ray) else G.intersects(qg, vg)
                around = None if isinstance(qg, G.Ray) else G.bounds(qg)
            need = _needs(where, ["q_" + id, *("q_" + n for n in keep)], ["v_" + self.id, *("v_" + n for n in keep_values)])
            out = None
            if metric is None and around is not None:
                asked = blocks.Asked(predicate.kind if predicate.kind == "within" else "intersects", None if isinstance(predicate.radius, str) else predicate.radius, bool(measure))
                out = self._by_blocks(q, v, qg, vg, around, need, asked, condition & extra, extra, (qc(id), vc(self.id)), radius if predicate.kind == "within" and isinstance(predicate.radius, str) else None, measure)
            if out is None:
                out = self._pairs(q, v, around, G.bounds(vg), condition & extra).select(*base, *measure, *kept)
            else:
                out = out.select(*base, *(["distance"] if measure else []), *kept)
            if predicate.kind == "ordered":
                out = out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "value_id")))
        return self._limited(out, max_results)

    def checked(self, queries: DataFrame, shape: Shape, most: int, radius: float | None = None, id: str = "id") -> DataFrame:
        """``queries``; raises LimitExceeded if one has more than ``most`` matches, which the search stops at."""
        at_most(self.some(queries, shape, most + 1, radius, id), most)
        return queries

    def _limited(self, out: DataFrame, max_results: int | None) -> DataFrame:
        return at_most(out, max_results) if max_results is not None else out

    def exists(self, queries: DataFrame, shape: Shape, radius: float | None = None, id: str = "id", where: Callable[[Getter, Getter], Column] | None = None) -> DataFrame:
        """(query_id) of the queries that intersect a value, or with ``radius`` have one within it.

        A semi-join over the cells, which leaves a query's cell at its first match; no pairs are made.
        """
        q, qc = _side(queries, "q_")
        v, vc = _side(self.df, "v_")
        qg, vg = shape(qc), self.shape(vc)
        condition = (G.intersects(qg, vg) if radius is None else G.distance(qg, vg) <= radius) & (where(qc, vc) if where else F.lit(True))
        if self.strategy == "brute":
            met = q.join(v, condition, "left_semi")
        else:
            qbox = G.bounds(qg if radius is None else G.grow(qg, F.lit(float(radius)) * PAD))
            met = bucket_pairs(q, v, qbox, G.bounds(vg), condition, self.cell, semi=True)
        return met.select(qc(id).alias("query_id")).distinct()

    def some(self, queries: DataFrame, shape: Shape, n: int, radius: float | None = None, id: str = "id", where: Callable[[Getter, Getter], Column] | None = None) -> DataFrame:
        """(query_id, value_id): ``n`` of a query's matches, whichever are found first, or all if it has fewer.

        Matches are values that intersect it, or with ``radius`` lie within that. The search goes in rounds: the first
        looks at a few values of each cell only, later ones at more of them, for queries that still lack matches. A query
        among thousands of matches so stops after a few dozen candidates.
        """
        if n < 1:
            raise GeometryError("n must be at least 1")
        q, qc = _side(queries, "q_")
        v, vc = _side(self.df, "v_")
        qg, vg = shape(qc), self.shape(vc)
        condition = (G.intersects(qg, vg) if radius is None else G.distance(qg, vg) <= radius) & (where(qc, vc) if where else F.lit(True))
        qbox, vbox = G.bounds(qg if radius is None else G.grow(qg, F.lit(float(radius)) * PAD)), G.bounds(vg)
        h = self.cell or radius or _typical((_boxed(v, vbox, "__v"), "__v"))
        cells = [F.floor(c / F.lit(h)) for c in G.centroid(vg).at[: min(AXES, vg.dim)]]
        place = F.row_number().over(Window.partitionBy(*cells).orderBy(F.xxhash64(vc(self.id))))
        v = materialize(v.withColumn("__turn", place), "turns")
        out, left, seen = None, q, 0
        for most in (*(4 * n * 16**k for k in range(2)), None):
            turn = v.where((F.col("__turn") > seen) & (F.col("__turn") <= most if most else F.lit(True))).drop("__turn")
            found = bucket_pairs(left, turn, qbox, vbox, condition, self.cell).select(qc(id).alias("query_id"), vc(self.id).alias("value_id"))
            found = first_matches(found if out is None else out.unionByName(found), n)
            if most is None:
                return found
            out = materialize(found, "some-matches")
            full = out.groupBy("query_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= n).select("query_id")
            left = materialize(left.join(full, qc(id) == F.col("query_id"), "left_anti"), "lacking")
            if left.isEmpty():
                return out
            seen = most

    def ray_hits(self, rays: DataFrame, shape: Shape, id: str = "id", keep: Sequence[str] = (), keep_values: Sequence[str] = ()) -> DataFrame:
        """(query_id, value_id, distance, length): where each ray enters the values that it meets, and how far it goes inside."""
        q, qc = _side(rays, "q_")
        v, vc = _side(self.df, "v_")
        q, ray = _ray_columns(q, shape(qc))
        need = [["q_" + id, *("q_" + n for n in keep)], ["v_" + self.id, *("v_" + n for n in keep_values)]]
        hits = self._along(q, v, ray, self.shape(vc), qc, vc, F.lit(True), need)
        return hits.select(qc(id).alias("query_id"), vc(self.id).alias("value_id"), "distance", (F.col("__out") - F.col("distance")).alias("length"), *(qc(c).alias(c) for c in keep), *(vc(c).alias(c) for c in keep_values))

    def _pairs(self, q: DataFrame, v: DataFrame, qbox: G.Box, vbox: G.Box, condition: Column) -> DataFrame:
        if self.strategy == "brute":
            return q.crossJoin(v).where(condition)
        return bucket_pairs(q, v, qbox, vbox, condition, self.cell)

    def _by_blocks(self, q, v, qg, vg, around, need, asked, condition, extra, ids, radius, measure) -> DataFrame | None:
        """The columns that are needed of pairs that match, by comparing blocks of rows; None where a grid sorts out more."""
        if type(vg) not in blocks.SHAPES or type(qg) not in blocks.SHAPES:
            return None
        brute, columns = self.strategy == "brute", [x for n in need for x in dict.fromkeys(n)]
        axes, boxed, counted = min(AXES, qg.dim), [], []
        for df, box, p in ((q, around, "__q"), (v, G.bounds(vg), "__v")):
            df = df.withColumns({f"{p}{side}{i}": x[i] for side, x in (("lo", box.lo), ("hi", box.hi)) for i in range(axes)}) if brute else _boxed(df, box, p)
            finite = F.coalesce(G._all([F.abs(F.col(f"{p}{side}{i}")) < G.INF for side in ("lo", "hi") for i in range(axes)]), F.lit(False))
            fit = blocks.regular(qg if p == "__q" else vg) & finite
            if p == "__q" and radius is not None:
                fit = fit & F.coalesce(F.abs(radius.cast("double")) < blocks.HUGE, F.lit(False))
            size = G.greatest([F.col(f"{p}hi{i}") - F.col(f"{p}lo{i}") for i in range(axes)])
            r = df.agg(F.count("*"), F.count_if(fit), F.percentile_approx(size, 0.5), *(F.max(f"{p}hi{i}") - F.min(f"{p}lo{i}") for i in range(axes))).first()
            boxed.append((df, fit, p))
            counted.append(r)
        if not all(r[1] for r in counted):
            return None
        if not brute:
            h = self.cell or max(r[2] for r in counted) or max(max(r[3:]) / max(1.0, r[0] ** (1 / axes)) for r in counted) or 1.0
            if math.prod(max(1.0, x / h) for x in counted[1][3:]) > COARSE:
                return None
        box = lambda p: G.Box([F.col(f"{p}lo{i}") for i in range(axes)], [F.col(f"{p}hi{i}") for i in range(axes)])
        (qd, qfit, _), (vd, vfit, _) = boxed
        out = blocks.block_pairs(qd.where(qfit), vd.where(vfit), qg, vg, box("__q"), box("__v"), *ids, need, dataclasses.replace(asked, every=brute), [r[1] for r in counted], radius).where(extra)
        names = out.columns
        odd = []
        if counted[0][1] < counted[0][0]:
            odd.append((qd.where(~qfit), vd))
        if counted[1][1] < counted[1][0]:
            odd.append((qd.where(qfit), vd.where(~vfit)))
        for a, b in odd:
            a, b = a.select(*q.columns), b.select(*v.columns)
            out = out.unionByName(self._pairs(a, b, around, G.bounds(vg), condition).select(*columns, *measure).select(*names))
        return out

    def _rays_by_blocks(self, q, v, ray, vg, qc, vc, extra, need, first) -> DataFrame | None:
        """As :meth:`_along`, with the columns that are needed only, by comparing blocks; None where rays pass by most values."""
        v = _boxed(v, G.bounds(vg), "__v")
        if (rows := self._crowded(q, v, ray, vg)) is None:
            return None
        box = G.Box([F.col(f"__vlo{i}") for i in range(3)], [F.col(f"__vhi{i}") for i in range(3)])
        asked = blocks.Asked("ray", measured=True, first=first, every=True)
        return blocks.block_pairs(q, v, ray, vg, G.Box(ray.o, ray.o), box, F.col(need[0][0]), vc(self.id), need, asked, rows).where(extra)

    def _crowded(self, q: DataFrame, v: DataFrame, ray: G.Ray, vg: G.Geometry) -> list[int] | None:
        """How many rays and values (with their boxes as columns) there are, if they are to be compared by blocks."""
        fit = [blocks.regular(ray), blocks.regular(vg)]
        n = q.agg(F.count("*"), F.count_if(fit[0])).first()
        r = v.agg(F.count("*"), F.count_if(fit[1]), F.percentile_approx("__vsize", 0.5), *(F.max(f"__vhi{i}") - F.min(f"__vlo{i}") for i in range(3))).first()
        if not n[0] or not r[0] or n[0] > n[1] or r[0] > r[1]:
            return None
        h = self.cell or max(r[2], max(r[3:]) / r[0] ** (1 / 3)) or 1.0
        return [n[0], r[0]] if math.prod(max(1.0, x / h) for x in r[3:]) <= COARSE else None

    def ray_rounds(self, rays: DataFrame, shape: Shape) -> int:
        """In how many rounds rays had better be taken, for what a round shuffles to grow with the rows: 1 where rays pass by most values."""
        q, qc = _side(rays, "q_")
        v, vc = _side(self.df, "v_")
        q, ray = _ray_columns(q, shape(qc))
        rows = self._crowded(q, _boxed(v, G.bounds(self.shape(vc)), "__v"), ray, self.shape(vc))
        return max(1, math.ceil(rows[0] * rows[1] / (sum(rows) * ROUND))) if rows else 1

    def _along(self, q: DataFrame, v: DataFrame, ray: G.Ray, vg: G.Geometry, qc: Getter, vc: Getter, extra: Column, need: Sequence[Sequence[str]], first: int | None = None) -> DataFrame:
        """The columns that are needed with ``distance`` to where the ray enters the value and ``__out`` where it leaves; each pair once.

        Of a query only the ``first`` values of a block by (distance, id) need be there.
        """
        if (out := self._rays_by_blocks(q, v, ray, vg, qc, vc, extra, need, first)) is not None:
            return out
        box = G.bounds(vg)
        v = _boxed(v, box, "__v")
        r = v.agg(F.count("*"), F.percentile_approx("__vsize", 0.5), *(f(f"__v{side}{i}") for side, f in (("lo", F.min), ("hi", F.max)) for i in range(3))).first()
        if not r[0]:
            return q.join(v, F.lit(False)).withColumns({"distance": F.lit(0.0), "__out": F.lit(0.0)})
        lo, hi = r[2:5], r[5:8]
        h = (self.cell or max(r[1], max(y - x for x, y in zip(lo, hi, strict=True)) / r[0] ** (1 / 3)) or 1.0) * PAD
        v = v.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(F.col("__vsize"), F.lit(h)) / F.lit(h))))).cast("int"))
        levels = sorted(x[0] for x in v.select("level").distinct().collect())  # at most LEVELS + 1
        size = F.lit(h) * F.pow(F.lit(2.0), F.col("level"))
        cells = lambda df, p: functools.reduce(lambda d, i: d.withColumn(f"cell{i}", F.explode(F.sequence(F.floor(F.col(f"{p}lo{i}") / size), F.floor(F.col(f"{p}hi{i}") / size)))), range(3), df)
        # The part of each ray inside the scene, cut into pieces of a cell's length on each level.
        trifle = 1e-9 * (1 + max(map(abs, (*lo, *hi))))  # a ray through a corner of everything must not be rounded away
        q = _computed(q, dict(zip(("__enter", "__leave"), G.ray_box(ray, G.Box.of([x - trifle for x in lo], [x + trifle for x in hi])), strict=True)))
        q = q.where("__enter <= __leave AND __leave >= 0").withColumn("__enter", F.greatest("__enter", F.lit(0.0)))
        q = q.withColumn("__leave", F.when(F.col("__leave") == G.INF, F.col("__enter")).otherwise(F.col("__leave")))  # no direction
        q = q.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__step", size)
        q = q.withColumn("__last", F.greatest(F.ceil((F.col("__leave") - F.col("__enter")) / F.col("__step")), F.lit(1)) - 1)
        q = q.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))))
        a = F.col("__enter") + F.col("__piece") * F.col("__step")
        q = q.withColumns({"__a": a, "__b": F.least("__leave", a + F.col("__step"))})
        pad = F.lit(1e-9) * (F.lit(1.0) + G.norm(ray.o) + F.abs("__leave"))
        ends = lambda i: [ray.o[i] + ray.d[i] * F.col(x) for x in ("__a", "__b")]
        q = _computed(q, {f"__qlo{i}": F.least(*ends(i)) - pad for i in range(3)} | {f"__qhi{i}": F.greatest(*ends(i)) + pad for i in range(3)})
        met = cells(q, "__q").join(cells(v, "__v"), ["level", "cell0", "cell1", "cell2"])
        touch = [(F.col(f"__qlo{i}") <= F.col(f"__vhi{i}")) & (F.col(f"__vlo{i}") <= F.col(f"__qhi{i}")) for i in range(3)]
        once = [F.floor(F.greatest(f"__qlo{i}", f"__vlo{i}") / size) == F.col(f"cell{i}") for i in range(3)]
        met = met.where(G._all([*touch, *once]) & extra)
        # The piece that holds the entry into the value's box; then the value itself.
        wider = F.lit(0.0) if isinstance(vg, G.Box) else pad / 2  # the value decides by itself, so its box may err on the large side
        around = G.Box([F.col(f"__vlo{i}") - wider for i in range(3)], [F.col(f"__vhi{i}") + wider for i in range(3)])
        met = _computed(met, dict(zip(("__in", "__out"), G.ray_box(ray, around), strict=True)))
        own = F.least(F.floor((F.greatest("__in", "__enter") - F.col("__enter")) / F.col("__step")), F.col("__last"))
        met = met.where((F.col("__in") <= F.col("__out")) & (F.col("__out") >= 0)).where(own == F.col("__piece"))
        if not isinstance(vg, G.Box):
            met = _computed(met.drop("__in", "__out"), dict(zip(("__in", "__out"), G.ray_interval(ray, vg), strict=True))).where("__in <= __out AND __out >= 0")
        return met.withColumn("distance", F.greatest("__in", F.lit(0.0)))

    def _nearest_by_blocks(self, asked, v, qg, vg, qc, vc, id, k, limit, most, condition, metric, metric_bound, keep, keep_values) -> tuple[DataFrame, DataFrame] | None:
        """What :func:`blocks.nearest_values` finds and the queries that it leaves; None where arrays don't serve."""
        if type(vg) not in blocks.SHAPES or type(qg) not in blocks.SHAPES or not _integral(v, "v_" + self.id):
            return None
        need = _needs(condition, ["q_" + id, *("q_" + n for n in keep), *(["q_" + k] if isinstance(k, str) else [])], ["v_" + self.id, *("v_" + n for n in keep_values)])
        shapes = [blocks.numbered(g, itertools.count()) for g in (qg, vg)]
        one = lambda *_: arrays.Numbers(np.ones((1, 1)))
        if condition and not (blocks.on_arrays(condition, one, one) and all(df.schema[c].dataType.typeName() in blocks.NUMERIC for df, own in ((asked, need[0]), (v, need[1])) for c in own)):
            return None
        if metric and not blocks.on_arrays(metric, *(blocks.filled(g, one) for g in shapes)):
            return None
        plain = metric is None and isinstance(qg, G.Point) and isinstance(vg, G.Point)
        axes, sides = min(AXES, qg.dim), []
        for df, g, p in ((asked, qg, "__q"), (v, vg, "__v")):
            if plain:  # what has no finite place is at no distance from anything
                df = df.where(F.coalesce(G._all([F.abs(x.cast("double")) < G.INF for x in g.at]), F.lit(False)))
            df, fit = _boxed(df, G.bounds(g), p), blocks.regular(g)
            r = df.agg(F.count("*"), F.count_if(fit)).first()
            if not r[0] or r[1] < r[0] or not plain and r[0] < (asked if p == "__q" else v).count():
                return None
            sides.append((df, r[0]))
        box = lambda p: G.Box([F.col(f"{p}lo{i}") for i in range(axes)], [F.col(f"{p}hi{i}") for i in range(axes)])
        near = blocks.Near(shapes, metric or G.distance, condition, most, PAD / (metric_bound if metric is not None else 1.0))
        return blocks.nearest_values(sides[0][0], sides[1][0], qg, vg, box("__q"), box("__v"), qc(id), vc(self.id), need, limit, near, sides[1][1])

    def _nearest(self, q, v, qg, vg, qc, vc, id, k, condition, metric, metric_bound, metric_box, keep=(), keep_values=()) -> DataFrame:
        """Two rounds: a distance within which a query has its k values for certain, then all values within it.

        Both compare queries with leaves of values on arrays where the geometries, metric and condition allow it. Else
        they join columns: queries among the values take the second round over the grid. Those apart from them, or whose ``where`` left too
        few values near by, take it over balanced parts: only parts whose box is within the bound are looked into.
        """
        measured = (metric or G.distance)(qg, vg)
        where = condition(qc, vc) if condition else None
        extra = where if where is not None else F.lit(True)
        limit = qc(k) if isinstance(k, str) else F.lit(int(k))
        most = int(q.agg(F.max(qc(k))).first()[0] or 0) if isinstance(k, str) else int(k)
        place = F.row_number().over(Window.partitionBy(qc(id)).orderBy("distance", vc(self.id)))
        names = [*q.columns, *v.columns]
        ranked = lambda pairs: pairs.select(*names, measured.alias("distance")).where(F.col("distance") < G.INF).withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= limit))
        asked = q.where(limit >= 1)
        unbounded = metric is not None and not metric_bound and metric_box is None
        if self.strategy == "brute" or most < 1 or isinstance(qg, G.Ray) or unbounded:  # rays: only by a metric of one's own
            if where is None and metric is None and most >= 1 and not isinstance(qg, G.Ray) and _integral(v, "v_" + self.id):
                # Of each block of values only the first can be among the nearest.
                need = _needs(None, ["q_" + id, *("q_" + n for n in keep), *(["q_" + k] if isinstance(k, str) else [])], ["v_" + self.id, *("v_" + n for n in keep_values)])
                near = self._by_blocks(asked, v, qg, vg, G.bounds(qg), need, blocks.Asked("nearest", measured=True, first=most), F.lit(True), extra, (qc(id), vc(self.id)), None, [measured.alias("distance")])
                if near is not None:
                    return near.where(F.col("distance") < G.INF).withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= limit))
            return ranked(asked.crossJoin(v).where(extra))
        centre = G.centroid(vg).at[: min(AXES, qg.dim)]
        at = G.centroid(qg).at[: len(centre)]
        r = v.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*centre)), *(f(c) for c in centre for f in (F.min, F.max))).first()
        n, low, high = r[0], r[2::2], r[3::2]
        if not n or any(x is None or not -G.INF < x < G.INF for x in (*low, *high)):
            v = v.where(G._all([(c > -G.INF) & (c < G.INF) for c in centre]))
            if not n or v.isEmpty():
                return ranked(asked.join(v, F.lit(False)))
            r = v.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*centre)), *(f(c) for c in centre for f in (F.min, F.max))).first()
            n, low, high = r[0], r[2::2], r[3::2]
        if where is None and isinstance(vg, G.Point) and n > 4 * most * r[1]:
            # Many values at the same places: of each place only the first ids can be among the nearest.
            first = F.row_number().over(Window.partitionBy(*vg.at).orderBy(vc(self.id)))
            v = v.withColumn("__first", first).where(F.col("__first") <= most).drop("__first")
        around = G.bounds(qg)
        if metric_box is not None:
            away = lambda b: metric_box(qg, b)
        else:
            away = lambda b: box_gap(around, b) * F.lit((metric_bound if metric is not None else 1.0) / PAD)
        parts = functools.cache(lambda largest=MOST: Parts(v, centre, G.bounds(vg), vc(self.id), most=min(largest, max(1, n // max(32, 4 * most)))))
        out, left, settled = None, asked, None
        if metric_box is None and (by_blocks := self._nearest_by_blocks(asked, v, qg, vg, qc, vc, id, k, limit, most, condition, metric, metric_bound, keep, keep_values)) is not None:
            settled, few = by_blocks
            settled = settled.withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= limit))
            if few.isEmpty():
                return settled
            left = asked.join(few.select(qc(id).alias("__id")), qc(id) == F.col("__id"), "left_semi")
        elif metric_box is None:
            bounded = self._reach(asked, v, centre, at, low, high, n, qc, id, measured, limit, most, extra)
            factor = PAD / (metric_bound if metric is not None else 1.0)
            apart = G.norm([x - F.greatest(F.lit(lo), F.least(F.lit(hi), x)) for x, lo, hi in zip(at, low, high, strict=True)]) * 4 > F.col("__reach") * F.lit(factor)
            near, far, left = bounded.where(~apart), bounded.where(apart), bounded.where("__reach IS NULL").drop("__reach")
            out = bucket_pairs(near, v, G.bounds(G.grow(around, F.col("__reach") * F.lit(factor))), G.bounds(vg), extra & (measured <= F.col("__reach"))).select(*names)
            if not far.isEmpty():
                # A near part with enough values gives a sharper bound than samples of cells.
                leaves = parts(MOST_LEAVES)
                one = leaves.meet(far.drop("__reach"), F.array(leaves.good(away, limit))).where(extra).withColumn("__d", measured)
                rank = F.row_number().over(Window.partitionBy(qc(id)).orderBy("__d"))
                one = one.withColumn("__rank", rank).where((F.col("__rank") <= most) & (F.col("__rank") == limit)).select(qc(id).alias("__id"), "__d")
                far = materialize(far.join(one, qc(id) == F.col("__id"), "left").withColumn("__reach", F.least("__reach", "__d")).drop("__id", "__d"), "reach")
                found = leaves.meet(far, leaves.within(away, F.col("__reach"))).where(extra & (measured <= F.col("__reach")))
                out = out.unionByName(found.select(*names))
            if left.isEmpty():
                return ranked(out)
        # Best parts first: what has its k values after a few parts needs only those within the bound that they give.
        rest = None
        for m in (8, 64):
            if m >= len(parts().rows) or most > n:
                break
            best = parts().meet(left, parts().nearest(away, m)).where(extra).withColumn("__d", measured).where(F.col("__d") < G.INF)
            rank = F.row_number().over(Window.partitionBy(qc(id)).orderBy("__d"))
            best = best.withColumn("__rank", rank).where((F.col("__rank") <= most) & (F.col("__rank") == limit)).select(qc(id).alias("__id"), F.col("__d").alias("__reach"))
            tried = materialize(left.join(best, qc(id) == F.col("__id"), "left").drop("__id"), "reach")
            done, left = tried.where("__reach IS NOT NULL"), tried.where("__reach IS NULL").drop("__reach")
            found = parts().meet(done, parts().within(away, F.col("__reach"))).where(extra & (measured <= F.col("__reach"))).select(*names)
            rest = found if rest is None else rest.unionByName(found)
        # What still lacks values may need any of them: there are too few, or ``where`` passes few.
        found = parts().meet(left, parts().all()).where(extra).select(*names)
        for some in (rest, out):
            found = found if some is None else found.unionByName(some)
        return ranked(found) if settled is None else settled.unionByName(ranked(found).select(*settled.columns))

    def _reach(self, q, v, centre, at, low, high, n, qc, id, measured, limit, most, extra) -> DataFrame:
        """``q`` with a distance within which it has enough values: the k-th smallest among some near ones.

        The values near a query are those whose centres lie in the cells around its own, or for a query outside all
        values around the nearest place of their box. Of a cell only a few values are taken, as any k of them give a
        bound. The cell size starts at k values a cell and grows fourfold for the queries that still lack some.
        """
        span = [y - x for x, y in zip(low, high, strict=True)]
        widest = max(span)
        at = [F.greatest(F.lit(lo), F.least(F.lit(hi), x)) for x, lo, hi in zip(at, low, high, strict=True)]
        out, left = None, q
        h = max(widest / max(1.0, (n / most) ** (1 / sum(x > widest * 1e-3 for x in span))), widest * 1e-6) if widest > 0 else 1.0
        while True:
            cells = [f"__c{i}" for i in range(len(centre))]
            some = v.withColumns({c: F.floor(x / F.lit(h)) for c, x in zip(cells, centre, strict=True)})
            few = F.row_number().over(Window.partitionBy(*cells).orderBy(F.xxhash64("v_" + self.id)))
            some = some.withColumn("__few", few).where(F.col("__few") <= 4 * most).drop("__few")
            asked = left
            for c, x in zip(cells, at, strict=True):
                asked = asked.withColumn(c, F.explode(F.sequence(F.floor(x / F.lit(h)) - 1, F.floor(x / F.lit(h)) + 1)))
            best = asked.join(some, cells).where(extra).withColumn("__d", measured).where(F.col("__d") < G.INF)
            rank = F.row_number().over(Window.partitionBy(qc(id)).orderBy("__d"))
            best = best.withColumn("__rank", rank).where((F.col("__rank") <= most) & (F.col("__rank") == limit)).select(qc(id).alias("__id"), F.col("__d").alias("__reach"))
            tried = materialize(left.join(best, qc(id) == F.col("__id"), "left").drop("__id"), "reach")
            done = tried.where("__reach IS NOT NULL")
            out = done if out is None else out.unionByName(done)
            left = tried.where("__reach IS NULL").drop("__reach")
            h *= 4
            if h >= widest * 4 or left.isEmpty():
                return out.unionByName(left.withColumn("__reach", F.lit(None).cast("double")))


# -- lists of neighbours -----------------------------------------------------------------------------------------------


def half_neighbors(df: DataFrame, names: Sequence[str], radius: float, id: str = "id", strategy: str = "grid") -> DataFrame:
    """(a, b, distance) with a < b for each pair of points within ``radius``, once."""
    out = SpatialIndex(df, points(*names), id, strategy, 2 * radius).query(df, points(*names), within(radius), id, where=lambda q, v: q(id) < v(id))
    return out.select(F.col("query_id").alias("a"), F.col("value_id").alias("b"), "distance")


def expand_half_to_full(half: DataFrame) -> DataFrame:
    """Each pair in both orientations."""
    rest = [c for c in half.columns if c not in ("a", "b")]
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def full_neighbors(df: DataFrame, names: Sequence[str], radius: float, id: str = "id", strategy: str = "grid") -> DataFrame:
    """(a, b, distance) for each ordered pair of different points within ``radius``."""
    found = SpatialIndex(df, points(*names), id, strategy, 2 * radius).query(df, points(*names), within(radius), id, where=lambda q, v: q(id) != v(id))
    return found.select(F.col("query_id").alias("a"), F.col("value_id").alias("b"), "distance")


# -- results per query -------------------------------------------------------------------------------------------------


def counts(results: DataFrame, queries: DataFrame, id: str = "id") -> DataFrame:
    """(query_id, n) for every query, with 0 for those without results."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select(F.col(id).alias("query_id")).join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _in_ranges(df: DataFrame, name: str, order: str, rows: int | None = None) -> DataFrame:
    """``df``, written in ranges of ``order`` that hold about equally many rows (``rows`` if given), with the range as ``__p``.

    Borders come from Spark's sample of the column, so it doesn't matter how its values are spread. Rows of one value
    are in one range; callers see to it that there are few.
    """
    parts = [max(1, min(100_000, -(-df.count() // rows)))] if rows else []
    return materialize(df.repartitionByRange(*parts, order).withColumn("__p", F.spark_partition_id()), name)


def _of_range(numbers: dict[int, int | None]) -> Column:
    """The number of a row's range: a literal of one entry a range."""
    table = F.split(F.lit(",".join("" if (x := numbers.get(p)) is None else str(x) for p in range(max(numbers, default=0) + 1))), ",")
    return F.expr("CAST(NULL AS BIGINT)") if not numbers else F.nullif(F.element_at(table, F.col("__p") + 1), F.lit("")).cast("bigint")


def _sum_up_to(ranged: DataFrame, order: str, n: str, name: str) -> DataFrame:
    """``ranged`` with the sum of ``n`` up to and with each row; totals of ranges first, then sums within each range."""
    totals = {r["__p"]: r["t"] for r in ranged.groupBy("__p").agg(F.sum(n).alias("t")).collect()}  # one row a range
    before, total = {}, 0
    for p in sorted(totals):
        before[p], total = total, total + (totals[p] or 0)
    inside = F.sum(n).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn(name, inside + _of_range(before))


def offsets(counted: DataFrame, block: int | None = None) -> DataFrame:
    """(query_id, n, offset): the running total before each query, in order of query_id.

    Totals run over ranges of ids first and within each range then; ranges hold about equally many queries (``block``
    if given) however sparse the ids are, so no task holds all queries.
    """
    ranged = _in_ranges(counted.select("query_id", "n"), "counted", "query_id", block)
    return _sum_up_to(ranged, "query_id", "n", "__upto").select("query_id", "n", (F.col("__upto") - F.col("n")).alias("offset"))


def to_counts(crs: DataFrame, block: int | None = None) -> DataFrame:
    """Counts from offsets that end with the total (query_id, offset): the difference to the next.

    The next row of a range's last one is the first of the next range; ranges hold about equally many rows (``block``
    if given).
    """
    ranged = _in_ranges(crs, "offsets", "query_id", block)
    first = {r["__p"]: r["m"]["offset"] for r in ranged.groupBy("__p").agg(F.min(F.struct("query_id", "offset")).alias("m")).collect()}  # one row a range
    order = sorted(first)
    after = {p: first[q] for p, q in itertools.pairwise(order)} | {p: None for p in order[-1:]}
    inside = F.lead("offset").over(Window.partitionBy("__p").orderBy("query_id"))
    out = ranged.withColumn("n", F.coalesce(inside, _of_range(after)) - F.col("offset"))
    return out.where("n IS NOT NULL").drop("__p")


def bounded_counts(df: DataFrame, names: Sequence[str], radius: float, most: int, id: str = "id") -> DataFrame:
    """(id, n): how many points lie within ``radius`` of each point, itself included, up to ``most``.

    Points of a grid cell whose diagonal is within the radius and that holds ``most`` points need no pairs; only the
    others are counted.
    """
    h = radius / math.sqrt(len(names)) * (1 - 1e-12)
    cell = [f"__c{i}" for i in range(len(names))]
    placed = df.select(id, *names, *(F.floor(F.col(n) / F.lit(h)).alias(c) for n, c in zip(names, cell, strict=True)))
    full = placed.groupBy(*cell).agg(F.count("*").alias("__n")).where(F.col("__n") >= most).select(*cell)
    settled = placed.join(full, cell, "left_semi").select(id, F.lit(most).cast("long").alias("n"))
    others = placed.join(full, cell, "left_anti").select(id, *names)
    found = SpatialIndex(df.select(id, *names), points(*names), id, cell=2 * radius).query(others, points(*names), within(radius), id)
    return settled.unionByName(found.groupBy(F.col("query_id").alias(id)).agg(F.least(F.count("*"), F.lit(most)).alias("n")))


def to_crs(results: DataFrame, queries: DataFrame, id: str = "id", order: Sequence[str] = ("value_id",)) -> DataFrame:
    """(query_id, value_id, position): each result's position in the flat array of all queries' results."""
    start = offsets(counts(results, queries, id))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return results.withColumn("__place", place).join(start, "query_id").select("query_id", "value_id", (F.col("offset") + F.col("__place") - 1).alias("position"))


def at_most(results: DataFrame, n: int) -> DataFrame:
    """``results`` as they are; raises LimitExceeded if a query has more than ``n``."""
    if results.groupBy("query_id").count().where(F.col("count") > n).limit(1).count():
        raise LimitExceeded(f"a query has more than {n} results")
    return results


def first_matches(results: DataFrame, n: int, order: Sequence[str] = ("value_id",)) -> DataFrame:
    """At most ``n`` results of each query, the first by ``order``."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return results.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def with_match(queries: DataFrame, results: DataFrame, id: str = "id") -> DataFrame:
    """Queries that have a result."""
    return queries.join(results.select(F.col("query_id").alias(id)), id, "left_semi")


def without_match(queries: DataFrame, results: DataFrame, id: str = "id") -> DataFrame:
    """Queries that have none."""
    return queries.join(results.select(F.col("query_id").alias(id)), id, "left_anti")


def sort_by_key(df: DataFrame, key: Column | str, ascending: bool = True) -> DataFrame:
    """(index, key, place): rows of (index, ...) in order of ``key`` and index, with their place from 0, over range partitions."""
    key = F.col(key) if isinstance(key, str) else key
    keyed = df.select("index", key.alias("key"))
    order = [F.col("key").asc() if ascending else F.col("key").desc(), F.col("index").asc()]
    return attach_indices(keyed.repartitionByRange(*order).sortWithinPartitions(*order), "place")


def apply_permutation(permutation: DataFrame, values: DataFrame) -> DataFrame:
    """(place, ...): at each place of ``permutation`` (index, place) the values of its index; ``values`` has an index."""
    return permutation.select("index", "place").join(values, "index").drop("index")


def insertion_points(sorted_values: DataFrame, queries: DataFrame, value: str = "value", id: str = "id", block: int | None = None) -> DataFrame:
    """(query_id, lower, upper): how many of the values are below each query's value, and how many aren't above it.

    Equal values are counted first, and equal queries ask once; both sides are merged in ranges of about equally many
    different values (``block`` if given), whatever outliers there are, so no task holds all of them.
    """
    known = sorted_values.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    asked = queries.select(F.col(value).alias("x"), F.lit(0).cast("long").alias("n"))
    merged = known.unionByName(asked).where("x IS NOT NULL").groupBy("x").agg(F.sum("n").alias("n"))
    found = _sum_up_to(_in_ranges(merged, "merged", "x", block), "x", "n", "upper")
    met = splittable_join(queries.select(F.col(id).cast("long").alias("query_id"), F.col(value).alias("x")), found.select("x", "n", "upper"), "x")
    return met.select("query_id", (F.col("upper") - F.col("n")).alias("lower"), "upper")


def attach_indices(df: DataFrame, name: str = "index") -> DataFrame:
    """``df`` with contiguous numbers from 0 in its present order; only the counts of partitions reach the driver.

    The rows are numbered in a written table, so one evaluation gives both the counts and the numbers.
    """
    marked = materialize(df.withColumn("__m", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("__m", 33)
    sizes = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = F.split(F.lit(",".join(str(starts.get(p, 0)) for p in range(max(starts) + 1))), ",").cast("array<bigint>")
    return marked.withColumn(name, F.element_at(table, (part + 1).cast("int")) + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")


def along_curve(df: DataFrame, code: Column, partitions: int | None = None) -> DataFrame:
    """``df`` in order of a space-filling curve: range-partitioned and sorted, so that near rows share files and row groups."""
    out = df.withColumn("__code", code)
    out = out.repartitionByRange(partitions, "__code") if partitions else out.repartitionByRange("__code")
    return out.sortWithinPartitions("__code").drop("__code")


class StoredIndex(SpatialIndex):
    """Values written once along a Morton curve with their boxes, to be queried many times.

    Near values share files and row groups, whose statistics bound the boxes, so a query whose geometries lie in a small
    region reads only the files and row groups there: the region enters the scan as a filter that Parquet is pruned by.
    Nearest queries and rays, which have no region, read the whole table.
    """

    def __init__(self, spark: SparkSession, path: str, shape: Shape, id: str = "id", cell: float | None = None):
        self.table = spark.read.parquet(path)
        self.axes = sum(c.startswith("__lo") for c in self.table.columns)
        super().__init__(self.table.drop(*self._ends()), shape, id, "grid", cell)

    def _ends(self) -> list[str]:
        return [f"__{side}{i}" for side in ("lo", "hi") for i in range(self.axes)]

    @staticmethod
    def write(df: DataFrame, shape: Shape, path: str, partitions: int | None = None, group_bytes: int = 8 << 20) -> None:
        """Write ``df`` as Parquet, in ``partitions`` files (Spark's number if not given) of row groups of ``group_bytes``."""
        box = G.bounds(shape(F.col))
        whole = extent(df, shape).first()
        scene = G.Box.of(*([0.0 if whole[f"lo_{i}"] > whole[f"hi_{i}"] else whole[f"{side}_{i}"] for i in range(box.dim)] for side in ("lo", "hi")))
        code = morton64(G.centroid(shape(F.col)), scene)
        ends = {f"__{side}{i}": c for side, cs in (("lo", box.lo), ("hi", box.hi)) for i, c in enumerate(cs[:AXES])}
        along_curve(df.withColumns(ends), code, partitions).write.option("parquet.block.size", group_bytes).option("compression", "zstd").parquet(path)

    def inside(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        """The values whose box meets the box ``lo`` to ``hi``."""
        meets = [(F.col(f"__lo{i}") <= F.lit(float(y))) & (F.col(f"__hi{i}") >= F.lit(float(x))) for i, (x, y) in enumerate(zip(lo[: self.axes], hi[: self.axes], strict=True))]
        return self.table.where(G._all(meets)).drop(*self._ends())

    def query(self, queries: DataFrame, shape: Shape, predicate: Predicate, *args, **more) -> DataFrame:
        g = shape(F.col)
        if predicate.kind == "nearest" or isinstance(g, G.Ray) or more.get("metric") is not None:
            return super().query(queries, shape, predicate, *args, **more)
        reach = F.lit(0.0) if predicate.kind != "within" else (F.col(predicate.radius) if isinstance(predicate.radius, str) else F.lit(float(predicate.radius)))
        box = G.bounds(g)
        r = queries.agg(*(F.min(x - reach * PAD) for x in box.lo[: self.axes]), *(F.max(x + reach * PAD) for x in box.hi[: self.axes])).first()
        lo, hi = list(r)[: self.axes], list(r)[self.axes :]
        values = self.inside(lo, hi) if all(x is not None for x in r) else self.df.limit(0)
        return SpatialIndex(values, self.shape, self.id, "grid", self.cell).query(queries, shape, predicate, *args, **more)


def pair_sums(df: DataFrame, names: Sequence[str], radius: float, terms: dict[str, Callable], least: float = 0.0, id: str = "id") -> DataFrame:
    """(id, n, each term): for each point with others farther than ``least`` and within ``radius``, how many, and sums over them.

    ``terms`` maps a name to a function of the distance and of the coordinates of the point and the other one (functions of
    the axis), written in :mod:`arrays`. Where blocks are compared, a task adds up the pairs of two blocks as it finds them,
    so that rows grow with the points and blocks and not with the pairs.
    """
    own, other = (df.select(F.col(id).alias(f"{side}_id"), *(F.col(n).cast("double").alias(f"{side}_{n}") for n in names)) for side in "ab")
    a, b = ([f"{side}_{n}" for n in names] for side in "ab")
    axes, numeric = min(AXES, len(names)), own.schema["a_id"].dataType.typeName() in blocks.NUMERIC
    place, value = G.Point.of(*map(F.col, a)), G.Point.of(*map(F.col, b))
    fit = blocks.regular(place) & F.col("a_id").isNotNull()
    r = own.agg(F.count("*"), F.count_if(fit), *(F.max(x) - F.min(x) for x in a[:axes])).first()
    if numeric and r[0] and r[0] == r[1] and math.prod(max(1.0, x / (2 * radius)) for x in r[2:]) <= COARSE:
        box = lambda g: G.Box(G.bounds(g).lo[:axes], G.bounds(g).hi[:axes])
        asked = blocks.Asked("within", float(radius), True, least=float(least), terms=terms)
        met = blocks.block_pairs(own, other, place, value, box(G.grow(place, F.lit(float(radius)) * PAD)), box(value), F.col("a_id"), F.col("b_id"), [["a_id"], ["b_id"]], asked, [r[0], r[0]])
        return met.groupBy(F.col("a_id").alias(id)).agg(F.sum("__n").alias("n"), *(F.sum(t).alias(t) for t in terms))
    met = SpatialIndex(other, points(*b), "b_id", cell=2 * radius).query(own, points(*a), within(radius), "a_id", keep=a, keep_values=b, where=lambda q, v: q("a_id") != v("b_id"))
    met = met.where(F.col("distance") > F.lit(float(least)))
    summed = [F.sum(f(F.col("distance"), lambda k: F.col(a[k]), lambda k: F.col(b[k]))).alias(t) for t, f in terms.items()]
    return met.groupBy(F.col("query_id").alias(id)).agg(F.count("*").alias("n"), *summed)


def pair_forces(df: DataFrame, names: Sequence[str], cutoff: float, sigma: float = 1.0, epsilon: float = 1.0, least: float = 0.0, id: str = "id") -> DataFrame:
    """(id, energy, force_<axis>): half the Lennard-Jones energy of each point's pairs, and the force on it.

    Each point sums over its own pairs, farther apart than ``least`` and up to ``cutoff``, as they are found.
    """

    def third(d):
        s = arrays.try_divide(arrays.lit(float(sigma) ** 2), d * d)
        return s * s * s

    def energy(d, a, b):
        s = third(d)
        return arrays.lit(2.0 * epsilon) * (s * s - s)

    def force(k: int) -> Callable:
        def f(d, a, b):
            s = third(d)
            return arrays.try_divide(arrays.lit(24.0 * epsilon) * (arrays.lit(2.0) * s * s - s), d * d) * (a(k) - b(k))

        return f

    terms = {"energy": energy} | {f"force_{n}": force(k) for k, n in enumerate(names)}
    return pair_sums(df, names, cutoff, terms, least, id).drop("n")


def energy_deposit(index: SpatialIndex, rays: DataFrame, shape: Shape, start: float = 1.0, gain: bool = True, id: str = "id") -> DataFrame:
    """(value_id, deposit): what rays of energy ``start`` leave in the values that they cross, in the order of crossing.

    Crossing a length L deposits energy * (1 - exp(-L)), which the ray gains, or loses with ``gain`` off. The product
    of the factors before a crossing is a running sum of logarithms. Where rays cross a good part of all values, they are
    taken in rounds, of which only sums are kept, so that the crossings that lie on disk grow with the rows.
    """
    rounds, sums = index.ray_rounds(rays, shape), []
    if rounds == 1:
        return _deposits(index, rays, shape, start, gain, id)
    for k in range(rounds):
        some = rays.where(F.pmod(F.xxhash64(id), F.lit(rounds)) == k)
        sums.append(materialize(_deposits(index, some, shape, start, gain, id), "deposits"))
        gc.collect()
        rays.sparkSession.sparkContext._jvm.System.gc()  # lets Spark drop the round's shuffle files
    return functools.reduce(DataFrame.unionByName, sums).groupBy("value_id").agg(F.sum("deposit").alias("deposit"))


def _deposits(index: SpatialIndex, rays: DataFrame, shape: Shape, start: float, gain: bool, id: str) -> DataFrame:
    met = index.ray_hits(rays, shape, id)
    factor = F.lit(2.0) - F.exp(-F.col("length")) if gain else F.exp(-F.col("length"))
    before = Window.partitionBy("query_id").orderBy("distance", "value_id").rowsBetween(Window.unboundedPreceding, -1)
    energy = F.exp(F.coalesce(F.sum(F.ln(factor)).over(before), F.lit(0.0))) * start
    met = met.withColumn("__deposit", energy * (F.lit(1.0) - F.exp(-F.col("length"))))
    return met.groupBy("value_id").agg(F.sum("__deposit").alias("deposit"))
